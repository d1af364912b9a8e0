"""Request monitoring over an event log, the same for a table and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.exact import exact_mean, exact_share


def timed(events: DataFrame) -> DataFrame:
    """ts as a timestamp with a zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def panels(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """window_start, requests, errors, error_rate, mean_latency, max_latency by tumbling window; `late` sets a watermark."""
    rows = timed(events)
    if late:
        rows = rows.withWatermark("ts", late)
    grouped = rows.groupBy(F.window("ts", width))
    out = grouped.agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), exact_mean(F.col("value"), 6).alias("mean_latency"), F.max("value").alias("max_latency"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", "errors", exact_share(F.col("errors"), F.col("requests")).alias("error_rate"), "mean_latency", "max_latency")


def latency_p95(events: DataFrame, width: str = "1 hour", approx: bool = False, late: str | None = None) -> DataFrame:
    """95th percentile of a window. Exact, a window's distinct values are counted in one buffer; approx (to a ten-thousandth of the
    ranks) has a state of bounded size, which a stream and windows of very many requests need. `late` sets a watermark."""
    rows = timed(events)
    if late:
        rows = rows.withWatermark("ts", late)
    value = F.percentile_approx("value", 0.95, 10_000).cast("double") if approx else F.percentile("value", F.lit(0.95))
    rows = rows.groupBy(F.window("ts", width)).agg(value.alias("p95"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.round("p95", 6).alias("p95"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, session_start, session_end, requests, errors: runs of a user's requests with no pause of more than `gap`."""
    rows = timed(events)
    if late:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("user_id", shown("session_window.start").alias("session_start"), shown("session_window.end").alias("session_end"), "requests", "errors")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str | None = None) -> DataFrame:
    """window_start, requests, errors over windows that overlap."""
    rows = timed(events)
    if late:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", "errors")


#: Upper borders of the latency histogram; the last bucket has none.
BORDERS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)
#: The sketch's size: 200 gives ranks within 1.65 % (99 % of the time), 1,600 within 0.23 %.
SKETCH_SIZE = 1600


def minute_sketches(events: DataFrame, late: str | None = None, k: int = SKETCH_SIZE) -> DataFrame:
    """minute, requests, errors, sketch (of latencies, of bounded size), le_0 .. : requests up to each border, counted cumulatively.

    Every column can be merged into longer spans: counts add up and sketches merge, so minutes are stored once and hours, days and
    weeks are made from them without the requests. Rows without a latency count as requests and are in no bucket.
    """
    rows = timed(events)
    if late:
        rows = rows.withWatermark("ts", late)
    up_to = [F.count_if(F.col("value") <= b).alias(f"le_{i}") for i, b in enumerate(BORDERS)]
    sketch = F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(k)).alias("sketch")
    grouped = rows.groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("value").alias("timed"), sketch, *up_to)
    return grouped.select(F.col("window.start").alias("minute"), "requests", "errors", "timed", "sketch", *[f"le_{i}" for i in range(len(BORDERS))])


def merged_panels(minutes: DataFrame, width: str = "1 hour") -> DataFrame:
    """window_start, requests, errors, error_rate, p95 (within the sketch's rank error), from the minutes alone; a window without latencies has p95 null."""
    whole = minutes.groupBy(F.window("minute", width)).agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.sum("timed").alias("timed"), F.kll_merge_agg_double("sketch").alias("sketch"))
    p95 = F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.95)))
    return whole.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", "errors", exact_share(F.col("errors"), F.col("requests")).alias("error_rate"), p95.alias("p95"))


def merged_histogram(minutes: DataFrame, width: str = "1 hour") -> DataFrame:
    """window_start, le (the border, null for the last bucket), requests: a cumulative histogram of latencies, from the minutes alone."""
    whole = minutes.groupBy(F.window("minute", width)).agg(*[F.sum(f"le_{i}").alias(f"le_{i}") for i in range(len(BORDERS))], F.sum("timed").alias("timed"))
    pairs = [F.struct(F.lit(b).alias("le"), F.col(f"le_{i}").alias("requests")) for i, b in enumerate(BORDERS)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("timed").alias("requests"))]
    return whole.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.explode(F.array(*pairs)).alias("b")).select("window_start", "b.le", "b.requests")


def uptime_islands(minutes: DataFrame, silence: int = 1) -> DataFrame:
    """up_from, up_to, minutes, down_before: runs of minutes in which the service answered, and how many minutes it was down before each.

    A minute is up if a request in it did not fail. Pauses of up to `silence` minutes don't end a run. Gaps and islands: the minutes are
    few (1,440 a day, however many requests), and are gone through day by day; runs over midnight are joined by the days' ends.
    """
    up = minutes.where("requests > errors").select(F.floor(F.unix_seconds("minute") / 60).alias("m")).distinct().withColumn("day", F.floor(F.col("m") / 1440))
    ends = up.groupBy("day").agg(F.max("m").alias("last"))
    # a row a day: the newest end of the days before
    earlier = ends.select("day", F.max("last").over(W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, -1)).alias("earlier"))
    order = W.partitionBy("day").orderBy("m")
    before = F.coalesce(F.lag("m").over(order), F.col("earlier"))
    marked = up.join(earlier, "day").withColumn("before", before).withColumn("starts", F.col("before").isNull() | (F.col("m") - F.col("before") > 1 + silence))
    # an island's minutes within a day share its number; the day's first island goes on if its first minute starts nothing
    own = marked.withColumn("island", F.sum(F.col("starts").cast("int")).over(order))
    parts = own.groupBy("day", "island").agg(F.min("m").alias("first"), F.max("m").alias("last"), F.count("*").alias("minutes"), F.max_by("before", F.when(F.col("starts"), 1)).alias("before"), F.max("starts").alias("starts"))
    # islands are few; their parts are joined along time
    joined = parts.withColumn("nth", F.sum(F.col("starts").cast("int")).over(W.partitionBy(F.lit(0)).orderBy("first")))
    whole = joined.groupBy("nth").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("minutes").alias("minutes"), F.min_by("before", "first").alias("before"))
    clock = lambda m: F.date_format(F.timestamp_seconds(m * 60), "yyyy-MM-dd HH:mm:ss")
    return whole.select(clock(F.col("first")).alias("up_from"), clock(F.col("last") + 1).alias("up_to"), "minutes", (F.col("first") - F.col("before") - 1).alias("down_before"))


def uptime(minutes: DataFrame) -> DataFrame:
    """day, up_minutes, seen_minutes, uptime: of the minutes of a day between the first and the last request of the log, the share that was up."""
    m = F.floor(F.unix_seconds("minute") / 60)
    seen = minutes.groupBy(m.alias("m")).agg(F.max((F.col("requests") > F.col("errors")).cast("int")).alias("up"))
    span = seen.agg(F.min("m").alias("low"), F.max("m").alias("high"))
    days = seen.groupBy(F.floor(F.col("m") / 1440).alias("day")).agg(F.sum("up").alias("up_minutes")).join(F.broadcast(span), F.lit(True))
    length = F.least(F.col("high"), F.col("day") * 1440 + 1439) - F.greatest(F.col("low"), F.col("day") * 1440) + 1
    return days.select(F.date_format(F.timestamp_seconds(F.col("day") * 86_400), "yyyy-MM-dd").alias("day"), "up_minutes", length.alias("seen_minutes"), exact_share(F.col("up_minutes"), length).alias("uptime"))
