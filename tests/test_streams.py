"""Stateful streams against batch results: arrival in any order, late rows, restarts, redelivery; sketches against exact ranks."""

import random
from datetime import datetime, timedelta

import pytest

from scriptorium.functions.splitter import fixed_split
from scriptorium.operators import chunking as C
from scriptorium.operators import graph as G
from scriptorium.streaming import ingest, monitoring, sessions

START = datetime(2024, 3, 1)
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def some_events(seed=1, users=7, n=260):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        rows.append((k, START + timedelta(seconds=rng.randrange(86_400)), rng.randrange(users), rng.choice(["view", "error"]), rng.random()))
    rows.append((n, rows[0][1], rows[0][2], None, None))
    # exactly a gap apart, and just over it
    rows += [(n + 1, START, 99, "view", 1.0), (n + 2, START + timedelta(minutes=30), 99, "view", 1.0), (n + 3, START + timedelta(minutes=60, seconds=1), 99, "error", 1.0)]
    rows += [(n + 4, None, 3, "view", 1.0), (n + 5, START, None, "view", 1.0)]
    return rows


def run(spark, folder, name, late):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = sessions.stateful_sessions(stream, 30, late).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drop_in(spark, folder, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def closing(k, days):
    """A request far ahead: it lets the watermark pass all that came before."""
    return (10_000 + k, START + timedelta(days=days), 1000, "view", 1.0)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stateful_sessions_equal_batch_in_any_order_and_over_a_restart(spark, tmp_path):
    rows = some_events()
    random.Random(3).shuffle(rows)
    folder = str(tmp_path)
    drop_in(spark, folder, rows[:120])
    run(spark, folder, "s1", "2 days")
    drop_in(spark, folder, rows[120:])
    drop_in(spark, folder, [closing(0, 9)])
    query = run(spark, folder, "s2", "2 days")  # goes on where the first one ended
    got = sorted(map(tuple, spark.read.schema(sessions.SESSIONS).parquet(f"{folder}/out").collect()))
    batch = monitoring.sessions(spark.createDataFrame(rows, EVENT).where("ts is not null and user_id is not null"))
    assert got == sorted(map(tuple, batch.select("user_id", "session_start", "session_end", "requests", "errors").collect()))
    assert len(got) > 100 and max(r[3] for r in got) > 1 and sum(r[0] == 99 for r in got) == 2
    assert sessions.dropped_rows(query) == 0
    assert sessions.state_rows(query)[-1] < max(sessions.state_rows(query))  # what is over leaves the store


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    folder = str(tmp_path)
    first = [(k, START + timedelta(hours=5, minutes=k), 1, "view", 1.0) for k in range(3)]
    drop_in(spark, folder, first)
    run(spark, folder, "l1", "10 minutes")
    drop_in(spark, folder, [(50, START, 1, "view", 1.0), (51, START, 2, "view", 1.0), (52, START + timedelta(hours=5, minutes=4), 1, "error", 1.0), closing(0, 2)])
    query = run(spark, folder, "l2", "10 minutes")
    got = sorted(map(tuple, spark.read.schema(sessions.SESSIONS).parquet(f"{folder}/out").collect()))
    assert got == [(1, "2024-03-01 05:00:00", "2024-03-01 05:34:00", 4, 1)]
    assert sessions.dropped_rows(query) == 2


def test_merged_sessions():
    assert sessions.merged([(20, 20, 1, 0), (0, 0, 1, 1), (9, 9, 1, 0)], 10) == [(0, 9, 2, 1), (20, 20, 1, 0)]
    assert sessions.merged([(0, 0, 1, 0), (10, 10, 1, 0)], 10) == [(0, 10, 2, 0)]
    assert sessions.merged([(0, 50, 3, 0), (10, 20, 1, 1)], 5) == [(0, 50, 4, 1)]


PAGE = "source string, page string, raw_text string, arrived timestamp"


def page_rows(hour, names):
    return [(name, str(p), f"Ada Lovelace met Charles Babbage of {name} on page {p}. They wrote to Mary Somerville.", START + timedelta(hours=hour)) for name in names for p in range(3)]


def test_redelivered_pages_are_kept_out_and_their_hashes_go(spark, tmp_path):
    folder = str(tmp_path)
    to_chunks = lambda df: C.process_pages(df.select("source", "page", "raw_text"), fixed_split)
    to_edges = lambda df: G.build_edges(G.capitalised_mentions(df))

    def deliver(rows):
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = ingest.ingest(stream, f"file://{folder}/out", to_chunks, to_edges, redelivery="2 hours", arrived="arrived")
        query.awaitTermination()
        edges = ingest.VersionedTable(spark, f"file://{folder}/out/edges", ingest.EDGES).newest().count()
        return edges, sessions.state_rows(query)

    first = page_rows(0, ["a.pdf", "b.pdf"])
    once = to_edges(to_chunks(spark.createDataFrame(first, PAGE))).count()
    assert once > 20
    assert deliver(first + first)[0] == once  # twice in one batch
    assert deliver(page_rows(1, ["a.pdf"]))[0] == once  # and in another
    more, _ = deliver(page_rows(1, ["c.pdf"]))
    assert more == once * 3 // 2
    _, kept = deliver(page_rows(30, ["d.pdf"]))
    _, later = deliver(page_rows(60, ["e.pdf"]))
    assert later[-1] <= 6 < 15  # 15 pages came in all; the hashes of old ones are gone
    assert kept[-1] <= 12


def test_merged_quantiles_are_within_the_rank_error(spark):
    rng = random.Random(9)
    rows = [(k, START + timedelta(seconds=rng.randrange(7200)), 1, "view", rng.choice([rng.random(), rng.expovariate(0.01), 5.0])) for k in range(30_000)]
    rows += [(99_999, START + timedelta(hours=30), 1, "view", None)]
    events = spark.createDataFrame(rows, EVENT).repartition(5)
    got = {r.window_start: r for r in monitoring.merged_panels(monitoring.minute_sketches(events)).collect()}
    assert got["2024-03-02 06:00:00"].p95 is None and got["2024-03-02 06:00:00"].requests == 1
    for hour in (0, 1):
        values = sorted(v for _, ts, _, _, v in rows if v is not None and ts.hour == hour and ts.day == 1)
        p95 = got[f"2024-03-01 0{hour}:00:00"].p95
        low, high = sum(v < p95 for v in values) / len(values), sum(v <= p95 for v in values) / len(values)
        assert low - 0.0035 <= 0.95 <= high + 0.0035


def test_stream_of_minutes_equals_table(spark, tmp_path):
    folder = str(tmp_path)
    rows = [r for r in some_events() if r[1] is not None]
    drop_in(spark, folder, rows)
    stream = spark.readStream.schema(EVENT).parquet(f"{folder}/in")
    query = monitoring.minute_sketches(stream, late="1 day").drop("sketch").writeStream.format("memory").queryName("minutes").outputMode("complete").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = monitoring.minute_sketches(spark.createDataFrame(rows, EVENT)).drop("sketch")
    assert sorted(map(tuple, spark.table("minutes").collect())) == sorted(map(tuple, batch.collect()))


def test_uptime_islands(spark):
    at = lambda minute, kind="view": (minute, START + timedelta(minutes=minute), 1, kind, 1.0)
    rows = [at(m) for m in (1430, 1431, 1433, 1439, 1440, 1441, 1500, 4500)] + [at(1435, "error"), at(1431, "error"), at(1470, "error")]
    minutes = monitoring.minute_sketches(spark.createDataFrame(rows, EVENT))
    got = sorted(map(tuple, monitoring.uptime_islands(minutes).collect()))
    assert got == [
        ("2024-03-01 23:50:00", "2024-03-01 23:54:00", 3, None),
        ("2024-03-01 23:59:00", "2024-03-02 00:02:00", 3, 5),
        ("2024-03-02 01:00:00", "2024-03-02 01:01:00", 1, 58),
        ("2024-03-04 03:00:00", "2024-03-04 03:01:00", 1, 2999),
    ]
    assert {r.day: (r.up_minutes, r.seen_minutes) for r in monitoring.uptime(minutes).collect()}["2024-03-02"] == (3, 1440)
