"""Filter interaction audit: what each filter removes at each place of each order, from one cube over failure flags.

Every document gets five flags and its part. Documents are counted by flags and part first, so the SQL CUBE runs over at most 128
rows a part. A row of a grouping set whose flags are all false counts the documents that pass the filters of that set: the
survivors of a subset. A step of an order is a pair of subsets, the filters before it and those up to it, and is a join of two such rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import columns_only, saved, scratch
from scriptorium.llm.components import join_groups

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 2
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """The conditions that hang on the text alone: too short, too repetitive, too many capitals, odd signs."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT_PERCENT * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, part, digest of the text, flags A to D, good and toxic (0 or 1); no text goes on from here."""
    text = F.coalesce("text", F.lit(""))
    own = columns_only(docs, "doc_id", "source", "text").select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[c.alias(name) for name, c in text_flags(text).items()])
    mark = lambda name: F.max((F.coalesce(F.col(name), F.lit(0)) == 1).cast("long"))
    marks = columns_only(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(mark("quality").alias("good"), mark("toxic").alias("toxic"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return own.join(marks.where("doc_id is not null"), "doc_id", "left").select("doc_id", "part", "digest", *"ABCD", zero("good"), zero("toxic"))


def cells(rows: DataFrame) -> DataFrame:
    """part, A to E, n, good, toxic: documents counted by flags. rows: a written table of flagged().

    E fails where another row of the same text has a smaller doc_id. Those are found by a join with the least id of each text that
    occurs more than once, and moved from E's false to its true side: no text's rows are gathered.
    """
    key = ["part", *"ABCD", "E"]
    total = rows.count()
    sums = [F.sum(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("size")).where("size > 1 and first_id is not null")
    copies = join_groups(rows, saved(first, "first-ids"), ["digest"], total).where("doc_id > first_id")
    late = copies.groupBy("part", *"ABCD").agg(*sums)
    everything = rows.groupBy("part", *"ABCD").agg(*sums).withColumn("E", F.lit(False))
    moved = late.withColumn("E", F.lit(True)).unionByName(late.select("part", *"ABCD", *[(-F.col(c)).alias(c) for c in COUNTS], F.lit(False).alias("E")))
    return everything.unionByName(moved).groupBy(*key).agg(*[F.sum(c).alias(c) for c in COUNTS])


def survivors(counted: DataFrame) -> DataFrame:
    """part, subset (a bit for each filter, A the lowest), n, good, toxic: the documents that pass all filters of the subset.

    Zeros are included: every part has a row for each of the 32 subsets.
    """
    subset = sum((F.when(F.grouping(f) == 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(FILTERS)), F.lit(0)).alias("subset")
    cube = counted.cube(*FILTERS, "part").agg(subset, F.grouping("part").alias("all_parts"), *[F.sum(c).alias(c) for c in COUNTS])
    passing = cube.where("all_parts = 0").where(" and ".join(f"coalesce({f}, false) = false" for f in FILTERS)).select("part", "subset", *COUNTS)
    grid = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("subset"))
    return grid.join(passing, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def orders(df: DataFrame) -> DataFrame:
    """The 600 steps of all orders: filter_order, step, filter, before and after (subsets), bit (the filter's own subset)."""
    rows = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            rows.append(("".join(order), step, f, before, before | bit, bit))
            before |= bit
    return df.sparkSession.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int, bit int")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents (doc_id, source, text) and labels (doc_id, quality, toxic) -> one row for each part, order of filters, and step:
    part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text: empty, however long texts are they are judged whole. Null source: the part ''. A row without doc_id has no smaller id and
    is none: it never fails E. Rows that repeat a doc_id and text don't fail E by each other. A document is good or toxic if any of its labels says so,
    null labels count as 0. An empty table gives an empty result. Further columns, whatever their names, are not read.
    """
    with scratch(docs.sparkSession) as kept:
        rows = saved(flagged(docs, labels), "flags")
        return saved(_steps(saved(survivors(cells(rows)), "subsets")), "interactions", keep=kept)


def _steps(subsets: DataFrame) -> DataFrame:
    everything = (1 << len(FILTERS)) - 1
    of = lambda name: subsets.select("part", F.col("subset").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in COUNTS])
    step = F.broadcast(orders(subsets))  # 600 rows
    pairs = of("before").join(step, "before").join(of("after"), ["part", "after"])
    alone = of("bit").select("part", "bit", F.col("bit_n").alias("passing"))
    others = of("others").select("part", (F.lit(everything) - F.col("others")).alias("bit"), F.col("others_n"))
    ends = subsets.groupBy("part").agg(F.max(F.when(F.col("subset") == 0, F.col("n"))).alias("total"), F.max(F.when(F.col("subset") == everything, F.col("n"))).alias("clean"))
    per = alone.join(others, ["part", "bit"]).join(ends, "part")
    found = pairs.join(per, ["part", "bit"]).withColumn("removed", F.col("before_n") - F.col("after_n"))
    shares = found.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return found.join(shares, ["part", "filter"]).select(
        "part", "filter_order", "step", "filter", F.col("after_n").alias("kept"), "removed",
        (F.col("total") - F.col("passing") - F.col("removed")).alias("redundant"), (F.col("others_n") - F.col("clean")).alias("unique_fails"),
        (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"), "shapley",
    )


ORACLE = r"""
WITH base AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM base GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * len(regexp_extract_all(base.t, '[A-Z]')) > 2 * length(base.t) AS c,
    regexp_matches(base.t, '[#$%&*|]') AS d, coalesce(base.doc_id > first_id, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM base JOIN firsts ON base.t = firsts.t LEFT JOIN marks ON base.doc_id = marks.doc_id),
counted AS (SELECT part, [a, b, c, d, e] AS f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
perms AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT p, array_to_string(list_transform(p, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, s.i AS step, p[s.i] AS own, p[1:s.i - 1] AS earlier FROM perms, l s),
found AS (
  SELECT part, filter_order, step, substr('ABCDE', own, 1) AS filter,
    coalesce(sum(n) FILTER (NOT gone AND NOT f[own]), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND f[own]), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND f[own]), 0) AS redundant, coalesce(sum(n) FILTER (f[own] AND len(list_filter(f, lambda x: x)) = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND f[own]), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND f[own]), 0) AS toxic_lost
  FROM (SELECT *, len(list_filter(earlier, lambda i: f[i])) > 0 AS gone FROM counted, steps)
  GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM found
"""
