"""Mixing sources to target weights: DataFrame functions only.

Words per source are aggregated, targets are filled up by weight under a cap of three times a source's size, and each document
is taken floor(rate) times plus once more with probability equal to the fraction, by a hash of its id and a seed.

A hash has DRAWS places from which a draw can be read. Each source reads all its documents' draws from one of them, the one
whose total comes nearest to the target, so a source of a few documents comes near it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.common import columns_only, saved, scratch

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
DRAWS = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size) rows -> source, source_size, target. Sources by code point, null last, take the weights in turn.

    All sizes are shared by weight; targets stop at `most` times their source's size, and the excess is shared again.
    In ascending order of size by weight the stopped sources come first, so one pass of prefix sums finds them.
    The windows run over one row a source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    ranked = sums.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(place - 1, F.lit(len(weights))).cast("int") + 1).cast("long"))
    everywhere, order = W.orderBy(F.lit(0)), W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = everywhere.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    left = F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), zero)
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)
    marked = ranked.withColumn("full", most * F.col("source_size") * rest <= F.col("weight") * left)
    open_size = F.sum("source_size").over(whole) - most * F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(whole)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise((F.col("weight") * open_size).cast("double") / open_weight)
    return marked.select("source", "source_size", target.alias("target"))


def id_hash(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def draw(hashed: Column, place: Column) -> Column:
    """A number in [0, 1): twelve of the hash's 32 digits from a place on."""
    return F.conv(F.substr(hashed, place + 1, F.lit(12)), 16, 10).cast("double") / float(1 << 48)


def copies(hashed: Column, place: Column, rate: Column) -> Column:
    return (F.floor(rate) + (draw(hashed, place) < rate - F.floor(rate)).cast("long")).cast("long")


def mix_plan(docs: DataFrame, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size of every document; mix_source, mix_source_size, mix_target, mix_rate, mix_place of every source).

    Texts are read once; both tables are written. So the size of the second is known when it is joined: Spark broadcasts it
    below spark.sql.autoBroadcastJoinThreshold and else shuffles, where AQE splits a hot source.
    """
    sized = saved(columns_only(docs, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sized.select("source", "size")).select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    targets = saved(targets.withColumn("mix_rate", rate), "targets")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("h", id_hash(F.col("doc_id"), seed))
    totals = joined.groupBy("mix_source", "mix_source_size", "mix_target", "mix_rate").agg(*[F.sum(F.col("size") * copies(F.col("h"), F.lit(k), F.col("mix_rate"))).alias(f"t{k}") for k in range(DRAWS)])
    miss = [F.abs(F.col(f"t{k}").cast("double") - F.col("mix_target")) for k in range(DRAWS)]
    place = (F.array_position(F.array(*miss), F.least(*miss)) - 1).cast("int")
    return sized, saved(totals.select("mix_source", "mix_source_size", "mix_target", "mix_rate", place.alias("mix_place")), "places")


def mix_report(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target (its source's), taken (size times copies), copies.

    Null text: size 0. Null source: a source of its own, the last. A source without words has target 0 and no copies.
    Null doc_id draws as the empty id; repeated rows draw alike and each count. Very long texts are counted whole. An empty table gives
    an empty result. Further columns, whatever their names, are not read.
    """
    with scratch(docs.sparkSession) as kept:
        sized, sources = mix_plan(docs, seed)
        rows = sized.join(sources, F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("copies", copies(id_hash(F.col("doc_id"), seed), F.col("mix_place"), F.col("mix_rate")))
        out = rows.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies")
        return saved(out, "mixed", keep=kept)


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns, whatever their names.

    Nulls, empty texts, repeated rows and empty tables are as in mix_report: a null text or a source without words is not taken,
    a null source is a source, rows without a doc_id draw alike. Very long texts are counted whole.
    """
    with scratch(docs.sparkSession) as kept:
        _, sources = mix_plan(docs, seed)
        sources = saved(sources, "sources", keep=kept)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row")  # so no name of theirs meets one of the plan's
    rows = docs.select(row).join(sources, F.col("mix_row.source").eqNullSafe(F.col("mix_source")))
    rows = rows.withColumn("mix_copies", copies(id_hash(F.col("mix_row.doc_id"), seed), F.col("mix_place"), F.col("mix_rate")))
    rows = rows.where("mix_copies > 0").select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return rows.select(*[F.col(f"mix_row.`{c}`").alias(c) for c in docs.columns])


MIX_CTES = r"""
sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM sums),
marked AS (
  SELECT *, 3 * source_size * (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))
         <= weight * (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0)) AS is_full
  FROM ranked WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE
    (weight * (sum(source_size) OVER () - 3 * sum(CASE WHEN is_full THEN source_size ELSE 0 END) OVER ()))::DOUBLE
    / (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ()) END AS target
  FROM marked),
rated AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
drawn AS (
  SELECT *, k, floor(rate)::BIGINT + (('0x' || substr(h, k + 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE < rate - floor(rate))::BIGINT AS copies
  FROM rated, range(20) t(k)),
missed AS (SELECT source, k, abs(sum(size * copies)::DOUBLE - target) AS miss FROM drawn GROUP BY source, target, k),
chosen AS (SELECT source, k FROM missed QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, k) = 1)
"""

ORACLE = f"""
WITH {MIX_CTES.format(docs="documents")}
SELECT doc_id, size, source_size, target, size * copies AS taken, copies
FROM drawn d JOIN chosen c ON d.k = c.k AND d.source IS NOT DISTINCT FROM c.source
"""
