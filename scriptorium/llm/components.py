"""Connected components of a table of links, by alternating large-star and small-star rounds over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import saved


#: At most so many keys are broadcast to be joined where their rows lie.
HOT_GROUPS = 10_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one batch: a star (smallest member, member) for each tree, so long chains shrink at once."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        stars = [(root(x), x) for x in parent]
        stars = [(a, x) for a, x in stars if a != x]
        yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in stars], pa.int64()), pa.array([s[1] for s in stars], pa.int64())], names=["a", "b"])


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], total: int) -> DataFrame:
    """rows joined to groups, which have one row a key and the key's `size`, the number of its rows; total: of all rows.

    Keys with more than one in HOT_GROUPS of all rows, HOT_GROUPS of them at most, are broadcast, so their rows are not dealt by key.
    """
    hot = F.broadcast(groups.where(F.col("size") * HOT_GROUPS > total))
    cold = groups.where(F.col("size") * HOT_GROUPS <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(cold, key))


def _with_least(both: DataFrame, total: int) -> DataFrame:
    """(u, v) with m, the least of u and all its v; total bounds the number of rows."""
    least = both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("size")).select("u", F.least("u", "least").alias("m"), "size")
    return join_groups(both, least, ["u"], total)


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """links (a, b) of longs -> (doc_id, component), one row for each id that occurs in a link; component is the smallest id reachable.

    Null ends and self-links are ignored. Only stars are ever held: no task gathers a component.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a < b")
    edges = saved(edges.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    state, total = None, 2 * edges.count()
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _with_least(both, total).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        large = saved(large, "edges")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = _with_least(down, total).select(F.explode(F.array("u", "v")).alias("b"), F.col("m").alias("a")).where("a < b").select("a", "b").distinct()
        edges = saved(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, total = now, 2 * int(now[0])
    else:
        raise RuntimeError("components did not settle")
    members = edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("doc_id"), "component")
    roots = edges.select(F.col("a").alias("doc_id"), F.col("a").alias("component")).distinct()
    return members.unionAll(roots)
