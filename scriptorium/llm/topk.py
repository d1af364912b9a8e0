"""Exact top-k search by pivot-table elimination.

Every vector keeps its distances to PIVOTS pivots. For a query the largest |d(q, p) - d(x, p)| is a lower bound of d(q, x), so
(|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of the inner product. Candidates are evaluated in the order of that bound
until it falls below the k-th best score so far; the rest cannot matter. Queries and candidates meet in blocks of a grid,
each block keeps its own best k, and a last ranking merges them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.common import longs, saved, scratch

PIVOTS = 32
#: Pivots are chosen, far from one another, among this many vectors; they change the speed, never the result.
PIVOT_POOL = 256
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 2048
STEP = 128
#: Where two vectors' lengths multiply to this or more their product may not fit in 64 bits, and is taken in whole numbers of any size.
MOST = float(1 << 62)


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, q): floor(1024 * x) of each component as int64 bytes. Vectors that take no part are left out."""
    for batch in batches:
        ids, valid = longs(batch, "vec_id"), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        column = batch.column(1).cast(pa.list_(pa.float64()))
        values = column.values
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
        off, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
        out_ids, out = [], []
        for i in np.flatnonzero(valid & there):
            x = flat[off[i] : off[i + 1]]
            if np.isfinite(x).all():
                whole = np.floor(1024.0 * x)
                if len(whole) and np.abs(whole).max() >= float(1 << 63):
                    raise OverflowError(f"vector {int(ids[i])} has a component that does not fit in 64 bits")
                out_ids.append(int(ids[i]))
                out.append(whole.astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "q"])


def choose_pivots(pool: list[bytes], count: int = PIVOTS) -> np.ndarray:
    """Farthest-first from the pool."""
    x = matrix(pool).astype(np.float64)
    if not len(x):
        return x
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def matrix(vectors: list[bytes], width: int | None = None) -> np.ndarray:
    """int64 rows; shorter vectors are filled up with zeros, which leaves inner products as they are."""
    width = max([width or 0, *(len(v) // 8 for v in vectors)])
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v) // 8] = np.frombuffer(v, np.int64)
    return out


def pivot_table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    x = np.pad(x.astype(np.float64), ((0, 0), (0, width - x.shape[1])))
    p = np.pad(pivots, ((0, 0), (0, width - pivots.shape[1])))
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * x @ p.T, 0))


def exact_products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with q in numbers of any size: 64 bits are not enough for these."""
    return c.astype(object) @ q.astype(object)


def _checked(score: int) -> int | None:
    """The score if it fits in 64 bits. One far above is among the best, so an error; one far below may come to nothing: null, which ranks last."""
    if score >= 1 << 63:
        raise OverflowError("an inner product does not fit in 64 bits")
    return None if score < -(1 << 63) else score


def block_top_k(qid: np.ndarray, q: np.ndarray, q_table: np.ndarray, cid: np.ndarray, c: np.ndarray, c_table: np.ndarray, k: int) -> Iterator[tuple[int, int, int | None]]:
    """(query_id, vec_id, score): the k best of one block of candidates for each query, and how it stops early is said above."""
    c_norm, q_norm = (c.astype(np.float64) ** 2).sum(1), (q.astype(np.float64) ** 2).sum(1)
    longest = np.sqrt(c_norm.max(initial=0.0))
    for i in range(len(qid)):
        low = np.zeros(len(cid))
        for p in range(q_table.shape[1]):
            np.maximum(low, np.abs(c_table[:, p] - q_table[i, p]), out=low)
        slack = 1 + 1e-9 * (q_norm[i] + c_norm)  # above any rounding of the tables
        bound = (q_norm[i] + c_norm - low**2) / 2 + slack
        bound[cid == qid[i]] = -np.inf
        order = np.argsort(-bound, kind="stable")
        big = longest * np.sqrt(q_norm[i]) >= MOST
        best = np.zeros((0, 2), object if big else np.int64)
        for at in range(0, len(order), STEP):
            if len(best) == k and bound[order[at]] < best[-1, 0]:
                break
            some = order[at : at + STEP]
            some = some[np.isfinite(bound[some])]
            if not len(some):
                break
            found = exact_products(c[some], q[i]) if big else c[some] @ q[i]
            best = np.concatenate([best, np.stack([found, cid[some]], 1)])
            if big:
                best = np.array(sorted(best.tolist(), key=lambda row: (-row[0], row[1]))[:k], object)
            else:
                best = best[np.lexsort((best[:, 1], -best[:, 0]))][:k]
        for score, vec in best:
            yield int(qid[i]), int(vec), _checked(int(score))


def _meet(pivots: np.ndarray, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if queries.num_rows and candidates.num_rows:
            q_raw, c_raw = queries.column("q").to_pylist(), candidates.column("q").to_pylist()
            width = max(max(map(len, q_raw)), max(map(len, c_raw))) // 8
            q, c = matrix(q_raw, width), matrix(c_raw, width)
            found = list(block_top_k(queries.column("vec_id").to_numpy(), q, pivot_table(q, pivots), candidates.column("vec_id").to_numpy(), c, pivot_table(c, pivots), k))
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    return run


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """embeddings (vec_id, embedding) -> query_id, rank, vec_id, score: the k highest integer inner products of each query.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows with another vec_id. Ties go to the
    smaller vec_id; fewer candidates give fewer rows. Vectors that are null or hold a null or non-finite component, and rows
    without a vec_id, take no part. Of rows that repeat a vec_id and vector one takes part. An empty vector scores 0.
    Scores are exact for vectors of any length; one that is returned and does not fit in 64 bits is an error, and so is a component
    that, times 1024, does not.
    An empty table gives an empty result. Further columns are not read.
    """
    with scratch(vectors.sparkSession) as kept:
        return saved(_top_k(vectors, every, k), "top-k", keep=kept)


def _top_k(vectors: DataFrame, every: int, k: int) -> DataFrame:
    rows = saved(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_quantised, "vec_id long, q binary").distinct(), "quantised")
    count = rows.count()
    pool = [bytes(r.q) for r in rows.orderBy(F.xxhash64("q"), "vec_id").limit(PIVOT_POOL).collect()]
    pivots = choose_pivots(pool)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    c_blocks, q_blocks = -(-count // CANDIDATE_BLOCK) or 1, -(-asked.count() // QUERY_BLOCK) or 1
    q_block = F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.lit(q_blocks)).cast("int")
    c_block = F.pmod(F.xxhash64(F.lit("c"), "vec_id"), F.lit(c_blocks)).cast("int")
    queries = asked.select("vec_id", "q", q_block.alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))
    candidates = rows.select("vec_id", "q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), c_block.alias("cb"))
    met = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(_meet(pivots, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    best = met.distinct().select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    return best.withColumn("score", F.coalesce("score", F.raise_error(F.lit("an inner product does not fit in 64 bits")).cast("long")))


ORACLE = """
WITH fit AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
  FROM fit a JOIN fit b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
