"""An embedder that is fitted on the texts: TF-IDF over hashed terms, and a randomised singular value decomposition.

Texts are taken apart once: the terms of each and how often they occur are written to the shared folder. A pass goes over these, and each task adds up
what its rows contribute to the product of the matrix's transpose, the matrix, and a thin block of vectors. These sums, a row for each run of terms, are added by an aggregation. So a power
iteration costs one pass, and what comes to the driver is terms times dimensions, however many texts there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.errors import EmbeddingError
from scriptorium.functions.vector import ROWS_AT_ONCE, Places, as_lists, text_parts, token_places
from scriptorium.session import new_folder, remove_folder

#: Terms are hashed to so many places; vectors have so many dimensions, and the decomposition works with some more.
TERMS, DIMENSIONS, SPARE = 1 << 14, 64, 10
POWER_STEPS = 6
#: Terms whose sums travel as one row, and entries of the matrix that are multiplied at once, few enough to stay in a core's cache.
RUN, ENTRIES = 1024, 1000
#: Rows with so many entries on average are multiplied one by one, as whole products; those with fewer by runs of entries.
LONG = 12
#: Tasks whose sums are added in one group before all are, and tasks of a pass for each core, as each has sums to hand on.
ADDED, TASKS = 16, 3
COUNTED = "terms binary, counts binary"


def entries(texts: pa.Array, places: Places, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of a batch, by row and term: term frequency times idf, rows of length 1."""
    row, term = token_places(texts, places)
    cell, count = np.unique(row * np.int64(places.dimensions) + term, return_counts=True)
    row, term = cell // places.dimensions, cell % places.dimensions
    if idf is None:
        return row, term, count.astype(np.float64)
    return row, term, weighted(row, term, count, idf, len(texts))


def weighted(row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    weight = count * idf[term]
    length = np.sqrt(np.bincount(row, weight * weight, minlength=rows))
    return weight / length[row]


def times(row: np.ndarray, term: np.ndarray, weight: np.ndarray, block: np.ndarray, rows: int) -> np.ndarray:
    """The rows of the matrix times a block of vectors."""
    out = np.zeros((rows, block.shape[1]))
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    if len(row) >= LONG * len(starts):
        for r, a, b in zip(row[starts].tolist(), starts.tolist(), np.append(starts[1:], len(row)).tolist(), strict=True):
            out[r] = weight[a:b] @ block[term[a:b]]
        return out
    for a in range(0, len(row), ENTRIES):
        r = row[a : a + ENTRIES]
        starts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        out[r[starts]] += np.add.reduceat(weight[a : a + ENTRIES, None] * block[term[a : a + ENTRIES]], starts, axis=0)
    return out


def _counted(terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each text its terms and their counts, as bytes of 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(terms)
        for batch in batches:
            for part in text_parts(batch.column(0)):
                row, term, count = entries(part, places, None)
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(part)))).astype(np.int32) * 4
                lists = [pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.astype(np.uint32).tobytes())]) for x in (term, count)]
                yield pa.RecordBatch.from_arrays(lists, names=["terms", "counts"])

    return run


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(entries of each row, all numbers) of a column of bytes."""
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int32, len(column) + 1, column.offset * 4)
    return np.diff(ends) // 4, np.frombuffer(data, np.uint32, (ends[-1] - ends[0]) // 4, ends[0]) if data is not None else np.zeros(0, np.uint32)


def stored_entries(batch: pa.RecordBatch, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`entries` of a batch that _counted has made."""
    each, term = _numbers(batch.column(0))
    _, count = _numbers(batch.column(1))
    row, term = np.repeat(np.arange(len(each)), each), term.astype(np.int64)
    if idf is None:
        return row, term, count.astype(np.float64)
    return row, term, weighted(row, term, count, idf, len(each))


def _frequencies(terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, total = 0, np.zeros(terms, np.int64)
        for batch in batches:
            _, term, _ = stored_entries(batch, None)
            total += np.bincount(term, minlength=terms)
            texts += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], texts))], names=["term", "n"])

    return run


def _products(idf: np.ndarray, block: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, sums: what this task's rows add to transpose x matrix x block, for each run of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block.shape)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                row, term, weight = stored_entries(part, idf)
                own = times(row, term, weight, block, part.num_rows)
                order = np.argsort(term, kind="stable")
                total += times(term[order], row[order], weight[order], own, len(idf))
        runs = range(0, len(idf), RUN)
        yield pa.RecordBatch.from_arrays([pa.array([a // RUN for a in runs], pa.int32()), pa.array([total[a : a + RUN].tobytes() for a in runs], pa.binary())], names=["run", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in sorted(table.column("sums").to_pylist()))
    return pa.table({"run": pa.array([table.column("run")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def gram_times(counted: DataFrame, idf: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Transpose x matrix x block, by one pass and one aggregation."""
    parts = counted.mapInArrow(_products(idf, block), "run int, sums binary").withColumn("task", F.floor(F.spark_partition_id() / ADDED))
    some = parts.groupBy("run", "task").applyInArrow(_added, "run int, sums binary")  # so a group has ADDED sums at most, then a row for each ADDED tasks
    parts = some.groupBy("run").applyInArrow(_added, "run int, sums binary")
    rows = sorted((r.run, bytes(r.sums)) for r in parts.collect())  # terms / RUN rows
    return np.concatenate([np.frombuffer(x, np.float64).reshape(-1, block.shape[1]) for _, x in rows])


@dataclass(frozen=True)
class FittedEmbedder:
    """A function of a column of texts: their TF-IDF rows in the space of the strongest singular vectors. Null and blank texts are zero vectors."""

    idf: np.ndarray
    axes: np.ndarray
    strengths: np.ndarray

    def __call__(self, text: Column) -> Column:
        idf, axes = self.idf, self.axes

        @F.arrow_udf("array<double>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            places = Places(len(idf))
            for texts in batches:
                for part in text_parts(texts):
                    yield as_lists(times(*entries(part, places, idf), axes, len(part)))

        return run.asNondeterministic()(text)  # it is deterministic: a filter on vectors is to read them, not to make them once more


def fit(texts: DataFrame, dimensions: int = DIMENSIONS, terms: int = TERMS, steps: int = POWER_STEPS, column: str = "text") -> FittedEmbedder:
    """Fits on all texts of a column. Dimensions beyond the matrix's rank are zero. An empty table is an error.

    Signs are fixed: each axis has its largest entry positive.
    """
    spark, folder = texts.sparkSession, new_folder(texts.sparkSession, "counted")
    try:
        texts.select(F.col(column).cast("string").alias("text")).mapInArrow(_counted(terms), COUNTED).write.parquet(folder)
        own = spark.read.schema(COUNTED).parquet(folder).coalesce(TASKS * spark.sparkContext.defaultParallelism)
        rows = own.mapInArrow(_frequencies(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # terms at most
        found = {r.term: r.n for r in rows}
        count = found.pop(-1, 0)
        if not count or not found:
            raise EmbeddingError("there are no words to fit on")
        seen = np.zeros(terms)
        seen[list(found)] = list(found.values())
        idf = np.where(seen > 0, np.log((1 + count) / (1 + seen)) + 1, 0.0)
        width = min(dimensions + SPARE, terms)
        block = np.random.default_rng(7).normal(size=(terms, width)) * (seen > 0)[:, None]
        for _ in range(steps):
            block, _ = np.linalg.qr(gram_times(own, idf, block))
        small = block.T @ gram_times(own, idf, block)
    finally:
        remove_folder(spark, folder)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[: min(dimensions, width)]
    axes, strengths = block @ vectors[:, order], np.sqrt(np.maximum(values[order], 0))
    axes = axes * (strengths > 1e-9 * max(strengths[0], 1e-300))
    sign = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return FittedEmbedder(idf, axes * np.where(sign == 0, 1, sign), strengths)
