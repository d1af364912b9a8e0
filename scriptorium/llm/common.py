"""Shared pieces of the training-data operators: scratch tables, Arrow batches cut by size, and vectorised hashing.

Texts are handled as the UTF-8 bytes that Arrow hands over, so hashing a word or a window is a few numpy
operations a byte and no Python object is made per word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import shared_folder

CHUNK_BYTES = 2 << 20

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix_int(x: int) -> int:
    x &= (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
    return x ^ (x >> 31)


#: One random 64-bit code for each byte.
_CODE = np.array([_mix_int(0x9E3779B97F4A7C15 * (i + 1)) | 1 for i in range(256)], dtype=np.uint64)
_BASE = np.uint64(_mix_int(12345) | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(_mix_int(777) | 1)
_tables: dict[str, np.ndarray] = {}
_made: list[str] = []
#: What operators hold in a worker from task to task: by name, how to drop it.
held: dict[str, Callable[[], None]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal in, equal out."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _tables[name] = have = np.multiply.accumulate(have)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums modulo 2**64; see span_hash."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_CODE[data] * _powers("pow", _BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes start..end, for many spans at once."""
    inv = _powers("inv", _INV, len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64) * _STEP)


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def forget(but: str | None = None) -> None:
    """Drops what operators hold in this worker from task to task, but for one; a task of another operator needs the memory."""
    for name in [n for n in held if n != but]:
        held.pop(name)()


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, holds: str | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into runs of rows of about `limit` bytes of text (a longer text stands alone): (rows, bytes, offsets)."""
    forget(holds)
    steady_heap()
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = binary_parts(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
    release_heap()


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of several texts, A-Z lower-cased: hash, row, and byte span of each."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        rows = len(off) - 1
        low = _LOWER[data]
        inside = ~_SEP[data]
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = off[1:-1][(off[1:-1] < len(data)) & (off[1:-1] > 0)]
            begins[edge] = inside[edge]
            ends[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.hash = span_hash(prefix_hash(low), self.start, self.end)
        self.first = np.searchsorted(self.start, off)  # the first word of each row, and one more
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(rows, dtype=np.int64), self.count)


def longs(batch: pa.RecordBatch, name: str, null: int = 0) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.int64())
    return (column.fill_null(null) if column.null_count else column).to_numpy(zero_copy_only=False)


def steady_heap() -> None:
    """Has glibc return large arrays to the system as they are freed, so a worker that also keeps many small objects stays small."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 21)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass  # another C library: nothing to set


def release_heap() -> None:
    """Gives back what a finished task leaves: Spark keeps idle Python workers for a minute, next to those of the next stage."""
    import ctypes

    _tables.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes what operators of this process have written to the shared folder, once their results are stored; how many paths."""
    count = len(_made)
    while _made:
        delete_path(spark, _made.pop())
    return count


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what was written inside it, but for the paths that are put on the list (saved does that for keep=)."""
    first, kept = len(_made), []
    yield kept
    for path in [p for p in _made[first:] if p not in kept]:
        _made.remove(path)
        delete_path(spark, path)


#: For queries that are run inside an operator: shuffle files go as the query ends, and Arrow batches stay small.
INNER = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


@contextmanager
def inner_settings(spark: SparkSession) -> Iterator[None]:
    """The settings of INNER while a query runs; the session's own come back."""
    before = {key: spark.conf.get(key, None) for key in INNER}
    for key, value in INNER.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def saved(df: DataFrame, name: str, compression: str = "zstd", keep: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    if keep is not None:
        keep.append(path)
    with inner_settings(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: sizes exchanges, never results."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])


def bucket_count(total_bytes: int) -> int:
    """Buckets of an exchange: about 2 MB of text each, and above 4 GB so many that a bucket stays below 256 MB of text."""
    return max(16, min(total_bytes // (2 << 20), max(2048, total_bytes // (256 << 20))) + 1)


def columns_only(docs: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that further ones with clashing names play no part."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
