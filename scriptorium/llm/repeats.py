"""Removal of long repeated byte strings.

Every byte that lies in a WINDOW-byte string that also starts anywhere else goes. The dealt method, column-wise construction
of the collection's Burrows-Wheeler transform and common prefixes, is in columnwise.py; it passes over all data once for each
byte of the longest text, or of the pieces that texts are cut into, so it serves small collections and tests alone (the README has figures). Here the same result is
found by content-chosen anchors:

1. Texts are laid down in files in the shared folder; a byte is known by file, row and place.
2. Each window is owned by the smallest GRAM-byte hash inside it. Equal windows have equal owners at equal distances, so
   only owners meet: (hash of the owner's gram, hash of the whole stretch of windows that it owns).
3. Where all owners with one gram own equal stretches, every window of theirs repeats. Where stretches differ, one owner of
   each distinct stretch gives the hashes of its windows one by one, and those are compared.
4. Marked stretches go back to their file, which is read once more, and what is left is hashed.

Owners travel as packed arrays, not as rows. Hashes have 64 bits; windows count as equal when hash, gram and distance are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import binary_parts, bucket_count, longs, mix, prefix_hash, saved, scratch, scratch_path, span_hash, text_bytes, text_chunks
from scriptorium.llm.warc import file_system

WINDOW, GRAM = 200, 32
FILE_BYTES, PIECE_BYTES, BLOCK_BYTES = 16 << 20, 2 << 20, 8 << 20
_PLACE = np.uint64((1 << 28) - 1)
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.large_binary())])


def _file_name(file: int) -> str:
    return f"part-{file >> 24:06d}-{file & 0xFFFFFF:06d}.arrow"


def _store(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the rows of one input partition to files of about FILE_BYTES, in pieces of PIECE_BYTES; returns their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, fs, done = TaskContext.get().partitionId(), *file_system(folder)[:1], []
        base = file_system(folder)[1]
        sink = writer = None
        held = 0

        def close() -> None:
            nonlocal sink, writer, held
            if writer is not None:
                writer.close()
                sink.close()
                fs.move(temp, f"{base}/{_file_name(task << 24 | len(done))}")
                done.append(task << 24 | len(done))
                sink = writer = None
                held = 0

        for rows, data, off in text_chunks(batches, limit=PIECE_BYTES):
            if writer is None:
                temp = f"{base}/.temp-{task:06d}-{uuid.uuid4().hex}"
                sink = fs.open_output_stream(temp)
                writer = pa.ipc.new_stream(sink, _SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            ids = pa.array(longs(rows, "doc_id"), mask=~rows.column(0).is_valid().to_numpy(zero_copy_only=False))
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            writer.write_batch(pa.RecordBatch.from_arrays([ids, text], schema=_SCHEMA))
            held += len(data)
            if held >= FILE_BYTES:
                close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["file"])

    return run


def _pieces(folder: str, file: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(first row, ids, bytes, offsets) of each piece of a file."""
    fs, base = file_system(folder)
    first = 0
    with fs.open_input_stream(f"{base}/{_file_name(file)}") as f, pa.ipc.open_stream(f) as stream:
        for batch in stream:
            data, off = binary_parts(batch.column(1))
            yield first, batch.column(0), data, off
            first += batch.num_rows


def _blocks(size: int) -> Iterator[tuple[int, int]]:
    """Blocks of a long run of bytes; each overlaps the next by a byte less than a window, so a window lies in one block."""
    for at in range(0, max(1, size - WINDOW + 1), BLOCK_BYTES):
        yield at, min(size, at + BLOCK_BYTES + WINDOW - 1)


def owners(data: np.ndarray, off: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first window's start in the row, the owner's distance from it, windows - 1, gram hash, stretch hash) of each owner, in order.

    A long text is gone through in blocks. A stretch that is cut between two is no longer equal to its whole copies, and so its
    windows are compared one by one.
    """
    parts = []
    for a, b in _blocks(len(data)):
        row, start, *rest = _block_owners(data[a:b], np.clip(off, a, b) - a, window, gram)
        parts.append((row, start + np.maximum(a - off[row], 0), *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _block_owners(data: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    start = np.arange(len(data) - window + 1)
    row = np.searchsorted(off, start, side="right") - 1
    inside = start + window <= off[row + 1] if len(start) else np.zeros(0, bool)
    start, row = start[inside], row[inside]
    if not len(start):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    sums = prefix_hash(data)
    place = np.arange(len(data) - gram + 1)
    h = span_hash(sums, place, place + gram)
    low = (h & ~_PLACE) | place.astype(np.uint64)  # the leftmost of equal ones is the smallest
    span, width = window - gram + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = (low & _PLACE).astype(np.int64)[start]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])))
    last = np.append(new[1:], len(start)) - 1
    first, final, at, row = start[new], start[last], at[new], row[new]
    stretch = span_hash(sums, first, final + window) ^ mix(((at - first) * 1024 + (final - first)).astype(np.uint64))
    return row, first - off[row], at - first, final - first, h[at], stretch


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(start, np.append(start[1:], len(bucket))[: len(start)], strict=True):
        yield int(bucket[a]), order[a:b]


def _packed(*columns: np.ndarray) -> bytes:
    return np.array([len(columns[0])], np.uint32).tobytes() + b"".join(c.tobytes() for c in columns)


def _unpacked(blobs: list[bytes], *kinds: type) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for x in blobs:
        n, at = int(np.frombuffer(x, np.uint32, 1)[0]), 4
        for o, kind in zip(out, kinds, strict=True):
            o.append(np.frombuffer(x, kind, n, at))
            at += o[-1].nbytes
    return [np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, kinds, strict=True)]


def _rows(rows: list[tuple], *names: str) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "file": pa.int64(), "kind": pa.int32(), "data": pa.binary()}
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(cols, names, strict=True)], names=list(names))


OWNER = (np.uint32, np.uint32, np.uint8, np.uint8, np.uint64, np.uint64)


def _owners(folder: str, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for first, _, data, off in _pieces(folder, file):
                    row, start, far, more, key, stretch = owners(data, off)
                    cols = [c.astype(k) for c, k in zip((row + first, start, far, more, key, stretch), OWNER, strict=True)]
                    out = [(b, file, _packed(*[c[i] for c in cols])) for b, i in _by_bucket(((key >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64))]
                    if out:
                        yield _rows(out, "bucket", "file", "data")

    return run


def _compare(table: pa.Table) -> pa.Table:
    """Of one bucket of grams: stretches that repeat whole (kind 0: row, first, windows - 1), and those to look into (kind 1: an owner)."""
    files, blobs = table.column("file").to_numpy(), table.column("data").to_pylist()
    row, start, far, more, key, stretch = _unpacked(blobs, *OWNER)
    file = np.repeat(files, [int(np.frombuffer(x, np.uint32, 1)[0]) for x in blobs])
    order = np.lexsort((start, row, file, stretch, key))
    row, start, far, more, key, stretch, file = (x[order] for x in (row, start, far, more, key, stretch, file))
    n = len(key)
    new_key = np.append(True, key[1:] != key[:-1]) if n else np.zeros(0, bool)
    new = new_key | np.append(True, stretch[1:] != stretch[:-1]) if n else new_key
    group, first = np.cumsum(new_key) - 1, np.flatnonzero(new)
    copies = np.repeat(np.diff(np.append(first, n)), np.diff(np.append(first, n)))
    kinds_of_group = np.bincount(group[first]) if n else np.zeros(0, np.int64)
    full, look = copies > 1, new & (kinds_of_group[group] > 1 if n else new)
    out = []
    for f, i in _by_bucket(file[full]):
        out.append((f, 0, _packed(*[c[full][i] for c in (row, start, more)])))
    for f, i in _by_bucket(file[look]):
        out.append((f, 1, _packed(*[c[look][i] for c in (row, start, far, more, key, stretch)])))
    return pa.Table.from_batches([_rows(out, "file", "kind", "data")])


def _window_hashes(folder: str, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Of one file: for each owner to look into a hash of each of its windows, which also has the gram and the distance to it."""

    def run(table: pa.Table) -> pa.Table:
        file = table.column("file")[0].as_py()
        row, start, far, more, key, _ = _unpacked(table.column("data").to_pylist(), *OWNER)
        row, start, far, more = (x.astype(np.int64) for x in (row, start, far, more))
        out = []
        for first, ids, data, off in _pieces(folder, file):
            own = np.flatnonzero((row >= first) & (row < first + len(ids)))
            if not len(own):
                continue
            count = more[own] + 1
            which = np.repeat(np.arange(len(own)), count)
            step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            at = off[row[own] - first][which] + start[own][which] + step
            name = mix(key[own][which] ^ mix((far[own][which] - step).astype(np.uint64)))
            for a, b in _blocks(len(data)):
                some = np.flatnonzero((at >= a) & (at + WINDOW <= b))
                name[some] ^= span_hash(prefix_hash(data[a:b]), at[some] - a, at[some] - a + WINDOW)
            begin = np.cumsum(count) - count
            for b, i in _by_bucket(((key[own] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)):
                names = np.concatenate([name[begin[j] : begin[j] + count[j]] for j in i])
                out.append((b, file, _packed(row[own][i].astype(np.uint32), start[own][i].astype(np.uint32), more[own][i].astype(np.uint8)) + names.tobytes()))
        return pa.Table.from_batches([_rows(out, "bucket", "file", "data")])

    return run


def _compare_windows(table: pa.Table) -> pa.Table:
    """Of one bucket: runs of windows that occur more than once (row, first, windows - 1)."""
    files, rows_, starts, names = [], [], [], []
    for file, x in zip(table.column("file").to_pylist(), table.column("data").to_pylist(), strict=True):
        row, start, more = _unpacked([x], np.uint32, np.uint32, np.uint8)
        count = more.astype(np.int64) + 1
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        rows_.append(np.repeat(row, count))
        starts.append(np.repeat(start, count) + step)
        names.append(np.frombuffer(x, np.uint64, int(count.sum()), 4 + 9 * len(row)))
        files.append(np.full(len(step), file, np.int64))
    row, start, name, file = (np.concatenate(x) for x in (rows_, starts, names, files))
    ordered = np.sort(name)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    at = np.minimum(np.searchsorted(twice, name), max(0, len(twice) - 1))
    hit = twice[at] == name if len(twice) else np.zeros(len(name), bool)
    row, start, file = row[hit], start[hit], file[hit]
    order = np.lexsort((start, row, file))
    row, start, file = row[order], start[order], file[order]
    out = []
    if len(row):
        run = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)))
        long = np.diff(np.append(run, len(row))) - 1
        for f, i in _by_bucket(file[run]):
            out.append((f, 2, _packed(row[run][i].astype(np.uint32), start[run][i].astype(np.uint32), long[i].astype(np.uint32))))
    return pa.Table.from_batches([_rows(out, "file", "kind", "data")])


def removed_mask(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    edge = np.bincount(begin, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
    return np.cumsum(edge[:-1]) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KEPT = "doc_id long, kept binary"


def _finish(folder: str, keep_text: bool = False) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        file = table.column("file")[0].as_py()
        kind, blobs = table.column("kind").to_pylist(), table.column("data").to_pylist()
        r0, s0, m0 = _unpacked([x for k, x in zip(kind, blobs, strict=True) if k == 0], np.uint32, np.uint32, np.uint8)
        r2, s2, m2 = _unpacked([x for k, x in zip(kind, blobs, strict=True) if k == 2], np.uint32, np.uint32, np.uint32)
        row = np.concatenate([r0, r2]).astype(np.int64)
        start = np.concatenate([s0, s2]).astype(np.int64)
        more = np.concatenate([m0.astype(np.int64), m2.astype(np.int64)])
        parts = []
        for first, ids, data, off in _pieces(folder, file):
            own = (row >= first) & (row < first + len(ids))
            begin = off[row[own] - first] + start[own]
            gone = removed_mask(data, begin, begin + more[own] + WINDOW)
            before = np.concatenate([[0], np.cumsum(gone)])
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            inner = off[:-1][(off[:-1] < len(data)) & (off[1:] > off[:-1])]
            rise[inner] = gone[inner]
            rises = np.concatenate([[0], np.cumsum(rise)])
            left = data[~gone].tobytes()
            edge = off - before[off]
            texts = [left[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
            if keep_text:
                parts.append(pa.table({"doc_id": ids, "kept": pa.array(texts, pa.binary())}))
                continue
            parts.append(pa.table({"doc_id": ids, "n_bytes": np.diff(off), "n_removed": np.diff(before[off]), "n_spans": np.diff(rises[off]), "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts]}))
        return pa.concat_tables(parts)

    return run


def _marked(docs: DataFrame, folder: str) -> DataFrame:
    """(file, kind, data): every file once with an empty mark, and the stretches and runs to remove."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), "text")
    buckets = bucket_count(text_bytes(own))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    files = saved(own.mapInArrow(_store(folder), "file long"), "files")
    deal = files.repartition(max(1, min(files.count(), 100_000)), "file")
    marks = saved(deal.mapInArrow(_owners(folder, buckets), "bucket int, file long, data binary").groupBy("bucket").applyInArrow(_compare, "file long, kind int, data binary"), "marks")
    windows = marks.where("kind = 1").groupBy("file").applyInArrow(_window_hashes(folder, buckets), "bucket int, file long, data binary")
    runs = windows.groupBy("bucket").applyInArrow(_compare_windows, "file long, kind int, data binary")
    return files.select("file", F.lit(3).alias("kind"), F.lit(None).cast("binary").alias("data")).unionAll(marks.where("kind = 0")).unionAll(runs)


def remove_repeats(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """documents -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row each.

    Null texts are empty. Texts under WINDOW bytes lose nothing. Repeated rows repeat each other and lose what is long enough.
    A null doc_id is kept as null. Strings are judged on the input, and overlaps count. An empty table gives an empty result.
    Very long texts are hashed in blocks; a text may have as many bytes as Spark allows. Further columns are not read.
    """
    with scratch(docs.sparkSession) as kept:
        folder = folder or scratch_path(docs.sparkSession, "texts")
        return saved(_marked(docs, folder).groupBy("file").applyInArrow(_finish(folder), RESULT), "repeats", keep=kept)


def kept_texts(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """documents -> doc_id and the bytes that stay (a cut can fall inside a character, so they are binary), one row each.

    Null and empty texts keep no bytes, and texts under WINDOW bytes all of theirs. Repeated rows repeat each other, so of a text of WINDOW bytes or
    more that comes twice nothing stays. A null doc_id is kept as null. Very long texts are gone through in blocks. An empty table gives
    an empty result. Further columns, whatever their names, are not read. The folder of texts is the caller's to delete.
    """
    folder = folder or scratch_path(docs.sparkSession, "texts")
    return _marked(docs, folder).groupBy("file").applyInArrow(_finish(folder, True), KEPT)
