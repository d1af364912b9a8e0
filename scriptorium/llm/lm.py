"""N-gram language model by deleted interpolation.

p(w | h) = l(b) f(w | h) + (1 - l(b)) q(w), q(w) = m f(w) + (1 - m) / (V + 1), where f are maximum-likelihood estimates and b
is the bucket (power of two) of the context's count. The weights are learned by expectation-maximisation on counts of a
deleted part of the training documents, with f from the rest; then f is taken from all training documents.

Counts never meet in one place. Words are dealt to K slices by hash, bigrams to K * K buckets by the slices of both words, so
a bucket needs the unigram counts of two slices only; it reads those from files in the shared folder. A first pass over the
texts merges the bigrams of each bucket, one entry for each chunk of text, and writes their counts beside those of their two
words. A second pass sends where bigrams occur, as packed arrays of one chunk; a bucket goes through them chunk by chunk beside
its table of counts and returns one partial sum for each document. A bucket in which bigrams occur very often is dealt out
further by chunk, as each of its parts can read the table. What expectation-maximisation needs of the held-out counts is a
histogram of the ratio f / q by bucket, a few thousand numbers at any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Words, binary_parts, forget, inner_settings, longs, mix, release_heap, saved, scratch, scratch_path, steady_heap, text_bytes
from scriptorium.llm.warc import file_system

FOLDS, HELD_OUT, DELETED = 7, 2, 3
END, BEGIN = np.uint64(0xE4D0F7E87), np.uint64(0xBE6177AB1)
#: A bucket gets the bigrams of about this many bytes of text.
BUCKET_BYTES = 14 << 20
CHUNK_BYTES = 2 << 20
HASH_BYTES = 1 << 18
#: A bucket with more occurrences, and with more than one in so many of all, is dealt out by chunk.
HOT_PLACES, MOST_HOT = 8 << 20, 100_000
#: Entries that wait, unless more are held already, before those of one bucket are merged.
MERGE_ENTRIES = 1 << 18
BINS = 32  # of the ratio's logarithm, for each power of two
STEPS = 60
_SHIFT = np.uint64(24)


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    forget()
    steady_heap()
    for batch in batches:
        data, off = binary_parts(batch.column(batch.schema.get_field_index("text")))
        at = 0
        while at < batch.num_rows:
            to = min(max(int(np.searchsorted(off, off[at] + limit, side="right")) - 1, at + 1), batch.num_rows, at + 65_000)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
    release_heap()


def sequences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, row) of every token: the words of each text and an end, each after the word before it or a begin."""
    counts, hashes, at = [], [], 0
    while at < len(off) - 1:  # words are hashed piece by piece: that takes many bytes for each of the text's
        to = max(int(np.searchsorted(off, off[at] + HASH_BYTES, side="right")) - 1, at + 1)
        words = Words(data[off[at] : off[to]], off[at : to + 1] - off[at])
        counts.append(words.count)
        hashes.append(words.hash)
        at = to
    size, hashes = np.concatenate(counts) + 1, np.concatenate(hashes)
    rows = len(size)
    last = np.cumsum(size) - 1
    token = np.empty(int(size.sum()), np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[last] = True
    token[is_end], token[~is_end] = END, hashes
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[last - size + 1] = BEGIN
    return context, token, np.repeat(np.arange(rows), size)


def _slice(h: np.ndarray, slices: int) -> np.ndarray:
    return ((h & ((np.uint64(1) << _SHIFT) - np.uint64(1))) % np.uint64(slices)).astype(np.int64)


def _sub(h: np.ndarray, slices: int) -> np.ndarray:
    """Part of a slice, by ranges of the hash: words meet in slices * slices parts, which laid end to end are sorted."""
    return (((h >> np.uint64(40)) * np.uint64(slices)) >> np.uint64(24)).astype(np.int64)


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _count_words(slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(slice, part, packed words with their counts in the kept and the deleted part); begins count as words here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            part = longs(rows, "fold", -1)
            _, token, row = sequences(data, off)
            every = np.concatenate([token, np.full(len(part), BEGIN)])
            which = np.concatenate([part[row], part])
            every, which = every[which != HELD_OUT], which[which != HELD_OUT]
            names, inverse = np.unique(every, return_inverse=True)
            gone = np.bincount(inverse, weights=which == DELETED, minlength=len(names)).astype(np.uint32)
            kept = np.bincount(inverse, minlength=len(names)).astype(np.uint32) - gone
            at, sub = _slice(names, slices), _sub(names, slices)
            order = np.argsort(at * slices + sub, kind="stable")
            start = _runs((at * slices + sub)[order])
            out = []
            for a, b in zip(start, np.append(start[1:], len(order))[: len(start)], strict=True):
                i = order[a:b]
                out.append((int(at[i[0]]), int(sub[i[0]]), names[i].tobytes(), kept[i].tobytes(), gone[i].tobytes()))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in cols[:2]], *[pa.array(c, pa.binary()) for c in cols[2:]]], names=["slice", "sub", "names", "kept", "gone"])

    return run


def _merge_words(table: pa.Table) -> pa.Table:
    """One part of a slice: sorted distinct words with their counts."""
    names = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("names").to_pylist()])
    kept = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("kept").to_pylist()]).astype(np.int64)
    gone = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("gone").to_pylist()]).astype(np.int64)
    order = np.argsort(names, kind="stable")
    names, kept, gone = names[order], kept[order], gone[order]
    start = _runs(names)
    names, kept, gone = names[start], np.add.reduceat(kept, start), np.add.reduceat(gone, start)
    word = names != BEGIN
    return pa.table({"slice": table.column("slice")[:1], "sub": table.column("sub")[:1], "names": pa.array([names.tobytes()], pa.binary()), "kept": pa.array([kept.tobytes()], pa.binary()), "gone": pa.array([gone.tobytes()], pa.binary()), "n_kept": [int(kept[word].sum())], "v_kept": [int((kept[word] > 0).sum())], "n": [int((kept + gone)[word].sum())], "v": [int(word.sum())]})


WORDS = "slice int, sub int, names binary, kept binary, gone binary, n_kept long, v_kept long, n long, v long"


class Slice:
    """Counts of the words of one slice, read from the shared folder."""

    def __init__(self, folder: str, number: int):
        fs, base = file_system(folder)
        self.names, self.kept, self.gone = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = []
        for f in fs.get_file_info(FileSelector(f"{base}/slice={number}", allow_not_found=True)):
            if f.type == FileType.File and f.base_name.endswith(".parquet"):
                with fs.open_input_file(f.path) as file:
                    parts += pq.read_table(file, columns=["sub", "names", "kept", "gone"]).to_pylist()
        if parts:
            parts.sort(key=lambda r: r["sub"])
            self.names, self.kept, self.gone = (np.concatenate([np.frombuffer(r[n], k) for r in parts]) for n, k in (("names", np.uint64), ("kept", np.int64), ("gone", np.int64)))

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of each word in the kept and the deleted part, 0 where it is not there."""
        if not len(self.names):
            return np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        there = self.names[at] == names
        return np.where(there, self.kept[at], 0), np.where(there, self.gone[at], 0)


def _pair(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(3) ^ token)


def squeeze(*arrays: np.ndarray, rising: int = 0) -> bytes:
    """Several arrays as one compressed blob: the bytes of each by place, so small numbers leave runs of zeros. The first `rising`
    arrays are held as differences."""
    planes, head = [], [len(arrays)]
    for k, x in enumerate(arrays):
        if k < rising and len(x):
            x = np.append(x[:1], np.diff(x))
        head += [ord(x.dtype.char), len(x)]
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(blob: pa.Buffer, rising: int = 0) -> list[np.ndarray]:
    size = int(np.frombuffer(blob, np.int64, 1)[0])
    raw = np.frombuffer(pa.decompress(blob.slice(8), decompressed_size=size, codec="zstd"), np.uint8)
    count = int(raw[:8].view(np.int64)[0])
    head, at, out = raw[8 : 8 + 16 * count].view(np.int64).reshape(count, 2).tolist(), 8 + 16 * count, []
    for k, (kind, n) in enumerate(head):
        width = np.dtype(chr(kind)).itemsize
        x = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(np.dtype(chr(kind)))
        out.append(np.cumsum(x, dtype=x.dtype) if k < rising else x)
        at += n * width
    return out


def _blobs(table: pa.Table, column: str = "data") -> Iterator[pa.Buffer]:
    for chunk in table.column(column).chunks:
        for x in chunk:
            yield x.as_buffer()


def _packed(rows: list[tuple], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 500):
        *keys, data = zip(*rows[a : a + 500], strict=True)
        yield pa.RecordBatch.from_arrays([*[pa.array(k, pa.int32()) for k in keys], pa.array(data, pa.binary())], names=list(names))


def _emit_counts(slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, data): the distinct bigrams of a chunk, with their counts in the kept and the deleted part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            part = longs(rows, "fold", -1)
            context, token, row = sequences(data, off)
            kept, gone = ((part != HELD_OUT) & (part != DELETED))[row], (part == DELETED)[row]
            bucket = _slice(context, slices) * slices + _slice(token, slices)
            if slices <= 256:  # equal contexts come together, so they compress; ties of the shortened hashes only repeat an entry
                order = np.argsort((bucket.astype(np.uint64) << np.uint64(48)) | ((context >> np.uint64(40)) << _SHIFT) | (token >> np.uint64(40)), kind="stable")
            else:
                order = np.lexsort((token, context, bucket))
            bucket, context, token = bucket[order], context[order], token[order]
            first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (token[1:] != token[:-1])))
            kept, gone = (np.add.reduceat(x[order], first, dtype=np.uint32) for x in (kept, gone))
            size = np.diff(np.append(first, len(order)))
            bucket, context, token = bucket[first], context[first], token[first]
            start, out = _runs(bucket), []
            for a, b in zip(start, np.append(start[1:], len(bucket)), strict=True):
                out.append((int(bucket[a]), squeeze(context[a:b], token[a:b], kept[a:b], gone[a:b], size[a:b].sum(keepdims=True), rising=1)))
            yield from _packed(out, ("bucket", "data"))

    return run


def _emit_places(slices: int, parts_of: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, salt, data): the distinct bigrams of a chunk with the rows they occur in, and the doc_ids of rows that begin here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            rid, doc = longs(rows, "rid"), rows.column(rows.schema.get_field_index("doc_id"))
            if (np.diff(rid) != 1).any():
                raise ValueError("row ids of a chunk do not follow one another")
            doc, null = longs(rows, "doc_id"), doc.is_null().to_numpy(zero_copy_only=False)
            context, token, row = sequences(data, off)
            bucket, name, begin = _slice(context, slices) * slices + _slice(token, slices), _pair(context, token), context == BEGIN
            del context, token
            order = np.argsort((bucket.astype(np.uint64) << np.uint64(48)) | (name >> np.uint64(16)), kind="stable") if slices <= 256 else np.lexsort((name, bucket))
            bucket, name, row, begin = bucket[order], name[order], row[order], begin[order]
            draw = int(mix(rid[:1].astype(np.uint64))[0])
            start, out = _runs(bucket), []
            for a, b in zip(start, np.append(start[1:], len(bucket)), strict=True):
                which, own = int(bucket[a]), name[a:b]
                first, new = _runs(own), row[a:b][begin[a:b]]
                blob = squeeze(own[first], np.diff(np.append(first, b - a)).astype(np.uint32), row[a:b].astype(np.uint16), new.astype(np.uint16), doc[new], null[new].astype(np.uint8), np.array([rid[0], rows.num_rows]), rising=1)
                out.append((which, draw % parts_of.get(which, 1), blob))
            yield from _packed(out, ("bucket", "salt", "data"))

    return run


def _bin(ratio: np.ndarray) -> np.ndarray:
    """Histogram place of f / q; a ratio of zero has a place of its own."""
    out = np.full(len(ratio), -(1 << 20), np.int64)
    out[ratio > 0] = np.round(np.log2(ratio[ratio > 0]) * BINS).astype(np.int64)
    return out


def _uniform_ratio(model: dict) -> Callable[[pa.Table], pa.Table]:
    """Of one part: the histogram of f(w) / (1 / (V + 1)) over the deleted part's tokens."""

    def run(table: pa.Table) -> pa.Table:
        kept, gone = np.frombuffer(table.column("kept")[0].as_py(), np.int64), np.frombuffer(table.column("gone")[0].as_py(), np.int64)
        names = np.frombuffer(table.column("names")[0].as_py(), np.uint64)
        some = (gone > 0) & (names != BEGIN)
        return _histogram(np.zeros(int(some.sum()), np.int64), _bin(kept[some] / max(1, model["n_kept"]) * (model["v_kept"] + 1)), gone[some])

    return run


def _histogram(level: np.ndarray, place: np.ndarray, weight: np.ndarray) -> pa.Table:
    keys, inverse = np.unique((level << 32) + place, return_inverse=True)
    total = np.bincount(inverse, weights=weight, minlength=len(keys)).astype(np.int64)
    found = (keys + (1 << 31)) >> 32
    return pa.table({"level": pa.array(found), "place": pa.array(keys - (found << 32)), "weight": pa.array(total)})


def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Contexts, tokens and both counts of several runs of entries as one, in the order of the pairs' hashes."""
    context, token, kept, gone = (np.concatenate(v) for v in zip(*parts, strict=True))
    name = _pair(context, token)
    order = np.argsort(name, kind="stable")
    start = _runs(name[order])
    del name
    kept, gone = (np.add.reduceat(x[order], start, dtype=np.int64) if len(start) else x.astype(np.int64) for x in (kept, gone))
    order = order[start]
    return [context[order], token[order], kept, gone]


PAIRS = "bucket int, counts binary, places long, ratios array<struct<level: long, place: long, weight: long>>"


def _merge_pairs(folder: str, slices: int, model: dict) -> Callable[[pa.Table], pa.Table]:
    """Of one bucket: its distinct bigrams by hash, with their training counts and those of both words; how often they occur; and
    the histogram of f(w | h) / q(w) over the deleted part's tokens, by the context's bucket in the kept part."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        of_context, of_token = Slice(folder, bucket // slices), Slice(folder, bucket % slices)
        held, waiting, places = [np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64)], [], 0
        for x in _blobs(table):
            *entries, total = unsqueeze(x, rising=1)
            places += int(total[0])
            waiting.append(entries)
            if sum(len(w[0]) for w in waiting) > max(MERGE_ENTRIES, len(held[0])):
                held, waiting = _merged([held, *waiting]), []
        context, token, kept, gone = _merged([held, *waiting])
        del held, waiting, entries
        seen, seen_gone = of_context.find(context)
        word, word_gone = of_token.find(token)
        some = gone > 0
        q = model["m"] * word[some] / max(1, model["n_kept"]) + (1 - model["m"]) / (model["v_kept"] + 1)
        f = np.where(seen[some] > 0, kept[some] / np.maximum(seen[some], 1), 0.0)
        ratios = _histogram(level(seen[some]), _bin(f / q), gone[some]).to_pylist()
        counts = squeeze(_pair(context, token), kept + gone, seen + seen_gone, word + word_gone, rising=1)
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("level", "place", "weight")]))
        out = pa.table([pa.array([bucket], pa.int32()), pa.array([counts], pa.binary()), pa.array([places]), pa.array([ratios], kind)], names=["bucket", "counts", "places", "ratios"])
        del of_context, of_token, context, token, kept, gone, seen, seen_gone, word, word_gone
        release_heap()
        return out

    return run


def level(count: np.ndarray) -> np.ndarray:
    """The bucket of a context's count: 0 for none, else 1 more than its power of two."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64)


def learn_weight(ratio: np.ndarray, weight: np.ndarray) -> float:
    """Expectation-maximisation for l in l * f + (1 - l) * q, given f / q of each held-out token."""
    if not weight.sum():
        return 0.5
    x = 0.5
    for _ in range(STEPS):
        x = float((weight * (x * ratio / (x * ratio + 1 - x))).sum() / weight.sum())
        x = min(max(x, 1e-6), 1 - 1e-6)
    return x


def _weights(rows: list) -> dict[int, float]:
    by_level: dict[int, list] = {}
    for r in rows:
        by_level.setdefault(r.level, []).append((0.0 if r.place == -(1 << 20) else 2.0 ** (r.place / BINS), r.weight))
    return {k: learn_weight(np.array([a for a, _ in v]), np.array([b for _, b in v], np.float64)) for k, v in by_level.items()}


PARTIAL = "part int, data binary"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _read_pairs(folder: str, bucket: int) -> list[np.ndarray]:
    """Names, and counts of bigram, context and word, of one bucket."""
    fs, base = file_system(folder)
    for f in fs.get_file_info(FileSelector(f"{base}/bucket={bucket}")):
        if f.type == FileType.File and f.base_name.endswith(".parquet"):
            with fs.open_input_file(f.path) as file:
                table = pq.read_table(file, columns=["counts"])
            for x in _blobs(table, "counts"):
                return unsqueeze(x, rising=1)
    raise FileNotFoundError(f"counts of bucket {bucket} in {folder}")


def _score(folder: str, model: dict, parts_out: int) -> Callable[[pa.Table], pa.Table]:
    """Of one bucket, or a part of it: chunk by chunk, the tokens of each document here and their sums of both models' log10
    probabilities. All sums of a chunk go to one part."""

    def run(table: pa.Table) -> pa.Table:
        names, both, seen, word = _read_pairs(folder, table.column("bucket")[0].as_py())
        q = model["m"] * word / max(1, model["n"]) + (1 - model["m"]) / (model["v"] + 1)
        lam = np.array([model["l"].get(k, model["l_other"]) if k else 0.0 for k in range(72)])[level(seen)]
        log = np.log10(lam * np.where(seen > 0, both / np.maximum(seen, 1), 0.0) + (1 - lam) * q)
        plain = np.log10((word + 1) / (model["n"] + 1 * (model["v"] + 1)))
        known = (word > 0).astype(np.float64)
        del both, seen, word, q, lam
        parts, out = [], []
        for x in _blobs(table):
            name, count, row, new, doc, null, (first, size) = unsqueeze(x, rising=1)
            at = np.searchsorted(names, name)
            if (names[np.minimum(at, len(names) - 1)] != name).any():
                raise ValueError("a bigram was not counted")
            at = np.repeat(at, count)
            n_tokens = np.bincount(row, minlength=size)
            some = np.flatnonzero(n_tokens)
            sums = [np.bincount(row, weights=value[at], minlength=size)[some] for value in (known, plain, log)]
            parts.append(int(mix(np.array([first]).astype(np.uint64))[0] % np.uint64(parts_out)))
            out.append(squeeze(some.astype(np.uint16), *(v.astype(np.uint32) for v in (n_tokens[some], sums[0])), *sums[1:], new, doc, null, np.array([first])))
        result = pa.table({"part": pa.array(parts, pa.int32()), "data": pa.array(out, pa.binary())})
        del names, log, plain, known, out
        release_heap()
        return result

    return run


def _sums(table: pa.Table) -> pa.Table:
    """Of one part of the chunks: one row for each document. Sums run in the order of the values, so reruns agree."""
    got, begun = [], []
    for x in _blobs(table):
        row, n_tokens, n_known, base, score, new, doc, null, first = unsqueeze(x)
        got.append((first[0] + row, n_tokens, n_known, base, score))
        begun.append((first[0] + new, doc, null))
    rid, n_tokens, n_known, base, score = (np.concatenate(v) for v in zip(*got, strict=True))
    begun, doc, null = (np.concatenate(v) for v in zip(*begun, strict=True))
    order = np.lexsort((score, base, rid))
    start = _runs(rid[order])
    out = {k: np.add.reduceat(v[order], start, dtype=kind) for k, v, kind in (("n_tokens", n_tokens, np.int64), ("n_known", n_known, np.int64), ("base_score", base, np.float64), ("score", score, np.float64))}
    order = np.argsort(begun)
    result = pa.table({"doc_id": pa.array(doc[order], mask=null[order].astype(bool)), **{k: pa.array(v) for k, v in out.items()}})
    del got, rid, n_tokens, n_known, base, score
    release_heap()
    return result


def fit(rows: DataFrame, folder: str, slices: int) -> dict:
    """Counts all training texts into folder (words by slice, bigrams by bucket) and learns the weights. rows: text, fold.

    The model's "hot" is a number of parts for each bucket that is dealt out; at most MOST_HOT buckets are."""
    spark = rows.sparkSession
    own = rows.select("text", "fold")
    words = own.mapInArrow(_count_words(slices), "slice int, sub int, names binary, kept binary, gone binary").groupBy("slice", "sub").applyInArrow(_merge_words, WORDS)
    with inner_settings(spark):
        words.repartition("slice").write.partitionBy("slice").parquet(f"{folder}/words")
    words = spark.read.schema(WORDS).parquet(f"{folder}/words")
    total = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_kept", "v_kept", "n", "v")]).first()
    model = {c: int(total[c]) for c in ("n_kept", "v_kept", "n", "v")}
    counts = words.groupBy("slice", "sub").applyInArrow(_uniform_ratio(model), "level long, place long, weight long")
    model["m"] = _weights(counts.groupBy("level", "place").agg(F.sum("weight").alias("weight")).collect()).get(0, 0.5)
    pairs = own.mapInArrow(_emit_counts(slices), "bucket int, data binary").groupBy("bucket").applyInArrow(_merge_pairs(f"{folder}/words", slices, model), PAIRS)
    with inner_settings(spark):
        pairs.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/pairs")
    pairs = spark.read.schema(PAIRS).parquet(f"{folder}/pairs")
    # One row for each power of two of the context's count and each place of the histogram: a few thousand at any size.
    ratios = pairs.select(F.explode("ratios").alias("r")).groupBy("r.level", "r.place").agg(F.sum("r.weight").alias("weight"))
    model["l"] = _weights(ratios.collect())
    known = [v for k, v in model["l"].items() if k]
    model["l_other"] = float(np.median(known)) if known else 0.5
    places = int(pairs.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0])
    bound = max(HOT_PLACES, places // MOST_HOT)
    model["hot"] = {r.bucket: -(-r.places // bound) for r in pairs.where(F.col("places") > bound).select("bucket", "places").collect()}
    return model


def lm_scores(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    Null and blank texts are the end token alone. A null doc_id is in no fold: it trains and is not held out. Repeated rows
    train and are scored each. Without training documents every probability is the uniform one of an empty vocabulary.
    Very long texts are scored whole, chunk by chunk. An empty table gives an empty result. Further columns, whatever their names,
    are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("fold", fold(F.col("doc_id"))).withColumn("rid", F.monotonically_increasing_id())
    slices = max(2, math.ceil(math.sqrt(text_bytes(docs) / BUCKET_BYTES)))
    with scratch(spark) as kept:
        folder = scratch_path(spark, "words")
        model = fit(rows, folder, slices)
        places = rows.mapInArrow(_emit_places(slices, model["hot"]), "bucket int, salt int, data binary")
        parts = places.groupBy("bucket", "salt").applyInArrow(_score(f"{folder}/pairs", model, max(16, slices * slices)), PARTIAL)
        scores = saved(parts.groupBy("part").applyInArrow(_sums, SCORES), "scores", keep=kept)
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    return scores.select("doc_id", held, "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score")
