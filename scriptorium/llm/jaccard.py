"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct five-word shingles, each a 64-bit hash. Toggling (XOR) one code per shingle into
sketches gives two lower bounds of the symmetric difference of two sets:

* block sketches: the hash space of a size band is cut into blocks, and each block keeps the XOR of its shingles' hashes.
  Every differing shingle changes one block at most, so sets with a symmetric difference of d share all but d blocks;
  by the pigeonhole principle the first d + 1 non-empty blocks in one common order have a member in common.
  These are the join keys; a document uses the blocks of its own band and, where its partners may be larger, of the next;
* bit sketches: four to eight bits a shingle, looked at folded to a quarter first; their Hamming distance is at most the symmetric difference.
  Pairs from the join whose distance exceeds (|A| + |B|) / 7 cannot reach 0.75 and go.

What stays is verified on the shingle sets themselves. Groups of documents that share a key never become all pairs:
a large group first proposes one likely partner for each member, those links are verified and merged into components, and
only pairs between different components that pass the bit sketches are verified after that.

Keys go to their buckets as packed arrays, six bytes a key, not as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Words, bucket_count, columns_only, longs, mix, saved, scratch, text_bytes, text_chunks
from scriptorium.llm.components import connected_components, join_groups

SHINGLE = 5
#: Bands below this level (sets under 128 shingles) use each shingle as a block of its own: too few blocks to rely on averages.
FIRST_BLOCK_LEVEL = 7
#: Groups up to this size propose all their pairs at once; larger ones start with so many hubs.
SMALL_GROUP, HUBS = 16, 8
#: Of the groups of four and more, one in so many is gone through before components are known. All are gone through after.
EARLY_SHARE = 8
_Q = [np.uint64(pow(0xD6E8FEB86659FD93, j, 1 << 64)) for j in range(64)]


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the sorted distinct shingle hashes of each row after another, and how many each row has."""
    h, rows = words.hash, len(words.count)
    n = len(h)
    grams = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        grams += h[j : j + len(grams)] * _Q[j]
    whole = np.flatnonzero(words.row[: len(grams)] == words.row[k - 1 :][: len(grams)])
    out, at = [mix(grams[whole])], [words.row[whole]]
    for c in range(1, k):
        short = np.flatnonzero(words.count == c)
        if len(short):
            first, total = words.first[short], np.full(len(short), c, np.uint64)
            for j in range(c):
                total = total + h[first + j] * _Q[j]
            out.append(mix(mix(total)))
            at.append(short)
    hashes, row = np.concatenate(out), np.concatenate(at)
    if len(out) > 1:
        order = np.argsort(row, kind="stable")
        hashes, row = hashes[order], row[order]
    edge = np.searchsorted(row, np.arange(rows + 1))
    sets = [np.unique(hashes[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def _levels(sizes: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(sizes, 1).astype(np.float64))[1].astype(np.int64) - 1


def _bits(level: int | np.ndarray) -> int | np.ndarray:
    return np.maximum(64, 8 << np.asarray(level, np.int64))


def bit_sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The parity sketch of each row: 4 to 8 bits a shingle, 64 at least."""
    bits = _bits(_levels(sizes))
    base = np.concatenate([[0], np.cumsum(bits)])
    width = np.repeat(bits, sizes).astype(np.uint64)
    where = np.repeat(base[:-1], sizes) + (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) & (width - np.uint64(1))).astype(np.int64)
    packed = np.packbits((np.bincount(where, minlength=int(base[-1])) & 1).astype(np.uint8))
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(base[:-1], base[1:], strict=True)]


def _first_blocks(hashes: np.ndarray, row: np.ndarray, level: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the first differ + 1 blocks of each row at its level: blocks with most shingles first, then by key."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lv = level[row]
    coarse = lv >= FIRST_BLOCK_LEVEL
    block = np.where(coarse, hashes >> (np.uint64(64) - np.minimum(lv, 63).astype(np.uint64)), hashes)
    new = np.empty(len(hashes), bool)
    new[0] = True
    new[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
    start = np.flatnonzero(new)
    inside = np.diff(np.append(start, len(hashes)))
    key = mix(np.bitwise_xor.reduceat(hashes, start) ^ mix(block[start] * np.uint64(64) + lv[start].astype(np.uint64)))
    owner = row[start]
    order = np.argsort((owner.astype(np.uint64) << np.uint64(40)) | ((255 - np.minimum(inside, 255)).astype(np.uint64) << np.uint64(32)) | (key >> np.uint64(32)), kind="stable")
    owner, key = owner[order], key[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    keep = rank <= differ[owner]
    return owner[keep], key[keep]


def block_keys(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all join keys. A partner has 3/4 to 4/3 of a set's size, and a pair is joined at the larger one's level."""
    row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    level, largest = _levels(sizes), sizes * 4 // 3
    top = (np.int64(2) << level) - 1
    own = _first_blocks(hashes, row, level, (sizes + np.minimum(largest, top)) // 7)
    up = (largest > top)[row]
    more = _first_blocks(hashes[up], row[up], level + 1, (sizes + largest) // 7)
    return np.concatenate([own[0], more[0]]), np.concatenate([own[1], more[1]])


def pack(bucket: np.ndarray, code: np.ndarray, row: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, bytes): for each bucket its 32-bit codes and whose they are. Rows number under 65,536."""
    order = np.lexsort((row, bucket))
    bucket, code, row = bucket[order], code[order], row[order]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(start, np.append(start[1:], len(bucket))[: len(start)], strict=True):
        r = row[a:b]
        new = np.append(True, r[1:] != r[:-1])
        head = np.array([int(new.sum()), b - a], np.uint32).tobytes()
        yield int(bucket[a]), head + ids[r[new]].tobytes() + code[a:b].astype(np.uint32).tobytes() + (np.cumsum(new) - 1).astype(np.uint16).tobytes()


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    codes, docs = [], []
    for x in blobs:
        n_docs, n = np.frombuffer(x, np.uint32, 2)
        ids = np.frombuffer(x, np.int64, n_docs, 8)
        codes.append(np.frombuffer(x, np.uint32, n, 8 + 8 * int(n_docs)))
        docs.append(ids[np.frombuffer(x, np.uint16, n, 8 + 8 * int(n_docs) + 4 * int(n))])
    return (np.concatenate(codes), np.concatenate(docs)) if codes else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


EMIT = "bucket int, kind int, doc_id long, n_shingles long, digest long, data binary"


def _emit(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of kind 0, one a document, and packed keys of kind 1. Of equal sets in one task the first alone emits its keys: they stand
    for one another later, and so a text that a third of all documents share has as many keys as there are tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for rows, data, off in text_chunks(batches):
            ids = longs(rows, "doc_id")
            has_id = rows.column(0).is_valid().to_numpy(zero_copy_only=False)
            hashes, sizes = shingle_sets(Words(data, off))
            sketches = bit_sketches(hashes, sizes)
            spread = (mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            edge = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes))])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            digest = (edge[ends[1:]] - edge[ends[:-1]]).view(np.int64)
            out = [(int(spread[i]), 0, int(ids[i]) if has_id[i] else None, int(sizes[i]), int(digest[i]), sketches[i]) for i in range(len(ids))]
            first = np.zeros(len(ids), bool)
            for i in np.flatnonzero(has_id & (sizes > 0)).tolist():
                if (name := (int(sizes[i]), int(digest[i]))) not in seen:
                    seen.add(name)
                    first[i] = True
            some = np.flatnonzero(first)
            row, key = block_keys(hashes[np.repeat(first, sizes)], sizes[some])
            row = some[row]
            bucket = ((key & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
            out += [(b, 1, None, None, None, blob) for b, blob in pack(bucket, key >> np.uint64(32), row, ids)]
            for a in range(0, len(out), 2000):
                part = list(zip(*out[a : a + 2000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.int64()), pa.array(part[4], pa.int64()), pa.array(part[5], pa.binary())], names=["bucket", "kind", "doc_id", "n_shingles", "digest", "data"])

    return run


REDUCED = "kind int, gid long, doc_id long, n_shingles long, sketch binary"


def _groups(table: pa.Table) -> pa.Table:
    """Of one bucket: the rows of kind 0 as they are (their digest as gid); of the keys that several documents have, each distinct group once."""
    kind = table.column("kind").to_numpy()
    info = table.filter(pa.array(kind == 0))
    codes, docs = unpack(table.filter(pa.array(kind == 1)).column("data").to_pylist())
    order = np.argsort(codes, kind="stable")
    codes, docs = codes[order], docs[order]
    same = codes[1:] == codes[:-1] if len(codes) else np.zeros(0, bool)
    shared = np.zeros(len(codes), bool)
    shared[1:] |= same
    shared[:-1] |= same
    codes, docs = codes[shared], docs[shared]
    gid, member = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(codes):
        order = np.lexsort((docs, codes))
        codes, docs = codes[order], docs[order]
        fresh = np.append(True, (codes[1:] != codes[:-1]) | (docs[1:] != docs[:-1]))
        codes, docs = codes[fresh], docs[fresh]
        start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        size = np.diff(np.append(start, len(codes)))
        name = mix(np.add.reduceat(mix(docs.astype(np.uint64)), start) ^ size.astype(np.uint64))
        _, first = np.unique(name, return_index=True)
        first = first[size[first] > 1]
        keep = np.zeros(len(start), bool)
        keep[first] = True
        wide = np.repeat(keep, size)
        gid, member = np.repeat(name, size)[wide].view(np.int64), docs[wide]
    n = len(gid)
    return pa.table(
        {
            "kind": pa.concat_arrays([pa.array(np.zeros(info.num_rows, np.int32)), pa.array(np.ones(n, np.int32))]),
            "gid": pa.concat_arrays([info.column("digest").combine_chunks().cast(pa.int64()), pa.array(gid)]),
            "doc_id": pa.concat_arrays([info.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(member)]),
            "n_shingles": pa.concat_arrays([info.column("n_shingles").combine_chunks().cast(pa.int64()), pa.nulls(n, pa.int64())]),
            "sketch": pa.concat_arrays([info.column("data").combine_chunks().cast(pa.binary()), pa.nulls(n, pa.binary())]),
        }
    )


def _distances(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    total = np.zeros((len(one), len(other)), np.int32)
    for w in range(one.shape[1]):
        total += np.bitwise_count(one[:, w, None] ^ other[None, :, w])
    return total


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """A wider parity sketch folds onto a narrower one by XOR of its halves."""
    while bits.shape[1] > width:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


class Group:
    """Members of one group, by size; bit sketches are kept by width, as widths differ by band."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, sketches: list[bytes]):
        order = np.lexsort((ids, sizes))
        self.ids, self.sizes = ids[order], sizes[order]
        widths = np.array([len(s) // 8 for s in sketches])[order]  # ascend with the sizes
        self.edges = [0, *(np.flatnonzero(widths[1:] != widths[:-1]) + 1).tolist(), len(ids)]
        self.bits = [np.frombuffer(b"".join(sketches[i] for i in order[a:b]), np.uint64).reshape(b - a, -1) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        self.order = order

    def near(self, some: np.ndarray, since: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, distance) of pairs of a member in some (ascending) with any from since on that may reach the threshold."""
        for k, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            mine = some[(some >= a) & (some < b)]
            for at in range(0, len(mine), 256):
                me = mine[at : at + 256]
                low, high = self.sizes[me[0]] * 3 // 4, self.sizes[me[-1]] * 4 // 3
                for m, (c, d) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
                    c = max(c, since, int(np.searchsorted(self.sizes, low)))
                    d = min(d, int(np.searchsorted(self.sizes, high, side="right")))
                    if c >= d:
                        continue
                    width = min(self.bits[k].shape[1], self.bits[m].shape[1])
                    one, other = _fold(self.bits[k][me - a], width), _fold(self.bits[m][c - self.edges[m] : d - self.edges[m]], width)
                    dist = _distances(_fold(one, max(1, width // 4)), _fold(other, max(1, width // 4)))
                    x, y = self.sizes[me][:, None], self.sizes[None, c:d]
                    i, j = np.nonzero((7 * dist <= x + y) & (4 * np.minimum(x, y) >= 3 * np.maximum(x, y)))
                    for at2 in range(0, len(i), 4096):
                        ii, jj = i[at2 : at2 + 4096], j[at2 : at2 + 4096]
                        full = np.bitwise_count(one[ii] ^ other[jj]).sum(1, dtype=np.int64)
                        keep = 7 * full <= self.sizes[me[ii]] + self.sizes[jj + c]
                        yield me[ii[keep]], jj[keep] + c, full[keep]


def first_pairs(group: Group) -> Iterator[tuple[int, int]]:
    """All pairs of a small group that may reach the threshold; of a larger one each member's best among HUBS members and its two neighbours by size."""
    n = len(group.ids)
    if n <= SMALL_GROUP:
        for i, j, _ in group.near(np.arange(n)):
            keep = i < j
            yield from zip(group.ids[i[keep]].tolist(), group.ids[j[keep]].tolist(), strict=True)
        return
    hubs = np.unique(np.linspace(0, n - 1, HUBS).astype(np.int64))
    best, whose = np.full(n, np.iinfo(np.int32).max, np.int64), np.full(n, -1)
    for i, j, d in group.near(hubs):
        for h in np.unique(i):
            own = i == h
            jj, dd = j[own], d[own]
            better = (dd < best[jj]) & (jj != h)
            best[jj[better]], whose[jj[better]] = dd[better], h
    some = np.flatnonzero(whose >= 0)
    yield from zip(group.ids[some].tolist(), group.ids[whose[some]].tolist(), strict=True)
    for at in range(0, n, 64):  # neighbours: a narrow band of the matrix
        part = np.arange(at, min(at + 65, n))
        sub = Group(group.ids[part], group.sizes[part], [group.bits[np.searchsorted(group.edges, i, side="right") - 1][i - group.edges[np.searchsorted(group.edges, i, side="right") - 1]].tobytes() for i in part])
        for i, j, _ in sub.near(np.arange(len(part))):
            keep = j == i + 1
            yield from zip(sub.ids[i[keep]].tolist(), sub.ids[j[keep]].tolist(), strict=True)


def cross_pairs(group: Group, parts: np.ndarray, best_only: bool) -> Iterator[tuple[int, int]]:
    """Pairs between different parts that may reach the threshold: all, or each member's nearest.

    Members of the largest part are only met, never compared among themselves.
    """
    parts = parts[group.order]
    names, counts = np.unique(parts, return_counts=True)
    largest = names[counts.argmax()]
    best, whose = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), -1)
    for i, j, d in group.near(np.flatnonzero(parts != largest)):
        keep = (parts[i] != parts[j]) & (best_only | (parts[j] == largest) | (i < j))
        i, j, d = i[keep], j[keep], d[keep]
        if not best_only:
            yield from zip(group.ids[i].tolist(), group.ids[j].tolist(), strict=True)
            continue
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        i, j, d = i[first], j[first], d[first]
        better = d < best[i]
        best[i[better]], whose[i[better]] = d[better], j[better]
    some = np.flatnonzero(whose >= 0)
    yield from zip(group.ids[some].tolist(), group.ids[whose[some]].tolist(), strict=True)


def _propose(with_parts: bool, best_only: bool = False) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        gid = table.column("gid").to_numpy()
        order = np.argsort(gid, kind="stable")
        gid = gid[order]
        ids, sizes = table.column("doc_id").to_numpy()[order], table.column("n_shingles").to_numpy()[order]
        parts = table.column("component").to_numpy()[order] if with_parts else None
        sketch = table.column("sketch").to_pylist()
        found: set[tuple[int, int]] = set()
        start = np.flatnonzero(np.append(True, gid[1:] != gid[:-1])) if len(gid) else np.zeros(0, np.int64)
        for a, b in zip(start, np.append(start[1:], len(gid))[: len(start)], strict=True):
            group = Group(ids[a:b], sizes[a:b], [sketch[i] for i in order[a:b]])
            for x, y in first_pairs(group) if parts is None else cross_pairs(group, parts[a:b], best_only):
                if x != y:
                    found.add((min(x, y), max(x, y)))
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in text_chunks(batches):
        hashes, sizes = shingle_sets(Words(data, off))
        edge = np.concatenate([[0], np.cumsum(sizes)])
        blobs = [hashes[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(longs(rows, "doc_id")), pa.array(blobs, pa.binary())], names=["doc_id", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                if x.equals(y):
                    keep.append(x.size > 0)
                    continue
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= 75 * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets reach the threshold. Only documents that occur in a pair are read again."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = saved(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "doc_id long, shingles binary"), "shingles")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long").distinct()


def _equal_sets(info: DataFrame) -> DataFrame:
    """(a, b): every document but the first of those with the same size and digest, with the first."""
    some = info.where("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "digest")
    first = some.groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("size")).where("a < z").select("n_shingles", "digest", "a", "size")
    joined = join_groups(some, saved(first, "first"), ["n_shingles", "digest"], some.count())
    return joined.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()


def _distinct_groups(members: DataFrame) -> DataFrame:
    """(gid, doc_id) -> the same with size, without groups of one and with each set of members once."""
    members = saved(members, "named")
    sets = members.groupBy("gid").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("name"), F.sum(F.col("doc_id").cast("decimal(38,0)")).alias("total")).where("size > 1")
    own = saved(sets.groupBy("size", "name", "total").agg(F.min("gid").alias("gid")).select("gid", "size"), "sets")
    return join_groups(members, own, ["gid"], members.count()).select("gid", "doc_id", "size")


def joined_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> the table of REDUCED: a row for each document, and the distinct groups of documents that share a key."""
    docs = columns_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return saved(docs.mapInArrow(_emit(_buckets(docs)), EMIT).groupBy("bucket").applyInArrow(_groups, REDUCED), "groups")


def _buckets(docs: DataFrame) -> int:
    return bucket_count(text_bytes(docs) // 4)


def jaccard_links(docs: DataFrame, reduced: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sizes, links): (doc_id, n_shingles) of every row, and verified links (a, b), a < b, that connect every component of the full join.

    Documents with equal sets stand for one another. Pairs and triples that share a key, and a share of the larger groups, are
    verified first. Then only groups that still hold several components are gone through, across components alone: first each
    member's nearest, to merge what belongs together, then all pairs that are left and were not verified yet.
    """
    docs = columns_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    reduced = joined_keys(docs) if reduced is None else reduced
    buckets = bucket_count(16 * int(reduced.where("kind = 1").count()))  # of what goes through groups: a member is about so large
    info = reduced.where("kind = 0").select("doc_id", "n_shingles", F.col("gid").alias("digest"), "sketch")
    equal = saved(_equal_sets(info), "equal")
    sketches = info.where("doc_id is not null and n_shingles > 0").join(equal.select(F.col("b").alias("doc_id")), "doc_id", "left_anti").select("doc_id", "n_shingles", "sketch").dropDuplicates(["doc_id"])
    members = reduced.where("kind = 1").select("gid", F.col("doc_id").alias("b")).join(equal, "b", "left").select("gid", F.coalesce("a", "b").alias("doc_id")).distinct()
    members = saved(_distinct_groups(members), "members")
    total = members.count()
    deal = F.pmod(F.xxhash64("gid"), F.lit(buckets)).alias("deal")
    early = members.where((F.col("size") <= 3) | (F.pmod("gid", F.lit(EARLY_SHARE)) == 0)).select("gid", "doc_id").join(sketches, "doc_id")
    pairs = saved(early.groupBy(deal).applyInArrow(_propose(False), "a long, b long").distinct(), "pairs")
    links = saved(verified(docs, pairs), "links")
    for best_only in (True, False):
        parts = connected_components(links)
        late = saved(members.select("gid", "doc_id").join(parts, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "late")
        mixed = late.groupBy("gid").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size")).where("least < most").select("gid", "size")
        late = join_groups(late, saved(mixed, "mixed"), ["gid"], total).drop("size").join(sketches, "doc_id")
        rest = saved(late.groupBy(deal).applyInArrow(_propose(True, best_only), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        links, pairs = links.unionAll(saved(verified(docs, rest), "links")), pairs.unionAll(rest)
    return info.select("doc_id", "n_shingles"), links.unionAll(equal)


NODE = "jaccard_node"


def by_text(docs: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(docs with NODE, names, keys): NODE is the doc_id, or a hash of id and text where one id comes with texts of different words.

    names (NODE, real_id) has the nodes that are not their doc_id, None where there are none, which is the rule; keys are joined_keys of
    the nodes. Whether ids clash is seen from the documents' rows among the keys, so texts are not read for it.
    """
    doc_id = F.col("doc_id").cast("long")
    plain = docs.withColumn(NODE, doc_id)
    keys = joined_keys(docs)
    sets = F.struct("n_shingles", "gid")
    clashing = keys.where("kind = 0 and doc_id is not null").groupBy("doc_id").agg(F.min(sets).alias("least"), F.max(sets).alias("most"))
    clashing = saved(clashing.where("least <> most").select(F.col("doc_id").alias("clash_id")), "clashing", keep=keep)
    if clashing.isEmpty():
        return plain, None, keys
    hashed = F.xxhash64(F.lit("node"), doc_id, F.coalesce("text", F.lit("")))
    keyed = docs.join(clashing, doc_id == F.col("clash_id"), "left").withColumn(NODE, F.when(F.col("clash_id").isNotNull(), hashed).otherwise(doc_id)).drop("clash_id")
    names = columns_only(keyed, NODE, "doc_id").where(f"{NODE} <> doc_id").select(NODE, doc_id.alias("real_id")).distinct()
    return keyed, saved(names, "names", keep=keep), joined_keys(columns_only(keyed, NODE, "text").withColumnRenamed(NODE, "doc_id"))


def _named(parts: DataFrame, names: DataFrame | None) -> DataFrame:
    """(doc_id, component) of nodes -> (node, real_id, component_id, first): the smallest doc_id of its component, and that one's node."""
    rows = parts.select(F.col("doc_id").alias("node"), "component")
    if names is None:
        return rows.select("node", F.col("node").alias("real_id"), F.col("component").alias("component_id"), F.col("component").alias("first"))
    rows = saved(rows.join(names.select(F.col(NODE).alias("node"), "real_id"), "node", "left").withColumn("real_id", F.coalesce("real_id", "node")), "named")
    least = saved(rows.groupBy("component").agg(F.min(F.struct("real_id", "node")).alias("least"), F.count("*").alias("size")), "least")
    return join_groups(rows, least, ["component"], rows.count()).select("node", "real_id", F.col("least.real_id").alias("component_id"), F.col("least.node").alias("first"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """documents -> one row each: doc_id, n_shingles, component_id (the smallest doc_id reachable by links of similarity >= 0.75).

    Null and blank texts: size 0, linked with nothing. Fewer than five words: the whole sequence is the one shingle.
    A null doc_id can't be linked: its component_id is null. Repeated rows come out as often as they came in; rows of one doc_id
    and the same words are one node of the graph, rows of one doc_id and different ones a node each. Very long texts are taken whole. An
    empty table gives an empty result. Further columns, whatever their names, are not read.
    """
    with scratch(docs.sparkSession) as kept:
        keyed, names, keys = by_text(columns_only(docs, "doc_id", "text"))
        info, links = jaccard_links(keyed.select(F.col(NODE).alias("doc_id"), "text"), keys)
        parts = _named(connected_components(links), names)
        rows = info.withColumnRenamed("doc_id", "node").join(parts.select("node", "component_id"), "node", "left")
        if names is None:
            rows = rows.withColumn("doc_id", F.col("node"))
        else:
            rows = rows.join(names.select(F.col(NODE).alias("node"), "real_id"), "node", "left").withColumn("doc_id", F.coalesce("real_id", "node"))
        return saved(rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "components", keep=kept)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component, with all its columns, whatever their names.

    Of rows that share a doc_id and all their words one stays; rows that share a doc_id alone are documents of their own. Documents without words (null, empty
    or blank texts) and those without a doc_id are linked with nothing and stay. Very long texts are taken whole. An empty table stays empty.
    """
    with scratch(docs.sparkSession) as kept:
        keyed, names, keys = by_text(docs, keep=kept)
        _, links = jaccard_links(columns_only(keyed, NODE, "text").select(F.col(NODE).alias("doc_id"), "text"), keys)
        gone = _named(connected_components(links), names).where("node <> first").select(F.col("node").alias(NODE))
        gone = saved(gone, "copies", keep=kept)
    left = keyed.join(gone, NODE, "left_anti")
    return left.where(f"{NODE} is null").unionByName(left.where(f"{NODE} is not null").dropDuplicates([NODE])).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS c FROM ways UNION SELECT w.b, r.c FROM reach r JOIN ways w ON w.a = r.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1) r ON r.doc_id = d.doc_id
"""
