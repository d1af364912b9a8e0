"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The edit distance of word sequences is what counts (words lower-cased, ASCII punctuation at their ends dropped). A document
matches an item of W words if some stretch of it is within MAX_EDITS * W edits of the item; items under five words verbatim.

* Where windows are laid: an edit spoils two of an item's W - 1 word pairs at most, so of any 2 d + t of them t are unharmed in a
  match with d edits. Each item lists 2 d + t pairs, the rarest, and item-sized windows are laid at every place that can be the start of
  a stretch with t of them. No match is lost here.
* The CGK random walk (copy a symbol, then step on or stay by a coin that depends on the symbol and the output position) maps
  windows and items so that few edits give a small Hamming distance. Bit sampling reads K positions of the walk's output,
  REPEATS times in each of WALKS walks, and each reading is hashed into a bucket. Items lie in their buckets; a window is looked
  up there, and an item that it meets in any bucket is a candidate. TARGET_RECALL of the matches are found, or more.
* Candidates are verified by the exact edit distance of the item to the best stretch around the window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Words, longs, mix, saved, text_chunks
from scriptorium.llm.toxicity import form_hashes

MAX_EDITS = 0.2
#: K samples a reading, REPEATS readings a walk; more walks and readings find more, more samples pass less.
K, REPEATS, WALKS = 3, 6, 12
TARGET_RECALL = 0.97
#: Items of fewer words are matched verbatim.
LEAST_WORDS = 5
#: Pairs that a window's place needs (t above) at least, where an item has so many to spare; it lists all that no more than
#: COMMON_PAIR items have.
PAIRS, COMMON_PAIR = 3, 8
#: Items go to the executors in blocks of at most this many bytes of text, one scan a block.
ITEM_BLOCK_BYTES = 4 << 20
#: Windows that walk at once.
WALK_ROWS = 512
_Q = [np.uint64(pow(0xC2B2AE3D27D4EB4F, j, 1 << 64)) for j in range(16)]
_PAD = np.uint64(0x1234567)


class Items:
    """Benchmark items ready for the search: their words, short ones by length, rare pairs, and LSH buckets."""

    def __init__(self, ids: list[int], texts: list[str], max_edits: float = MAX_EDITS, least: int = LEAST_WORDS):
        raw = [t.encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        words = Words(data, off)
        h = form_hashes(data, words)
        own = [(item, h[words.first[i] : words.first[i + 1]]) for i, item in enumerate(ids)]
        self.ids, self.words = [i for i, w in own if len(w)], [w for _, w in own if len(w)]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.where(self.size < least, 0, (max_edits * self.size).astype(np.int64))
        self.needed = np.minimum(PAIRS, self.size - 1 - 2 * self.edits)
        verbatim = (self.size < least) | (self.needed < 1)
        self.short = {}
        for size in np.unique(self.size[verbatim]).tolist():
            which = np.flatnonzero(verbatim & (self.size == size))
            names = np.array([grams(self.words[k], size)[0] for k in which], np.uint64)
            order = np.argsort(names)
            self.short[size] = _Table(names[order], which[order])
        long = np.flatnonzero(~verbatim)
        pairs = [grams(self.words[k], 2) for k in long]
        common, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.unique(p) for p in pairs]]), return_counts=True)
        names, which, offset = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, p in zip(long, pairs, strict=True):
            rare = np.argsort(times[np.searchsorted(common, p)], kind="stable")
            if len(np.unique(p)) == len(p):
                often = times[np.searchsorted(common, p[rare])]
                rare = rare[: max(2 * int(self.edits[k]) + int(self.needed[k]), int((often <= COMMON_PAIR).sum()))]
                self.needed[k] = len(rare) - 2 * self.edits[k]
            else:
                self.needed[k] = len(p) - 2 * self.edits[k]  # an item that holds a pair twice lists all of them
            names.append(p[rare])
            which.append(np.full(len(rare), k))
            offset.append(rare)
        self.pairs = _Table.of(np.concatenate(names), np.concatenate(which), np.concatenate(offset))
        buckets, which = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at in range(0, len(long), WALK_ROWS):
            some = long[at : at + WALK_ROWS]
            width = int(self.size[some].max())
            grid = np.full((len(some), width), _PAD)
            for i, k in enumerate(some):
                grid[i, : self.size[k]] = self.words[k]
            names = bucket_names(grid, self.size[some], self.size[some])
            buckets.append(names.ravel())
            which.append(np.repeat(some, names.shape[1]))
        self.buckets = _Table.of(np.concatenate(buckets), np.concatenate(which))


class _Table:
    """Sorted hashes and an item for each; a bitmap keeps most others from the search."""

    def __init__(self, names: np.ndarray, which: np.ndarray, offset: np.ndarray | None = None):
        self.names, self.which, self.offset = names, which, offset
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(names >> np.uint64(44)).astype(np.int64)] = True

    @classmethod
    def of(cls, names: np.ndarray, which: np.ndarray, offset: np.ndarray | None = None) -> _Table:
        order = np.argsort(names, kind="stable")
        return cls(names[order], which[order], None if offset is None else offset[order])

    def hits(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in names, place in the table) of every hit."""
        some = np.flatnonzero(self.maybe[(names >> np.uint64(44)).astype(np.int64)])
        a, b = np.searchsorted(self.names, names[some], side="left"), np.searchsorted(self.names, names[some], side="right")
        hits = b - a
        at = np.repeat(a - (np.cumsum(hits) - hits), hits) + np.arange(int(hits.sum()))
        return np.repeat(some, hits), at

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in names, item) of every hit."""
        where, at = self.hits(names)
        return where, self.which[at]


def grams(h: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        out += h[j : j + len(out)] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j, 1 << 64))
    return mix(out)


def sample_plan(width: int) -> np.ndarray:
    """WALKS x REPEATS x K positions among the first 2 * width outputs (where walks of that width have not ended yet), fixed by width."""
    return np.random.RandomState(width % (1 << 32)).randint(0, 2 * width, size=(WALKS, REPEATS, K))


def walk_outputs(windows: np.ndarray, length: np.ndarray, steps: int) -> np.ndarray:
    """CGK: the first outputs of all walks over each row of windows, of which `length` symbols count; beyond them it pads."""
    n, width = windows.shape
    seeds = mix(np.arange(1, WALKS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    coins = mix(windows[None] ^ seeds[:, None, None])
    out = np.full((steps, WALKS, n), _PAD, np.uint64)
    at = np.zeros((WALKS, n), np.int64)
    walk, row = np.arange(WALKS)[:, None], np.arange(n)[None]
    for step in range(steps):
        inside = at < length[None]
        if not inside.any():
            break
        here = np.minimum(at, width - 1)
        out[step] = np.where(inside, windows[row, here], _PAD)
        at += ((coins[walk, row, here] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64) & inside
    return out


def bucket_names(windows: np.ndarray, length: np.ndarray, size: np.ndarray) -> np.ndarray:
    """WALKS * REPEATS bucket hashes of each row: its samples, by the plan of its item's size, with walk, reading and size."""
    out = walk_outputs(windows, length, 2 * int(size.max()))
    names = np.zeros((len(windows), WALKS, REPEATS), np.uint64)
    for s in np.unique(size).tolist():
        rows, plan = np.flatnonzero(size == s), sample_plan(s)
        for walk in range(WALKS):
            for reading in range(REPEATS):
                total = np.full(len(rows), (s * WALKS + walk) * REPEATS + reading, np.uint64)
                for j, p in enumerate(plan[walk, reading]):
                    total = total * np.uint64(0x9E3779B97F4A7C15) + out[p, walk, rows] * _Q[j + 1]
                names[rows, walk, reading] = mix(total)
    return names.reshape(len(windows), -1)


def window_places(items: Items, h: np.ndarray, first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the item-sized windows that may match: those that some item's listed pairs allow."""
    where, at = items.pairs.hits(grams(h, 2))
    same = row[where] == row[where + 1]
    where, item, offset = where[same], items.pairs.which[at[same]], items.pairs.offset[at[same]]
    # Hits of one item side by side; of each, whether they are at enough places within the item's size and its edits.
    order = np.lexsort((where, item))
    where, item, offset = where[order], item[order], offset[order]
    key = item * np.int64(len(h) + 1) + where
    reach = np.minimum(where + items.size[item] + items.edits[item], first[row[where] + 1])
    places, end = np.unique(key), item * np.int64(len(h) + 1) + reach
    some = np.flatnonzero(np.searchsorted(places, end) - np.searchsorted(places, key) >= items.needed[item])
    # Of those that pass, whether they are of enough different pairs too: a word said over and over is one pair.
    from_, count = np.searchsorted(key, key[some]), np.searchsorted(key, end[some]) - np.searchsorted(key, key[some])
    which = np.repeat(np.arange(len(some)), count)
    seen = np.unique(which << 32 | offset[np.repeat(from_ - (np.cumsum(count) - count), count) + np.arange(len(which))])
    some = some[np.bincount(seen >> 32, minlength=len(some)) >= items.needed[item[some]]]
    where, item, offset = where[some], item[some], offset[some]
    # Edits before an unharmed pair shift it by as many words as they are, at most.
    shifts = 2 * items.edits[item] + 1
    which = np.repeat(np.arange(len(where)), shifts)
    shift = np.arange(len(which)) - np.repeat(np.cumsum(shifts) - shifts, shifts) - items.edits[item][which]
    low, high = first[row[where]][which], first[row[where] + 1][which]
    start, size = np.maximum((where - offset)[which] + shift, low), items.size[item][which]
    fits = start < high
    spot = np.unique(np.stack([start[fits], size[fits]], 1), axis=0)
    return spot[:, 0], spot[:, 1]


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of text that is nearest to item; the first of the nearest by end."""
    n = len(text)
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for i, w in enumerate(item, 1):
        change, drop = row[:-1] + (text != w), row[1:] + 1
        best = np.concatenate([[i], np.minimum(change, drop)])
        origin = np.concatenate([[0], np.where(change <= drop, begin[:-1], begin[1:])])
        lowest = np.minimum.accumulate(best - steps)
        source = np.maximum.accumulate(np.where(best - steps == lowest, steps, 0))
        row, begin = lowest + steps, origin[source]
    end = int(row.argmin())
    return int(row[end]), int(begin[end]), end


def candidates(items: Items, h: np.ndarray, first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, item) of the windows that meet an item in a bucket."""
    start, size = window_places(items, h, first, row)
    found = [np.zeros((0, 2), np.int64)]
    order = np.argsort(size, kind="stable")
    for at in range(0, len(order), WALK_ROWS):
        some = order[at : at + WALK_ROWS]
        s, w = start[some], size[some]
        length = np.minimum(w, first[row[s] + 1] - s)
        step = np.arange(int(w.max()))
        windows = np.where(step[None] < length[:, None], h[np.minimum(s[:, None] + step[None], len(h) - 1)], _PAD)
        names = bucket_names(windows, length, w)
        place, item = items.buckets.find(names.ravel())
        found.append(np.unique(np.stack([s[place // names.shape[1]], item], 1), axis=0))
    hits = np.concatenate(found)
    return hits[:, 0], hits[:, 1]


def find(items: Items, h: np.ndarray, row: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first word, last word + 1, edits): the best match of each item in each row."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for size, table in items.short.items():
        at, item = table.find(grams(h, size))
        whole = row[at] == row[at + size - 1]
        for k, a in zip(item[whole].tolist(), at[whole].tolist(), strict=True):
            found.setdefault((int(row[a]), k), (0, a, a + size))
    start, item = candidates(items, h, first, row)
    order = np.lexsort((start, item))
    start, item = start[order], item[order]
    size, edits = items.size[item], items.edits[item]
    low, high = np.maximum(first[row[start]], start - edits), np.minimum(first[row[start] + 1], start + size + edits)
    # Windows of one item that overlap are one region, gone through once.
    new = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (low[1:] >= high[:-1]))[: len(item)])
    for a, b in zip(new.tolist(), np.append(new[1:], len(item))[: len(new)].tolist(), strict=True):
        k, r = int(item[a]), int(row[start[a]])
        best = found.get((r, k), (int(edits[a]) + 1, 0, 0))
        if best[0] == 0:
            continue
        dist, x, y = edit_distance(items.words[k], h[low[a] : high[b - 1]])
        if dist < best[0]:
            found[r, k] = (dist, int(low[a]) + x, int(low[a]) + y)
    return [(r, k, a, b, dist) for (r, k), (dist, a, b) in sorted(found.items())]


HITS = "doc_id long, item_id long, start long, end long, edits int, item_words int"


def _scan(items: Items, keep_clean: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in text_chunks(batches):
            words = Words(data, off)
            hits = find(items, form_hashes(data, words), words.row, words.first) if len(words.start) else []
            if keep_clean:
                dirty = {r for r, *_ in hits}
                yield rows.filter(pa.array([i not in dirty for i in range(rows.num_rows)], pa.bool_()))
                continue
            ids, valid = longs(rows, "doc_id"), rows.column(0).is_valid().to_numpy(zero_copy_only=False)
            cols = [[int(ids[r]) if valid[r] else None for r, *_ in hits], [items.ids[k] for _, k, *_ in hits], [int(words.start[a] - off[r]) for r, _, a, _, _ in hits], [int(words.end[b - 1] - off[r]) if b > a else int(words.start[a] - off[r]) for r, _, a, b, _ in hits], [e for *_, e in hits], [len(items.words[k]) for _, k, *_ in hits]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "start", "end", "edits", "item_words"])

    return run


def item_blocks(benchmark: DataFrame, limit: int | None = None) -> Iterator[tuple[Items, bool]]:
    """The benchmark in blocks of bounded size, one at a time, and whether there are several."""
    own = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    size = int(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = -(-size // (limit or ITEM_BLOCK_BYTES)) or 1
    for b in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield Items([r.item_id for r in rows], [r.text for r in rows]), blocks > 1


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that match: doc_id, item_id, start and end (UTF-8 byte offsets), edits, item_words.

    Null and blank texts, items without words, and null items match nothing. Documents without a match have no row;
    a null doc_id is reported as null; repeated rows are reported each. An empty benchmark or table gives an empty result. Very long
    texts are searched whole; further columns are not read. Where the benchmark has several blocks each one's hits are written
    before the next is taken up, so the driver holds one block.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for items, several in item_blocks(benchmark):
        part = own.mapInArrow(_scan(items, False), HITS)
        part = saved(part, "hits") if several else part
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item, with all their columns, whatever their names; each as often as it came.

    Null and blank texts match nothing and stay, and so does a document without a doc_id that is clean. An empty benchmark, or one
    of null and blank items, leaves all documents; an empty table gives an empty result. Very long texts are searched whole.
    """
    for items, several in item_blocks(benchmark):
        clean = docs.mapInArrow(_scan(items, True), docs.schema)
        docs = saved(clean, "clean") if several else clean
    return docs
