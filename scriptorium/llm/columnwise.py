"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes with external files.

Round j inserts, for every text at once, the symbol j places before its end: the suffix that starts there goes to its place
among those already there. Each round reads the files of the round before from front to back and writes new ones, so memory
holds one entry a text, and work is rounds times size: the longest text's length times all bytes. in_pieces cuts texts first,
so that rounds are few. Both serve small collections; scriptorium.llm.repeats finds the same repeats on large ones.

Equal suffixes of different texts stand in the order of the texts. The end of a text is smaller than every byte.
"""

from __future__ import annotations

import os
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np

#: One suffix: the byte before it (-1 before the first), its common prefix with the suffix above, its text and start.
_ROW = struct.Struct("<hiii")
_BLOCK = 4096


def _read(path: str) -> Iterator[tuple[int, int, int, int]]:
    with open(path, "rb") as f:
        while block := f.read(_ROW.size * _BLOCK):
            yield from _ROW.iter_unpack(block)


class _Writer:
    def __init__(self, path: str):
        self.f, self.held = open(path, "wb"), []

    def add(self, *row: int) -> None:
        self.held.append(_ROW.pack(*row))
        if len(self.held) >= _BLOCK:
            self.f.write(b"".join(self.held))
            self.held = []

    def close(self) -> None:
        self.f.write(b"".join(self.held))
        self.f.close()


def build(texts: list[bytes], folder: str) -> tuple[list[int | None], list[int], list[tuple[int, int]]]:
    """(transform, common prefixes, (text, start)) of all suffixes, the empty ones included, in sorted order."""
    path = construct(texts, folder)
    rows = list(_read(path))
    return [None if b < 0 else b for b, *_ in rows], [p for _, p, _, _ in rows], [(d, i) for *_, d, i in rows]


def construct(texts: list[bytes], folder: str) -> str:
    """Builds the sorted suffixes; returns the file that holds them."""
    os.makedirs(folder, exist_ok=True)
    now, then = os.path.join(folder, "a"), os.path.join(folder, "b")
    out = _Writer(now)
    for d, t in enumerate(texts):
        out.add(t[-1] if t else -1, 0, d, len(t))
    out.close()
    place = list(range(len(texts)))  # where each text's newest suffix stands
    starts = np.zeros(256, np.int64)  # suffixes in the file by their first byte
    for j in range(1, max(map(len, texts), default=0) + 1):
        newest = {place[d]: d for d, t in enumerate(texts) if len(t) >= j}
        inserted, repaired = _places(now, newest, len(texts), starts)
        _merge(texts, now, then, inserted, repaired, j, place, starts)
        now, then = then, now
    return now


def _places(now: str, newest: dict[int, int], ends: int, starts: np.ndarray) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """One pass over the file: ([(place among the old suffixes, text, common prefix)], {place of an old suffix: its new common prefix}).

    Before a suffix c + S stand all that start with less than c, and of those that start with c as many as c occurs before old
    suffixes above S (the newest ones' extensions are only coming in). Its common prefix with the one above is 1 more than the
    least common prefix since c occurred last.
    """
    first = ends + np.cumsum(starts) - starts
    count, low, after_new = np.zeros(256, np.int64), np.full(256, -1, np.int64), np.zeros(256, bool)
    inserted, repaired = [], {}
    for at, (c, p, _, _) in enumerate(_read(now)):
        np.minimum(low, p, out=low, where=low >= 0)
        if c < 0:
            continue
        prefix, spot = int(low[c]) + 1, int(first[c] + count[c])
        if at in newest:
            inserted.append((spot, c, at, newest[at], prefix))
            after_new[c] = True
        else:
            if after_new[c]:
                repaired[spot], after_new[c] = prefix, False
            count[c] += 1
        low[c] = 1 << 30
    inserted.sort()
    return [(spot, d, prefix) for spot, _, _, d, prefix in inserted], repaired


def _merge(texts: list[bytes], now: str, then: str, inserted: list[tuple[int, int, int]], repaired: dict[int, int], j: int, place: list[int], starts: np.ndarray) -> None:
    """Writes the next file: the old suffixes with the new ones between them. Moves place and starts on."""
    out, k = _Writer(then), 0
    spots = [spot for spot, _, _ in inserted]

    def put_new(k: int) -> None:
        _, d, prefix = inserted[k]
        i = len(texts[d]) - j
        out.add(texts[d][i - 1] if i else -1, prefix, d, i)

    for at, (c, p, d, i) in enumerate(_read(now)):
        while k < len(inserted) and spots[k] == at:
            put_new(k)
            k += 1
        out.add(c, repaired.get(at, p), d, i)
    for rest in range(k, len(inserted)):
        put_new(rest)
    out.close()
    for d, old in enumerate(place):
        place[d] = old + bisect_right(spots, old)
    for k, (spot, d, _) in enumerate(inserted):
        place[d] = spot + k
        starts[texts[d][len(texts[d]) - j]] += 1


def repeated_bytes(texts: list[bytes], length: int, folder: str) -> list[np.ndarray]:
    """A mask for each text: the bytes that lie in a string of `length` bytes that also starts anywhere else."""
    path = construct(texts, folder)
    starts: list[list[int]] = [[] for _ in texts]
    previous = None
    for _, p, d, i in _read(path):
        if previous is not None and p >= length:
            starts[d].append(i)
            starts[previous[0]].append(previous[1])
        previous = (d, i)
    out = []
    for t, own in zip(texts, starts, strict=True):
        edge = np.zeros(len(t) + 1, np.int64)
        at = np.unique(np.array(own, np.int64))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        out.append(np.cumsum(edge[:-1]) > 0)
    return out


def in_pieces(texts: list[bytes], length: int, folder: str, step: int | None = None) -> list[np.ndarray]:
    """As repeated_bytes, in as many rounds as a piece has bytes: texts are cut every `step` bytes, into pieces of step + length - 1.

    A suffix that starts in the bytes a piece shares with the next is shorter than `length`, so it is never found twice. Rounds
    are whole-array operations on the files of the round before; common prefixes are kept up to 255, so `length` is 255 at most.
    """
    if not 0 < length < 256:
        raise ValueError("length must be 1 to 255")
    step = step or length
    cut = [(d, i) for d, t in enumerate(texts) for i in range(0, max(1, len(t) - length + 1), step)]
    pieces = [np.frombuffer(texts[d][i : i + step + length - 1], np.uint8) for d, i in cut]
    found = _grow(pieces, folder)
    hits = [[] for _ in texts]
    for piece, start in found(length):
        d, i = cut[piece]
        hits[d].append(i + start)
    out = []
    for t, own in zip(texts, hits, strict=True):
        edge = np.zeros(len(t) + 1, np.int64)
        np.add.at(edge, np.array(own, np.int64), 1)
        np.add.at(edge, np.array(own, np.int64) + length, -1)
        out.append(np.cumsum(edge[:-1]) > 0)
    return out


def _grow(pieces: list[np.ndarray], folder: str) -> Callable[[int], Iterator[tuple[int, int]]]:
    """Inserts one symbol a piece each round; the result gives (piece, start) of the suffixes that share so many symbols with another."""
    os.makedirs(folder, exist_ok=True)
    symbol, prefix = os.path.join(folder, "symbol"), os.path.join(folder, "prefix")
    ends, sizes = len(pieces), np.array([len(p) for p in pieces], np.int64)
    data, last = np.concatenate([*pieces, np.zeros(1, np.uint8)]), np.cumsum(sizes)
    np.where(sizes > 0, data[np.maximum(last - 1, 0)].astype(np.int16), np.int16(-1)).tofile(symbol)
    np.zeros(ends, np.uint8).tofile(prefix)
    place = np.arange(ends)
    for j in range(1, int(sizes.max(initial=0)) + 1):
        c, p = np.fromfile(symbol, np.int16), np.fromfile(prefix, np.uint8)
        live = np.flatnonzero(sizes >= j)
        owner = np.full(len(c), -1, np.int64)
        owner[place[live]] = live
        order = _by_symbol(c)
        fresh = owner[order] >= 0
        k = np.flatnonzero(fresh)
        meets = np.append(False, c[order[1:]] == c[order[:-1]])
        after = k[k + 1 < len(order)] + 1
        after = after[meets[after] & ~fresh[after]]
        spots = np.sort(np.concatenate([k, after]))  # of old suffixes, those right after a new one
        spots, alone = spots[meets[spots]], spots[~meets[spots]]
        least = _least(np.append(p, np.uint8(255)), order[spots - 1] + 1, order[spots] + 1, c[order[spots]])
        old = np.ones(len(c) + len(k), bool)
        old[ends + k] = False
        symbols, prefixes = np.empty(len(old), np.int16), np.empty(len(old), np.uint8)
        symbols[old], prefixes[old] = c, p
        who = owner[order[k]]
        symbols[ends + k] = np.where(sizes[who] > j, data[np.maximum(last[who] - j - 1, 0)].astype(np.int16), np.int16(-1))
        prefixes[ends + spots], prefixes[ends + alone] = np.minimum(least.astype(np.int16) + 1, 255), 0
        symbols.tofile(symbol)
        prefixes.tofile(prefix)
        place[who] = ends + k

    def found(length: int) -> Iterator[tuple[int, int]]:
        c, p = np.fromfile(symbol, np.int16), np.fromfile(prefix, np.uint8)
        order = _by_symbol(c)
        before = np.zeros(len(c), np.int64)  # where the suffix stands that is one symbol longer
        before[order] = ends + np.arange(len(order))
        hit = p >= length
        hit[:-1] |= hit[1:]
        row = np.arange(ends)
        for j in range(1, int(sizes.max(initial=0)) + 1):
            live = np.flatnonzero(sizes >= j)
            row[live] = before[row[live]]
            some = live[hit[row[live]]]
            yield from zip(some.tolist(), (sizes[some] - j).tolist(), strict=True)

    return found


def _by_symbol(c: np.ndarray) -> np.ndarray:
    """The rows that have a symbol before them, by symbol and place: the order of the suffixes one symbol longer."""
    own = np.flatnonzero(c >= 0)
    return own[np.argsort(c[own], kind="stable")]


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The least value of each span; those of one symbol come in order and don't overlap."""
    out = np.empty(len(begin), values.dtype)
    edges = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])) if len(symbol) else np.zeros(0, np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(symbol))[: len(edges)], strict=True):
        pairs = np.stack([begin[a:b][::-1], end[a:b][::-1]], 1).ravel()  # from the last on, so what lies between two spans is not gone through
        out[a:b] = np.minimum.reduceat(values, pairs)[::2][::-1]
    return out
