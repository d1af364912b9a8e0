"""Token ids in Re-Pair compressed shard files.

Texts are encoded with a public tokenizer; documents go to shards by ranges of doc_id. In each shard frequent pairs of ids are
replaced by new symbols, round after round; a file keeps the rules, each rule's expansion length, and for each document where its
symbols and its ids begin, so one document, or a range of its ids, is decoded without the rest.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.common import _LOWER, forget, held, longs, mix, release_heap, saved, scratch_path, text_bytes, text_chunks
from scriptorium.llm.warc import file_system

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARD_BYTES, MOST_SHARDS = 5 << 20, 262_144
#: How often a pair must be replaced to earn a rule.
LEAST_USES = 8
#: Text that is encoded at once.
ENCODE_BYTES = 2 << 20
#: Distinct words whose ids a worker remembers, from task to task, before it starts anew; in a table of 2**TABLE_BITS slots.
CACHE_WORDS, TABLE_BITS = 1_000_000, 21
MAGIC = b"REPAIR02"
_loaded: dict[str, tuple] = {}
_CUT = np.zeros(256, bool)
_CUT[[10, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123)]] = True


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def piece_hash(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of many short pieces, read eight bytes at a time; 0 stands for none."""
    eight = np.ndarray((len(text) + 1,), "<u8", np.append(text, np.zeros(8, np.uint8)), strides=(1,))
    left = stop - start
    out = mix((eight[start] & _MASK[np.minimum(left, 8)]) + left.astype(np.uint64) * _ODD)
    which = np.flatnonzero(left > 8)
    at, left = start[which] + 8, left[which] - 8
    while len(which):
        out[which] = mix(out[which] * _ODD ^ (eight[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    out[out == 0] = 1
    return out


def _plain(word: str) -> bool:
    """Lower-case letters of the alphabets up to Cyrillic, in the form that normalising leaves alone."""
    return word.isalpha() and word.islower() and max(word) < "\u0530" and unicodedata.is_normalized("NFC", word)


class _Words:
    """Ids of words by the words' 64-bit hashes: an open-addressing table of numpy arrays and one pool of ids.

    New words that are lower-case letters alone, in normal form, are encoded many at a time: the normaliser leaves such a word
    as it is and the pre-tokenizer takes it as one unit, so the model alone does, and a word's ids end at the first one that
    closes a word. Others are encoded one by one by the whole tokenizer.
    """

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = tokenizer
        self.plain = Tokenizer(tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.zeros(1 << 16, bool)
        self.closes[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.signs = [self.one(b"."), self.one(b",")]
        self.reset()

    def reset(self, words: int = 0) -> None:
        """Forgets all; there is room for twice the given number of words."""
        slots = 1 << max(TABLE_BITS, (2 * words).bit_length())
        self.keys = np.zeros(slots, np.uint64)  # 0: free
        self.begin, self.size = np.zeros(slots, np.uint32), np.zeros(slots, np.uint32)
        self.pool, self.used, self.count = np.zeros(1 << 20, np.uint16), 0, 0

    def one(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}H", *ids)

    def find(self, names: np.ndarray) -> np.ndarray:
        """The slot of each name, -1 where it is not there."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (names & mask).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == names, slot, -1)
        left = np.flatnonzero((key != names) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            key = self.keys[slot[left]]
            hit = key == names[left]
            out[left[hit]] = slot[left[hit]]
            left = left[~hit & (key != 0)]
        return out

    def learn(self, names: np.ndarray, words: list[bytes]) -> None:
        """Adds distinct words that are not there yet."""
        ids = self.encoded(words)
        size = np.array([len(x) // 2 for x in ids], np.int64)
        new = np.frombuffer(b"".join(ids), "<u2")
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(new)] = new
        begin = self.used + np.cumsum(size) - size
        self.used += len(new)
        if self.used >= 1 << 32:
            raise OverflowError("ids of the words kept do not fit in a table of 32 bits")
        self.count += len(names)
        slot, left = (names & np.uint64(len(self.keys) - 1)).astype(np.int64), np.arange(len(names))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            free = free[np.unique(slot[free], return_index=True)[1]]  # one name a slot
            at = slot[free]
            self.keys[at], self.begin[at], self.size[at] = names[free], begin[free], size[free]
            left = left[self.keys[slot[left]] != names[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def encoded(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        plain, other = [], []
        for k, word in enumerate(words):
            (plain if word.isalpha() or _plain(word.decode()) else other).append(k)  # of bytes: ASCII letters, lower-cased before
        for a in range(0, len(plain), 200):
            some = plain[a : a + 200]
            ids = np.array(self.plain.encode_batch_fast([b" ".join([words[k] for k in some]).decode()], add_special_tokens=False)[0].ids, "<u2")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                other += some
                continue
            raw, at = ids.tobytes(), 0
            for k, end in zip(some, (2 * ends).tolist(), strict=True):
                out[k] = raw[at:end]
                at = end
        for k in other:
            out[k] = self.one(words[k])
        return out


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(path):
            import public_tokenizers

            tokenizer = Tokenizer.from_file(public_tokenizers.path(path))
        else:
            tokenizer = Tokenizer.from_file(path)
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        _loaded[path] = (tokenizer, _Words(tokenizer))
    return _loaded[path]


def encode_rows(data: np.ndarray, off: np.ndarray, path: str = TOKENIZER, end: int | None = None) -> list[bytes]:
    """Ids of each of several UTF-8 texts as little-endian uint16 bytes, with `end` after each.

    The vocabulary lower-cases, and its pre-tokenizer never joins across a space or line feed, nor a full stop or comma after
    a letter or digit and before a space with anything. So texts are cut there, each distinct piece of all texts is encoded
    once, and the ids are laid out by numpy. Texts in which a special token may stand are encoded whole.
    """
    tokenizer, known = _tokenizer(path)
    rows, low = len(off) - 1, _LOWER[data]
    inside = ~_CUT[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = off[1:-1][(off[1:-1] < len(data)) & (off[1:-1] > 0)]
        begins[edge], ends[edge - 1] = inside[edge], inside[edge - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sign = low[stop - 1] if len(stop) else np.zeros(0, np.uint8)
    long = stop - start > 1
    before, lead = low[np.maximum(stop - 2, 0)] if len(stop) else sign, low[np.maximum(stop - 3, 0)] if len(stop) else sign
    letter = _ALNUM[before] | ((stop - start > 2) & (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
    cut = long & letter & ((sign == 46) | (sign == 44))
    stop = stop - cut
    names = piece_hash(low, start, stop)
    slot = known.find(names)
    miss = np.flatnonzero(slot < 0)
    if len(miss):
        if known.count + len(miss) > CACHE_WORDS:
            known.reset(len(names))
            miss = np.arange(len(names))
        fresh, first = np.unique(names[miss], return_index=True)
        raw, some = low.tobytes(), miss[first]
        known.learn(fresh, [raw[a:b] for a, b in zip(start[some].tolist(), stop[some].tolist(), strict=True)])
        slot[miss] = known.find(names[miss])
    special = [*known.signs, b"" if end is None else struct.pack("<H", end)]
    extra = np.frombuffer(b"".join(special), "<u2")
    flat = np.concatenate([known.pool[: known.used], extra])
    sizes = np.array([len(x) // 2 for x in special], np.int64)
    begins_of = known.used + np.cumsum(sizes) - sizes
    per_row = np.searchsorted(start, off)
    row = np.repeat(np.arange(rows), np.diff(per_row))
    at = np.arange(len(start)) + np.cumsum(cut) - cut + row  # units: words, cut signs, and an end after each row
    n = len(start) + int(cut.sum()) + rows
    begin, width = np.full(n, begins_of[2], np.int64), np.full(n, sizes[2], np.int64)
    begin[at], width[at] = known.begin[slot], known.size[slot]
    which = (sign[cut] != 46).astype(np.int64)
    begin[at[cut] + 1], width[at[cut] + 1] = begins_of[which], sizes[which]
    signs = np.concatenate([[0], np.cumsum(cut)])
    unit_end = per_row[1:] + signs[per_row[1:]] + np.arange(1, rows + 1)
    total = np.cumsum(width)
    out = flat[np.repeat(begin - (total - width), width) + np.arange(int(total[-1]) if len(total) else 0)].tobytes()
    border = np.concatenate([[0], 2 * total[unit_end - 1]]).tolist()
    got = [out[a:b] for a, b in zip(border[:-1], border[1:], strict=True)]
    text = data.tobytes()
    if b"<|" in text:
        for i in range(rows):
            if b"<|" in (own := text[off[i] : off[i + 1]]):
                ids = tokenizer.encode(own.decode(), add_special_tokens=False).ids
                got[i] = struct.pack(f"<{len(ids)}H", *ids) + special[2]
    return got


ENCODED = "shard int, doc_id long, ids binary"
#: What a row without doc_id is dealt out by: it comes before all others.
_FIRST = -(1 << 63)


def deal(borders: np.ndarray, docs: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Shards by ranges of doc_id. An id that is a border several times fills several shards, and its rows are spread over them by their place."""
    low, high = np.searchsorted(borders, docs, side="left"), np.searchsorted(borders, docs, side="right")
    spread = np.where(high - low > 1, mix(place.astype(np.uint64)) % np.maximum(high - low, 1).astype(np.uint64), 0).astype(np.int64)
    return (high - spread).astype(np.int32)


def _encode(path: str, borders: np.ndarray, end: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in text_chunks(batches, limit=ENCODE_BYTES, holds="words"):
            held["words"] = _tokenizer(path)[1].reset
            ids = encode_rows(data, off, path, end)
            docs, valid = longs(rows, "doc_id", _FIRST), rows.column(0).is_valid().to_numpy(zero_copy_only=False)
            shard = deal(borders, docs, longs(rows, "place"))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(docs, mask=~valid), pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"])
        release_heap()

    return run


def compress(seq: np.ndarray, last: np.ndarray, first_symbol: int, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, last, rules). seq: ids; last: True at a document's end, which no pair crosses.

    Goes on until no pair can be replaced `least` times; symbols have 32 bits, and there are fewer rules than ids. A round takes the
    pairs at least half as frequent as the most frequent one. Where two of them overlap the more frequent wins, by eighths of a
    doubling and then by hash, so that a long run of pairs alike in number is halved and not gone along one by one; what stays
    over comes in the next round. The first pair in that order gets all its places, so a round makes a rule or strikes a pair.

    Symbols are linked to their neighbours, and places are listed by pair, so after one sort of all pairs a round touches only
    the places that it replaces and those beside them. Counts are exact, but for an id that follows itself over and over: that is
    counted at every place and replaced at every second one. A pair gets all its places in the round that makes its later
    symbol, so pairs less frequent than `least` never come back.
    """
    n = len(seq)
    wide = np.uint64(max(1, (first_symbol + n // least + 1).bit_length()))  # bits of a symbol: a rule replaces `least` ids or more
    far = np.uint64(max(1, n.bit_length()))
    mask, packs = np.uint64((1 << int(wide)) - 1), 2 * int(wide) + int(far) <= 64
    sym, following, before = np.append(seq, 0).astype(np.uint32), np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    following[:-1][last], before[1:][last] = n, n
    following[n], before[0], before[n] = n, n, n
    pair, rank_at, gone = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32), np.zeros(n + 1, bool)
    pool, used, rules = np.empty(2 * n, np.int32), 0, np.zeros(0, np.uint64)  # places, pair by pair, of one round after the other
    begin, sizes, counts, codes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def code_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << wide) | right

    def enlist(places: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Lists these places by their pairs, if those are frequent: the numbers of the pairs."""
        nonlocal pool, used, begin, sizes, counts, codes
        if len(code):  # a frequent pair fills its slot of a small table by itself, so pairs of other slots need no sorting
            bits = min(20, max(10, len(code).bit_length()))
            slot = ((code * _ODD) >> np.uint64(64 - bits)).view(np.int64)
            full = (np.bincount(slot, minlength=1 << bits) >= least)[slot]
            places, code = places[full], code[full]
        if packs:
            key = (code << far) | places.astype(np.uint64)
            key.sort()
            code, places = key >> far, (key & ((np.uint64(1) << far) - np.uint64(1))).astype(np.uint32)
            del key
        else:
            order = np.lexsort((places, code))
            code, places = code[order], places[order]
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))[: len(code)]
        count = np.diff(np.append(start, len(code)))
        often = count >= least
        places, count = places[np.repeat(often, count)].astype(np.int64), count[often]
        new = np.arange(len(counts), len(counts) + len(count))
        pair[places] = np.repeat(new, count)
        while used + len(places) > len(pool):
            pool = np.append(pool, np.empty_like(pool))
        pool[used : used + len(places)] = places
        begin, sizes = np.append(begin, used + np.cumsum(count) - count), np.append(sizes, count)
        counts, codes = np.append(counts, count), np.append(codes, code[start[often]])
        used += len(places)
        return new

    at = np.flatnonzero(following[:n] != n).astype(np.uint32)
    live = enlist(at, code_of(sym[at], sym[at + 1]))
    del at
    while len(live):
        count = counts[live]
        chosen = live[count >= max(least, -(-int(count.max()) // 2))]
        count = counts[chosen]
        chosen = chosen[np.lexsort((mix(codes[chosen]), -np.floor(8 * np.log2(count))))]
        size = sizes[chosen]
        where = pool[np.repeat(begin[chosen] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].astype(np.int64)
        rank = np.repeat(np.arange(len(chosen)), size)
        there = pair[where] == np.repeat(chosen, size)
        where, rank = where[there], rank[there]
        rank_at[where] = rank
        same = np.flatnonzero(((codes[chosen] >> wide) == (codes[chosen] & mask))[rank])
        if len(same):  # one id over and over: of each run every second place
            same = same[np.argsort(where[same])]
            first, place = rank_at[before[where[same]]] != rank[same], np.arange(len(same))
            odd = same[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 1]
            rank_at[where[odd]] = -1
            where, rank = np.delete(where, odd), np.delete(rank, odd)
        counts[chosen[np.bincount(rank, minlength=len(chosen)) < least]] = 0
        second, left = following[where], before[where]
        after, ahead = rank_at[second], rank_at[left]
        lost = ((after >= 0) & (after < rank)) | ((ahead >= 0) & (ahead < rank))
        rank_at[where] = -1
        good = np.bincount(rank[~lost], minlength=len(chosen)) >= least
        stay = np.flatnonzero(~lost & good[rank])
        where, rank, second, left = where[stay], rank[stay], second[stay], left[stay]
        third = following[second].astype(np.int64)
        gone[second] = True
        left = left[(left != n) & ~gone[left]].astype(np.int64)
        old = np.concatenate([pair[where], pair[second], pair[left]])
        counts -= np.bincount(old[old >= 0], minlength=len(counts))
        pair[second], pair[where], pair[left] = -1, -1, -1
        name = (np.cumsum(good) - 1 + first_symbol + len(rules)).astype(np.uint32)[rank]
        sym[where], following[where], before[third] = name, third, where
        before[n] = n
        rules = np.append(rules, codes[chosen[good]])
        inner = third != n
        new = enlist(np.concatenate([where[inner], left]), np.concatenate([code_of(name[inner], sym[third[inner]]), code_of(sym[left], sym[following[left]])]))
        live = np.append(live, new)
        live = live[counts[live] >= least]
    keep = np.flatnonzero(~gone[:n])
    return sym[keep], following[keep] == n, np.stack([rules >> wide, rules & mask], 1).astype(np.uint32)


def narrow(symbols: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, little-endian."""
    return symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def widened(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view("<u4").ravel()


def pack_shard(doc_ids: list[int | None], ids: list[bytes], first_symbol: int) -> bytes:
    """One shard's file. All numbers little-endian: MAGIC; documents, rules, symbols, first symbol, bytes of a symbol (uint64 each); doc
    ids (int64), null flags (uint8), ids and symbols of each document (uint64 each), rules' left and right symbols, rules' expansion
    lengths (uint32), symbols; symbols take 2 to 4 bytes, as many as the last rule needs."""
    seq = np.frombuffer(b"".join(ids), "<u2")
    tokens = np.array([len(x) // 2 for x in ids], np.uint64)
    ends = np.cumsum(tokens).astype(np.int64)
    last = np.zeros(len(seq), bool)
    last[ends[tokens > 0] - 1] = True
    symbols, last, rules = compress(seq, last, first_symbol)
    lengths = np.ones(first_symbol + len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[first_symbol + k] = lengths[a] + lengths[b]
    per_doc = np.zeros(len(ids), np.uint64)
    per_doc[tokens > 0] = np.diff(np.append(-1, np.flatnonzero(last)))
    width = max(2, -(-(first_symbol + len(rules)).bit_length() // 8))
    head = struct.pack("<QQQQQ", len(ids), len(rules), len(symbols), first_symbol, width)
    return b"".join([MAGIC, head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), tokens.astype("<u8").tobytes(), per_doc.astype("<u8").tobytes(), narrow(rules[:, 0], width), narrow(rules[:, 1], width), lengths[first_symbol:].astype("<u4").tobytes(), narrow(symbols, width)])


class Shard:
    """A shard's file, with random access."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a shard file")
        n, r, s, self.first, width = struct.unpack("<QQQQQ", raw[8:48])
        at = 48

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null = take("<i8", n), take("u1", n).astype(bool)
        self.tokens, self.per_doc = take("<u8", n).astype(np.int64), take("<u8", n).astype(np.int64)
        self.left, self.right = widened(take("u1", r * width), width), widened(take("u1", r * width), width)
        self.lengths, self.symbols = take("<u4", r), widened(take("u1", s * width), width)
        self.symbol_start = np.concatenate([[0], np.cumsum(self.per_doc)])
        self._flat: np.ndarray | None = None

    def _rules(self) -> tuple[np.ndarray, np.ndarray]:
        """Expansions of all symbols in one array, and where each begins."""
        if self._flat is None:
            size = np.concatenate([np.ones(self.first, np.int64), self.lengths.astype(np.int64)])
            self._begin = np.concatenate([[0], np.cumsum(size)])
            flat = np.empty(int(self._begin[-1]), np.uint16)
            flat[: self.first] = np.arange(self.first)
            pairs, at = np.stack([self.left, self.right], 1), 0
            while at < len(pairs):  # rules up to the first one that refers to another of this run are expanded at once
                later = (pairs[at:] >= self.first + at).any(1)
                end = at + int(later.argmax()) if later.any() else len(pairs)
                flat[self._begin[self.first + at] : self._begin[self.first + end]] = self._gather(flat, size, pairs[at:end].ravel())
                at = end
            self._flat, self._size = flat, size
        return self._flat, self._begin

    def _gather(self, flat: np.ndarray, sizes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        size = sizes[symbols]
        where = np.repeat(self._begin[symbols] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return flat[where]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, _ = self._rules()
        return self._gather(flat, self._size, symbols)

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.symbol_start[i] : self.symbol_start[i + 1]])

    def ids(self, i: int, start: int, count: int) -> np.ndarray:
        """ids start..start+count of document i: expansion lengths say which symbols hold them, and only those are expanded."""
        self._rules()
        own = self.symbols[self.symbol_start[i] : self.symbol_start[i + 1]]
        ends = np.cumsum(self._size[own])
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + count, side="left") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(own[a:b])[skip : skip + count]


WRITTEN = "shard int, path string, documents long, ids long, file_bytes long"


def _write(folder: str, first_symbol: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        forget()
        docs, ids = table.column("doc_id").to_pylist(), table.column("ids").to_pylist()
        order = sorted(range(len(docs)), key=lambda i: (docs[i] is not None, docs[i] or 0, ids[i]))
        shard = table.column("shard")[0].as_py()
        raw = pack_shard([docs[i] for i in order], [ids[i] for i in order], first_symbol)
        fs, base = file_system(folder)
        temp, name = f"{base}/.temp-{shard:06d}-{uuid.uuid4().hex}", f"{base}/shard-{shard:06d}.repair"
        with fs.open_output_stream(temp) as out:
            out.write(raw)
        fs.move(temp, name)
        total, size = sum(map(len, ids)) // 2, len(raw)
        del ids, raw
        release_heap()
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [f"shard-{shard:06d}.repair"], "documents": pa.array([len(docs)], pa.int64()), "ids": pa.array([total], pa.int64()), "file_bytes": pa.array([size], pa.int64())})

    return run


REPORT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _report(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{base}/{path}") as f:
                    shard = Shard(f.read())
                wide = shard.expand(shard.symbols).astype("<u4")
                end = np.cumsum(shard.tokens)
                begin = end - shard.tokens
                view = memoryview(wide)
                crc = [zlib.crc32(view[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.null), pa.array(begin + start), pa.array(shard.tokens), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end: int | None = END_ID) -> DataFrame:
    """Encodes documents and writes one file a shard, in ascending doc_id order; returns (shard, path, documents, ids, file_bytes).

    Shards are ranges of doc_id of about SHARD_BYTES of text, by quantiles of the ids alone. Rows of one doc_id, or of none, that
    are more than a shard's share are spread over several.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("place"))
    shards = min(-(-text_bytes(own) // SHARD_BYTES) or 1, MOST_SHARDS)
    dealt = own.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("doc_id"))
    found = dealt.stat.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 1 / (20 * shards)) if shards > 1 else []
    borders = np.sort(np.array(found, np.float64)).astype(np.int64)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    encoded = own.mapInArrow(_encode(tokenizer, borders, end), ENCODED)
    first_symbol = _tokenizer(tokenizer)[0].get_vocab_size()
    return saved(encoded.groupBy("shard").applyInArrow(_write(folder, first_symbol), WRITTEN), "shards")


def read_report(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files. The window runs over one row a shard."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = files.select("shard", "path", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("start"))
    return placed.repartition(max(1, min(files.count(), 100_000)), "shard").select("path", "start").mapInArrow(_report(folder), REPORT)


def token_ids(docs: DataFrame, folder: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """documents -> doc_id, start, n_tokens (with the end id), ids_crc32, from files written in ascending doc_id order and read back.

    Null and empty texts are the end id alone. Null doc_ids come first. Rows with equal doc_ids stand together, those
    of one shard in the order of their ids. A very long text lies whole in one shard. An empty table gives an empty result and no file. Further columns, whatever
    their names, are not read.
    """
    folder = folder or scratch_path(docs.sparkSession, "ids")
    return read_report(write_ids(docs, folder, tokenizer), folder)
