"""Labelled entities from a table of names: an Aho-Corasick automaton over it finds all of them in one pass over a text.

The table may be of any size. Where it is small, the usual case, each task holds all of it and texts are read once. Where it is larger, texts are
taken in blocks of some megabytes, and a block meets the names that can stand in it: a name's longest run of letters and digits is a run of any
text that it stands in, so the block's runs are joined with those. Texts are written once and travel once, however many names there are.
Of matches that overlap the one that begins first counts, of those the longest.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.graph import HEAD
from scriptorium.session import stored

#: Names that every task holds at most: an automaton of so many takes some 100 MB.
PART_NAMES = 200_000
#: Bytes of texts that make a block; a longer text is one of its own.
BLOCK_BYTES = 8 << 20
#: Bits by which runs are sorted out that are no name's (2 MB); with very many names fewer are, and the join decides in any case.
BITS = 1 << 24
#: Runs as the automaton's matches are bounded: what str.isalnum() holds for.
RUN = re.compile(r"[^\W_]+")
#: Bytes of a batch's sentences that are gone through at once, and rows at most; a longer text stands alone.
BYTES_AT_ONCE, ROWS_AT_ONCE = 256 << 10, 256
MENTIONS = pa.list_(pa.list_(pa.struct([("surface", pa.string()), ("label", pa.string())])))
ROW = "chunk_id string, source string, page string, head string"
FOUND = f"{ROW}, mentions array<array<struct<surface:string,label:string>>>"


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def slices(batch: pa.RecordBatch, column: int, bytes_at_once: int = BYTES_AT_ONCE, rows_at_once: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose lists of strings have about so many bytes, and so many rows at most; objects of one run are held at a time."""
    lists = batch.column(column)
    sizes = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(lists.flatten()), 0).to_numpy(zero_copy_only=False)))
    ends, at = sizes[np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))], 0
    while at < batch.num_rows:
        to = min(max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + bytes_at_once, side="right"))), at + rows_at_once)
        yield batch.slice(at, to - at)
        at = to


def automaton(names: list[tuple[str, str]]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for name, label in names:
        out.add_word(name, (len(name), label))
    out.make_automaton()
    return out


def matches(found, text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, label) of every name in a text that no letter or digit stands next to."""
    for last, (length, label) in found.iter(text) if len(found) else ():
        start, end = last + 1 - length, last + 1
        if (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum()):
            yield start, end, label


def leftmost_longest(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out, free = [], 0
    for start, end, label in sorted(hits, key=lambda h: (h[0], -h[1])):
        if start >= free:
            out.append((start, end, label))
            free = end
    return out


def _mentions(found, batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch whose fifth column are sentences, with their mentions in its place."""
    out = [[[{"surface": text[a:b], "label": label} for a, b, label in leftmost_longest(list(matches(found, text)))] for text in texts or []] for texts in batch.column(4).to_pylist()]
    return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, MENTIONS)], names=[*batch.schema.names[:4], "mentions"])


def _find(names: list[tuple[str, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(names)
        for batch in (part for whole in batches for part in slices(whole, 4)):
            yield _mentions(found, batch)

    return run


def name_key(name: str) -> str:
    """The longest run of letters and digits of a name, the first of equally long ones; empty where it has signs alone."""
    return max(RUN.findall(name), key=len, default="")


def _bit(run: str) -> int:
    return zlib.crc32(run.encode("utf-8", "surrogatepass")) % BITS


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([name_key(x) for x in batch.column(0).to_pylist()], pa.string()), *batch.columns], names=["run", "name", "label"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITS, bool)
    for batch in batches:
        bits[[_bit(x) for x in batch.column(0).to_pylist()]] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])


def _blocks(bits: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts as they are, each with the id of its block, and behind those of a block the runs in it that may be a name's: rows that have a run alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, runs, schema = uuid.uuid4().hex, 0, {""}, None

        def ended() -> pa.RecordBatch:
            own = pa.array([x for x in runs if bits[(at := _bit(x)) >> 3] >> (7 - (at & 7)) & 1 or not x], pa.string())
            return pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.string()), own, *[pa.nulls(len(own), f.type) for f in schema]], names=["block", "run", *schema.names])

        for batch in (part for whole in batches for part in slices(whole, 4)):
            schema = batch.schema
            more = pc.sum(pc.binary_length(batch.column(4).flatten())).as_py() or 0
            if size and size + more > BLOCK_BYTES:
                yield ended()
                block, size, runs = uuid.uuid4().hex, 0, {""}
            for text in batch.column(4).flatten().to_pylist():
                runs.update(RUN.findall(text or ""))
            size += more
            yield pa.RecordBatch.from_arrays([pa.array([block] * batch.num_rows, pa.string()), pa.nulls(batch.num_rows, pa.string()), *batch.columns], names=["block", "run", *schema.names])
        if schema is not None:
            yield ended()

    return run


def _find_in_block(texts: pa.Table, names: pa.Table) -> pa.Table:
    found = automaton(list(zip(names.column("name").to_pylist(), names.column("label").to_pylist(), strict=True)))
    own = texts.select(["chunk_id", "source", "page", "head", "sentences"])
    parts = [_mentions(found, part) for whole in own.to_batches() for part in slices(whole, 4)]
    schema = pa.schema([*own.schema.remove(4), pa.field("mentions", MENTIONS)])
    return pa.Table.from_batches([part.cast(schema) for part in parts], schema)


def labelled_mentions(chunks: DataFrame, gazetteer: DataFrame, part_names: int = PART_NAMES) -> DataFrame:
    """Mentions of a gazetteer's names (name, label) in the form of graph.capitalised_mentions: one row a chunk.

    Null and empty names are left out; a name with several labels has the first by alphabet. Names may hold spaces and signs, and count
    where no letter or digit stands next to them. Null texts have no mentions. An empty gazetteer finds nothing. With more than `part_names` names
    texts are searched block by block.
    """
    names = stored(gazetteer.where("name <> '' and label is not null").groupBy("name").agg(F.min("label").alias("label")), "gazetteer")
    rows = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "source", "page", F.left("text", F.lit(HEAD)).alias("head"), sentences(F.col("text")).alias("sentences"))
    if names.count() <= part_names:
        return rows.mapInArrow(_find([(r.name, r.label) for r in names.collect()]), FOUND)
    keyed = names.mapInArrow(_keyed, "run string, name string, label string")
    bits = np.zeros(BITS // 8, np.uint8)
    for r in keyed.select("run").mapInArrow(_bits, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r.bits, np.uint8)
    blocks = stored(rows.mapInArrow(_blocks(bits.tobytes()), f"block string, run string, {ROW}, sentences array<string>"), "blocks", compression="zstd")  # ids of blocks are made once
    own = blocks.where("run is not null").select("block", "run").join(keyed, "run").select(F.col("block").alias("at"), "name", "label")
    texts = blocks.where("run is null").drop("run")
    return texts.groupBy("block").cogroup(own.groupBy("at")).applyInArrow(_find_in_block, FOUND)
