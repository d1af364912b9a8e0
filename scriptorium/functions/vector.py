"""Vectors as arrays of doubles: cosine by built-in functions, and the default embedder, hashed term frequencies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 384
#: Tokens whose places a task keeps.
MOST_KNOWN = 500_000
HIGH, MEDIUM = 0.75, 0.50


class Embedder(Protocol):
    """Anything that turns a column of texts into a column of arrays of doubles, such as a pandas UDF around a model."""

    def __call__(self, text: Column) -> Column: ...


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def score(cos: Column) -> Column:
    """Similarity as reported: rounded to four places before anything is decided by it."""
    return F.round(cos, 4)


def confidence(rounded: Column) -> Column:
    return F.when(rounded >= HIGH, "High").when(rounded >= MEDIUM, "Medium").otherwise("Low")


def bucket(token: str, dimensions: int = DIMENSIONS) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimensions


class Places:
    """The places of tokens, kept from batch to batch: what is known is looked up as a whole array, and Python sees a token, and takes its md5, once."""

    def __init__(self, dimensions: int):
        self.dimensions, self.known, self.at = dimensions, pa.array([], pa.string()), np.zeros(0, np.int64)

    def __call__(self, tokens: pa.Array) -> np.ndarray:
        """tokens: distinct ones."""
        self.known = self.known.cast(tokens.type)
        found = pc.index_in(tokens, value_set=self.known)
        out = self.at[found.fill_null(0).to_numpy()] if len(self.at) else np.zeros(len(tokens), np.int64)
        new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        if len(new):
            words = tokens.take(pa.array(new))
            out[new] = np.fromiter((bucket(t, self.dimensions) for t in words.to_pylist()), np.int64, len(new))
            if len(self.known) > MOST_KNOWN:
                self.known, self.at = self.known.slice(0, 0), self.at[:0]
            self.known, self.at = pa.concat_arrays([self.known, words]), np.append(self.at, out[new])
        return out


def token_places(texts: pa.Array, places: Places) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every token. Tokens are runs of letters and digits, lower-cased."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}\p{N}]+")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    tokens = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = tokens.dictionary
    place = places(words)
    which = tokens.indices.to_numpy(zero_copy_only=False)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[which]
    return row[real], place[which[real]]


def hashed_counts(texts: pa.Array, places: Places) -> np.ndarray:
    """A row for each text: how many of its tokens fall into each place."""
    row, place = token_places(texts, places)
    at = row * places.dimensions + place
    return np.bincount(at, minlength=len(texts) * places.dimensions).astype(np.float64).reshape(len(texts), places.dimensions)


#: Bytes of text that are taken apart at once, and rows at most.
AT_ONCE, ROWS_AT_ONCE = 1 << 20, 1024


def text_parts(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in runs of rows of about AT_ONCE bytes and ROWS_AT_ONCE at most; a longer text stands alone."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        to = min(max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right"))), at + ROWS_AT_ONCE)
        yield texts.slice(at, to - at)
        at = to


def as_lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Term frequencies by hash: the default embedder, deterministic and without a model. Null texts give a zero vector.

    Batches stay Arrow arrays: splitting, coding of tokens and counting are whole-array steps, and Python sees each distinct token of a batch once.
    Vectors are handed on part by part, so a task holds those of ROWS_AT_ONCE texts at most, whatever a batch has. The function is declared as not
    deterministic, which it is, so that a filter on vectors reads them and doesn't make them once more.
    """

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = Places(dimensions)
        for texts in batches:
            for part in text_parts(texts):
                yield as_lists(hashed_counts(part, places))

    return run.asNondeterministic()(text)
