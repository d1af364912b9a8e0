"""The recursive character splitter, as an Arrow-batched UDF: its state runs along a text, which no built-in function expresses."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.vector import text_parts

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _borders(text: str, separator: str) -> list[int]:
    """Where pieces begin, and the text's end: a separator opens the piece after it; no piece is empty."""
    if not separator:
        return list(range(len(text) + 1))
    head, *rest = map(len, text.split(separator))
    at = list(accumulate((n + len(separator) for n in rest), initial=head))
    return [0, *at] if head else at


def _merged(text: str, at: list[int], size: int, overlap: int) -> Iterator[str]:
    """Greedy runs of the pieces between borders, of at most `size` characters; a new run keeps whole pieces, `overlap` characters
    at most, of the last one's end. Borders rise, so both ends of a run are found by bisection."""
    first, last = 0, len(at) - 1
    while first < last:
        end = min(max(bisect_right(at, at[first] + size) - 1, first + 1), last)
        if joined := text[at[first] : at[end]].strip():
            yield joined
        if end == last:
            return
        first = max(first, bisect_left(at, at[end] - overlap), min(bisect_left(at, at[end + 1] - size), end))


def split_text(text: str, size: int = 500, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of about `size` characters, cut at the coarsest separator that occurs and within long pieces at finer ones."""
    which = next(i for i, s in enumerate(separators) if s == "" or s in text or i == len(separators) - 1)
    at, finer = _borders(text, separators[which]), separators[which + 1 :]
    out: list[str] = []
    first = 0
    for k in [k for k in range(len(at) - 1) if at[k + 1] - at[k] >= size]:
        out += _merged(text, at[first : k + 1], size, overlap)
        piece = text[at[k] : at[k + 1]]
        out += split_text(piece, size, overlap, finer) if finer else [piece]
        first = k + 1
    return out + list(_merged(text, at[first:], size, overlap))


def recursive_split(text: Column, size: int = 500, overlap: int = 100) -> Column:
    """The chunks of each text; a batch is split part by part (text_parts), so a task holds the chunks of one part."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in text_parts(texts):
                yield pa.array([[] if t is None else split_text(t, size, overlap) for t in part.to_pylist()], pa.list_(pa.string()))

    return run.asNondeterministic()(text)  # it is deterministic: what explodes the chunks is not to split once more for a filter


def fixed_split(text: Column, size: int = 500, step: int = 400) -> Column:
    """Windows of `size` characters every `step`, by built-in functions; the last one starts where the text is not yet covered."""
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - (size - step)) / F.lit(float(step))).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * step + 1, F.lit(size)))
