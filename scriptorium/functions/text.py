"""Text expressions. All are built-in column functions but NFKC, which Spark lacks and which runs as an Arrow UDF."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriptorium.functions.vector import text_parts

MIN_CHUNK, MAX_HEADING, MIN_SENTENCE = 50, 80, 10
#: The characters that Unicode calls white space.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end. Only the ends are looked at."""
    return F.btrim(text, F.lit(SPACE))


@F.arrow_udf(StringType())
def nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for part in text_parts(texts):
            yield pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in part.to_pylist()], pa.string())


def tidy_lines(text: Column) -> Column:
    """The cleaning steps after NFKC, in their order: NUL, private bullet, rule lines, runs of line feeds, then right ends of lines.

    Runs of line feeds are cut before lines are trimmed, so lines of blanks alone can leave three or more behind.
    """
    text = F.regexp_replace(text, "\x00", "")
    text = F.regexp_replace(text, "", "•")
    text = F.regexp_replace(text, r"(?mdU)^[-_=]{3,}\s*$", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, "\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n")
    return strip(F.regexp_replace(text, r"(?mdU)[^\S\n]+$", ""))


def clean_text(text: Column) -> Column:
    """Text as extracted from a page, normalised. ASCII texts skip the Python step."""
    return tidy_lines(F.when(text.rlike(r"[^\x00-\x7f]"), nfkc(text)).otherwise(text))


def sentences(text: Column) -> Column:
    """Array of the stripped sentences over MIN_SENTENCE characters; a sentence ends at white space after . ! or ?."""
    parts = F.transform(F.split(strip(text), r"(?<=[.!?])(?U)\s+"), strip)
    return F.filter(parts, lambda s: F.length(s) > MIN_SENTENCE)


def truncated(text: Column, limit: int = 300) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), F.lit("...")))


def selection_preview(text: Column, least: int = 3, limit: int = 80) -> Column:
    """Null for a selection under `least` characters, else its first `limit`."""
    own = strip(text)
    return F.when(F.length(own) >= least, truncated(own, limit))


def source_line(source: Column, page: Column, section: Column) -> Column:
    return F.concat(F.coalesce(source, F.lit("Unknown")), F.lit(" — Page "), F.coalesce(page, F.lit("?")), F.lit(" — Section: "), F.coalesce(section, F.lit("Unknown")))


def score_bar(score: Column, width: int = 30) -> Column:
    return F.rpad(F.repeat(F.lit("#"), F.floor(score * width).cast("int")), width, "-")


def base64_text(content: Column) -> Column:
    """Unwrapped base64, whatever spark.sql.chunkBase64String.enabled says."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


def chunk_id(source: Column, page: Column, index: Column, text: Column) -> Column:
    """md5 of source, page, position and the first 80 characters; null where one of them is null."""
    return F.md5(F.concat(source, F.lit("__"), page, F.lit("__"), index.cast("string"), F.lit("__"), F.substring(text, 1, 80)))
