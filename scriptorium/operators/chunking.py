"""From pages to chunks: headings, section offsets, the backward as-of join of chunks to sections, and chunk metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.splitter import recursive_split

Splitter = Callable[[Column], Column]


def physical_pages(decoded: DataFrame) -> DataFrame:
    """(source, pages array) -> source, page, page_num, raw_text. Pages count from 1 as they lie; blank ones are left out, gaps stay."""
    rows = decoded.select("source", F.posexplode("pages").alias("at", "raw_text")).withColumn("page_num", F.col("at") + 1)
    return rows.where(T.strip(F.col("raw_text")) != "").select("source", F.col("page_num").cast("string").alias("page"), "page_num", "raw_text")


def headings(pages: DataFrame, text: str = "text") -> DataFrame:
    """(source, page, text) -> source, page, offset, heading.

    A heading is a stripped, non-empty line of at most 80 characters, not all digits, before a blank line; a last line never is.
    Offsets count every line before it with its line feed. Windows stay within a page.
    """
    lines = pages.select("source", "page", F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"))
    page = W.partitionBy("source", "page").orderBy("at")
    before = F.coalesce(F.sum(F.length("line") + 1).over(page.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = lines.withColumn("offset", before.cast("long")).withColumn("next", F.lead("line").over(page)).withColumn("heading", T.strip(F.col("line")))
    found = (F.length("heading").between(1, T.MAX_HEADING)) & ~F.col("heading").rlike(r"^\d+$") & (T.strip(F.col("next")) == "")
    return marked.where(found).select("source", "page", "offset", "heading")


def numbered_chunks(pages: DataFrame, split: Splitter, text: str = "text") -> DataFrame:
    """Pages cut by `split`: source, page, chunk_index, total_chunks (both before short ones go), text (stripped), cursor.

    The cursor is the summed length of all chunks before, overlaps and separators notwithstanding, so it drifts.
    """
    cut = pages.select("source", "page", F.transform(split(F.col(text)), T.strip).alias("parts"))
    rows = cut.select("source", "page", F.size("parts").alias("total_chunks"), F.posexplode("parts").alias("chunk_index", "text"))
    before = W.partitionBy("source", "page").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("cursor", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long"))


def nearest_section(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Backward as-of join: the section with the greatest offset at or before the cursor, else "Unknown".

    Both sides meet in one union sorted by (page, place), and the last heading seen is carried on: one shuffle, no pairs.
    """
    marks = sections.select("source", "page", F.col("offset").alias("place"), F.lit(0).alias("side"), "heading", F.lit(None).cast("struct<chunk_index:int,total_chunks:int,text:string,cursor:bigint>").alias("chunk"))
    asks = chunks.select("source", "page", F.col("cursor").alias("place"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("heading"), F.struct(F.col("chunk_index").cast("int").alias("chunk_index"), F.col("total_chunks").cast("int").alias("total_chunks"), "text", F.col("cursor").cast("long").alias("cursor")).alias("chunk"))
    along = W.partitionBy("source", "page").orderBy("place", "side").rowsBetween(W.unboundedPreceding, 0)
    joined = marks.unionByName(asks).withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(along), F.lit("Unknown")))
    return joined.where("side = 1").select("source", "page", "section", "chunk.*")


def process_pages(pages: DataFrame, split: Splitter = recursive_split, clean: bool = True) -> DataFrame:
    """(source, page, raw_text) -> chunks with metadata: cleaned, sectioned, split, chunks under 50 characters left out."""
    text = T.clean_text(F.col("raw_text")) if clean else F.col("raw_text")
    own = pages.select("source", "page", text.alias("text"))
    chunks = nearest_section(numbered_chunks(own, split), headings(own))
    kept = chunks.where(F.length("text") >= T.MIN_CHUNK)
    return with_ids(kept.withColumn("doc_type", F.lit("pdf")))


def image_chunks(images: DataFrame, split: Splitter = recursive_split) -> DataFrame:
    """(source, text) of images -> chunks: stripped, not cleaned; page "image", section "image_ocr"."""
    own = images.select("source", F.lit("image").alias("page"), T.strip(F.col("text")).alias("text")).where("text <> ''")
    kept = numbered_chunks(own, split).where(F.length("text") >= T.MIN_CHUNK)
    return with_ids(kept.withColumn("section", F.lit("image_ocr")).withColumn("doc_type", F.lit("image")))


def with_ids(chunks: DataFrame) -> DataFrame:
    ids = T.chunk_id(F.col("source"), F.col("page"), F.col("chunk_index"), F.col("text"))
    return chunks.select(ids.alias("chunk_id"), "source", "page", "section", F.col("chunk_index").cast("int"), F.col("total_chunks").cast("int"), "doc_type", "text")


def size_sweep(texts: DataFrame, sizes: list[tuple[int, int]], split: Callable[[Column, int, int], Column]) -> DataFrame:
    """Chunk statistics of whole texts for several (size, overlap): chunk_size, chunk_overlap, chunks, mean (cut to an int), least, most."""
    out = None
    for size, overlap in sizes:
        part = texts.select(F.explode(split(F.col("text"), size, overlap)).alias("c")).agg(
            F.count("*").alias("chunks"), F.floor(F.avg(F.length("c"))).alias("mean_length"), F.min(F.length("c")).alias("min_length"), F.max(F.length("c")).alias("max_length")
        )
        part = part.select(F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def overlaps(chunks: DataFrame, width: int = 100) -> DataFrame:
    """For neighbours in a page: the end of one chunk and the start of the next."""
    along = W.partitionBy("source", "page").orderBy("chunk_index")
    rows = chunks.withColumn("next", F.lead("text").over(along)).where("next is not null")
    return rows.select("source", "page", "chunk_index", F.right("text", F.lit(width)).alias("tail"), F.left("next", F.lit(width)).alias("head"))
