"""File sources and sinks: binary documents behind a decoder, images behind OCR, JSON, and Parquet tables."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.errors import DocumentLoadError, ImageIngestionError, VectorStoreError
from scriptorium.functions.text import base64_text, strip
from scriptorium.operators.chunking import physical_pages

#: The images that are read, by suffix.
MEDIA_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".gif": "image/gif"}
IMAGE_SUFFIXES = tuple(MEDIA_TYPES)
#: The token limit of an image's text.
MOST_TOKENS = 4096

#: A decoder turns a column of file contents into a column of arrays of page texts; OCR turns base64 and media type into text.
PageDecoder = Callable[[Column], Column]
Ocr = Callable[[Column, Column], Column]


def text_decoder(content: Column) -> Column:
    """The default decoder: UTF-8 text whose pages are parted by form feeds. A PDF library behind a pandas UDF goes in its place."""
    return F.split(F.decode(content, "UTF-8"), "\f")


def batched_decoder(read: Callable[[bytes], list[str]]) -> PageDecoder:
    """A decoder around a function of a file's bytes, such as one of a PDF library: Arrow batches of files go to Python, one file at a time.

    A file that the function can't read is a DocumentLoadError of the query, with the reason. Null contents have no pages.
    """

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in batches:
            pages = []
            for content in contents:
                try:
                    pages.append(list(read(content.as_py())) if content.is_valid else [])
                except Exception as e:
                    raise DocumentLoadError(f"a document can't be read: {e}") from e
            yield pa.array(pages, pa.list_(pa.string()))

    return run


def batched_ocr(model: Callable[[list[str], list[str], str, int], list[str | None]], prompt: str, most_tokens: int = MOST_TOKENS, at_once: int = 16) -> Ocr:
    """OCR around a model that takes images (base64), media types, a prompt and a token limit for `at_once` images at a time, and gives their texts.

    Where a call fails its images are asked for one by one, so one bad image does not take others with it; one that fails alone has no text,
    which image_texts reports as the row's status.
    """

    def asked(images: list[str], kinds: list[str]) -> list[str | None]:
        try:
            texts = list(model(images, kinds, prompt, most_tokens))
            if len(texts) != len(images):
                raise ImageIngestionError(f"{len(texts)} texts for {len(images)} images")
            return texts
        except Exception:
            return [None] if len(images) == 1 else [t for image, kind in zip(images, kinds, strict=True) for t in asked([image], [kind])]

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for images, kinds in batches:
            images, kinds, texts = images.to_pylist(), kinds.to_pylist(), []
            for a in range(0, len(images), at_once):
                texts += asked(images[a : a + at_once], kinds[a : a + at_once])
            yield pa.array(texts, pa.string())

    return run


def _scan(spark: SparkSession, paths: str | list[str], suffixes: tuple[str, ...], error: type[Exception]) -> DataFrame:
    wanted = [paths] if isinstance(paths, str) else list(paths)
    bad = [p for p in wanted if os.path.splitext(p)[1] and not any(p.lower().endswith(s) for s in suffixes) and "*" not in p]
    if not wanted or bad:
        raise error(f"expected {', '.join(suffixes)}: {bad or 'no path'}")
    files = spark.read.format("binaryFile").load(wanted)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    suffix = F.lower(F.regexp_extract(name, r"\.[^.]+$", 0))
    return files.select(name.alias("source"), F.col("path").alias("source_uri"), suffix.alias("suffix"), "content").where(F.col("suffix").isin(*suffixes))


def document_pages(spark: SparkSession, paths: str | list[str], decode: PageDecoder = text_decoder, suffixes: tuple[str, ...] = (".pdf",)) -> DataFrame:
    """source, page, page_num, raw_text of one or several files. The suffix counts in any case; a missing path is an error of the scan."""
    return physical_pages(_scan(spark, paths, suffixes, DocumentLoadError).select("source", decode(F.col("content")).alias("pages")))


def image_texts(spark: SparkSession, paths: str | list[str], ocr: Ocr) -> DataFrame:
    """source, text, status of images; blank text is an error in its row, so one image does not stop the others."""
    rows = _scan(spark, paths, IMAGE_SUFFIXES, ImageIngestionError)
    media = F.element_at(F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair]), F.col("suffix"))
    read = rows.select("source", ocr(base64_text(F.col("content")), media).alias("text"))
    blank = F.coalesce(strip(F.col("text")) == "", F.lit(True))
    return read.select("source", "text", F.when(blank, "error: no text").otherwise("success").alias("status"))


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document that is an array of objects."""
    return spark.read.option("multiLine", True).json(path)


def save_report(rows: DataFrame, path: str) -> None:
    """A small report as indented UTF-8 JSON, for people. Larger results go to Parquet."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.asDict(recursive=True) for r in rows.collect()], f, indent=2, ensure_ascii=False)


def save_tables(folder: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{folder}/{name}")
    except Exception as e:
        raise VectorStoreError(f"no table {name} in {folder}") from e
