"""Paged text documents as a data source: `spark.read.format("paged_documents")`, and the same as a stream.

Rows are pages: source (the file's name), suffix, page, page_num, raw_text, modified. Filters on source and suffix go to the listing, so files
that don't fit are not opened; files are dealt into partitions by size, and a large one is read by several tasks, each from the first
page that begins in its range. Other formats are binary files behind a decoder (see sources.files).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from scriptorium.errors import DocumentLoadError

SCHEMA = "source string, suffix string, page string, page_num int, raw_text string, modified timestamp"
#: Bytes of a partition; files of more are cut.
PARTITION_BYTES = 32 << 20
#: Pages end here.
FEED = b"\f"
BLOCK = 1 << 20


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if uri.startswith("file:") or "://" in uri else f"file://{uri}")


class Part(InputPartition):
    """Ranges of files: (path, name, modified, from, to)."""

    def __init__(self, ranges: list[tuple[str, str, int, int, int]]):
        self.ranges = ranges


class Listing:
    """What reading in batches and streaming share: files by name, their ranges, and their pages."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise DocumentLoadError("the option path is missing")
        self.path, self.bytes = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.kept: list[tuple[str, str, tuple[str, ...]]] = []

    def fits(self, name: str) -> bool:
        suffix = suffix_of(name)
        for column, kind, values in self.kept:
            own = name if column == "source" else suffix
            if not {"in": own in values, "ends": own.endswith(values), "starts": own.startswith(values)}[kind]:
                return False
        return True

    def files(self) -> list[tuple[int, str, str, int]]:
        """(modified, path, name, size) of the files below the path, the oldest first; hidden ones and those of filters are left out."""
        fs, base = file_system(self.path)
        info = fs.get_file_info(base)
        if info.type == pafs.FileType.NotFound:
            raise DocumentLoadError(f"nothing at {self.path}")
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True))
        return sorted((f.mtime_ns // 1000, f.path, f.base_name, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")) and self.fits(f.base_name))

    def parts(self, files: list[tuple[int, str, str, int]]) -> list[Part]:
        out, own, held = [], [], 0
        for modified, path, name, size in files:
            for low in range(0, size, self.bytes):
                high = min(size, low + self.bytes)
                if own and held + high - low > self.bytes:
                    out.append(Part(own))
                    own, held = [], 0
                own.append((path, name, modified, low, high))
                held += high - low
        return [*out, Part(own)] if own else out

    def pages(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        for path, name, modified, low, high in part.ranges:
            with fs.open_input_file(path) as f:
                rows, held = [], 0
                for number, text in range_pages(f, low, high):
                    if text.strip():
                        rows.append((name, suffix_of(name), str(number), number, text, datetime.fromtimestamp(modified / 1e6, timezone.utc)))
                        held += len(text)
                    if held >= BLOCK:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)


def suffix_of(name: str) -> str:
    return m[0].lower() if (m := re.search(r"\.[^.]+$", name)) else ""


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.timestamp("us", tz="UTC")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def range_pages(f, low: int, high: int) -> Iterator[tuple[int, str]]:
    """(number, text) of the pages that begin in [low, high) of an open file; the last one is read to its end, wherever that is."""
    number, at = 1, 0
    while at < low:  # pages before the range are counted, not kept; a page begins after each feed
        block = f.read(min(BLOCK, low - at))
        number += block.count(FEED)
        at += len(block)
    if low:
        f.seek(low - 1)
        begins = f.read(1) == FEED
    else:
        begins = True
    held, page_at = b"", at
    while True:
        block = f.read(BLOCK)
        if not begins:  # the rest of a page that an earlier range has
            cut = block.find(FEED)
            if cut < 0 and block:
                at += len(block)
                continue
            if not block:
                return
            at += cut + 1
            number += 1
            block, begins, page_at = block[cut + 1 :], True, at
            if page_at >= high:
                return
        held += block
        *whole, held = held.split(FEED)
        for page in whole:
            yield number, page.decode("utf-8", "replace")
            number += 1
            page_at += len(page) + 1
            if page_at >= high:
                return
        if not block:
            if held:
                yield number, held.decode("utf-8", "replace")
            return


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.listing = Listing(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        kinds = {EqualTo: "in", In: "in", StringEndsWith: "ends", StringStartsWith: "starts"}
        for f in filters:
            named = f.attribute in (("source",), ("suffix",)) if hasattr(f, "attribute") else False
            if named and isinstance(f, IsNotNull):
                continue  # they never are
            if named and type(f) in kinds:
                self.listing.kept.append((f.attribute[0], kinds[type(f)], tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self) -> list[Part]:
        return self.listing.parts(self.listing.files()) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from self.listing.pages(partition)


class StreamReader(DataSourceStreamReader):
    """Files in the order in which they were changed; an offset is the time of the last one, so a file must be put in place whole."""

    def __init__(self, options: dict):
        self.listing = Listing(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"modified": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"modified": max((f[0] for f in self.listing.files()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.listing.parts([f for f in self.listing.files() if start["modified"] < f[0] <= end["modified"]]) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from self.listing.pages(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedDocuments(DataSource):
    """Options: path (a file or a folder with all below it), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "paged_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets filters go to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedDocuments)
