"""WARC archives: writing, reading, and revisit resolution.

Headers (digest, id) are shuffled by payload digest, each digest's original response is found by a partial maximum, revisit
records are joined to it, and archives are written in which only originals carry their payload. Files go to the shared
folder through pyarrow's file systems, under a temporary name until they are whole, so a retried task leaves no half file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import saved, scratch_path

#: A file is closed once it has this many compressed bytes.
ROLL_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, by built-in functions: 40 hex digits are 8 times 20 bits, or 4 letters each."""
    digest = F.sha1(payload)
    letters = []
    for g in range(8):
        v = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def resolve_revisits(headers: DataFrame, smallest: int = 0) -> DataFrame:
    """(page_id, payload_digest, refers_to, refers_uri), once for each page and digest that is a revisit; all other records are responses.

    headers: page_id, url, payload_digest, payload_bytes. Of records with one digest and at least `smallest` bytes the largest page_id
    is the response; all others refer to it. Only headers are shuffled by digest, and only digests that occur more than once are joined.
    """
    slim = headers.where(F.col("payload_bytes") >= smallest).select("page_id", "url", "payload_digest")
    originals = slim.groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to"), F.max_by("url", "page_id").alias("refers_uri"))
    originals = saved(originals.where("n > 1 and refers_to is not null").drop("n"), "originals")
    found = slim.select("page_id", "payload_digest").join(originals, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select("page_id", "payload_digest", "refers_to", "refers_uri").distinct()


def with_revisits(rows: DataFrame, revisits: DataFrame) -> DataFrame:
    """rows (page_id, payload_digest and more) with refers_to and refers_uri, null for responses. The key is page and digest, so equal payloads
    don't meet in one task; a table of revisits below Spark's threshold is broadcast and payloads stay where they are."""
    keyed = revisits.select(F.col("page_id").alias("r_page"), F.col("payload_digest").alias("r_digest"), "refers_to", "refers_uri")
    same = F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("payload_digest") == F.col("r_digest"))
    return rows.join(keyed, same, "left").drop("r_page", "r_digest")


def record_name(page_id: int | None, place: str = "") -> str:
    """The id of a record: its page's number, and where nothing refers to it (revisits, and pages without an id) its place, so ids differ."""
    return f"<urn:page:{'' if page_id is None else page_id}{place and '/' + place}>"


def _line(value: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_uri: str | None, date: str, place: str) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header block alone, whose Content-Length tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_name(page_id, place if refers_to is not None or page_id is None else "")), ("WARC-Date", date), ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is None:
        block = http + payload
    else:
        block = http
        fields += [("WARC-Refers-To", record_name(refers_to)), ("WARC-Refers-To-Target-URI", _line(refers_uri)), ("WARC-Refers-To-Date", date), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if "://" not in uri or uri.startswith("file:") else uri)


def _write(folder: str, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        fs, base = file_system(folder)
        out, temp, names, counts, at, number, own = None, "", [], [], 0, 0, uuid.uuid4().hex[:12]

        def close() -> None:
            nonlocal out, number, at
            if out is not None:
                out.close()
                name = f"{base}/part-{task:05d}-{number:04d}-{own}.warc.gz"  # each attempt of a task has names of its own
                fs.move(temp, name)
                names.append(name.rsplit("/", 1)[1])
                out, number, at = None, number + 1, 0

        for batch in batches:
            column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for row in zip(*[column[n] for n in ("page_id", "url", "html", "payload_digest", "refers_to", "refers_uri")], strict=True):
                if out is None:
                    temp = f"{base}/.temp-{task:05d}-{number:04d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp)
                    counts.append(0)
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = pack.compress(record(row[0], row[1], (row[2] or "").encode(), *row[3:], date, f"{own}-{number}-{counts[-1]}")) + pack.flush()
                out.write(member)
                counts[-1] += 1
                at += len(member)
                if at >= ROLL_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["file", "records"])

    return run


def write_archives(records: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Writes rows of page_id, url, html, payload_digest, refers_to, refers_uri; returns the manifest (file, records).

    date: the WARC-Date of all records, by default the time of writing. What a lost attempt of a task left behind is in no manifest.
    """
    spark = records.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return saved(records.select("page_id", "url", "html", "payload_digest", "refers_to", "refers_uri").mapInArrow(_write(folder, date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")), "file string, records long"), "archive-files")


def _number(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">").partition("/")[0]
    return int(digits) if digits else None


def parse(stream) -> Iterator[dict]:
    """Records of one decompressed archive: WARC fields, HTTP fields and payload. A response whose payload does not have its digest is an error."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.lower()] = v.strip()
        block = stream.read(int(fields["content-length"]))
        head, _, payload = block.partition(b"\r\n\r\n")
        http = dict(x.decode().lower().split(": ", 1) for x in head.split(b"\r\n")[1:])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
        yield {"fields": fields, "http": http, "payload": payload, "digest": digest}


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = file_system(uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for x in parse(stream):
                        f = x["fields"]
                        rows.append((_number(f["warc-record-id"]), f["warc-target-uri"], int(x["http"]["content-length"]), x["digest"], f["warc-type"], _number(f["warc-refers-to"]) if "warc-refers-to" in f else None) + ((x["payload"],) if with_payload else ()))
                        held += len(x["payload"]) * with_payload
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield _batch(rows, with_payload)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, with_payload)

    return run


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, folder: str, payload: bool = False, manifest: DataFrame | None = None) -> DataFrame:
    """Rows of the archives that a manifest names, or of all in a folder. Files are streamed record by record; payload is null-free
    bytes, empty for revisits."""
    if manifest is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")
    else:
        files = manifest.select(F.concat(F.lit(f"{folder}/"), "file").alias("path")).repartition(max(1, min(manifest.count(), 100_000)), "path")
    return files.mapInArrow(_read(payload), READ + ", payload binary" * payload)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """pages (page_id, url, html) -> deduplicated archives, read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; empty payloads are equal and revisit as others do. Null url: an empty target.
    Rows repeated with the largest page_id of their payload are each a response, under one record id. A null page_id revisits where the
    payload has an original with an id, else it is a response. Very long payloads are written whole, one record at a time. An
    empty table gives an empty result. Further columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("html"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    revisits = saved(resolve_revisits(rows), "revisits")
    manifest = write_archives(with_revisits(rows, revisits), folder)
    return read_archives(spark, folder, manifest=manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LETTERS = " || ".join(f"substr('{_BASE32}', (v[{g + 1}] >> {s}) % 32 + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
ORACLE = f"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
split AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(hex, (5 * g + 1)::BIGINT, 5))::BIGINT) AS v FROM hashed),
named AS (SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest, max(page_id) OVER (PARTITION BY hex) AS original FROM split)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN original IS NULL OR page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM named
"""
