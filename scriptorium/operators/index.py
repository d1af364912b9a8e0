"""The index as a whole: ingest files, delete a document, list and count, over logs of Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.errors import DocumentLoadError, ImageIngestionError, VectorStoreError
from scriptorium.functions.vector import Embedder, hashed_embedding
from scriptorium.log import logger
from scriptorium.operators import chunking, graph, vectors
from scriptorium.operators.inverted import InvertedLists
from scriptorium.sources import files
from scriptorium.sources.buckets import BucketedTable
from scriptorium.streaming.ingest import CHUNKS, EDGES, VersionedTable


class Index:
    """Chunks, vectors and edges in one folder, chunks in `buckets` where that is given (see sources.buckets). `ingest_*` return (source, chunks_added, status) rows; a failing file is a status.

    An index opened over a folder goes on where the last one ended. Two that write at once don't overwrite each other: the
    second to write a version gets a VectorStoreError, and `refresh` takes it to what is there.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Embedder = hashed_embedding, decode: files.PageDecoder = files.text_decoder, ocr: files.Ocr | None = None, extract: graph.Extractor = graph.capitalised, relation: graph.Relation | None = None, logs: str | None = None, buckets: int | None = None):
        self.spark, self.embed, self.decode, self.ocr, self.extract, self.relation = spark, embed, decode, ocr, extract, relation
        self.chunk_table = BucketedTable(spark, f"{root}/chunks", CHUNKS, "chunk_id", buckets) if buckets else VersionedTable(spark, f"{root}/chunks", CHUNKS, "chunk_id")
        self.edge_table = VersionedTable(spark, f"{root}/edges", EDGES)
        self.log = logger(folder=logs)
        self.refresh()

    def refresh(self) -> int:
        """Takes the index to the newest version in its folder."""
        self.version = max(self.chunk_table.latest(), self.edge_table.latest())
        return self.version

    def chunks(self) -> DataFrame:
        return self.chunk_table.at(self.version)

    def vectors(self) -> DataFrame:
        return self.chunks().select("chunk_id", "source", self.embed(F.col("text")).alias("embedding"))

    def edges(self) -> DataFrame:
        return self.edge_table.at(self.version)

    def search(self, questions: list[str], k: int = 5) -> DataFrame:
        """The k best chunks of each question, numbered from 0 as query_id. Blank questions and an empty store raise RetrievalError."""
        vectors.require_searchable(self.chunks(), questions)
        asked = self.spark.createDataFrame(list(enumerate(questions)), "query_id int, question string")
        return vectors.retrieve(self.chunks(), self.vectors(), asked.select("query_id", self.embed(F.col("question")).alias("embedding")), k)

    def add(self, new: DataFrame, replace: bool = False) -> DataFrame:
        """Upserts chunks and appends their edges. replace: chunks that the files had before and have no more go too.

        The chunks are written first; counts and edges are taken from what was written. Where the edges fail, the chunks stay and
        the error is logged and raised.
        """
        version = self.version + 1
        self.chunk_table.write(version, new, again=False)
        self.version = version
        written = self.chunk_table.written(version)
        if replace:
            self.chunk_table.delete(version, written.select("source"), again=False)
        try:
            self.edge_table.write(version, graph.build_edges(graph.capitalised_mentions(written, self.extract), self.relation), again=False)
        except Exception:
            self.log.exception("edges of version %d were not written; its chunks are", version)
            raise
        self.log.info("version %d is written", version)
        return written.groupBy("source").agg(F.count("*").alias("chunks_added"))

    def compact(self) -> int:
        """Merges what was written so far, bucket by bucket, so later reads are plain scans; for an index in buckets. Returns the version."""
        if not isinstance(self.chunk_table, BucketedTable):
            raise VectorStoreError("this index is not in buckets")
        self.log.info("version %d is compacted", self.version)
        return self.chunk_table.compact(self.version)

    def approximate(self, folder: str, lists: int | None = None) -> InvertedLists:
        """Inverted lists over the chunks' vectors as they are now."""
        return InvertedLists.build(self.vectors(), folder, lists)

    def ingest_documents(self, paths: str | list[str], suffixes: tuple[str, ...] = (".pdf",)) -> list[tuple[str, int, str]]:
        try:
            counted = self.add(chunking.process_pages(files.document_pages(self.spark, paths, self.decode, suffixes))).collect()
        except DocumentLoadError as e:
            self.log.error("documents were not taken in: %s", e)
            return [(str(paths), 0, f"error: {e}")]
        return [(r.source, r.chunks_added, "success") for r in counted]

    def ingest_images(self, paths: str | list[str]) -> list[tuple[str, int, str]]:
        if self.ocr is None:
            return [(str(paths), 0, "error: no OCR is set")]
        try:
            texts = files.image_texts(self.spark, paths, self.ocr)
        except ImageIngestionError as e:
            return [(str(paths), 0, f"error: {e}")]
        counted = self.add(chunking.image_chunks(texts.where("status = 'success'"))).collect()
        failed = [(r.source, 0, r.status) for r in texts.where("status <> 'success'").select("source", "status").collect()]
        return [(r.source, r.chunks_added, "success") for r in counted] + failed

    def delete_document(self, source: str, cascade: bool = False) -> int:
        """Drops a document's chunks and returns how many; its edges stay unless cascade is asked for."""
        _, goes = vectors.without_source(self.chunks(), source)
        count = self.chunks().where(goes).count()
        version = self.version + 1
        self.chunk_table.delete(version, source, again=False)
        if cascade:
            self.edge_table.delete(version, source, again=False)
        self.version = version
        return count

    def list_documents(self) -> list[str]:
        return [r.source for r in vectors.list_sources(self.chunks()).collect()]

    def count(self) -> int:
        return self.chunks().count()

    def stats(self) -> DataFrame:
        return vectors.stats(self.chunks())
