"""Incremental ingest: each micro-batch of chunks is upserted into the chunk table and its edges are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.errors import VectorStoreError

CHUNKS = "chunk_id string, source string, page string, section string, chunk_index int, total_chunks int, doc_type string, text string"
EDGES = "src string, dst string, relation string, source string, page string, chunk_text string, chunk_id string, kind int, place_a int, place_b int"


class VersionedTable:
    """A log of Parquet folders, one a version: a write costs what it adds, and reading takes the newest row of each key.

    Without a key all rows count. A version that is written again replaces itself, so a batch delivered twice changes nothing.
    Deletions are a log of their own: a source deleted at a version hides the rows it had before that version.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str | None = None):
        self.spark, self.root, self.schema, self.key = spark, root, schema, key

    def _log(self, folder: str, schema: str, version: int) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return self.spark.createDataFrame([], f"{schema}, version int")
        return self.spark.read.schema(f"{schema}, version int").parquet(folder).where(F.col("version") <= version)

    def at(self, version: int) -> DataFrame:
        """The rows as of a version. Versions are partitions, so later ones are not read."""
        rows = self._log(f"{self.root}/rows", self.schema, version)
        if self.key:  # before deletions, so none brings an older row of a key back
            newest = F.row_number().over(W.partitionBy(self.key).orderBy(F.col("version").desc()))
            rows = rows.withColumn("nth", newest).where("nth = 1").drop("nth")
        gone = self._log(f"{self.root}/gone", "source string", version).groupBy("source").agg(F.max("version").alias("gone"))
        rows = rows.join(gone, "source", "left").where("gone is null or version >= gone").drop("gone")
        return rows.select(*[c.split()[0] for c in self.schema.split(", ")])

    def latest(self) -> int:
        """The greatest version that holds rows or deletions, 0 where there is none."""
        jvm, found = self.spark.sparkContext._jvm, [0]
        for part in ("rows", "gone"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}")
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            if fs.exists(path):
                names = [s.getPath().getName() for s in fs.listStatus(path)]
                found += [int(n.split("=")[1]) for n in names if n.startswith("version=")]
        return max(found)

    def written(self, version: int) -> DataFrame:
        """The rows of one version, as they were written."""
        return self._log(f"{self.root}/rows", self.schema, version).where(F.col("version") == version).drop("version")

    def newest(self) -> DataFrame:
        return self.at((1 << 31) - 1)

    def write(self, version: int, df: DataFrame, again: bool = True) -> None:
        """Adds rows; of rows with one key in one version one stays. Without `again` a version that is there is an error."""
        own = df.dropDuplicates([self.key]) if self.key else df
        self._put(own.select(*[c.split()[0] for c in self.schema.split(", ")]), f"{self.root}/rows/version={version}", again)

    def delete(self, version: int, sources: str | DataFrame, again: bool = True) -> None:
        """Hides the older rows of a source, or of all sources in a frame with that column."""
        gone = self.spark.createDataFrame([(sources,)], "source string") if isinstance(sources, str) else sources.select("source").distinct()
        self._put(gone, f"{self.root}/gone/version={version}", again)

    def _put(self, df: DataFrame, path: str, again: bool) -> None:
        try:
            df.write.mode("overwrite" if again else "errorifexists").parquet(path)
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" in str(e):
                raise VectorStoreError(f"another writer has made {path}") from e
            raise

    def compact(self, version: int, folder: str) -> VersionedTable:
        """The table as of a version, as the first version of another folder."""
        other = VersionedTable(self.spark, folder, self.schema, self.key)
        other.write(version, self.at(version))
        return other


def without_redelivery(stream: DataFrame, within: str, arrived: str | None = None) -> DataFrame:
    """Pages (source, page, raw_text) that were not delivered before: equal ones in one batch or in several, up to `within` apart, pass once.

    What is kept for it is a hash a page in the state store, and goes as the watermark passes. Time is a column `arrived` of the stream, or
    that of the batch. Chunk ids are made of just these columns, so no chunk comes twice either.
    """
    rows = stream.withColumn("_arrived", F.col(arrived).cast("timestamp") if arrived else F.current_timestamp()).withWatermark("_arrived", within)
    rows = rows.withColumn("_page", F.sha2(F.concat_ws("\x1f", F.coalesce("source", F.lit("\x00")), F.coalesce("page", F.lit("\x00")), F.coalesce("raw_text", F.lit("\x00"))), 256))
    return rows.dropDuplicatesWithinWatermark(["_page"]).drop("_page", "_arrived")


def ingest(stream: DataFrame, root: str, to_chunks: Callable[[DataFrame], DataFrame], to_edges: Callable[[DataFrame], DataFrame] | None = None, dedupe_edges: bool = False, redelivery: str | None = None, arrived: str | None = None) -> StreamingQuery:
    """Runs what is there and ends. Chunks are written before edges; where edges fail, that batch runs again as a whole.

    A file taken in again has its edges twice unless dedupe_edges is asked for, which compares a batch with all edges there are, or
    `redelivery`, the time within which pages that come again are kept out of the stream (see without_redelivery).
    """
    spark = stream.sparkSession
    if redelivery:
        stream = without_redelivery(stream, redelivery, arrived)
    chunks, edges = VersionedTable(spark, f"{root}/chunks", CHUNKS, "chunk_id"), VersionedTable(spark, f"{root}/edges", EDGES)

    def batch(df: DataFrame, number: int) -> None:
        new = to_chunks(df).persist()
        try:
            chunks.write(number, new)
            if to_edges is not None:
                fresh = new.join(edges.at(number - 1).select("chunk_id").distinct(), "chunk_id", "left_anti").select(*new.columns) if dedupe_edges else new
                edges.write(number, to_edges(fresh))
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
