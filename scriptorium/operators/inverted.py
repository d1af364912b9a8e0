"""Approximate search by inverted lists: vectors are written by their nearest centroid, and a query reads the lists it probes.

Centroids are trained by k-means over a sample whose size is a parameter: each step is one pass in which every task adds up its
vectors by list, in whole numbers, so the result hangs neither on the order of the rows nor on how they are split. The lists are
partitions of one table; a search names the lists that any query probes, so files of the others are not opened. A list meets its queries block
by block, as a matrix product, and hands on the k best of each. With all lists probed the result is that of exact search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from scriptorium.errors import VectorStoreError
from scriptorium.operators.vectors import matrix_rows, ranked, shown_scores

#: Centroids at most: with 1,024 places they take 32 MB in each task.
MOST_LISTS = 4096
#: The sample that centroids are trained on: so many vectors a list. Steps over it.
TRAINING, STEPS = 256, 8
#: Vectors of a list that are scored in one task.
BLOCK = 50_000
#: Components of unit vectors are added up in this unit.
UNIT = 1 << 30


def unit_rows(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(1))
    return np.divide(rows, length[:, None], out=np.zeros_like(rows), where=length[:, None] > 0)


def usable(vectors: DataFrame, id_col: str = "chunk_id") -> Column:
    """Vectors without an id, null ones and those that hold a null are left out, as in exact search."""
    return F.col(id_col).isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())


def common_width(vectors: DataFrame) -> int:
    """The length that most vectors have, the smaller of equals; 0 for an empty table."""
    row = vectors.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return int(row.width) if row else 0


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """list, n, sums: what the vectors of one task add to each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, np.int64)
        for batch in batches:
            x = unit_rows(matrix_rows(batch.column(0), centroids.shape[1]))
            own = (x @ centroids.T).argmax(1)
            n += np.bincount(own, minlength=len(n))
            np.add.at(sums, own, np.round(x * UNIT).astype(np.int64))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["list", "n", "sums"])

    return run


def train(vectors: DataFrame, lists: int, steps: int = STEPS, training: int = TRAINING, id_col: str = "chunk_id") -> np.ndarray:
    """`lists` centroids of length 1, fewer where there are fewer vectors. Only centroids and the first sample of them come to the driver."""
    if not 0 < lists <= MOST_LISTS:
        raise VectorStoreError(f"lists must be between 1 and {MOST_LISTS}")
    own = vectors.where(usable(vectors, id_col)).select(id_col, F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    count, width = own.count(), common_width(own)
    own = own.where(F.size("embedding") == width)
    spot = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("ivf")), F.lit(1 << 40))
    sample = own.where(spot < int((1 << 40) * min(1.0, lists * training / max(1, count)))).select("embedding").persist()
    try:
        first = own.orderBy(spot, id_col).limit(lists).select("embedding").collect()
        centroids = unit_rows(np.array([r.embedding for r in first], np.float64).reshape(len(first), width))
        for _ in range(steps if len(first) > 1 else 0):
            parts = sample.mapInArrow(_sums(centroids), "list int, n long, sums array<long>")
            added = parts.select("list", F.posexplode("sums").alias("place", "s")).groupBy("list", "place").agg(F.sum("s").alias("s")).groupBy("list").agg(F.sort_array(F.collect_list(F.struct("place", "s"))).alias("s"))
            for r in added.collect():  # a row for each centroid
                centroids[r.list] = [x.s for x in r.s]
            centroids = unit_rows(centroids)
    finally:
        sample.unpersist()
    return centroids


def _nearest(centroids: np.ndarray, probes: int, kind: str, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row once for each of its `probes` nearest lists; rows without length go to the first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(unit_rows(matrix_rows(batch.column(batch.schema.get_field_index("embedding")), centroids.shape[1])) @ centroids.T), axis=1, kind="stable")[:, :probes]
            rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.ravel().astype(np.int32))], names=[*batch.schema.names, name])

    return run


def _best(k: int, id_col: str, query_col: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids, asked = rows.column(id_col).combine_chunks(), queries.column(query_col).combine_chunks()
        found_q, found_r, found_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if rows.num_rows and queries.num_rows:
            width = int(pc.list_value_length(rows.column("embedding"))[0].as_py())
            v, q = (matrix_rows(t.column("embedding").combine_chunks(), width) for t in (rows, queries))
            order = np.argsort(np.array(ids.to_pylist(), object if pa.types.is_string(ids.type) else None), kind="stable")  # ties to the smaller id
            v = v[order]
            for a in range(0, len(q), 256):
                shown = shown_scores(v, q[a : a + 256])
                best = np.argsort(-shown, axis=0, kind="stable")[:k]
                found_q.append(np.repeat(np.arange(a, a + best.shape[1]), best.shape[0]))
                found_r.append(order[best.T.ravel()])
                found_s.append(shown[best.T.ravel(), np.repeat(np.arange(best.shape[1]), best.shape[0])])
        return pa.table({query_col: asked.take(pa.array(np.concatenate(found_q))), id_col: ids.take(pa.array(np.concatenate(found_r))), "score": pa.array(np.concatenate(found_s))})

    return run


@dataclass(frozen=True)
class InvertedLists:
    """An index in a folder: centroids/ (list, n, blocks, centroid) and lists/list=N/ (the id, embedding, block)."""

    spark: SparkSession
    folder: str
    id_col: str = "chunk_id"

    @staticmethod
    def build(vectors: DataFrame, folder: str, lists: int | None = None, id_col: str = "chunk_id", steps: int = STEPS) -> InvertedLists:
        """Trains and writes; by default there are about as many lists as the root of the number of vectors. Vectors whose length is not the
        usual one can't be found in it."""
        own = vectors.where(usable(vectors, id_col)).select(id_col, "embedding")
        lists = lists or max(1, min(MOST_LISTS, round(own.count() ** 0.5)))
        centroids = train(own, lists, steps, id_col=id_col)
        spark = own.sparkSession
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
        index = InvertedLists(spark, folder, id_col)
        index.add(own)
        return index

    @staticmethod
    def open(spark: SparkSession, folder: str, id_col: str = "chunk_id") -> InvertedLists:
        index = InvertedLists(spark, folder, id_col)
        index.centroids()
        return index

    def centroids(self) -> np.ndarray:
        try:
            rows = self.spark.read.parquet(f"{self.folder}/centroids").orderBy("list").collect()  # MOST_LISTS at most
        except AnalysisException as e:
            raise VectorStoreError(f"no index in {self.folder}") from e
        return np.array([r.centroid for r in rows], np.float64).reshape(len(rows), len(rows[0].centroid) if rows else 0)

    def add(self, vectors: DataFrame) -> None:
        """Appends vectors to their lists; ids are not compared with those that are there."""
        centroids = self.centroids()
        own = vectors.where(usable(vectors, self.id_col)).select(self.id_col, "embedding").where(F.size("embedding") == centroids.shape[1])
        if not len(centroids):
            return
        schema = StructType([*own.schema.fields, StructField("list", IntegerType())])
        placed = own.mapInArrow(_nearest(centroids, 1, "list", "list"), schema)
        # a large list is split among tasks by AQE, so no writer has it all
        placed.hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{self.folder}/lists")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/lists")

    def search(self, queries: DataFrame, k: int = 5, nprobe: int | None = 8, query_col: str = "query_id") -> DataFrame:
        """The k best of the `nprobe` nearest lists of each query (all lists for None): query_col, rank, id, score, as exact search has them.

        Queries that are null, hold a null or have another length than the index find nothing. Fewer rows in the lists give fewer hits.
        """
        centroids = self.centroids()
        id_type = vectors_type(self.rows() if len(centroids) else None, self.id_col)
        if not len(centroids):
            return self.spark.createDataFrame([], f"{query_col} {queries.schema[query_col].dataType.simpleString()}, {self.id_col} {id_type}, score double, rank int")
        double = F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
        asked = queries.where(usable(queries, query_col)).select(query_col, double).where(F.size("embedding") == centroids.shape[1])
        probed = asked.mapInArrow(_nearest(centroids, min(nprobe or len(centroids), len(centroids)), "list", "list"), StructType([*asked.schema.fields, StructField("list", IntegerType())]))
        lists = [r.list for r in probed.select("list").distinct().collect()]  # MOST_LISTS at most
        rows = self.rows().where(F.col("list").isin(lists))
        sizes = F.broadcast(rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))  # a row a list
        block = F.pmod(F.xxhash64(self.id_col), F.col("blocks")).cast("int").alias("block")
        dealt = rows.join(sizes, "list").select("list", block, self.id_col, double)
        meet = probed.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), query_col, "embedding")
        query_type = queries.schema[query_col].dataType.simpleString()
        met = meet.groupBy("list", "block").cogroup(dealt.groupBy("list", "block")).applyInArrow(_best(k, self.id_col, query_col), f"{query_col} {query_type}, {self.id_col} {id_type}, score double")
        return ranked(met, k, query_col, self.id_col)


def vectors_type(rows: DataFrame | None, id_col: str) -> str:
    return rows.schema[id_col].dataType.simpleString() if rows is not None else "string"


def recall(exact: DataFrame, found: DataFrame, id_col: str = "chunk_id", query_col: str = "query_id") -> DataFrame:
    """n_exact, n_found: hits of exact search, and those of them that the other search has too."""
    there = found.select(query_col, id_col).distinct().withColumn("hit", F.lit(1))
    return exact.select(query_col, id_col).join(there, [query_col, id_col], "left").agg(F.count("*").alias("n_exact"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"))
