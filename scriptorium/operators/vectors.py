"""The vector collection: ids, upsert, exact top-k search, selection search, deletion, and score statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.errors import RetrievalError
from scriptorium.functions import vector as V
from scriptorium.functions.exact import exact_mean

#: So many queries at most are sent out as one matrix (6 MB at 384 places).
MATRIX_QUERIES = 2048
#: Where there are more, blocks of so many rows meet blocks of so many queries.
VECTOR_BLOCK, GRID_QUERIES = 8192, 8192
#: Scores that a task holds at once (8 MB), and rows of a batch that it takes at once.
CELLS, ROWS_AT_ONCE = 1 << 20, 2048


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "chunk_id", version: str | None = None) -> DataFrame:
    """Insert or replace by key: incoming rows win, and of those with one key the highest version (or any of equal rows).

    Rows of an earlier version of the same file under other keys stay.
    """
    order = F.col(version).desc() if version else F.lit(0)
    newest = incoming.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return stored.join(newest.select(key), key, "left_anti").unionByName(newest)


def replace_source(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert that first drops all chunks of the incoming files, stale ones too."""
    return stored.join(incoming.select("source").distinct(), "source", "left_anti").unionByName(incoming)


def similarities_within(vectors: DataFrame, queries: DataFrame, id_col: str = "chunk_id", query_col: str = "query_id") -> DataFrame:
    """query_col, id_col, similarity, source of each query with the rows of the source it wants: one join by source, so a query
    meets no other source's rows. AQE splits a source that holds many of them."""
    stored = vectors.select(id_col, "source", F.transform("embedding", lambda x: x.cast("double")).alias("v")).withColumn("vn", V.norm(F.col("v")))
    asked = queries.select(query_col, "wanted", F.transform("embedding", lambda x: x.cast("double")).alias("q")).withColumn("qn", V.norm(F.col("q")))
    met = stored.join(asked, (F.col("source") == F.col("wanted")) & (F.size("v") == F.size("q")))
    cos = F.when((F.col("vn") == 0) | (F.col("qn") == 0), F.lit(0.0)).otherwise(V.dot(F.col("q"), F.col("v")) / (F.col("qn") * F.col("vn")))
    return met.select(query_col, id_col, V.score(cos).alias("score"), "source")


def require_searchable(vectors: DataFrame, questions: list[str]) -> None:
    """Raises RetrievalError for a blank question, and for a store without rows."""
    if not questions or any(not (q or "").strip() for q in questions):
        raise RetrievalError("a question is empty")
    if vectors.isEmpty():
        raise RetrievalError("the store is empty; take in documents first")


def ranked(scored: DataFrame, k: int, by: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """The k best of each query; Spark cuts each partition to k rows a query before the shuffle (WindowGroupLimit)."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.col("score").desc(), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def matrix_rows(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix: cut or filled up with zeros to the width, null as zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def as_shown(cos: np.ndarray) -> np.ndarray:
    """Cosines as they are reported, to four places."""
    cos = np.round(cos, 9)
    return np.floor(np.abs(cos) * 1e4 + 0.5) / 1e4 * np.sign(cos)


def of_length_one(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(1))[:, None]
    return np.divide(rows, length, out=np.zeros_like(rows), where=length != 0)


def shown_scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of all rows of v with all rows of q as they are reported, to four places; 0 where one has no length."""
    return as_shown(of_length_one(v) @ of_length_one(q).T)


def nearest(v: np.ndarray, v_widths: np.ndarray, q: np.ndarray, q_widths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, reported score) of the k best rows of v for each row of q, ties to the first row; pairs of unequal width are left out.

    At most CELLS scores are held at once. Rounding keeps the order, so what may be among the k best is found by the k-th best cosine and only that is
    rounded and sorted. NaN is the greatest score, as in Spark's order.
    """
    v, q = of_length_one(v), of_length_one(q)
    odd, uneven = np.isnan(v).any() or np.isnan(q).any(), len(set(v_widths.tolist()) | set(q_widths.tolist())) > 1
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, CELLS // max(1, len(v)))
    for a in range(0, len(q) if len(v) else 0, step):
        cos = q[a : a + step] @ v.T
        if odd:
            cos[np.isnan(cos)] = np.inf
        if uneven:
            cos[q_widths[a : a + step, None] != v_widths[None]] = -np.inf
        least = np.partition(cos, len(v) - k, axis=1)[:, len(v) - k] - 2e-4 if len(v) > k else np.full(len(cos), -np.inf)
        rows, cols = np.nonzero((cos >= least[:, None]) & (cos > -np.inf))
        found = cos[rows, cols]
        score = np.where(np.isinf(found), np.inf, as_shown(np.where(np.isinf(found), 0.0, found)))
        order = np.lexsort((cols, -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        out.append((rows[nth < k] + a, cols[nth < k], np.where(np.isinf(score[nth < k]), np.nan, score[nth < k])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _lengths(column: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def _by_id(ids: pa.Array) -> np.ndarray:
    """The order of ids: ties go to the smaller one."""
    return np.argsort(np.array(ids.to_pylist(), object if pa.types.is_string(ids.type) else None), kind="stable")


def _matmul_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, query_col: str) -> DataFrame:
    """Each Arrow batch is scored against a query matrix of bounded size, some rows at once, and hands on its k best of each query."""
    asked = queries.select(query_col, "embedding").where("embedding is not null").collect()
    widths = np.array([len(r[1]) for r in asked], np.int64)
    width = int(widths.max(initial=0))
    q = np.array([list(r[1]) + [0.0] * (width - len(r[1])) for r in asked], np.float64).reshape(len(asked), width)
    names = pa.array([r[0] for r in asked], to_arrow_type(queries.schema[query_col].dataType))
    id_type, query_type = vectors.schema[id_col].dataType.simpleString(), queries.schema[query_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(a, ROWS_AT_ONCE)
                order = _by_id(batch.column(0))
                own, row, score = nearest(matrix_rows(batch.column(1), width)[order], _lengths(batch.column(1))[order], q, widths, k)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), batch.column(0).take(pa.array(order[row])), pa.array(score)], names=[query_col, id_col, "score"])

    own = vectors.select(id_col, F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).where(F.col(id_col).isNotNull())
    return ranked(own.mapInArrow(run, f"{query_col} {query_type}, {id_col} {id_type}, score double"), k, query_col, id_col)


def _grid_best(k: int, id_col: str, query_col: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, names, v, q = (t.column(c).combine_chunks() for t, c in ((rows, id_col), (asked, query_col), (rows, "embedding"), (asked, "embedding")))
        order, width = _by_id(ids), int(max(_lengths(v).max(initial=0), _lengths(q).max(initial=0)))
        own, row, score = nearest(matrix_rows(v, width)[order], _lengths(v)[order], matrix_rows(q, width), _lengths(q), k)
        return pa.table({query_col: names.take(pa.array(own)), id_col: ids.take(pa.array(order[row])), "score": pa.array(score)})

    return run


def _grid_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, query_col: str) -> DataFrame:
    """Blocks of vectors meet blocks of queries, each pair of blocks in a group of its own, as a product of two matrices.

    A group is of bounded size however many rows there are on either side; there are as many as the product of the blocks.
    """
    sides, n = [], (-(-vectors.count() // VECTOR_BLOCK), -(-queries.count() // GRID_QUERIES))
    for side, (df, key) in enumerate(((vectors, id_col), (queries, query_col))):
        own = df.select(key, F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
        own = own.withColumn(f"block{side}", F.pmod(F.xxhash64(key, "embedding"), F.lit(max(1, n[side]))))
        sides.append(own.withColumn(f"block{1 - side}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n[1 - side]) - 1).cast("long")))))
    id_type, query_type = (df.schema[c].dataType.simpleString() for df, c in ((vectors, id_col), (queries, query_col)))
    met = sides[0].groupBy("block0", "block1").cogroup(sides[1].groupBy("block0", "block1"))
    return ranked(met.applyInArrow(_grid_best(k, id_col, query_col), f"{query_col} {query_type}, {id_col} {id_type}, score double"), k, query_col, id_col)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "chunk_id", query_col: str = "query_id") -> DataFrame:
    """Exact top-k: query_col, rank, id_col, score; fewer where the collection is smaller.

    Vectors and queries that are null or hold a null are left out, and so are pairs of unequal length.
    Up to MATRIX_QUERIES queries go to the executors as one matrix; beyond that, blocks of queries meet blocks of rows.
    """
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    vectors, queries = vectors.where(whole & F.col(id_col).isNotNull()), queries.where(whole)
    if queries.limit(MATRIX_QUERIES + 1).count() <= MATRIX_QUERIES:
        return _matmul_search(vectors, queries, k, id_col, query_col)
    return _grid_search(vectors, queries, k, id_col, query_col)


def retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Search joined to chunk metadata with defaults and a confidence label, ordered by rank within a query."""
    hits = search(vectors, queries, k)
    meta = chunks.select("chunk_id", "text", F.coalesce("source", F.lit("Unknown")).alias("source"), F.coalesce("page", F.lit("?")).alias("page"), F.coalesce("section", F.lit("Unknown")).alias("section"), F.coalesce("doc_type", F.lit("pdf")).alias("doc_type"))
    return hits.join(meta, "chunk_id").select("query_id", "rank", "chunk_id", "text", "source", "page", "section", "score", V.confidence(F.col("score")).alias("confidence"), "doc_type")


def selection_search(vectors: DataFrame, queries: DataFrame, n: int = 5, id_col: str = "chunk_id", query_col: str = "query_id", prefilter: bool = False) -> DataFrame:
    """Search near a selection: queries also have `wanted`, the source it was made in.

    The 3 n best are found first, and of those the ones from that source are kept; where there are none, all are. That is
    not the same as a search within the source, which prefilter=True gives.
    """
    sources = vectors.select(id_col, "source")
    if prefilter:
        return ranked(similarities_within(vectors, queries, id_col, query_col), n, query_col, id_col)
    wide = search(vectors, queries, 3 * n, id_col, query_col).join(sources, id_col).join(queries.select(query_col, "wanted"), query_col)
    matches = F.coalesce(F.col("source") == F.col("wanted"), F.lit(False))
    marked = wide.withColumn("match", matches).withColumn("any_match", F.max("match").over(W.partitionBy(query_col)))
    return ranked(marked.where("match or not any_match").drop("match", "any_match", "wanted", "rank"), n, query_col, id_col)


def without_source(stored: DataFrame, source: str) -> tuple[DataFrame, Column]:
    """(the rows that stay, the condition of those that go). Count the latter before the former is written elsewhere."""
    return stored.where(F.col("source").isNull() | (F.col("source") != source)), F.col("source") == source


def list_sources(chunks: DataFrame) -> DataFrame:
    return chunks.select("source").where("source is not null").distinct().orderBy("source")


def stats(chunks: DataFrame) -> DataFrame:
    """total_chunks, total_documents, documents (sorted names, one line each). Names are made distinct before they are gathered."""
    per = chunks.groupBy("source").count()
    return per.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_chunks"), F.count("source").alias("total_documents"), F.array_join(F.sort_array(F.collect_list("source")), "\n").alias("documents"))


def score_summary(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), exact_mean(F.col("score"), 6).alias("mean"))


def score_histogram(hits: DataFrame, bins: int = 25) -> DataFrame:
    """Equal bins between the least and the most score, the last one closed; each with its left edge's label."""
    ends = hits.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    at = F.when(F.col("high") == F.col("low"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("low")) / ((F.col("high") - F.col("low")) / F.lit(bins))).cast("int")))
    rows = hits.join(ends, F.lit(True)).select(at.alias("bin"), "low", "high")
    edge = F.round(F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / bins, 6)
    counted = rows.groupBy("bin", "low", "high").count().withColumn("left_edge", edge)
    return counted.select("bin", "left_edge", F.col("count").alias("n"), V.confidence(F.col("left_edge")).alias("label"))


def projection(vectors: DataFrame, id_col: str = "vec_id", first: int = 100) -> DataFrame:
    """Two principal components of the first vectors by id: id_col, x, y. Signs are arbitrary."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = vectors.orderBy(id_col).limit(first).select(id_col, array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(own)
    out = model.transform(own).select(id_col, vector_to_array("p").alias("p"))
    return out.select(id_col, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
