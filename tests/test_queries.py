"""Every core query against DuckDB on the smallest tables, plans, and streams against tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import chunking as C
from scriptorium.operators import graph as G
from scriptorium.functions.splitter import fixed_split
from scriptorium.plans.oracles import ORACLES
from scriptorium.plans.queries import QUERIES
from scriptorium.streaming import ingest, monitoring

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert got
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == cols
        assert sorted(map(repr, got)) == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in want.fetchall())


def test_every_branch_is_taken(spark):
    got = lambda n, c: {r[c] for r in QUERIES[n](spark, SF).collect()}
    assert got("v8_confidence", "confidence") == {"High", "Medium", "Low"}
    assert got("q1_route", "tool") == {"summarizer", "comparator", "extractor", "retriever"}
    assert got("g6_rejections", "reason") == {"kept", "self_loop", "garbage"}
    assert len(got("t4_nearest_section", "section")) > 10


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark, capsys):
    QUERIES["v5_similarity_search"](spark, SF).explain("formatted")
    assert "WindowGroupLimit" in capsys.readouterr().out
    QUERIES["v10_delete_source"](spark, SF).explain("formatted")
    out = capsys.readouterr().out
    assert "PushedFilters" in out and "ReadSchema: struct<doc_id:bigint,source:string>" in out
    QUERIES["t4_nearest_section"](spark, SF).explain()
    out = capsys.readouterr().out
    assert "NestedLoop" not in out and "CartesianProduct" not in out


def test_stream_ingest_equals_batch_and_reruns_change_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("source", F.col("doc_id").cast("string").alias("page"), F.col("text").alias("raw_text"))
    half = docs.where("cast(page as int) % 2 = 0")
    half.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    docs.where("cast(page as int) % 2 = 1").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    to_chunks = lambda df: C.process_pages(df, fixed_split)
    to_edges = lambda df: G.build_edges(G.capitalised_mentions(df))

    def run():
        stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest.ingest(stream, f"file://{tmp_path}/out", to_chunks, to_edges).awaitTermination()
        return tuple(ingest.VersionedTable(spark, f"file://{tmp_path}/out/{t}", s, k).newest() for t, s, k in (("chunks", ingest.CHUNKS, "chunk_id"), ("edges", ingest.EDGES, None)))

    chunks, edges = run()
    want = to_chunks(docs)
    assert sorted(r.chunk_id for r in chunks.collect()) == sorted({r.chunk_id for r in want.collect()})
    assert edges.count() == to_edges(want).count()
    half.coalesce(1).write.parquet(f"{tmp_path}/in/c")
    again, doubled = run()
    assert again.count() == chunks.count()
    assert doubled.count() == edges.count() + to_edges(to_chunks(half)).count()


def test_stream_panels_equal_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = monitoring.panels(stream, late="10 minutes").writeStream.format("memory").queryName("panels").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(repr, spark.table("panels").collect())) == sorted(map(repr, monitoring.panels(events).collect()))
