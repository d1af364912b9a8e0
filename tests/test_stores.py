"""Inverted lists against exact search, and the store by buckets against the plain log."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.errors import VectorStoreError
from scriptorium.operators import inverted as I
from scriptorium.operators import vectors as X
from scriptorium.sources.buckets import BucketedTable
from scriptorium.streaming.ingest import VersionedTable


def plan_of(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(40, 24))
    rows = [(i, (middles[i % 40] + 0.6 * rng.normal(size=24)).tolist()) for i in range(4000)]
    rows += [(5000, None), (5001, [None] + [1.0] * 23), (5002, [1.0] * 3), (5003, [0.0] * 24), (None, [1.0] * 24)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(5).cache()


def asked_of(df):
    return df.where("chunk_id % 20 = 0 or chunk_id > 4990").select(F.col("chunk_id").alias("query_id"), "embedding")


def test_probing_all_lists_is_exact_search(spark, clustered, tmp_path):
    index = I.InvertedLists.build(clustered, f"file://{tmp_path}/a", lists=30)
    exact = X.search(clustered, asked_of(clustered), 5)
    usual = exact.where("query_id <> 5002")  # of another length than the index
    assert sorted(map(tuple, index.search(asked_of(clustered), 5, None).select(*usual.columns).collect())) == sorted(map(tuple, usual.collect()))
    again = I.InvertedLists.open(spark, f"file://{tmp_path}/a")
    assert (again.centroids() == index.centroids()).all() and (I.train(clustered.repartition(3), 30) == index.centroids()).all()


def test_few_lists_find_nearly_all_and_read_no_others(spark, clustered, tmp_path, capsys):
    index = I.InvertedLists.build(clustered, f"file://{tmp_path}/b", lists=40)
    asked = asked_of(clustered).where("query_id < 4000")
    found = index.search(asked, 5, 6)
    row = I.recall(X.search(clustered, asked, 5), found).first()
    assert row.n_exact == 1000 and row.n_found >= 0.9 * row.n_exact
    one = index.search(asked.where("query_id = 20"), 5, 2)
    out = plan_of(one, capsys)
    assert "PartitionFilters: [isnotnull(list" in out or "PartitionFilters: [list" in out
    lists = {r.list for r in index.rows().select("list").distinct().collect()}
    read = set(one.inputFiles())
    assert 0 < len({p.split("list=")[1].split("/")[0] for p in read if "list=" in p}) <= len(lists)
    index.add(clustered.where("chunk_id < 100").withColumn("chunk_id", F.col("chunk_id") + 10_000))
    twin = index.search(asked.where("query_id = 20"), 2, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in twin] == [20, 10_020]


def test_inverted_lists_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    index = I.InvertedLists.build(empty, f"file://{tmp_path}/c")
    assert index.centroids().shape[0] == 0
    with pytest.raises(VectorStoreError):
        I.InvertedLists.open(spark, f"file://{tmp_path}/nowhere")
    with pytest.raises(VectorStoreError):
        I.train(empty, 0)


SCHEMA = "chunk_id string, source string, n int"


def test_buckets_agree_with_the_plain_log(spark, tmp_path, capsys):
    rng = random.Random(4)
    plain = VersionedTable(spark, f"file://{tmp_path}/plain", SCHEMA, "chunk_id")
    table = BucketedTable(spark, f"file://{tmp_path}/buckets", SCHEMA, "chunk_id", 4)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert table.newest().count() == 0 and table.latest() == 0
    for version in range(1, 8):
        if version in (3, 6):
            plain.delete(version, f"s{version % 3}")
            table.delete(version, f"s{version % 3}")
        keys = rng.sample(range(60), 25)
        rows = spark.createDataFrame([(f"k{k}", f"s{rng.randrange(3)}", version * 100 + k) for k in keys], SCHEMA)
        plain.write(version, rows)
        table.write(version, rows)
        if version == 4:
            assert table.compact() == 4 == table.compact()
        assert same(table.newest(), plain.newest())
    assert all(same(table.at(v), plain.at(v)) for v in (4, 5, 6))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = plan_of(table.at(5), capsys)
        assert "SortMergeJoin" in merged and "Exchange" not in merged and "Window" not in merged
        incoming = spark.createDataFrame([("k1", "x", 1), ("new", "x", 2)], SCHEMA)
        table.compact()
        stored = plan_of(X.upsert(table.newest(), incoming), capsys)
        assert "Window" not in plan_of(table.newest(), capsys) and "Join" not in plan_of(table.newest(), capsys)
        assert stored.count(") Exchange") == len([x for x in stored.split("\n") if "Exchange" in x and x.startswith("(")]) <= 2
        upsert = stored[stored.index("SortMergeJoin") :]
        assert "Bucketed: true" in upsert and "SelectedBucketsCount: 4 out of 4" in upsert
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert same(table.newest(), plain.newest())
    rows = spark.createDataFrame([("k1", "again", 7)], SCHEMA)
    table.write(8, rows)
    table.write(8, rows)  # delivered twice
    assert table.newest().where("chunk_id = 'k1'").collect() == [("k1", "again", 7)]
    table.compact()
    table.forget(8)
    other = BucketedTable(spark, f"file://{tmp_path}/buckets", SCHEMA, "chunk_id", 4)  # opened again
    plain.write(8, rows)
    assert same(other.newest(), plain.newest()) and other.latest() == 8
    with pytest.raises(Exception, match="chunk_id is null"):
        other.write(9, spark.createDataFrame([(None, "s", 1)], SCHEMA))
    with pytest.raises(VectorStoreError):
        other.forget(3)
    other.drop_names()


def test_an_index_in_buckets_is_the_index(spark, tmp_path):
    from scriptorium.operators.index import Index

    (tmp_path / "in").mkdir()
    for k, name in enumerate(("a.pdf", "b.pdf")):
        (tmp_path / "in" / name).write_text("\f".join(f"Ada Lovelace wrote page {p} of volume {k}, and told Charles Babbage about the looms of Lyon. " * 9 for p in range(3)))
    both = [Index(spark, f"file://{tmp_path}/{n}", buckets=n) for n in (None, 4)]
    for index in both:
        assert {s for _, _, s in index.ingest_documents(f"file://{tmp_path}/in/*.pdf")} == {"success"}
    plain, bucketed = both
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(plain.chunks()) == rows(bucketed.chunks()) and bucketed.compact() == bucketed.version
    assert rows(plain.search(["looms of Lyon"], 3)) == rows(bucketed.search(["looms of Lyon"], 3))
    near = bucketed.approximate(f"file://{tmp_path}/lists", 3)
    asked = bucketed.vectors().limit(3).select(F.col("chunk_id").alias("query_id"), "embedding")
    assert rows(near.search(asked, 2, None).select("query_id", "rank", "chunk_id", "score")) == rows(X.search(bucketed.vectors(), asked, 2).select("query_id", "rank", "chunk_id", "score"))
    assert plain.delete_document("a.pdf") == bucketed.delete_document("a.pdf") > 0
    again = Index(spark, f"file://{tmp_path}/4", buckets=4)
    assert again.list_documents() == ["b.pdf"] and again.version == bucketed.version and rows(again.chunks()) == rows(plain.chunks())
    bucketed.version = 0
    with pytest.raises(VectorStoreError):
        bucketed.ingest_documents(f"file://{tmp_path}/in/b.pdf")  # a version that is there
    with pytest.raises(VectorStoreError):
        plain.compact()
    again.chunk_table.drop_names()
