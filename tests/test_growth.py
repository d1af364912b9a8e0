"""What must not grow faster than its input: rows that are shuffled, how often a step is run, rows that a task holds."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import vector as V
from scriptorium.functions.splitter import recursive_split
from scriptorium.operators import fitted, gazetteer, tagging
from scriptorium.operators import graph as G
from scriptorium.operators import vectors as X
from scriptorium.session import stored
from tests.test_graph import EDGE, random_edges


def shuffled_rows(spark, run) -> int:
    """Rows that the jobs of a call send through a shuffle."""
    sc, group = spark.sparkContext, f"group-{random.random()}"
    sc.setJobGroup(group, group)
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    stages = {s for job in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(job).stageIds}
    return sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def whole_walks(edges, starts, hops, n, both):
    walked = G.traverse(edges, starts, hops, both).withColumn("head", F.left("chunk_text", F.lit(50)))
    order = ["start_rank", "level", "order_key"]
    once = walked.withColumn("nth", F.row_number().over(W.partitionBy("query_id", "source", "page", "head").orderBy(*order))).where("nth = 1")
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= n)
    return ranked.select("query_id", "rank", "chunk_text", "source", "page", F.array_join("path", " -> ").alias("entity_path"), "relation")


@pytest.mark.parametrize("both", [False, True])
def test_retrieval_is_what_whole_walks_find(spark, both):
    few_pages = [(s, d, r, src, str(seq % 4), f"{t[:3]}{seq % 3}", seq) for s, d, r, src, _, t, seq in random_edges(seed=11)]
    starts = spark.createDataFrame([(1, "n3", 1), (1, "n7", 2), (2, "n50", 1), (2, "n12", 2), (2, "n1", 3), (3, "nowhere", 1), (4, "n20", 1)], "query_id long, node string, start_rank int")
    for rows, n, hops in ((random_edges(), 5, 2), (few_pages, 9, 2), (few_pages, 30, 3)):
        edges = spark.createDataFrame(rows, EDGE)
        assert sorted(map(repr, G.graph_retrieve(edges, starts, hops, n, both).collect())) == sorted(map(repr, whole_walks(edges, starts, hops, n, both).collect()))


def test_retrieval_from_a_hub_leaves_the_second_hop_alone(spark):
    """300 ways out of a node, and 100 from each of them: 30,000 edges behind, none of which is needed."""
    near = spark.range(300).select(F.lit("hub").alias("src"), F.concat(F.lit("m"), "id").alias("dst"), F.col("id").alias("seq"))
    far = spark.range(30_000).select(F.concat(F.lit("m"), F.col("id") % 300).alias("src"), F.concat(F.lit("x"), "id").alias("dst"), (F.col("id") + 300).alias("seq"))
    edges = near.unionByName(far).select("src", "dst", F.lit("r").alias("relation"), F.lit("s").alias("source"), F.col("seq").cast("string").alias("page"), F.lit("text").alias("chunk_text"), "seq")
    starts = spark.createDataFrame([(1, "hub", 1)], "query_id long, node string, start_rank int")
    got = []
    assert shuffled_rows(spark, lambda: got.extend(G.graph_retrieve(edges, starts).orderBy("rank").collect())) < 5_000
    assert [r.page for r in got] == ["0", "1", "2", "3", "4"]


def by_brute_force(v, q, k):
    shown = X.shown_scores(v, q)
    return [(j, i, shown[i, j]) for j in range(len(q)) for i in sorted(range(len(v)), key=lambda i: (-shown[i, j], i))[:k]]


@pytest.mark.parametrize("cells", [1, 1000, 1 << 20])
def test_nearest_equals_sorting_all_scores(monkeypatch, cells):
    monkeypatch.setattr(X, "CELLS", cells)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(60, 5)), np.zeros((3, 5)), np.repeat(rng.normal(size=(1, 5)), 20, 0), rng.integers(0, 2, (40, 5)).astype(float)])
    q = np.concatenate([v[60:85:3], rng.normal(size=(6, 5))])
    for k in (1, 7, 200):
        own, row, score = X.nearest(v, np.full(len(v), 5), q, np.full(len(q), 5), k)
        assert list(zip(own.tolist(), row.tolist(), score.tolist(), strict=True)) == by_brute_force(v, q, k)


def test_many_queries_meet_vectors_in_blocks_of_bounded_size(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(300)]
    stored = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = stored.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    by_matrix = sorted(map(tuple, X.search(stored, asked, 4).collect()))
    for name, value in {"MATRIX_QUERIES": 8, "VECTOR_BLOCK": 64, "GRID_QUERIES": 32}.items():
        monkeypatch.setattr(X, name, value)
    found = X.search(stored, asked, 4)
    assert sorted(map(tuple, found.select("query_id", "chunk_id", "score", "rank").collect())) == sorted((r[0], r[1], r[2], r[3]) for r in by_matrix)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def python_steps(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_texts_are_embedded_and_split_once(spark):
    docs = spark.createDataFrame([("a", "One two. Three four"), ("b", None)], "chunk_id string, text string").select("chunk_id", "text", V.hashed_embedding(F.col("text")).alias("embedding"))
    asked = docs.select(F.col("chunk_id").alias("query_id"), "embedding").where("query_id = 'a'")
    found = X.search(docs, asked, 2)
    assert python_steps(found) == 1
    assert sorted((r.chunk_id, r.score) for r in found.collect()) == [("a", 1.0), ("b", 0.0)]
    assert python_steps(docs.select(F.explode(recursive_split(F.col("text"))))) == 1


def test_sentences_are_counted_without_a_row_for_each_token(spark, monkeypatch):
    """The same counts as by a row for each token; what is exploded and aggregated are sums."""
    monkeypatch.setattr(tagging, "COUNTED_TOKENS", 20)
    odd = ["", None, "...", "Ada met\u00a0Bob\u2003today. Él vio 12½ Ärger! ÉCOLE Σίσυφος ΣΟΦΟΣ e\u0301te \U0001d400x _a-b İzmir ǅungla", "\n\n A.  B?\tc! d", "der Hund traf 3 Katzen (und 4 «Mäuse»)."]
    rng = random.Random(12)
    words = "Ada Bob met wrote the der 12 , ; Zürich hat fondé LE running Walking 3rd".split()
    texts = odd + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) + rng.choice([".", "!", " x. Y"]) for _ in range(60)]
    chunks = spark.createDataFrame([(str(i), "s", "1", t) for i, t in enumerate(texts)], "chunk_id string, source string, page string, text string").repartition(3)
    found = tagging.lexicon_counts(chunks)
    whole = {(r.kind, r.a, r.b): r.n for r in tagging.counts(tagging.tagged_tokens(chunks)).collect()}
    assert {(r.kind, r.a, r.b): r.n for r in found.collect()} == whole and len(whole) > 60
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Aggregate") < plan.index("MapInArrow") < plan.index("Generate")  # sentences alone are rows
    by_rows, by_sums = tagging.fit(tagging.tagged_tokens(chunks)), tagging.fit_by_lexicon(chunks)
    assert (by_rows.step == by_sums.step).all() and by_rows.words.keys() == by_sums.words.keys()


def test_texts_are_written_once_however_many_names_there_are(spark, monkeypatch):
    """Blocks of a few texts with three names each: what one automaton over all names finds, and one table of texts."""
    monkeypatch.setattr(gazetteer, "BLOCK_BYTES", 200)
    kept = []
    monkeypatch.setattr(gazetteer, "stored", lambda df, name, **more: kept.append(name) or stored(df, name, **more))
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("Ann", "Ärger", "x_Bo", "c-D", "O'N", "½", "1") for b in range(9)] + ["+", "++", "_", "and"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", "-", "_", "'"]) for _ in range(rng.randint(0, 25))) for _ in range(90)] + ["", None]
    names = {f"{w}{rng.choice(['', f' {rng.choice(words)}', '.', '-x'])}" for w in words} | {"+", "++", "_", "Ann1_"}
    chunks = spark.createDataFrame([(str(i), "s", "1", t) for i, t in enumerate(texts)], "chunk_id string, source string, page string, text string").repartition(3)
    table = spark.createDataFrame([(n, f"L{i % 4}") for i, n in enumerate(sorted(names))], "name string, label string")
    whole, by_blocks = (sorted(map(repr, gazetteer.labelled_mentions(chunks, table, part).collect())) for part in (1000, 3))
    assert whole == by_blocks and len(whole) == 92 and sum("surface" in r for r in whole) > 50
    assert kept == ["gazetteer", "gazetteer", "blocks"]


def test_a_space_is_fitted_by_taking_texts_apart_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return f"word{i % 7} word{i % 11} more"

    df = spark.range(200).select(text.asNondeterministic()("id").alias("text"))
    model = fitted.fit(df, dimensions=4, terms=256, steps=3)
    assert seen.value == 200 and (model.strengths[:4] > 0).all()


@pytest.mark.parametrize("long", [1, 10**9])
def test_products_do_not_hang_on_how_rows_are_multiplied(monkeypatch, long):
    monkeypatch.setattr(fitted, "LONG", long)
    rng = np.random.default_rng(2)
    texts = pa.array([" ".join(f"w{i}" for i in rng.integers(0, 90, n)) for n in (3, 0, 40, 900, 1)] + [None])
    counted = list(fitted._counted(64)(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])))
    row, term, weight = fitted.entries(texts, V.Places(64), np.arange(1.0, 65.0))
    matrix, block = np.zeros((6, 64)), rng.normal(size=(64, 5))
    matrix[row, term] = weight
    got = b"".join(x for b in fitted._products(np.arange(1.0, 65.0), block)(iter([b.slice(1) for b in counted] + [b.slice(0, 1) for b in counted])) for x in b.column(1).to_pylist())
    assert np.allclose(np.frombuffer(got).reshape(64, 5), matrix.T @ matrix @ block)


def test_places_are_those_of_each_token(monkeypatch):
    monkeypatch.setattr(V, "MOST_KNOWN", 3)
    places = V.Places(97)
    for words in (["a", "b"], ["b", "", "c"], ["d", "a", "e"], [], ["a", "e", "ß"]):
        assert places(pa.array(words, pa.string())).tolist() == [V.bucket(w, 97) for w in words]


def test_a_part_of_a_batch_is_bounded_in_rows_and_bytes():
    texts = pa.array(["x"] * 3000 + ["y" * (V.AT_ONCE // 2)] * 5 + [None, "z" * (2 * V.AT_ONCE), ""])
    parts = list(V.text_parts(texts))
    assert pa.concat_arrays(parts).equals(texts)
    assert all(len(p) <= V.ROWS_AT_ONCE and (len(p) == 1 or sum(len(x or "") for x in p.to_pylist()) <= V.AT_ONCE) for p in parts)
    lists = pa.RecordBatch.from_arrays([pa.array([["a" * 100_000, "b"], None, [], ["c" * 300_000], ["d"]] + [["e"]] * 600, pa.list_(pa.string()))], names=["s"])
    runs = list(gazetteer.slices(lists, 0))
    assert [x for r in runs for x in r.column(0).to_pylist()] == lists.column(0).to_pylist()
    assert max(r.num_rows for r in runs) <= gazetteer.ROWS_AT_ONCE and len(runs) >= 4


def test_tags_do_not_hang_on_what_is_tagged_side_by_side(monkeypatch):
    model = tagging.Model([("step", "", "NAME", 5), ("step", "NAME", "VERB", 4), ("step", "VERB", "NAME", 3), ("word", "^ann", "NAME", 3), ("word", "met", "VERB", 3), ("tag", "", "NAME", 5), ("tag", "", "VERB", 4)])
    batch = [["Ann", "met", "Bob"] * n for n in (1, 40, 3, 7)] + [[]]
    whole = [x.tolist() for x in tagging.viterbi(model, batch)]
    monkeypatch.setattr(tagging, "GRID_TOKENS", 10)
    assert [x.tolist() for x in tagging.viterbi(model, batch)] == whole


def test_edges_are_gone_through_once_for_their_counts(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b"), ("c", "a")], "src string, dst string")
    chunks = spark.createDataFrame([("d_1.pdf",), ("a",)], "source string")
    stats = G.graph_stats(edges, chunks)
    assert [tuple(r) for r in stats.collect()] == [(4, 4)] and [tuple(r) for r in G.graph_stats(edges.limit(0)).collect()] == [(0, 0)]
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + stats._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 2
