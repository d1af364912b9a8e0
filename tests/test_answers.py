"""Ranked answers and labelled mentions against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.errors import EmbeddingError
from scriptorium.functions import vector as V
from scriptorium.operators import answering as A
from scriptorium.operators import fitted as D
from scriptorium.operators import gazetteer as Z
from scriptorium.operators import graph as G
from scriptorium.operators import tagging as N

TEXT = "chunk_id string, source string, page string, text string"


def plain_ranks(sims, wanted):
    n, start = len(sims), [max(w, 0.0) for w in wanted]
    start = [s / sum(start) for s in start] if sum(start) else [1 / n] * n
    ways = []
    for i in range(n):
        row = [max(sims[i][j], 0.0) if i != j else 0.0 for j in range(n)]
        ways.append([x / sum(row) for x in row] if sum(row) else [1 / n] * n)
    rank = start
    for _ in range(A.ROUNDS):
        rank = [(1 - A.DAMPING) * start[j] + A.DAMPING * sum(rank[i] * ways[i][j] for i in range(n)) for j in range(n)]
    return rank


def test_ranks_and_novelty_equal_plain_python():
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(12, 5)))
    x[4] = 0.0
    length = np.maximum(np.linalg.norm(x, axis=1), 1e-12)
    sims = (x / length[:, None]) @ (x / length[:, None]).T
    wanted = rng.random(12)
    rank = A.sentence_ranks(sims, wanted)
    assert np.allclose(rank, plain_ranks(sims.tolist(), wanted.tolist())) and abs(rank.sum() - 1) < 1e-9
    chosen, top = [], max(rank)
    while len(chosen) < 4:
        score = lambda i: A.NOVELTY * round(rank[i] / top, 9) - (1 - A.NOVELTY) * max((round(sims[i][j], 9) for j in chosen), default=0.0)
        chosen.append(max((i for i in range(12) if i not in chosen), key=lambda i: (score(i), -i)))
    assert A.most_novel(rank, sims, 4) == chosen
    assert A.most_novel(np.zeros(0), np.zeros((0, 0)), 2) == []


def test_answers_cite_their_chunks_and_repeat_nothing(spark):
    questions = spark.createDataFrame([(1, "Which colour has the grass in spring?"), (2, "nothing is found"), (3, "short")], "query_id long, question string")
    hits = spark.createDataFrame(
        [
            (1, 1, "c1", "The sky is blue over the sea. The grass has a green colour in spring. Cats sleep all day long."),
            (1, 2, "c2", "The grass has a green colour in spring. In autumn the grass has a brown colour. Dogs bark at night."),
            (3, 1, "c3", "tiny. x."),
        ],
        "query_id long, rank int, chunk_id string, text string",
    )
    got = {r.query_id: r for r in A.ranked_answers(questions, hits).collect()}
    assert set(got) == {1}
    cites = [(c.chunk_id, c.sentence, c.text) for c in got[1].cites]
    assert cites[0] == ("c1", 1, "The grass has a green colour in spring.") and len(cites) == 2
    assert got[1].answer == " ".join(c[2] for c in cites) and cites[1][2] != cites[0][2]
    few = A.ranked_answers(questions, hits, limit=5, most=1).first()
    assert len(few.cites) == 1
    status = {r.query_id: (r.status, r.answer) for r in A.answered(questions, hits.withColumns({"source": F.lit("s"), "page": F.lit("1"), "section": F.lit("x"), "score": F.lit(0.5), "confidence": F.lit("Low")}), ranked=True).collect()}
    assert status[1] == ("ok", got[1].answer) and status[2][0] == "no_context" and status[3][0] == "failed"


def test_all_sentences_of_the_hits_take_part(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(f"{' '.join(rng.choice(words) for _ in range(6)).capitalize()} n{k}s{i}." for i in range(150)) for k in range(2)]
    question = "zebra"  # like none of them, so the first 200 would be as good as any
    hits = spark.createDataFrame([(1, k + 1, f"c{k}", t) for k, t in enumerate(texts)], "query_id long, rank int, chunk_id string, text string")
    asked = spark.createDataFrame([(1, question)], "query_id long, question string")
    sentences = [(f"c{k}", i, s) for k, t in enumerate(texts) for i, s in enumerate(t.replace(". ", ".\n").split("\n"))]

    def vector(text):
        out = np.zeros(V.DIMENSIONS)
        for token in text.lower().replace(".", "").split():
            out[V.bucket(token)] += 1
        return out / np.linalg.norm(out)

    x = np.array([vector(s) for _, _, s in sentences])
    rank = plain_ranks((x @ x.T).tolist(), (x @ vector(question)).tolist())
    want = [sentences[i] for i in A.most_novel(np.array(rank), x @ x.T, 6)]
    got = [(c.chunk_id, c.sentence, c.text) for c in A.ranked_answers(asked, hits, limit=6).first().cites]
    assert len(sentences) == 300 and got == want
    fewer = [(c.chunk_id, c.sentence, c.text) for c in A.ranked_answers(asked, hits, limit=6, most=200).first().cites]
    assert fewer != want


@pytest.mark.parametrize("signed", [False, True])
def test_ranks_by_vectors_equal_those_of_the_matrix(monkeypatch, signed):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2, (70, 12)).astype(float) * rng.random((70, 12))
    x[5], x[6], x[7, :] = 0.0, 0.0, 0.0
    x = np.concatenate([x, np.zeros((70, 1))], 1)
    x[7, 12] = 1.0  # like no other
    x = x * rng.choice([-1, 1], x.shape) if signed else x
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    wanted = rng.random(70)
    whole = A.vector_ranks(x, wanted)
    assert np.allclose(whole, plain_ranks((x @ x.T).tolist(), wanted.tolist()), atol=1e-12)
    monkeypatch.setattr(A, "CELLS", 300)
    assert np.allclose(A.vector_ranks(x, wanted), whole, rtol=1e-12, atol=1e-14)
    assert np.isclose(whole.sum(), 1)


def plain_mentions(text, names):
    out, at = [], 0
    while at < len(text):
        fits = [n for n in names if text.startswith(n, at) and (at == 0 or not text[at - 1].isalnum()) and (at + len(n) == len(text) or not text[at + len(n)].isalnum())]
        if fits:
            best = max(fits, key=len)
            out.append((best, names[best]))
            at += len(best)
        else:
            at += 1
    return out


@pytest.mark.parametrize("part", [100, 3])
def test_labelled_mentions_equal_plain_search(spark, part):
    rng = random.Random(1)
    names = {"New York": "GPE", "York": "GPE", "New York Times": "ORG", "Times": "ORG", "São Tomé": "LOC", "C++": "PRODUCT", "Ada": "PERSON", "1945": "DATE", "Ada Lovelace": "PERSON", "Lovelace Prize": "EVENT"}
    words = ["New", "York", "Times", "Ada", "Lovelace", "Prize", "São", "Tomé", "C++", "1945", "19450", "Yorker", "the", "xAda", "Ada."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", None, "New York", "Ada! Ada? Ada Lovelace Prize"]
    chunks = spark.createDataFrame([(str(i), "s", "1", t) for i, t in enumerate(texts)], TEXT)
    table = spark.createDataFrame([*names.items(), ("Ada", "ZZZ"), ("", "ORG"), (None, "ORG"), ("Nobody", None)], "name string, label string")
    got = {}
    for r in Z.labelled_mentions(chunks, table, part).collect():
        got[int(r.chunk_id)] = [(m.surface, m.label) for s in r.mentions or [] for m in s]
    import re

    for i, text in enumerate(texts):
        want = [m for s in re.split(r"(?<=[.!?])\s+", text or "") for m in plain_mentions(s, names)]
        assert got[i] == want, text
    kept = G.relevant(Z.labelled_mentions(chunks, table, part)).select(F.explode("m").alias("m")).select("m.name").distinct().collect()
    assert "1945" not in {r.name for r in kept} and "Ada Lovelace" in {r.name for r in kept}
    assert Z.labelled_mentions(chunks, table.limit(0)).select(F.explode(F.flatten("mentions"))).count() == 0


def test_hashed_embedding_counts_tokens(spark):
    df = spark.createDataFrame([("Ab ab, AB_c 12 ½",), (None,), ("",), ("über Über",)], "t string")
    rows = [r.v for r in df.select(V.hashed_embedding(F.col("t")).alias("v")).collect()]
    want = np.zeros(V.DIMENSIONS)
    for token in ("ab", "ab", "ab", "c", "12", "½"):
        want[V.bucket(token)] += 1
    assert rows[0] == want.tolist() and sum(rows[1]) == sum(rows[2]) == 0 and max(rows[3]) == 2.0


def test_viterbi_finds_the_best_of_all_taggings():
    import itertools

    rng = random.Random(2)
    tags = ("A", "B", "C")
    rows = [("step", a, b, rng.randint(0, 9)) for a in ("", *tags) for b in tags] + [("tag", "", t, 30) for t in tags]
    rows += [("word", w, t, rng.randint(0, 9)) for w in ("x", "y", "^z") for t in tags] + [("ending", "ing", "B", 20)]
    model = N.Model(rows, tags)
    batch = [[rng.choice(["x", "y", "Z", "going", "new"]) for _ in range(n)] for n in (0, 1, 2, 5, 6, 6, 1)]
    for sentence, got in zip(batch, N.viterbi(model, batch), strict=True):
        score = lambda path: sum(model.emission(w)[t] for w, t in zip(sentence, path, strict=True)) + (model.start[path[0]] if path else 0) + sum(model.step[a, b] for a, b in itertools.pairwise(path))  # noqa: E731,B023
        best = max((score(p) for p in itertools.product(range(3), repeat=len(sentence))), default=0)
        assert len(got) == len(sentence) and abs(score(tuple(got.tolist())) - best) < 1e-9
    assert (model.emission("singing") == model.emission("bring")).all() and (model.emission("z") == model.other).all()


def test_counts_are_those_of_the_sentences(spark):
    words = "token string, tag string"
    rows = spark.createDataFrame([([("Ada", "NAME"), ("met", "VERB"), ("Bob", "NAME")],), ([("met", "VERB")],)], f"words array<struct<{words.replace(' string', ':string')}>>")
    got = {(r.kind, r.a, r.b): r.n for r in N.counts(rows).collect()}
    assert got == {
        ("step", "", "NAME"): 1, ("step", "NAME", "VERB"): 1, ("step", "VERB", "NAME"): 1, ("step", "", "VERB"): 1, ("word", "^ada", "NAME"): 1, ("word", "met", "VERB"): 2, ("word", "^bob", "NAME"): 1,
        ("ending", "^ada", "NAME"): 1, ("ending", "met", "VERB"): 2, ("ending", "^bob", "NAME"): 1, ("tag", "", "NAME"): 2, ("tag", "", "VERB"): 2,
    }


def test_relations_are_named_by_verbs(spark):
    told = ["Ada met Bob in the garden.", "Bosch acquired Daimler and Carl left Opel.", "The Bosch made tools for Daimler.", "Carl wrote to Ada.", "Ada and Bob with Carl."] * 40
    unknown = ["Ada frobbed Bob.", "Carl frobbed Opel.", "Bob frobbed Ada."]
    chunks = spark.createDataFrame([(str(i), "s", "1", t) for i, t in enumerate([*told, *unknown, "", None, "Ada"])], TEXT)
    found = N.mentions_with_verbs(chunks, N.fit(N.tagged_tokens(chunks)))
    got = {(r.src, r.dst, r.relation) for r in G.build_edges(found).where("kind = 0").collect()}
    assert {("Ada", "Bob", "met"), ("Bosch", "Daimler", "acquired"), ("Carl", "Opel", "left"), ("Bosch", "Daimler", "made"), ("Carl", "Ada", "wrote"), ("Ada", "Bob", "related_to")} <= got
    assert ("Bosch", "Opel", "acquired") in got and ("Daimler", "Carl", "related_to") in got
    assert ("Ada", "Bob", "frobbed") in got  # by what stands around it, not by the list
    plain = G.build_edges(G.capitalised_mentions(chunks)).where("kind = 0")
    assert plain.count() == G.build_edges(found).where("kind = 0").count()


def plain_tfidf(texts, terms):
    import collections
    import re

    counts = [collections.Counter(V.bucket(t, terms) for t in re.split(r"[\W_]+", (x or "").lower()) if t) for x in texts]
    seen = collections.Counter(t for c in counts for t in c)
    idf = {t: np.log((1 + len(texts)) / (1 + n)) + 1 for t, n in seen.items()}
    out = np.zeros((len(texts), terms))
    for i, c in enumerate(counts):
        for t, n in c.items():
            out[i, t] = n * idf[t]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def test_fitted_space_equals_that_of_numpy(spark):
    rng = random.Random(6)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(5)]
    texts = [" ".join(rng.choice(topics[i % 5]) if rng.random() < 0.9 else f"noise{rng.randrange(60)}" for _ in range(rng.randint(5, 60))) for i in range(240)] + [None, "", "...", "word " * 900]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(4)
    model = D.fit(df, dimensions=5, terms=2048, steps=30)
    matrix = plain_tfidf(texts, 2048)
    _, values, axes = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(model.strengths, values[:5], atol=1e-6)
    assert np.abs(model.axes @ model.axes.T - axes[:5].T @ axes[:5]).max() < 1e-6
    got = np.array([r.v for r in df.select("i", model(F.col("text")).alias("v")).orderBy("i").collect()])
    assert np.allclose(got, matrix @ model.axes, atol=1e-9) and not got[-4:-1].any()
    near = got[:240] / np.linalg.norm(got[:240], axis=1, keepdims=True)
    assert np.mean([(near[i] @ near.T).argsort()[-2] % 5 == i % 5 for i in range(240)]) > 0.95
    few = D.fit(df.where("i < 2"), dimensions=8, terms=512)
    assert (np.linalg.norm(few.axes, axis=0) > 0.5).sum() == 2  # the rest of the rank is not made up
    with pytest.raises(EmbeddingError):
        D.fit(df.where("text = ''"))


def test_projection_equals_principal_components_up_to_sign(spark):
    from scriptorium.operators import vectors as X

    rng = np.random.default_rng(5)
    rows = rng.normal(size=(130, 6)) * [5, 3, 1, 1, 0.5, 0.1]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id int, embedding array<double>")
    got = np.array([(r.x, r.y) for r in X.projection(table).orderBy("vec_id").collect()])
    first = rows[:100]
    _, _, axes = np.linalg.svd(first - first.mean(0), full_matrices=False)
    want = first @ axes[:2].T
    assert got.shape == (100, 2) and np.allclose(got * np.sign(got[0]), want * np.sign(want[0]), atol=1e-6)
