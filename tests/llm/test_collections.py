"""Phrases, near vectors and filter audits against brute force: nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import filters, neardup, phrases, vamana

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(seed=3):
    rng = random.Random(seed)
    words = ["new", "York", "city", "of", "the", "Hall", "über", "straße", "#x", "a b", "1,5", "end."] + [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(120):
        out = []
        for _ in range(rng.randint(0, 120)):
            out.append(rng.choice(["New York city Hall", "of the", "of the new York", "the the the the", "w1 w2", "w3 w4 w5 w6"]) if rng.random() < 0.4 else rng.choice(words))
        texts.append("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\r", "\x0b"]) for w in out))
    texts += ["", " \t ", "...,,,;;;", "one", "word " * 3000 + ", of the " * 2000]
    rows = [(i, t, rng.choice(["en", "de", None, "und"]), rng.choice(["s", "", None, "Z"]), 0) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, None, "en", "s", None), (None, texts[1], None, None, None), (999, None, "fr", "s", 1)]


@pytest.fixture(scope="module")
def rows():
    return prose()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).selectExpr("*", "1 as n", "'x' as part", "2 as subset", "3 as E", "'y' as digest", "5 as name", "6 as kind")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def brute_phrases(rows, most=4, least=30, shown=2000):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * f[p[i:j]]}
        best = []
        for p, a in found.items():
            if p not in covered:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, lft, rgt, totals[lang], -s) for i, (s, a, p, lft, rgt) in enumerate(sorted(best)[:shown], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [phrases.BLOCK_BYTES, 700])
def test_phrases_match_brute_force(docs, rows, empty, block, monkeypatch):
    monkeypatch.setattr(phrases.frequent_phrases, "__defaults__", (4, 30, block))
    want = brute_phrases(rows)
    assert len(want) > 20
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == want
    assert phrases.collocations(empty).count() == 0


def test_phrases_of_other_lengths_and_ranks_in_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(phrases.best_of_each, "__defaults__", (3,))
    assert sorted(map(tuple, phrases.collocations(docs, 5, 3, 12).collect())) == brute_phrases(rows, 3, 12, 5)
    assert sorted(map(tuple, phrases.collocations(docs, 9, 2, 2).collect())) == brute_phrases(rows, 2, 2, 9)


def test_phrase_scores_beyond_64_bits(spark):
    """Counts of which two million times as many pass 64 bits."""
    big = 9 * 10**12
    one = spark.createDataFrame([(1, None, None, 2 * big, "en", "a"), (2, None, None, big, "en", "b")], "name long, parent_left long, parent_right long, f long, lang string, word string")
    two = spark.createDataFrame([(3, 1, 2, big, None, None)], one.schema)
    (got,) = phrases.scored([one, two]).collect()
    assert (got.phrase, got.a, got.l, got.r, got.score) == ("a b", big, 2 * big, big, 2_000_000 * big // (3 * big))


def brute_audit(rows, labels):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, _, source, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = i is not None and first[t] < i
        fails = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), e), strict=True) if x}
        docs.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = [d for d in own if not d[1] & set(order[: step - 1])]
                gone = [d for d in before if f in d[1]]
                out[part, "".join(order), step] = (len(before) - len(gone), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone))
    return out


def test_filter_audit_matches_brute_force(spark, docs, rows, empty):
    labels = [(i, i % 3 % 2, int(i % 4 == 0)) for i in range(0, 110, 2)] + [(4, 1, 1), (None, 1, 1), (7, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'z' as part", "9 as good")
    got = {(r.part, r.filter_order, r.step): r for r in filters.interactions(docs, table).collect()}
    want = brute_audit(rows, labels)
    assert {k: (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) for k, r in got.items()} == want
    for (part, order, step), r in got.items():
        assert r.filter == order[step - 1]
        if step == 1 and order[1:] == "".join(sorted(order[1:])):
            assert r.shapley == sum(w[1] for (p, o, s), w in want.items() if p == part and o[s - 1] == r.filter)
    assert sum(w[2] for w in want.values()) and sum(w[3] for w in want.values())
    assert filters.interactions(empty, table).count() == 0


def near_rows(seed=1):
    """Groups of near vectors, a chain, equal ones, and those that link with nothing."""
    rng = np.random.default_rng(seed)
    rows, number = [], itertools.count(10)
    for label in (1, 1, 2, None):
        for size, noise in ((40, 0.01), (12, 0.02), (300, 0.2)):
            middle = rng.normal(size=16)
            middle /= np.linalg.norm(middle)
            rows += [(next(number), (middle + noise * rng.normal(size=16)).tolist(), label) for _ in range(size)]
    step = np.linspace(0, 2.5, 26)  # neighbours have cosine 0.995, so a chain links its ends
    rows += [(next(number), [float(np.cos(a)), float(np.sin(a))] + [0.0] * 14, 3) for a in step]
    rows += [(next(number), rows[5][1], 1) for _ in range(30)] + [(next(number), rows[5][1], 2)]
    rows += [(next(number), v, 1) for v in (None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1e300] * 16, [2e300] * 16, [1e-300] * 16, [1.0] * 3, [2.0] * 3)]
    rows += [rows[0], rows[0], (None, rows[0][1], 1), (rows[60][0], rows[200][1], 1)]
    return rows


def brute_near(rows, least=0.98):
    usable = [i for i, (k, v, label) in enumerate(rows) if k is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(usable, 2):
        if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
            x, y = (np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in (a, b))
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for i in usable:
        groups[root(i)].append(rows[i][0])
    found = {i: min(groups[root(i)]) for i in usable}
    return sorted(((k, links[i], found.get(i, k), k is None or k == found.get(i, k)) for i, (k, _, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("shard", [neardup.SHARD, 60])
def test_near_vectors_match_brute_force(spark, shard):
    rows = near_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).selectExpr("*", "1 as node", "2 as copies", "'s' as space", "4 as a")
    got = sorted(map(tuple, neardup.near_duplicates(table, shard=shard).collect()), key=repr)
    want = brute_near(rows)
    assert sum(w[1] for w in want) > 2000
    assert got == want


def test_near_vectors_of_an_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_graph_is_pruned_and_reaches_everything():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 24))
    x[:200] = x[0] + 0.01 * rng.normal(size=(200, 24))  # a tight group far from the medoid
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph, starts = vamana.build(x)
    assert (graph >= 0).sum(1).max() <= 2 * vamana.NEAR + vamana.FAR + 4
    pairs = set()
    for a, b, gap in vamana.range_search(x, graph, starts, np.arange(len(x)), 0.6):
        assert np.allclose(gap, np.linalg.norm(x[a] - x[b], axis=1), atol=1e-3) and (gap <= 0.6 + 1e-6).all()
        pairs |= set(zip(a.tolist(), b.tolist(), strict=True))
    true = {(a, b) for a, b in zip(*np.nonzero(vamana.distances(x, x) <= 0.6), strict=True) if a != b}
    assert len(pairs & true) >= 0.99 * len(true) > 30_000


def test_robust_pruning_keeps_what_no_nearer_one_hides():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pool = np.arange(50)[None]
    (kept,) = vamana.prune(np.array([0]), pool, x, 50)
    want, left = [], sorted(range(1, 50), key=lambda i: np.linalg.norm(x[0] - x[i]))
    while left:
        best = left.pop(0)
        want.append(best)
        left = [i for i in left if vamana.ALPHA * np.linalg.norm(x[best] - x[i]) > np.linalg.norm(x[0] - x[i])]
    assert [k for k in kept.tolist() if k >= 0] == want


def test_audit_counts_what_is_missing(spark):
    rows = [r for r in near_rows() if r[2] == 1 and r[0] is not None]
    _, nodes, kind = neardup.distinct_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    links = neardup.graph_links(nodes, kind, 0.98, 2, {})
    true, found = neardup.audit_recall(nodes, links, kind, count=10_000)
    assert true == found == links.count() > 500
    assert neardup.audit_recall(nodes, links.where(F.col("a") % 2 == 0), kind, count=10_000) == (true, links.where("a % 2 = 0").count())
