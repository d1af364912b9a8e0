"""Each operator against brute force on small fixtures: nulls, empty and very long texts, ties, repeated rows, extra columns, empty tables."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import columnwise, decontam, jaccard, lm, mixing, repeats, sharding, tokens, topk, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def tricky(extra=()):
    """Rows with every awkward case; doc_id ascends apart from a null and a repeated row."""
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma.", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "лямбда", "mu"] + [f"w{i}" for i in range(300)]
    base = " ".join(rng.choice(vocabulary) for _ in range(120))
    texts = [base, base.upper().lower(), base + " tail words here", None, "", " \n\t ", "one", "one two three four", "ONE  two\nthree four", " ".join(rng.choice(vocabulary) for _ in range(20_000)), base.replace("w1", "x1"), "é" * 700, "the " * 500]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    for _ in range(40):
        source = rng.choice(texts[13:]).split()
        for _ in range(rng.randint(0, max(1, len(source) // 10))):
            source[rng.randrange(len(source))] = rng.choice(vocabulary)
        texts.append(" ".join(source))
    rows = [(i, t, "en", rng.choice(["s1", "s2", "Z", None]), 0) for i, t in enumerate([*texts, *extra])]
    return [*rows, rows[0], (None, base, None, "s1", None)]


@pytest.fixture(scope="module")
def rows():
    return tricky()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).selectExpr("*", "1 as size", "2 as shard", "'x' as bucket", "3 as file", "4 as fold")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


def test_jaccard_matches_brute_force(docs, rows, empty):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    want = components(sets)
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, len(s), want[i]) for i, s in sets.items()}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert len(set(want.values())) < len(want)
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(base[:60] + [f"q{k}_{i}" for i in range(90)]) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components({i: shingles(t) for i, t in enumerate(texts)})
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == want


def test_drop_near_duplicates_keeps_one_of_each(docs, rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    want = components(sets)
    kept = jaccard.drop_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(i for i in want if want[i] == i)
    assert sum(r.doc_id is None for r in kept) == 1


def test_jaccard_of_ids_that_come_with_several_texts(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"v{rng.randrange(400)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (2, b + " more", "x"), (3, c, "x"), (0, c + " more", "x"), (5, None, "x"), (5, "", "x"), (6, text(), "x"), (None, a, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, component string").selectExpr("*", "7 as node", "8 as real_id")
    got = sorted(map(tuple, jaccard.jaccard_components(table).select("doc_id", "component_id").collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (1, 1), (2, 1), (3, 0), (0, 0), (5, 5), (5, 5), (6, 6), (None, None)], key=repr)
    kept = [(r.doc_id, r.text) for r in jaccard.drop_near_duplicates(table).collect()]
    assert sorted(kept, key=repr)[:-1] == sorted([(0, c + " more"), (1, a), (1, b), (5, kept[[k[0] for k in kept].index(5)][1]), (6, rows[8][1])], key=repr)
    assert len(kept) == 6 and jaccard.drop_near_duplicates(table).columns == table.columns


def test_repeats_match_brute_force(docs, rows, empty):
    check_repeats(docs, rows)
    assert repeats.remove_repeats(empty).count() == 0


def check_repeats(df, rows, w=200):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    count = collections.Counter(t[i : i + w] for _, t in texts for i in range(len(t) - w + 1))
    want = []
    for k, t in texts:
        edge = np.zeros(len(t) + 1, int)
        for i in range(len(t) - w + 1):
            if count[t[i : i + w]] > 1:
                edge[i] += 1
                edge[i + w] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
        want.append((k, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    got = [tuple(r) for r in repeats.remove_repeats(df).collect()]
    order = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=order) == sorted(want, key=order)
    return want


def test_repeats_at_borders(spark):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, short = letters(260), letters(199)
    rows = [(1, letters(500) + shared + letters(10), ""), (2, shared + letters(300), ""), (3, letters(40) + short, ""), (4, short + letters(5), ""), (5, "ab" * 400, ""), (6, letters(199), ""), (7, shared[30:], "")]
    want = check_repeats(spark.createDataFrame(rows, "doc_id long, text string, x string"), rows)
    assert want[0][2] == 260 and want[2][2] == 0 and want[4][2] == 800


def test_kept_texts_match_brute_force(docs, rows, empty):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = collections.Counter(x[a : a + 200] for _, x in raw for a in range(len(x) - 199))
    want = []
    for i, x in raw:
        gone = np.zeros(len(x), bool)
        for a in range(len(x) - 199):
            if seen[x[a : a + 200]] > 1:
                gone[a : a + 200] = True
        want.append((i, bytes(np.frombuffer(x, np.uint8)[~gone])))
    got = [(r[0], bytes(r[1])) for r in repeats.kept_texts(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert repeats.kept_texts(empty).count() == 0


def test_repeats_of_long_texts_in_blocks(spark, monkeypatch):
    """Blocks far smaller than the texts give the same result as one block."""
    rng = random.Random(12)
    base = bytes(rng.randrange(97, 123) for _ in range(6_000)).decode()
    rows = [(1, base), (2, "x" * 700 + base[1_000:4_000] + "y"), (3, base[:199]), (4, base[5_000:5_200] + base[100:2_000]), (5, None), (6, base[2_500:2_699] + "é" * 300)]
    data, off = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8), np.concatenate([[0], np.cumsum([len((t or "").encode()) for _, t in rows])])
    for size in (1, 7, 250, 1_000, 4_096):
        monkeypatch.setattr(repeats, "BLOCK_BYTES", size)
        if size > 200:
            row, start, far, more, *_ = repeats.owners(data, off)
            covered = sorted((r, s + k) for r, s, m in zip(row.tolist(), start.tolist(), more.tolist(), strict=True) for k in range(m + 1))
            assert covered == [(r, k) for r in range(len(rows)) for k in range(int(off[r + 1] - off[r]) - 199)]
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 1_000)
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_columnwise_construction_agrees(spark, tmp_path):
    rng = random.Random(4)
    part = "".join(rng.choice("abc") for _ in range(30))
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + part * rng.randint(0, 1) for _ in range(12)] + [""]
    raw = [t.encode() for t in texts]
    bwt, lcp, where = columnwise.build(raw, str(tmp_path))
    suffixes = sorted((t[i:], d, i) for d, t in enumerate(raw) for i in range(len(t) + 1))
    assert [(d, i) for _, d, i in suffixes] == where
    assert bwt == [raw[d][i - 1] if i else None for _, d, i in suffixes]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert lcp == [0] + [common(a[0], b[0]) for a, b in zip(suffixes[:-1], suffixes[1:], strict=True)]
    masks = columnwise.repeated_bytes(raw, 20, str(tmp_path / "again"))
    count = collections.Counter(t[i : i + 20] for t in raw for i in range(len(t) - 19))
    for t, m in zip(raw, masks, strict=True):
        want = [any(count[t[i : i + 20]] > 1 for i in range(max(0, k - 19), min(k, len(t) - 20) + 1)) for k in range(len(t))]
        assert list(m) == want


def lm_brute(rows):
    """Base scores by hand; the model's probabilities are checked to sum to one."""
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7
    seqs = [(r[0], fold(r[0]), [*words(r[1]), None]) for r in rows]
    count = collections.Counter(w for _, f, s in seqs if f != 2 for w in s)
    n, v = sum(count.values()), len(count)
    return {(i, f == 2, len(s), sum(count[w] > 0 for w in s), n): sum(math.log10((count[w] + 1) / (n + v + 1)) for w in s) for i, f, s in seqs}


def test_lm_base_scores(docs, rows, empty):
    want = lm_brute(rows)
    got = lm.lm_scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_score == pytest.approx(want[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens], rel=1e-9)
    assert lm.lm_scores(empty).count() == 0


def test_lm_model_matches_its_formula(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    from scriptorium.llm.common import scratch_path

    model = lm.fit(df.withColumn("fold", lm.fold(F.col("doc_id"))).withColumn("rid", F.monotonically_increasing_id()), scratch_path(spark, "w"), 2)
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if fold(i) != 2:
            s = [*words(t), "</s>"]
            uni.update(s)
            for h, w in zip(["<s>", *s], s, strict=False):
                bi[h, w] += 1
                ctx[h] += 1
    n, v = sum(uni.values()), len(uni)

    def p(h, w):
        q = model["m"] * uni[w] / n + (1 - model["m"]) / (v + 1)
        lam = model["l"].get(ctx[h].bit_length(), model["l_other"]) if ctx[h] else 0.0
        return lam * (bi[h, w] / ctx[h] if ctx[h] else 0) + (1 - lam) * q

    for h in ["<s>", "a", "zzz"]:
        assert sum(p(h, w) for w in uni) + p(h, "unseen") == pytest.approx(1)
    want = {i: sum(math.log10(p(h, w)) for h, w in zip(["<s>", *words(t)], [*words(t), "</s>"], strict=True)) for i, t in rows}
    for r in lm.lm_scores(df).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-9)


def test_lm_beats_base_on_held_out(spark):
    got = [r for r in lm.lm_scores(spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_buckets_that_are_dealt_out(spark, docs, monkeypatch):
    want = sorted(map(tuple, lm.lm_scores(docs).collect()), key=str)
    monkeypatch.setattr(lm, "HOT_PLACES", 3)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 50)
    got = sorted(map(tuple, lm.lm_scores(docs.repartition(5).sortWithinPartitions("doc_id")).collect()), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5:] for x in got] == [pytest.approx(x[5:], rel=1e-9) for x in want]


def test_weights_are_learned():
    ratio, weight = np.array([0.0, 4.0]), np.array([30.0, 70.0])
    best = max((sum(w * math.log(x * r + 1 - x) for r, w in zip(ratio, weight, strict=True)), x) for x in np.linspace(0.001, 0.999, 999))[1]
    assert lm.learn_weight(ratio, weight) == pytest.approx(best, abs=0.01)


def test_tokens_round_trip(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    enc = [(r[0], [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    enc.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    want, start = [], 0
    for i, ids in enc:
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tokens.token_ids(docs).collect()]
    assert sorted(got, key=lambda x: x[1]) == want
    assert tokens.token_ids(empty).count() == 0


def test_tokens_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a\x1cb!\x1c!", "x <|endoftext|>y<|startoftext|>", "é ́e", "tab\tline\r\nfeed\x0b\x85 nb", "don't WE'LL 12,5 ½ ２", " a　b", "  ", "İstanbul ΣΑΣ ς", "wait., then ., a, b. C_. d ... e, ... f,\n g.", "ǅ ﬁne ÉCOLE école, straße. <|ENDOFTEXT|> .", "x1. y, 2, ½. é. é́, ok"]
    odd += ["", "end”. “x”, ×. ÷, à. A.", ".", ",", "a.b. ..", "x.\ny,\n"]
    raw = [t.encode() for t in odd]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    for t, got in zip(odd, tokens.encode_rows(np.frombuffer(b"".join(raw), np.uint8), off), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_tokens_of_a_long_piece():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["7" * 70_001, "one two", "7" * 70_001 + " three"]  # more than 65,536 ids and no space
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for t, got in zip(texts, tokens.encode_rows(np.frombuffer("".join(texts).encode(), np.uint8), off), strict=True):
        ids = np.frombuffer(got, "<u2").tolist()
        assert ids == tok.encode(t, add_special_tokens=False).ids and (len(ids) > 65_536) == (len(t) > 65_536)


def test_repair_random_access():
    rng = np.random.RandomState(0)
    ids = [rng.randint(0, 9, size=n).astype("<u2").tobytes() for n in (0, 1, 500, 3000, 0, 40)]
    raw = tokens.pack_shard([1, 2, None, 4, 5, 6], ids, 100)
    shard = tokens.Shard(raw)
    assert len(shard.left) > 0 and len(shard.symbols) < 0.7 * sum(map(len, ids)) // 2
    for i, x in enumerate(ids):
        whole = np.frombuffer(x, "<u2")
        assert (shard.document(i) == whole).all() and len(shard.document(i)) == len(whole)
        if len(whole) > 30:
            for a, n in ((0, 1), (7, 20), (len(whole) - 3, 3)):
                assert (shard.ids(i, a, n) == whole[a : a + n]).all()
    assert shard.null.tolist() == [False, False, True, False, False, False]


def test_repair_overlapping_pairs():
    seq = np.array([7] * 101, np.uint16)
    last = np.zeros(101, bool)
    last[100] = True
    symbols, _, rules = tokens.compress(seq, last, 10, least=2)
    expand = lambda s: [int(s)] if s < 10 else expand(rules[s - 10][0]) + expand(rules[s - 10][1])
    assert [x for s in symbols for x in expand(s)] == [7] * 101 and len(symbols) < 101


def test_repair_goes_on_to_the_end():
    def left_over(symbols, last):
        seen, before = collections.Counter(), None
        for i in range(len(symbols) - 1):
            pair = None if last[i] else (int(symbols[i]), int(symbols[i + 1]))
            pair = None if pair == before and pair is not None else pair  # of an id over and over every second pair
            seen[pair] += pair is not None
            before = pair
        return max(seen.values(), default=0)

    rng = np.random.RandomState(3)
    passage, ids = rng.randint(0, 40_000, size=900), []
    for k in range(300):
        ids.append(np.concatenate([rng.randint(0, 30, size=rng.randint(0, 60)), passage[: 900 - k % 7], np.full(rng.randint(0, 40), 5), rng.randint(0, 40_000, size=20)]))
    seq, last = np.concatenate(ids).astype(np.uint16), np.zeros(sum(map(len, ids)), bool)
    last[np.cumsum([len(x) for x in ids]) - 1] = True
    symbols, ends, rules = tokens.compress(seq, last, 40_000)
    assert left_over(symbols, ends) < tokens.LEAST_USES and ends.sum() == 300 and len(rules) < (1 << 16) - 40_000
    raw = tokens.pack_shard(list(range(300)), [x.astype("<u2").tobytes() for x in ids], 40_000)
    shard = tokens.Shard(raw)
    assert shard.lengths.max() >= 890 and all((shard.document(i) == x).all() for i, x in enumerate(ids))
    assert (shard.ids(9, 100, 700) == ids[9][100:800]).all()
    more, ends, rules = tokens.compress(seq, last, (1 << 16) - 3)  # symbols pass 16 bits
    assert len(rules) > 100 and more.max() > 65_535 and left_over(more, ends) < tokens.LEAST_USES
    wide = tokens.Shard(tokens.pack_shard(list(range(300)), [x.astype("<u2").tobytes() for x in ids], (1 << 16) - 3))
    assert all((wide.document(i) == x).all() for i, x in enumerate(ids))


def test_repair_of_a_full_shard_ends_for_want_of_pairs(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(3500).collect()]
    ids = [tokens.encode_rows(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), end=2)[0] for t in texts]
    assert sum(len(t.encode()) for t in texts) > tokens.SHARD_BYTES
    shard = tokens.Shard(tokens.pack_shard(list(range(len(ids))), ids, 49_408))
    assert len(shard.left) > 16_128  # more rules than 16 bits had room for
    edge = np.zeros(len(shard.symbols), bool)
    edge[np.cumsum(shard.per_doc) - 1] = True
    inner = np.flatnonzero(~edge[:-1])
    pairs = (shard.symbols[inner].astype(np.uint64) << np.uint64(32)) | shard.symbols[inner + 1]
    equal = shard.symbols[inner] == shard.symbols[inner + 1]
    assert np.unique(pairs[~equal], return_counts=True)[1].max() < tokens.LEAST_USES
    assert shard.expand(shard.symbols).astype("<u2").tobytes() == b"".join(ids)


def test_repeated_ids_fill_several_shards(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_BYTES", 2000)
    rows = [(k, f"text {k} " * 5) for k in range(50)] + [(20, f"again {k} " * 4) for k in range(300)] + [(None, f"none {k} " * 4) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    files = tokens.write_ids(table, folder := tokens.scratch_path(spark, "ids"))
    sizes = {r.shard: r.documents for r in files.collect()}
    assert sum(sizes.values()) == 650 and max(sizes.values()) < 120
    got = sorted(tokens.read_report(files, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert [r.start for r in got[1:]] == np.cumsum([r.n_tokens for r in got])[:-1].tolist()
    table.unpersist()


def test_top_k_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], 0) for i in range(0, 450)]
    rows += [(500, None, 0), (600, [1.0, None] + [0.0] * 6, 0), (700, [float("nan")] * 8, 0), (800, [float("inf")] + [0.0] * 7, 0), (900, [0.0] * 8, 0), (None, [1.0] * 8, 0), (1000, [], 0), rows[100], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    fit = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fit[i] = [math.floor(1024 * float(np.float32(x))) for x in v]
    want = set()
    for q in fit:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(fit[q], fit[c], strict=False)), c) for c in fit if c != q)[:10]
            want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_long_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    big = spark.createDataFrame([(100, [1e20, 0.0]), (1, [1.0, 1.0])], kind)
    with pytest.raises(Exception, match="vector 100 has a component"):
        topk.top_k(big).collect()
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 6, 9]) if i % 3 else rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows += [(200, [3e6, 2e6, 1e6, -3e6]), (300, [float("inf"), 0.0, 0.0, 0.0])]
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows if all(map(math.isfinite, v))}
    for q in (0, 200):  # queries whose best scores fit, though lengths say they might not
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q)[:10]
        near = spark.createDataFrame([r for r in rows if r[0] == q or r[0] % 100], kind)
        if all(-s < 1 << 63 for s, _ in best):
            best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q and c % 100)[:10]
            assert [(r.vec_id, r.score) for r in topk.top_k(near).orderBy("rank").collect()] == [(c, -s) for s, c in best]
    far = spark.createDataFrame([(100, [4e9, 4e9]), (1, [4e9, -4e9]), (2, [-4e9, -4e9]), (3, [1.0, 1.0])], kind)
    assert [(r.vec_id, r.score) for r in topk.top_k(far, k=2).orderBy("rank").collect()] == [(3, 2 * 1024 * int(4e9) * 1024), (1, 0)]
    with pytest.raises(Exception, match="does not fit in 64 bits"):
        topk.top_k(far).collect()


def test_top_k_stops_early():
    x = np.random.RandomState(1).randint(-1000, 1000, size=(4000, 6))
    pivots = topk.choose_pivots([v.astype(np.int64).tobytes() for v in x[:200]])
    table = topk.pivot_table(x, pivots)
    got = list(topk.block_top_k(np.array([0]), x[:1], table[:1], np.arange(4000), x, table, 5))
    scores = (x @ x[0]).astype(float)
    scores[0] = -np.inf
    best = np.lexsort((np.arange(4000), -scores))[:5]
    assert got == [(0, int(i), int(scores[i])) for i in best]


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nx", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 40_000), (6, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (7, "u", "é" * 40_000), (None, "n", "<p>x</p>"), (None, "n", "alone"), (5, "u", "é" * 40_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as n", "2 as original").repartition(3)
    got = warc.archive_pages(df).collect()
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max((x for x in groups[h or ""] if x is not None), default=None)
        revisit = top is not None and i != top
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    key = lambda x: str(x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_reads_what_the_manifest_names(spark, tmp_path):
    """Files that a lost attempt has left in the folder are not read; ids of records differ, but for pages that come as responses twice."""
    df = spark.createDataFrame([(k % 7, f"u{k}", "same" if k % 2 else f"page {k}") for k in range(20)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    rows = df.withColumn("payload_digest", warc.base32_sha1(F.col("html"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    manifest = warc.write_archives(warc.with_revisits(rows, warc.resolve_revisits(rows)), folder, date="2030-01-02T03:04:05Z")
    name = manifest.first().file
    (tmp_path / "w" / "part-00099-0000-left.warc.gz").write_bytes((tmp_path / "w" / name).read_bytes())
    assert warc.read_archives(spark, folder, manifest=manifest).count() == 20 < warc.read_archives(spark, folder).count()
    fields = []
    for r in manifest.collect():
        with gzip.open(tmp_path / "w" / r.file) as f:
            fields += [x["fields"] for x in warc.parse(f)]
    revisits = [f["warc-record-id"] for f in fields if f["warc-type"] == "revisit"]
    assert len(revisits) == len(set(revisits)) and {f["warc-date"] for f in fields} == {"2030-01-02T03:04:05Z"}
    assert {f["warc-refers-to"] for f in fields if f["warc-type"] == "revisit"} <= {f["warc-record-id"] for f in fields if f["warc-type"] == "response"}


def test_warc_payloads_and_smaller_ones(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "longer text"), (4, "d", "longer text")], "page_id long, url string, html string")
    from pyspark.sql import functions as F

    rows = df.withColumn("payload_digest", warc.base32_sha1(F.col("html"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    folder = f"file://{tmp_path}/w"
    warc.write_archives(warc.with_revisits(rows, warc.resolve_revisits(rows, smallest=5)), folder)
    got = {r.page_id: (r.record_type, bytes(r.payload)) for r in warc.read_archives(spark, folder, payload=True).collect()}
    assert got == {1: ("response", b"xy"), 2: ("response", b"xy"), 3: ("revisit", b""), 4: ("response", b"longer text")}


def test_min_cost_flow_moves_least():
    rng = random.Random(0)
    for _ in range(20):
        n = rng.randint(2, 5)
        old = [rng.randint(0, 50) for _ in range(n)]
        new = [sum(old) * (j + 1) // n - sum(old) * j // n for j in range(n)]
        flow = sharding.min_cost_flow(old, new, [[int(i != j) for j in range(n)] for i in range(n)])
        assert [sum(x for (i, _), x in flow.items() if i == k) for k in range(n)] == old
        assert [sum(x for (_, j), x in flow.items() if j == k) for k in range(n)] == new
        assert sum(x for (i, j), x in flow.items() if i != j) == sum(max(0, a - b) for a, b in zip(old, new, strict=True))
    assert sharding.min_cost_flow([4, 0], [2, 2], [[5, 1], [1, 5]]) in ({(0, 0): 2, (0, 1): 2},)


def test_resharding(spark, docs, rows, empty):
    got = sharding.reshard_documents(docs).collect()
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == want
    check_slots(got)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sharding.reshard_documents(empty).count() == 0


def check_slots(got):
    by = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.shard < 16
        by[r.shard].append(r.slot)
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_resharding_is_near_equal(spark):
    got = sharding.reshard_documents(spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")).collect()
    check_slots(got)
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    assert len(size) == 16 and max(size.values()) - min(size.values()) < 0.01 * sum(size.values()) / 16


def test_resharding_of_very_many_rows_of_one_id(spark):
    rng = random.Random(11)
    rows = [(k, "x" * rng.randint(20, 900), f"s{k % 7}") for k in range(1000)] + [(17, "y" * 300, "s1")] * 1000 + [(None, "z" * 200, None)] * 400
    got = sharding.reshard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    check_slots(got)
    assert len(got) == 2400
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 2 * 901


def test_resharding_rewrites_affected_files_alone(spark, tmp_path):
    """Moved bytes against the least possible, and files: those of pieces that lose nothing stay the only ones of their rows."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 400), 0 if rng.random() < 0.4 else rng.randrange(16)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, old int")
    layout = sharding.lay_out(df, F.col("old"), f"file://{tmp_path}/old")
    old = [sum(len(t) + 1 for _, t, k in rows if k == j) for j in range(16)]
    for capacities in (None, [old[0], old[1] + old[2], 0, *old[3:]], old):
        got, report = sharding.reshard(spark, layout, f"file://{tmp_path}/new-{capacities is None}-{capacities == old}", capacities)
        got = got.collect()
        check_slots(got)
        assert sorted((r.doc_id, r.text, r.old_shard) for r in got) == rows and report["old_sizes"] == old
        least = sum(max(0, a - b) for a, b in zip(old, report["capacities"], strict=True))
        moved = sum(len(r.text) + 1 for r in got if r.shard != r.old_shard)
        assert report["planned_moved_bytes"] == least and abs(moved - least) <= 0.002 * sum(old)
        size = collections.Counter()
        for r in got:
            size[r.shard] += len(r.text) + 1
        assert all(abs(size[j] - c) <= 0.001 * sum(old) / 16 + 401 for j, c in enumerate(report["capacities"]))
        touched = {r.old_shard for r in got if r.rewritten}
        assert {r.old_shard for r in got if r.shard != r.old_shard} <= touched <= {j for j in range(16) if old[j] > report["capacities"][j]}
        if capacities is None:
            assert 0 < sum(r.rewritten for r in got) < len(got) / 2
        else:
            assert touched == ({2} if capacities != old else set())


def test_mixing(docs, rows, empty):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left, total = sum(size.values()) - sum(target.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 3 * size[s]}
        for s in full:
            target[s] = 3 * size[s]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        open_ -= full
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert r.source_size == size[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs).collect()))
    assert mixing.mix(docs).count() == sum(r.copies for r in got)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_report(empty).count() == 0


def test_mix_keeps_columns_of_any_name(spark, rows):
    docs = spark.createDataFrame(rows, DOC)
    names = ["mix_source", "mix_source_size", "mix_target", "mix_rate", "mix_place", "mix_copies", "mix_copy", "mix_row", "size", "col", "h", "copies"]
    odd = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)], F.lit("x").alias("a.b"))
    got = mixing.mix(odd)
    assert got.columns == odd.columns
    copies = collections.Counter()
    for r in mixing.mix_report(odd).collect():
        copies[r.doc_id] += r.copies
    assert collections.Counter(r.doc_id for r in got.collect()) == +copies
    assert {tuple(r)[5:] for r in got.collect()} == {(*range(len(names)), "x")}
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_comes_near_its_targets(spark):
    got = mixing.mix_report(spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - t) < 0.05 * t for s, t in target.items())


def test_toxicity(spark, docs, rows):
    documents, labels = (spark.read.parquet(f"{SF}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.toxicity_scores(documents, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.97
    for r in list(got.values())[:2000]:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        raw = texts[r.doc_id].encode()
        for s in r.spans:
            assert raw[s.start : s.end].decode().strip() and 0 <= s.start < s.end <= len(raw)
    odd = toxicity.toxicity_scores(docs, labels).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.toxicity_scores(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_toxicity_trains_on_texts_that_can_train(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(toxicity, "MAX_TRAIN_DOCS", 3)
    ids = spark.range(1, 60).select(F.col("id").alias("doc_id")).where(~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = [r.doc_id for r in ids.collect()]
    labels = spark.createDataFrame([(d, k % 2) for k, d in enumerate(ids)], "doc_id long, toxic int")
    long = "calm words " * 2_000
    docs = spark.createDataFrame([(d, long if k < 6 else f"calm words number {k} {'foul ' * (k % 2)}") for k, d in enumerate(ids)], "doc_id long, text string")
    assert (toxicity.fit(docs, labels).document != toxicity._empty().document).any()  # the first six of the hash order are too long


def test_drop_toxic_on_awkward_rows(spark, docs, rows, empty):
    """Rows without an id, repeated rows, null and blank texts and columns of any name: what is scored below 0.5 stays as it came."""
    labels, documents = (spark.read.parquet(f"{SF}/../sf0.01/{t}.parquet") for t in ("labels", "documents"))
    plain = documents.select("doc_id", "text")
    odd = plain.unionByName(plain.where("doc_id < 50")).unionByName(plain.where("doc_id < 50").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.unionByName(spark.createDataFrame([(10**9, None), (10**9 + 1, " \n"), (10**9 + 2, "")], "doc_id long, text string"))
    odd = odd.selectExpr("*", "1 as score", "2 as toxic", "'x' as spans", "3 as predicted", "true as held_out", "4 as model")
    scored = toxicity.toxicity_scores(odd, labels).collect()
    left = toxicity.drop_toxic(odd, labels)
    assert left.columns == odd.columns
    got = collections.Counter(map(str, left.collect()))
    assert collections.Counter(r.doc_id for r in left.collect()) == collections.Counter(r.doc_id for r in scored if not r.predicted)
    assert not got - collections.Counter(map(str, odd.collect())) and 0 < sum(got.values()) < odd.count()
    assert left.where("doc_id >= 1000000000").count() == 3
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.drop_toxic(empty, labels).count() == 0


def test_chain_marginals_match_enumeration():
    import itertools

    rng = np.random.RandomState(3)
    count = np.array([3, 0, 70, 1, 9])
    u, t = rng.normal(size=int(count.sum())), rng.normal(size=(2, 2))
    marginal, pairs = toxicity.Chain(count).run(u, t, pairs=True)
    at = 0
    for n in count:
        if 0 < n <= 9:
            mass, one = 0.0, np.zeros(n)
            for y in itertools.product((0, 1), repeat=int(n)):
                w = math.exp(sum(u[at + k] * y[k] + t[y[k - 1] if k else 0, y[k]] for k in range(n)))
                mass += w
                one += w * np.array(y)
            assert marginal[at : at + n] == pytest.approx(one / mass)
        at += n
    assert pairs.sum() == pytest.approx(count.sum()) and pairs[:, 1].sum() == pytest.approx(marginal.sum())


def test_decontamination(spark, rows):
    rng = random.Random(9)
    item = [f"item{i}" for i in range(40)]
    near = list(item)
    near[5], near[20] = "changed", "other"
    del near[30]
    half = item[:20]
    texts = {1: "x y z " + " ".join(item).upper() + ". q r", 2: " ".join(["a"] * 50 + near + ["b"]), 3: " ".join(half + [f"z{i}" for i in range(30)]), 4: None, 5: "", 6: "short one", 7: " ".join(rng.choice(item) for _ in range(400))}
    df = spark.createDataFrame([*texts.items(), (None, " ".join(item)), (1, texts[1])], "doc_id long, text string").selectExpr("*", "0 as item_id", "1 as start")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "too short"), (12, None), (None, "x"), (13, "")], "item_id long, text string")
    got = decontam.contaminated(df, bench).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.edits) for r in got) == [(-1, 10, 0), (1, 10, 0), (1, 10, 0), (2, 10, 3)]
    hit = next(r for r in got if r.doc_id == 2)
    assert texts[2].encode()[hit.start : hit.end].decode() == " ".join(near)
    assert sorted(r.doc_id for r in decontam.drop_contaminated(df, bench).collect() if r.doc_id) == [3, 4, 5, 6, 7]
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


def test_decontamination_by_items_of_few_words(spark):
    df = spark.createDataFrame([(1, "Then it was forty two, they said."), (2, "forty or two"), (3, "the Answer: forty"), (4, None), (5, "forty two")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Forty two"), (2, "answer"), (3, "it was forty TWO"), (4, " "), (5, "two forty")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits, r.item_words) for r in decontam.contaminated(df, bench).collect()}
    assert got == {(1, 1, 0, 2), (1, 3, 0, 4), (3, 2, 0, 1), (5, 1, 0, 2)}
    assert [r.doc_id for r in decontam.drop_contaminated(df, bench).orderBy("doc_id").collect()] == [2, 4]


def test_decontamination_recall_against_brute_force():
    """Random edits up to the limit: what the exact edit distance finds in every stretch, the search finds in nearly all cases."""
    rng = random.Random(4)
    item = [f"i{k}" for k in range(30)]
    items = decontam.Items([1], [" ".join(item)])
    found = wanted = 0
    for _ in range(300):
        own = list(item)
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(own))
            how = rng.random()
            if how < 0.4:
                own[k] = f"r{rng.random()}"
            elif how < 0.7:
                del own[k]
            else:
                own.insert(k, f"r{rng.random()}")
        text = " ".join([f"p{rng.random()}" for _ in range(20)] + own + [f"s{rng.random()}" for _ in range(20)])
        raw = np.frombuffer(text.encode(), np.uint8)
        w = decontam.Words(raw, np.array([0, len(raw)]))
        h = decontam.form_hashes(raw, w)
        best = decontam.edit_distance(items.words[0], h)[0]
        hits = decontam.find(items, h, w.row, w.first)
        wanted += best <= items.edits[0]
        found += bool(hits)
        assert not hits or (best <= items.edits[0] and hits[0][4] >= best)
    assert wanted > 150 and found >= 0.97 * wanted


@pytest.mark.parametrize("size", [5, 8, 15, 30, 60])
def test_decontamination_recall_by_size_and_edits(size):
    """Every number of edits up to the limit, at any place, in texts that repeat a word, share the item's words and its halves."""
    rng = random.Random(size)
    item = [f"i{rng.randrange(size * 4)}" for _ in range(size)]
    items = decontam.Items([1], [" ".join(item)])
    for edits in range(int(0.2 * size) + 1):
        found = wanted = 0
        for _ in range(60):
            own = list(item)
            for _ in range(edits):
                k = rng.randrange(len(own))
                how = rng.random()
                if how < 0.4:
                    own[k] = f"r{rng.random()}"
                elif how < 0.7:
                    del own[k]
                else:
                    own.insert(k, f"r{rng.random()}")
            text = " ".join([item[0]] * 30 + item[: size // 2] + [f"p{rng.random()}" for _ in range(rng.randint(0, 9))] + own + [f"s{rng.random()}" for _ in range(rng.randint(0, 9))] + rng.sample(item, size))
            raw = np.frombuffer(text.encode(), np.uint8)
            w = decontam.Words(raw, np.array([0, len(raw)]))
            h = decontam.form_hashes(raw, w)
            best = decontam.edit_distance(items.words[0], h)[0]
            hits = decontam.find(items, h, w.row, w.first)
            wanted += best <= items.edits[0]
            found += bool(hits)
            assert not hits or best <= hits[0][4] <= items.edits[0]
        assert wanted >= 50 and found >= decontam.TARGET_RECALL * wanted


def test_windows_that_cannot_match_are_not_laid():
    rng = random.Random(2)
    items = decontam.Items(list(range(50)), [" ".join(f"w{rng.randrange(200)}" for _ in range(30)) for _ in range(50)])
    for text in (" ".join(f"w{rng.randrange(200)}" for _ in range(20_000)), "w1 w2 " * 5_000, "w7 " * 9_000):
        raw = np.frombuffer(text.encode(), np.uint8)
        w = decontam.Words(raw, np.array([0, len(raw)]))
        assert len(decontam.window_places(items, decontam.form_hashes(raw, w), w.first, w.row)[0]) == 0


def test_decontamination_block_by_block(spark, rows, monkeypatch):
    """Blocks of the benchmark one at a time give what one block gives; a table with any columns keeps its rows."""
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 20]
    bench = spark.createDataFrame([(k, " ".join(t.split()[5:25])) for k, t in enumerate(texts[:30])] + [(99, None), (98, " ")], "item_id long, text string")
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as item_id", "2 as edits", "'x' as hits")
    find = lambda: sorted(map(str, decontam.contaminated(docs, bench).collect()))
    keep = lambda: sorted(map(str, decontam.drop_contaminated(docs, bench).collect()))
    one = find(), keep()
    monkeypatch.setattr(decontam, "ITEM_BLOCK_BYTES", 500)
    assert (find(), keep()) == one and one[0] and 0 < len(one[1]) < len(rows)
    dirty = {r.doc_id for r in decontam.contaminated(docs, bench).collect()}
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id not in dirty)


def test_edit_distance_matches_plain():
    rng = random.Random(6)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 8))] for _ in range(2))

        def plain(x, y):
            row = list(range(len(y) + 1))
            for i, c in enumerate(x, 1):
                row, old = [i], row
                for j, d in enumerate(y, 1):
                    row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
            return row[-1]

        want = min(plain(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        dist, start, end = decontam.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64))
        assert dist == want == plain(a, b[start:end])


@pytest.mark.parametrize("name", ["op2_ngram_jaccard", "op5_mixing", "op6_warc_revisits", "op7_exact_top_k"])
def test_sql_agrees(spark, name):
    from scriptorium.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF).select(*cols).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.fetchall()))


def test_scratch_is_cleared(spark):
    from scriptorium.llm import common

    path = common.saved(spark.range(3), "three").inputFiles()[0]
    assert common.clear_scratch(spark) > 0 and common.clear_scratch(spark) == 0
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_toxicity_training_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["ab", "Cde,", "fghij", "klmnopqr", "été"], int(n))).encode() for n in [0, 1, 3, 200, 64, 65, 0, 500, 7]]
    count, hashes = toxicity._tokens(texts)
    u, transition = rng.normal(size=int(count.sum())), rng.normal(size=(2, 2))
    marginal, pairs = toxicity.Chain(count).run(u, transition, pairs=True)
    monkeypatch.setattr(toxicity, "BLOCK_SEGMENTS", 2)
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 100)
    some, parts = toxicity.Chains(count).run(u, transition)
    assert len(toxicity.Chains(count).parts) > 3
    assert np.allclose(some, marginal, atol=1e-12) and np.allclose(parts, pairs, atol=1e-9)
    again, others = toxicity._tokens(texts)
    assert (again == count).all() and all((a == b).all() for a, b in zip(hashes, others, strict=True))
    assert not len(toxicity.Chains(np.zeros(0, np.int64)).run(np.zeros(0), transition)[0])


def test_columnwise_in_pieces_agrees_with_counting(tmp_path):
    rng = np.random.default_rng(1)
    for n in range(25):
        length, step = int(rng.integers(1, 12)), int(rng.integers(1, 20))
        texts = [bytes(rng.choice(list(b"ab\x00\xff"), int(rng.integers(0, 60))).tolist()) for _ in range(int(rng.integers(0, 6)))]
        seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for t, got in zip(texts, columnwise.in_pieces(texts, length, str(tmp_path / str(n)), step), strict=True):
            want = np.zeros(len(t), bool)
            for i in range(len(t) - length + 1):
                if seen[t[i : i + length]] > 1:
                    want[i : i + length] = True
            assert (want == got).all()
    with pytest.raises(ValueError):
        columnwise.in_pieces([b"a"], 256, str(tmp_path / "x"))
