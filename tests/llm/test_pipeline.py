"""The pipeline against brute force: every stage's decisions are made again by plain Python from the rows that it got."""

import collections
import zlib

import numpy as np

import corpus_pipeline
from scriptorium.llm import mixing, tokens, toxicity
from tests.llm.test_operators import components, shingles, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id: r for r in corpus_pipeline.clean(spark, docs, SF).collect()}
    assert set(kept) == {i for i, p in score.items() if not p} and all(kept[i] == rows[i] for i in kept)

    now = spark.createDataFrame(list(kept.values()), docs.schema)
    want = components({i: shingles(r.text) for i, r in kept.items()})
    kept = {r.doc_id: r for r in corpus_pipeline.deduplicate(spark, now, SF).collect()}
    assert set(kept) == {i for i, c in want.items() if i == c} and all(kept[i] == rows[i] for i in kept)
    assert len(kept) < len(want)

    now = spark.createDataFrame(list(kept.values()), docs.schema)
    strip = lambda t: [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w for w in words(t)]
    items = [strip(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {i for i, r in kept.items() if any(" " + " ".join(x) + " " in " " + " ".join(strip(r.text)) + " " for x in items if len(x) >= 5)}
    left = {r.doc_id: r for r in corpus_pipeline.decontaminate(spark, now, SF).collect()}
    assert exact and not exact & set(left)
    assert set(kept) - set(left) <= exact | {i for i, r in kept.items() if min_edits(strip(r.text), items)}

    now = spark.createDataFrame(list(left.values()), docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix_report(now).collect()}
    mixed = corpus_pipeline.mix(spark, now, SF).collect()
    assert collections.Counter(r.doc_id for r in mixed) == +collections.Counter(copies)
    assert all(r == rows[r.doc_id] for r in mixed)

    now = spark.createDataFrame(mixed, docs.schema)
    got = sorted(corpus_pipeline.encode(spark, now, SF).collect(), key=lambda r: r.start)
    tok = tokens._tokenizer(tokens.TOKENIZER)[0]
    start = 0
    for r, d in zip(got, sorted(mixed, key=lambda r: r.doc_id), strict=True):
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def min_edits(text, items):
    """Whether an item of at least five words is within a fifth of its words of a stretch of the text."""
    for item in items:
        if len(item) < 5:
            continue
        row = [0] * (len(text) + 1)
        for i, w in enumerate(item, 1):
            old, row = row, [i]
            for j, v in enumerate(text, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (v != w)))
        if min(row) <= int(0.2 * len(item)):
            return True
    return False


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
