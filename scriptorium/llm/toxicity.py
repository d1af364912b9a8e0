"""Toxic spans by a linear-chain conditional random field; forward-backward marginals give document scores and offsets.

Two states, clean and toxic. A token's features are its form, its first bytes (PREFIXES of them) and its neighbours' forms;
transitions are free weights. Labels exist for documents, so token labels are made in rounds: forms and beginnings that mark
toxic training documents label the first round's tokens, and the model's own marginals, inside toxic documents alone, label the next.

Marginals are exact. The chain is cut into segments of SEGMENT tokens; each segment's product of 2x2 matrices is formed for
all segments at once, the products are chained through each document, and a second sweep fills in the tokens.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import _LOWER, CHUNK_BYTES, Words, forget, inner_settings, longs, mix, prefix_hash, release_heap, saved, span_hash, steady_heap, text_chunks

#: At most this many labelled documents of each class train the model, the first by a hash of their id.
MAX_TRAIN_DOCS = 2000
#: Longer texts don't train (they are scored whole as all others).
MAX_TRAIN_BYTES = 16_384
#: Forms and beginnings that occur in at least this many training documents have weights of their own.
MIN_DOCS = 2
PREFIXES = (3, 4, 5, 6, 7)
FOLDS = 5
SEGMENT = 64
#: Segments that training goes through at a time.
BLOCK_SEGMENTS = 8192
ROUNDS, STEPS, L2 = 2, 40, 2.0
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


@dataclass
class Model:
    """Sorted hashes of forms and of beginnings of each length; weights by feature (own form, beginnings, form before, form after) with
    one more, zero, for all others; bias, transition log weights, and the document's logistic."""

    tables: list[np.ndarray]
    weights: list[np.ndarray]
    bias: float = -4.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.zeros(4))


def _trimmed(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end without ASCII punctuation at their ends (a word of punctuation alone keeps a byte)."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(4):
        start += _PUNCT[data[start]] & (end - start > 1) if len(start) else 0
        end -= _PUNCT[data[end - 1]] & (end - start > 1) if len(end) else 0
    return start, end


def form_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """Hashes of the words, lower-cased and without punctuation at their ends."""
    return span_hash(prefix_hash(_LOWER[data]), *_trimmed(data, words))


def token_hashes(data: np.ndarray, words: Words) -> list[np.ndarray]:
    """Hashes of each token's form and of its beginnings; a token no longer than a beginning has its form there."""
    start, end = _trimmed(data, words)
    sums = prefix_hash(_LOWER[data])
    return [span_hash(sums, start, end), *[span_hash(sums, start, np.minimum(end, start + k)) for k in PREFIXES]]


def _lookup(forms: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash in forms; len(forms) for others. A bitmap keeps most others from the search."""
    out = np.full(len(h), len(forms), np.int32)
    if len(forms):
        maybe = np.zeros(1 << 20, bool)
        maybe[(forms >> np.uint64(44)).astype(np.int64)] = True
        some = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(forms, h[some]), len(forms) - 1)
        hit = forms[at] == h[some]
        out[some[hit]] = at[hit]
    return out


def neighbours(index: np.ndarray, row: np.ndarray, other: int) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.full(len(index), other, np.int32), np.full(len(index), other, np.int32)
    if len(index) > 1:
        same = row[1:] == row[:-1]
        before[1:][same] = index[:-1][same]
        after[:-1][same] = index[1:][same]
    return before, after


class Chain:
    """Forward-backward over several documents at once, given how many tokens each has."""

    def __init__(self, count: np.ndarray):
        self.count = count
        first = np.concatenate([[0], np.cumsum(count)])
        segs = -(-count // SEGMENT)
        self.n = int(first[-1])
        seg_doc = np.repeat(np.arange(len(count)), segs)
        self.seg_first = np.concatenate([[0], np.cumsum(segs)])
        inner = np.arange(len(seg_doc)) - self.seg_first[seg_doc]
        begin = first[seg_doc] + inner * SEGMENT
        length = np.minimum(SEGMENT, first[seg_doc + 1] - begin)
        step = np.arange(SEGMENT)[:, None]
        self.mask = step < length[None]
        self.at = np.where(self.mask, begin[None] + step, 0)
        self.order = np.argsort(-segs, kind="stable")
        self.segs = segs[self.order]

    def run(self, u: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(P(toxic) of each token, summed pair marginals 2x2 if asked for). The state before a document's first token is clean."""
        marginal = np.zeros(self.n)
        total = np.zeros((2, 2)) if pairs else None
        if not self.n:
            return marginal, total
        t = np.exp(transition)
        on = 1 / (1 + np.exp(-np.clip(u, -30, 30)))
        e1 = on[self.at]
        e0 = 1 - e1
        cols = e1.shape[1]
        m = [np.ones(cols), np.zeros(cols), np.zeros(cols), np.ones(cols)]
        for k in range(SEGMENT):
            a, b, c, d = m
            new = [(a * t[0, 0] + b * t[1, 0]) * e0[k], (a * t[0, 1] + b * t[1, 1]) * e1[k], (c * t[0, 0] + d * t[1, 0]) * e0[k], (c * t[0, 1] + d * t[1, 1]) * e1[k]]
            scale = 1 / (new[0] + new[1] + new[2] + new[3])
            keep = self.mask[k]
            m = [np.where(keep, x * scale, y) for x, y in zip(new, m, strict=True)]
        enter, leave = np.zeros(cols), np.full(cols, 0.5)
        p, q = np.zeros(len(self.count)), np.full(len(self.count), 0.5)
        deepest = int(self.segs[0])
        active = np.searchsorted(-self.segs, -np.arange(deepest), side="left")
        for k in range(deepest):
            docs = self.order[: active[k]]
            s = self.seg_first[docs] + k
            enter[s] = p[docs]
            v0, v1 = (1 - p[docs]) * m[0][s] + p[docs] * m[2][s], (1 - p[docs]) * m[1][s] + p[docs] * m[3][s]
            p[docs] = v1 / (v0 + v1)
        for k in range(deepest - 1, -1, -1):
            docs = self.order[: active[k]]
            s = self.seg_first[docs] + k
            leave[s] = q[docs]
            v0, v1 = m[0][s] * (1 - q[docs]) + m[1][s] * q[docs], m[2][s] * (1 - q[docs]) + m[3][s] * q[docs]
            q[docs] = v1 / (v0 + v1)
        before = np.empty((SEGMENT, cols))
        p = enter
        alpha = np.empty((SEGMENT, cols))
        for k in range(SEGMENT):
            before[k] = p
            v0, v1 = ((1 - p) * t[0, 0] + p * t[1, 0]) * e0[k], ((1 - p) * t[0, 1] + p * t[1, 1]) * e1[k]
            p = np.where(self.mask[k], v1 / (v0 + v1), p)
            alpha[k] = p
        q = leave
        for k in range(SEGMENT - 1, -1, -1):
            keep = self.mask[k]
            on1, on0 = alpha[k] * q, (1 - alpha[k]) * (1 - q)
            marginal[self.at[k][keep]] = (on1 / (on1 + on0))[keep]
            r0, r1 = e0[k] * (1 - q), e1[k] * q
            if total is not None:
                part = [[(1 - before[k]) * t[0, 0] * r0, (1 - before[k]) * t[0, 1] * r1], [before[k] * t[1, 0] * r0, before[k] * t[1, 1] * r1]]
                scale = keep / (part[0][0] + part[0][1] + part[1][0] + part[1][1])
                for i in (0, 1):
                    for j in (0, 1):
                        total[i, j] += (part[i][j] * scale).sum()
            b0, b1 = t[0, 0] * r0 + t[0, 1] * r1, t[1, 0] * r0 + t[1, 1] * r1
            q = np.where(keep, b1 / (b0 + b1), q)
        return marginal, total


class Chains:
    """Forward-backward over many documents, some of them at a time: memory is bounded by BLOCK_SEGMENTS, and a step's arrays stay in cache."""

    def __init__(self, count: np.ndarray):
        segs, first = np.cumsum(-(-count // SEGMENT)), np.concatenate([[0], np.cumsum(count)])
        self.n, self.parts, at = int(first[-1]), [], 0
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(segs, (segs[at - 1] if at else 0) + BLOCK_SEGMENTS, side="right")))
            self.parts.append((int(first[at]), int(first[to]), Chain(count[at:to])))
            at = to

    def run(self, u: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marginal, total = np.zeros(self.n), np.zeros((2, 2))
        for a, b, chain in self.parts:
            marginal[a:b], pairs = chain.run(u[a:b], transition, pairs=True)
            total += pairs
        return marginal, total


def _places(tables: list[np.ndarray], hashes: list[np.ndarray], row: np.ndarray) -> list[np.ndarray]:
    """The place of each feature of each token in its table, the table's length where it has none."""
    own = [_lookup(t, h) for t, h in zip(tables, hashes, strict=True)]
    return [*own, *neighbours(own[0], row, len(tables[0]))]


def _emission(model: Model, places: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(places[0]), model.bias)
    for w, p in zip(model.weights, places, strict=True):
        out += w[p]
    return out


def document_features(marginal: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """1, log of 1 + the expected toxic tokens, largest marginal, expected share of toxic tokens; per document."""
    out = np.zeros((len(count), 4))
    out[:, 0] = 1
    some = count > 0
    if some.any():
        start = first[:-1][some]
        total, most = np.add.reduceat(marginal, start), np.maximum.reduceat(marginal, start)
        out[some, 1], out[some, 2], out[some, 3] = np.log1p(total), most, total / count[some]
    return out


def train(texts: list[bytes], toxic: np.ndarray, prior: float) -> Model:
    """Fits the model on whole texts with a 0/1 label each; prior is the share of toxic documents among all labelled for training.

    A field trained on two thirds of the texts gives the others' marginals, on which the document's logistic is fitted, so it
    sees those of unseen texts. The field itself is then trained on all.
    """
    third = np.arange(len(texts)) % 3 == 0
    model = _field([t for t, k in zip(texts, third, strict=True) if not k], toxic[~third], prior)
    own = toxic[third]
    if 0 < toxic.sum() < len(toxic) and 0 < own.sum() < len(own):
        count, hashes = _tokens([t for t, k in zip(texts, third, strict=True) if k])
        places = _places(model.tables, hashes, np.repeat(np.arange(len(count)), count))
        del hashes
        marginal, _ = Chains(count).run(_emission(model, places), model.transition)
        x = document_features(marginal, np.concatenate([[0], np.cumsum(count)]), count)
        weight = np.where(own == 1, prior / own.sum(), (1 - prior) / (1 - own).sum()) * len(own)
        w = np.zeros(4)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(4)
            w = w + np.linalg.solve(hess, x.T @ (weight * (own - p)) - 0.05 * w)
        model = _field(texts, toxic, prior)
        model.document = w
    return model


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words of each text, hashes of each word's form and beginnings). Hashing needs dozens of bytes a byte, so it goes block by block."""
    count, hashes = [np.zeros(0, np.int64)], [[np.zeros(0, np.uint64)] for _ in range(1 + len(PREFIXES))]
    size = np.cumsum([len(t) for t in texts])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
        block = texts[at:to]
        data = np.frombuffer(b"".join(block), np.uint8)
        words = Words(data, np.concatenate([[0], np.cumsum([len(t) for t in block])]).astype(np.int64))
        count.append(words.count)
        for kept, h in zip(hashes, token_hashes(data, words), strict=True):
            kept.append(h)
        at = to
    return np.concatenate(count), [np.concatenate(h) for h in hashes]


def _field(texts: list[bytes], toxic: np.ndarray, prior: float) -> Model:
    count, hashes = _tokens(texts)
    row = np.repeat(np.arange(len(count)), count)
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    tables, marked, in_bad = [], np.zeros(len(row), bool), toxic[row] == 1
    for h in hashes:
        once = np.unique(mix(h ^ mix(row.astype(np.uint64))), return_index=True)[1]  # a form counts once a document
        forms, inverse, docs = np.unique(h[once], return_inverse=True, return_counts=True)
        bad = np.bincount(inverse, weights=toxic[row[once]], minlength=len(forms))
        keep = docs >= MIN_DOCS
        forms, bad, good = forms[keep], bad[keep], (docs - bad)[keep]
        share_bad, share_good = (bad + 0.5) / (n_bad + 1), (good + 0.5) / (n_good + 1)
        chance = n_bad / (n_bad + n_good)
        total = np.maximum(bad + good, 1)
        gain = bad * np.log(np.maximum(bad, 0.5) / (total * chance)) + good * np.log(np.maximum(good, 0.5) / (total * (1 - chance)))
        marks = (np.log(share_bad / share_good) > 2.5) & (gain > np.log(len(forms) + 1) + 5)  # beyond what chance gives among so many
        marked |= np.append(marks, False)[_lookup(forms, h)]
        tables.append(forms)
    model = Model(tables, [np.zeros(len(t) + 1) for t in [*tables, tables[0], tables[0]]])
    if not 0 < toxic.sum() < len(toxic):
        model.document[0] = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
        return model
    places = _places(tables, hashes, row)
    del hashes, h
    target = (marked & in_bad).astype(float)
    chain = Chains(count)
    for _ in range(ROUNDS):
        _fit(model, chain, places, target, row)
        marginal, _ = chain.run(_emission(model, places), model.transition)
        target = np.where(in_bad, (marginal > 0.5).astype(float), 0.0)
    _prune(model)
    return model


def _prune(model: Model, least: float = 0.05) -> None:
    """Drops features whose weights hardly matter, so that fewer tokens need a search."""
    forms = (np.abs(model.weights[0]) > least) | (np.abs(model.weights[-2]) > least) | (np.abs(model.weights[-1]) > least)
    for k in range(len(model.tables)):
        keep = forms if k == 0 else np.abs(model.weights[k]) > least
        keep[-1] = True
        model.tables[k] = model.tables[k][keep[:-1]]
        for w in (0, len(model.weights) - 2, len(model.weights) - 1) if k == 0 else (k,):
            model.weights[w] = model.weights[w][keep]


def _fit(model: Model, chain: Chains, places: list[np.ndarray], target: np.ndarray, row: np.ndarray) -> None:
    """Adam on the conditional likelihood of 0/1 token targets, with a small L2 pull."""
    state = target.astype(np.int64)
    last = np.zeros(len(state), np.int64)
    last[1:] = np.where(row[1:] == row[:-1], state[:-1], 0)
    seen = np.bincount(last * 2 + state, minlength=4).reshape(2, 2).astype(float)
    params = [*model.weights, np.array([model.bias]), model.transition]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        marginal, pairs = chain.run(_emission(model, places), model.transition)
        diff = target - marginal
        grad = [np.bincount(p, weights=diff, minlength=len(w)) - L2 * w for p, w in zip(places, model.weights, strict=True)]
        for g in grad:
            g[-1] = 0
        grad += [np.array([diff.sum()]), seen - pairs - L2 * model.transition]
        for k, (p, g) in enumerate(zip(params, grad, strict=True)):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            p += 0.2 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        model.bias = float(params[-2][0])


def score_texts(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """(scores, spans): of each text its probability and the UTF-8 byte offsets of runs of tokens with a marginal of 0.5 or more."""
    words = Words(data, off)
    marginal, _ = Chain(words.count).run(_emission(model, _places(model.tables, token_hashes(data, words), words.row)), model.transition)
    score = 1 / (1 + np.exp(-np.clip(document_features(marginal, words.first, words.count) @ model.document, -30, 30)))
    spans: list[list[tuple[int, int]]] = [[] for _ in words.count]
    hit = np.flatnonzero(marginal >= 0.5)
    for i in hit:
        row = int(words.row[i])
        base = int(off[row])
        own = spans[row]
        if own and i > 0 and marginal[i - 1] >= 0.5 and words.row[i - 1] == row:
            own[-1] = (own[-1][0], int(words.end[i]) - base)
        else:
            own.append((int(words.start[i]) - base, int(words.end[i]) - base))
    return score, spans


SCORED = "doc_id long, score double, spans array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _score(model: Model, keep_rows: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in text_chunks(batches):
            score, spans = score_texts(model, data, off)
            if keep_rows:
                yield rows.filter(pa.array(score < 0.5))
                continue
            ids = pa.array(longs(rows, "doc_id"), mask=~rows.column(0).is_valid().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([ids, pa.array(score), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS)], names=["doc_id", "score", "spans"])

    return run


def held_out(doc_id, folds: int = FOLDS, fold: int = 0):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on at most MAX_TRAIN_DOCS labelled documents of each class, none of them held out.

    The ids are picked among those whose text can train; two bounded lists of them are all that comes to the driver, with the model.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    own = docs.select(F.col("doc_id").cast("long"), "text").where(F.octet_length("text") <= MAX_TRAIN_BYTES)
    able = saved(known.join(own.select("doc_id"), "doc_id", "left_semi"), "able")
    picks = [r for c in (0, 1) for r in able.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_DOCS).collect()]
    if not picks:
        return _empty()
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in picks], "doc_id long, toxic int")  # 2 * MAX_TRAIN_DOCS rows at most
    rows = own.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).coalesce(1)  # at most 2 * MAX_TRAIN_DOCS texts of MAX_TRAIN_BYTES
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    with inner_settings(docs.sparkSession):
        found = rows.select("doc_id", "text", "toxic").mapInArrow(_train(prior), "model binary").collect()
    return pickle.loads(found[0].model) if found else _empty()


def _empty() -> Model:
    return Model([np.zeros(0, np.uint64)] * (1 + len(PREFIXES)), [np.zeros(1)] * (3 + len(PREFIXES)), document=np.array([-3.0, 0, 0, 0]))


def _train(prior: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trains in a task, so the driver holds neither the sample nor the arrays; the model comes back as one small row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        steady_heap()
        rows = sorted((d, t or "", y) for batch in batches for d, t, y in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True))
        if rows:
            model = train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], np.int64), prior)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        release_heap()

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents -> doc_id, held_out, score, predicted, spans (UTF-8 byte offsets of toxic runs), one row each.

    Null and blank texts get the score of a text without evidence; labels, lang, source and doc_id are no inputs.
    A null doc_id is scored and not held out. Repeated rows score alike. Without labels of both classes every text gets
    the prior. Very long texts are scored whole. An empty table gives an empty result. Further columns, whatever their names, are not
    read.
    """
    model = fit(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(model, False), SCORED)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below 0.5, with all their columns, whatever their names; each as often as it came.

    Null and blank texts have the score of a text without evidence, and stay unless most labelled documents are toxic. A null
    doc_id is judged by its text as any other. Without labels of both classes every text has the prior, so without any label all
    stay. Very long texts are scored whole. An empty table gives an empty result.
    """
    model = fit(docs, labels)
    return docs.mapInArrow(_score(model, True), docs.schema)
