"""Relations named by verbs: a hidden-Markov tagger whose counts come from one aggregation, and Viterbi over Arrow batches.

The model is what two counts say, over all sentences: which tag follows which, and which word a tag puts out. Training tags are a column of
the caller's, or those of a small lexicon, from which the tagger goes on to words that the lexicon doesn't know by what stands around them.
The relation of two mentions is the first word tagged as a verb that stands between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.gazetteer import sentences, slices
from scriptorium.operators.graph import CAPITALISED, HEAD

TAGS = ("NAME", "VERB", "FUNCTION", "NUMBER", "SIGN", "WORD")
VERB = TAGS.index("VERB")
TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"
#: Words whose emissions are kept by themselves, the most frequent ones; others go by their ending and, where that is new too, by the tag alone.
MOST_WORDS = 100_000
#: Tokens that are tagged side by side, short sentences filled up to the longest one of them; a longer sentence stands alone.
GRID_TOKENS = 1 << 16
#: Bytes of sentences whose names are found before those with pairs are tagged, and rows at most.
TAGGED_BYTES, TAGGED_ROWS = 1 << 20, 1024
#: Distinct tokens whose counts a task holds before it hands them on.
COUNTED_TOKENS = 200_000
ENDING = 3
#: Closed-class words and frequent verbs of the four languages, which give the training tags.
FUNCTION_WORDS = (
    "the a an of in on at by for with from to into and or but as that which who this these those his her its their our is are was were be been "
    "der die das den dem des ein eine einer und oder aber in im auf an am bei für mit von zu zum zur als dass sein ihr ist sind war waren "
    "le la les un une des du de et ou mais dans sur à par pour avec que qui ce cette ces son sa ses est sont était "
    "el los las una unos del y o pero en por para con su sus es son era lo al"
).split()
VERBS = (
    "met wrote founded owns acquired bought sold makes made leads led joined left built uses used supports supplies supplied works worked said says has had have "
    "gründete besitzt kaufte verkaufte leitet trifft traf schrieb baut nutzt liefert arbeitet sagt sagte hat hatte haben "
    "fonda possède acheta dirige rencontra écrit utilise fournit travaille dit a avait ont "
    "fundó posee compró dirige conoció escribió usa suministra trabaja dijo tiene tenía tienen"
).split()


def tokens(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0))


def lexicon_tag(token: Column) -> Column:
    """The training tag of a token by itself: verbs and function words by the lists, names by their capital."""
    low = F.lower(token)
    return (
        F.when(low.isin(*VERBS), "VERB").when(low.isin(*FUNCTION_WORDS), "FUNCTION").when(token.rlike(r"^\p{N}"), "NUMBER")
        .when(token.rlike(r"^[^\p{L}]"), "SIGN").when(token.rlike(r"^\p{Lu}\p{Ll}"), "NAME").otherwise("WORD")
    )


def tagged_tokens(chunks: DataFrame) -> DataFrame:
    """One row a sentence: `words`, an array<struct<token, tag>> by the lexicon."""
    rows = chunks.select(F.explode(sentences(F.col("text"))).alias("s")).select(tokens(F.col("s")).alias("t")).where(F.size("t") > 0)
    return rows.select(F.transform("t", lambda t: F.struct(t.alias("token"), lexicon_tag(t).alias("tag"))).alias("words"))


def _lexicon_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex

    number, sign, name, capital = (regex.compile(x) for x in (r"\p{N}", r"[^\p{L}]", r"\p{Lu}\p{Ll}", r"\p{Lu}"))
    verbs, function, at = frozenset(VERBS), frozenset(FUNCTION_WORDS), {t: i for i, t in enumerate(TAGS)}
    n = len(TAGS)

    def tag(word: str) -> int:
        """lexicon_tag of a token."""
        low = word.lower()
        return at["VERB" if low in verbs else "FUNCTION" if low in function else "NUMBER" if number.match(word) else "SIGN" if sign.match(word) else "NAME" if name.match(word) else "WORD"]

    known: dict[str, int] = {}
    seen: dict[str, int] = {}
    steps = np.zeros((n + 1) * n, np.int64)

    def sums() -> pa.RecordBatch:
        out: dict[tuple[str, str, str], int] = {("step", TAGS[i // n] if i < n * n else "", TAGS[i % n]): int(steps[i]) for i in np.flatnonzero(steps)}
        for word, count in seen.items():
            front, own = "^" if capital.match(word) else "", TAGS[known[word]]
            for entry in (("word", front + word.lower(), own), ("ending", front + word[-ENDING:].lower(), own), ("tag", "", own)):
                out[entry] = out.get(entry, 0) + count
        kind, a, b = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.string()) for x in (kind, a, b)], pa.array(out.values(), pa.int64())], names=["kind", "a", "b", "n"])

    for batch in (part for whole in batches for part in slices(whole, 0, TAGGED_BYTES, whole.num_rows)):
        sizes = pc.list_value_length(batch.column(0)).to_numpy()
        coded = batch.column(0).flatten().dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        for word, count in zip(words, np.bincount(which, minlength=len(words)).tolist(), strict=True):
            if word not in known:
                known[word] = tag(word)
            seen[word] = seen.get(word, 0) + count
        tags = np.array([known[w] for w in words])[which]
        before = np.append(n, tags[:-1])
        before[np.cumsum(sizes)[:-1]] = n
        steps += np.bincount(before * n + tags, minlength=(n + 1) * n)
        if len(seen) > COUNTED_TOKENS:
            yield sums()
            known.clear(), seen.clear()
            steps[:] = 0
    yield sums()


def lexicon_counts(chunks: DataFrame) -> DataFrame:
    """What counts(tagged_tokens(chunks)) gives, by one pass: a token's tag hangs on the token alone, so a task counts tokens, tags each distinct one once, and hands on its sums."""
    rows = chunks.select(F.explode(sentences(F.col("text"))).alias("s")).select(tokens(F.col("s")).alias("t")).where(F.size("t") > 0).mapInArrow(_lexicon_counts, "kind string, a string, b string, n long")
    return rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


class Model:
    """Logarithms of smoothed shares: start (of each tag), step (tag to tag), and what each word and each ending says for each tag."""

    def __init__(self, rows: list[tuple[str, str, str, int]], tags: tuple[str, ...] = TAGS):
        at = {t: i for i, t in enumerate(tags)}
        n = len(tags)
        start, step, whole = np.ones(n), np.ones((n, n)), np.ones(n)
        words: dict[str, np.ndarray] = {}
        endings: dict[str, np.ndarray] = {}
        for kind, a, b, count in rows:
            if kind == "step":
                if a == "":
                    start[at[b]] += count
                else:
                    step[at[a], at[b]] += count
            elif kind == "tag":
                whole[at[b]] += count
            else:
                (words if kind == "word" else endings).setdefault(a, np.zeros(n))[at[b]] += count
        self.tags = tags
        self.start, self.step = np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True))
        share = lambda counts: np.log((counts + 0.1) / (whole + 0.1 * n))
        self.words, self.endings = {w: share(c) for w, c in words.items()}, {e: share(c) for e, c in endings.items()}
        self.other = share(np.zeros(n))

    def emission(self, token: str) -> np.ndarray:
        low = token.lower()
        found = self.words.get(("^" if token[:1].isupper() else "") + low)
        if found is None:
            found = self.endings.get(("^" if token[:1].isupper() else "") + low[-ENDING:])
        return self.other if found is None else found


def _key(token: Column, part: Column) -> Column:
    """A word or ending, with whether it is capitalised."""
    return F.concat(F.when(token.rlike(r"^\p{Lu}"), F.lit("^")).otherwise(F.lit("")), F.lower(part))


def counts(tagged: DataFrame) -> DataFrame:
    """kind, a, b, n: steps from tag a (empty at a sentence's start) to b, words and endings a with tag b, and tags b. One aggregation.

    tagged: one row a sentence with `words`, an array<struct<token, tag>>.
    """
    entry = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    before = lambda i: F.when(i == 0, F.lit("")).otherwise(F.element_at("words", F.greatest(i, F.lit(1)))["tag"])
    said = lambda w, i: F.array(entry("step", before(i), w["tag"]), entry("word", _key(w["token"], w["token"]), w["tag"]), entry("ending", _key(w["token"], F.right(w["token"], F.lit(ENDING))), w["tag"]), entry("tag", F.lit(""), w["tag"]))
    rows = tagged.select(F.explode(F.flatten(F.transform("words", said))).alias("e")).select("e.*")
    return rows.groupBy("kind", "a", "b").agg(F.count("*").alias("n"))


def fit(tagged: DataFrame, most_words: int = MOST_WORDS, tags: tuple[str, ...] = TAGS) -> Model:
    """The model. What comes to the driver is bounded: the steps, the tags, and for words and endings the `most_words` most frequent entries."""
    return _fitted(counts(tagged), most_words, tags)


def fit_by_lexicon(chunks: DataFrame, most_words: int = MOST_WORDS) -> Model:
    """The model that fit(tagged_tokens(chunks)) gives."""
    return _fitted(lexicon_counts(chunks), most_words, TAGS)


def _fitted(found: DataFrame, most_words: int, tags: tuple[str, ...]) -> Model:
    found = found.persist()
    try:
        few = found.where("kind in ('step', 'tag')").collect()
        many = found.where("kind in ('word', 'ending')").orderBy(F.desc("n"), "kind", "a", "b").limit(most_words).collect()
    finally:
        found.unpersist()
    return Model([(r.kind, r.a, r.b, r.n) for r in [*few, *many]], tags)


def viterbi(model: Model, batch: list[list[str]]) -> list[np.ndarray]:
    """The most likely tags of each sentence; of equally likely ones the first. Sentences of like length go along together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(batch)
    order = sorted((i for i in range(len(batch)) if batch[i]), key=lambda i: len(batch[i]))
    known: dict[str, np.ndarray] = {}
    a = 0
    while a < len(order):
        to = a + 1
        while to < min(len(order), a + 256) and (to + 1 - a) * len(batch[order[to]]) <= GRID_TOKENS:
            to += 1
        some, a = order[a:to], to
        size = np.array([len(batch[i]) for i in some])
        grid = np.zeros((len(some), int(size.max()), len(model.tags)))
        for r, i in enumerate(some):
            for t, token in enumerate(batch[i]):
                if token not in known:
                    known[token] = model.emission(token)
                grid[r, t] = known[token]
        best = model.start + grid[:, 0]
        came = np.zeros(grid.shape, np.int8)
        last = best.argmax(1)
        ends = np.where(size == 1, last, 0)
        for t in range(1, grid.shape[1]):
            ways = best[:, :, None] + model.step[None]
            came[:, t] = ways.argmax(1)
            best = ways.max(1) + grid[:, t]
            ends = np.where(size == t + 1, best.argmax(1), ends)
        for r, i in enumerate(some):
            tags = np.zeros(size[r], np.int64)
            tags[-1] = ends[r]
            for t in range(size[r] - 1, 0, -1):
                tags[t - 1] = came[r, t, tags[t]]
            out[i] = tags
    return out


MENTION = "array<array<struct<surface:string,label:string,start:int,verb:string,verb_start:int>>>"


def _verbs(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    import regex

    token, name = regex.compile(TOKEN), regex.compile(CAPITALISED)
    kind = pa.list_(pa.list_(pa.struct([("surface", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("verb", pa.string()), ("verb_start", pa.int32())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 4, TAGGED_BYTES, TAGGED_ROWS)):
            texts = batch.column(4).to_pylist()
            names = [[list(name.finditer(s)) for s in own or []] for own in texts]
            asked = [(i, k) for i, own in enumerate(names) for k, found in enumerate(own) if len(found) > 1]  # others have no pair
            spans = [list(token.finditer(texts[i][k])) for i, k in asked]
            verbs: dict[tuple[int, int], list[tuple[int, str]]] = {}
            for where, span, tags in zip(asked, spans, viterbi(model, [[m.group() for m in s] for s in spans]), strict=True):
                verbs[where] = [(m.start(), m.group().lower()) for m, tag in zip(span, tags.tolist(), strict=True) if tag == VERB]
            out = []
            for i, own in enumerate(names):
                row = []
                for k, found in enumerate(own):
                    there = verbs.get((i, k), [])
                    following = [next(((at, v) for at, v in there if at >= m.end()), (None, None)) for m in found]
                    row.append([{"surface": m.group(), "label": "ORG", "start": m.start(), "verb": v, "verb_start": at} for m, (at, v) in zip(found, following, strict=True)])
                out.append(row)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, kind)], names=[*batch.schema.names[:4], "mentions"])

    return run


def mentions_with_verbs(chunks: DataFrame, model: Model) -> DataFrame:
    """graph.capitalised_mentions with, for each mention, the first verb behind it in its sentence; graph.build_edges names relations by it.

    Null and empty texts have no mentions; very long sentences are tagged whole.
    """
    rows = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "source", "page", F.left("text", F.lit(HEAD)).alias("head"), sentences(F.col("text")).alias("sentences"))
    return rows.mapInArrow(_verbs(model), f"chunk_id string, source string, page string, head string, mentions {MENTION}")
