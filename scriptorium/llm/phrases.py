"""Phrase collocations by hierarchical pair naming.

A phrase of k words is named by the pair of its (k-1)-word phrases, the one that begins and the one that ends it. Texts become sequences
of names: level 1 names the words, and level k names each place whose two neighbouring names of level k - 1 are both frequent. A
sequence stays with its block of texts; only the block's distinct pairs with their counts travel, packed by bucket, and are joined
there over all blocks. What comes back to a block is one bit a pair, frequent or not, and the names of those that are, so a place that is not
goes before the next level, and between the levels a block keeps numbers alone. The pair that names a phrase also points at its parents: cuts add up counts along these pointers, and a phrase lies
inside a longer one exactly if it is the parent of one, or of one that is.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import _LOWER, binary_parts, columns_only, delete_path, inner_settings, mix, prefix_hash, release_heap, saved, scratch, scratch_path, span_hash, text_bytes, text_chunks

MOST_WORDS, LEAST_USES, COVERED_PERCENT, SHOWN = 4, 30, 80, 2000
SCORE_SCALE = 2_000_000
#: Text whose places are one sequence. A longer text is cut between two pieces.
BLOCK_BYTES = 4 << 20
#: Candidates of a language that are sorted as one array.
SORTED_AT_ONCE = 20_000

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _PIECE.copy()
_GAP[[9, 32]] = True
_ODD, _EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)

#: What a pass over blocks writes: sequences (kind 0) and what goes to the buckets (kind 1).
PASSED = "kind int, block long, bucket int, lang string, seq binary, names binary, lefts binary, rights binary, counts binary, words binary"
#: What the buckets write: of a block's f names there the bits, and the names of those that are frequent (kind 0), frequent phrases (kind 1), words
#: of a language (kind 2).
COUNTED = "kind int, block long, bucket int, bits binary, names binary, name long, parent_left long, parent_right long, f long, lang string, word string"


def pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _ODD + mix(right + _EVEN))


def lang_code(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little"))


def pieces_cut(data: np.ndarray, off: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of texts in blocks; one that alone is longer than the limit is cut where a piece ends."""
    if len(off) > 2 or len(data) <= limit:
        yield data, off
        return
    ends = np.flatnonzero(_PIECE[data]) + 1
    at = 0
    while at < len(data):
        k = int(np.searchsorted(ends, at + limit, side="right")) - 1
        if k < 0 or ends[k] <= at:
            k += 1
        to = int(ends[k]) if k < len(ends) and len(data) - at > limit else len(data)
        yield data[at:to], np.array([0, to - at])
        at = to


def word_sequence(data: np.ndarray, off: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(seq, names, counts, words): seq has each place's word as 1 + its number, and 0 between pieces."""
    low, inside = _LOWER[data], ~_GAP[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = off[1:-1][(off[1:-1] < len(data)) & (off[1:-1] > 0)]
    begins[edge], ends[edge - 1] = inside[edge], inside[edge - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    name = mix(span_hash(prefix_hash(low), start, stop) + lang_code(lang))
    names, first, which, counts = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    pieces = np.cumsum(_PIECE[data])
    apart = (pieces[start[1:]] != pieces[start[:-1]]) | (np.diff(np.searchsorted(off, start, side="right")) > 0)
    seq = np.zeros(len(start) + int(apart.sum()), np.uint32)
    seq[np.arange(len(start)) + np.concatenate([[0], np.cumsum(apart)])[: len(start)]] = which + 1
    raw = low.tobytes()
    return seq, names, counts, [raw[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)]


def by_bucket(names: np.ndarray, seq: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket of each in that order, seq with the new numbers): names of a bucket side by side."""
    bucket = (names % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    number = np.zeros(len(names) + 1, np.uint32)
    number[order + 1] = np.arange(1, len(names) + 1)
    return order, bucket[order], number[seq]


def _packed(block: int, lang: str, seq: np.ndarray | None, names: np.ndarray, bucket: np.ndarray, counts: np.ndarray, lefts: np.ndarray | None = None, rights: np.ndarray | None = None, words: list[bytes] | None = None) -> pa.RecordBatch:
    """A block's sequence, if it goes on, and a row for each bucket that it has names in."""
    kept = seq is not None
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    spans = list(zip(edges.tolist(), np.append(edges[1:], len(bucket)).tolist(), strict=True))
    part = lambda x, kind, a, b: None if x is None else x[a:b].astype(kind).tobytes()
    none = [None] * kept
    cols = [
        pa.array([0] * kept + [1] * len(spans), pa.int32()),
        pa.array([block] * (kept + len(spans)), pa.int64()),
        pa.array(none + bucket[edges].tolist(), pa.int32()),
        pa.array([lang] * (kept + len(spans)), pa.string()),
        pa.array(([seq.astype("<u4").tobytes()] if kept else []) + [None] * len(spans), pa.binary()),
        pa.array(none + [part(names, "<u8", a, b) if lefts is None else None for a, b in spans], pa.binary()),
        pa.array(none + [part(lefts, "<u8", a, b) for a, b in spans], pa.binary()),
        pa.array(none + [part(rights, "<u8", a, b) for a, b in spans], pa.binary()),
        pa.array(none + [part(counts, "<u4", a, b) for a, b in spans], pa.binary()),
        pa.array(none + [None if words is None else b"\n".join(words[a:b]) for a, b in spans], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PASSED.split(", ")])


def _read(buckets: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Level 1: texts of one language at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in text_chunks(batches, limit=limit):
            langs = np.array(rows.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                for data, off in pieces_cut(*binary_parts(rows.column(1).filter(pa.array(langs == lang))), limit):
                    seq, names, counts, words = word_sequence(data, off, lang)
                    if not len(names):
                        continue
                    order, bucket, seq = by_bucket(names, seq, buckets)
                    yield _packed(uuid.uuid4().int >> 65, lang, seq, names[order], bucket, counts[order], words=[words[i] for i in order])

    return run


def _count(least: int, bits_wanted: bool) -> Callable[[pa.Table], pa.Table]:
    """A bucket's names over all blocks: which are frequent, and for each block the bits of its own."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_pylist()
        numbers = lambda name, kind: np.frombuffer(b"".join(column(name)), kind)
        counts, words = numbers("counts", "<u4").astype(np.int64), column("words")
        pairs = table.column("names").null_count > 0
        left, right = (numbers("lefts", "<u8"), numbers("rights", "<u8")) if pairs else (None, None)
        names = pair_names(left, right) if pairs else numbers("names", "<u8")
        size = np.array([len(x) // 4 for x in column("counts")], np.int64)
        distinct, first, which = np.unique(names, return_index=True, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, which, counts)
        often = total >= least
        found, at = np.flatnonzero(often), first[often]
        langs, begin = column("lang"), np.cumsum(size) - size
        row = np.searchsorted(begin, at, side="right") - 1
        spelled: dict[int, list[bytes]] = {}
        text = [None] * len(found)
        if not pairs:
            for k in np.argsort(row, kind="stable").tolist():
                if (r := int(row[k])) not in spelled:
                    spelled = {r: words[r].split(b"\n")}
                text[k] = spelled[r][int(at[k] - begin[r])].decode()
        wanted = size if bits_wanted else size[:0]
        bits = [np.packbits(often[which[a : a + n]]).tobytes() for a, n in zip(begin.tolist(), wanted.tolist(), strict=False)]
        own = [distinct[which[a : a + n]][often[which[a : a + n]]].astype("<u8").tobytes() for a, n in zip(begin.tolist(), wanted.tolist(), strict=False)]
        uses: dict[str, int] = {}
        if not pairs:
            for lang, a, n in zip(langs, begin.tolist(), size.tolist(), strict=True):
                uses[lang] = uses.get(lang, 0) + int(counts[a : a + n].sum())
        b, f, u = len(bits), len(found), len(uses)
        whole = lambda x: pa.concat_arrays([pa.nulls(b, pa.int64()), pa.array(x.view(np.int64)), pa.nulls(u, pa.int64())])
        none = pa.nulls(f, pa.int64())
        blank = pa.concat_arrays([pa.nulls(b, pa.int64()), none, pa.nulls(u, pa.int64())])
        cols = [
            pa.array([0] * b + [1] * f + [2] * u, pa.int32()),
            pa.array(column("block")[:b] + [None] * (f + u), pa.int64()),
            pa.array(column("bucket")[:b] + [None] * (f + u), pa.int32()),
            pa.array(bits + [None] * (f + u), pa.binary()),
            pa.array(own + [None] * (f + u), pa.binary()),
            whole(distinct[found]),
            whole(left[at]) if pairs else blank,
            whole(right[at]) if pairs else blank,
            pa.array(size[:b].tolist() + total[found].tolist() + list(uses.values()), pa.int64()),
            pa.array([None] * b + [langs[r] for r in row.tolist()] + list(uses), pa.string()),
            pa.array([None] * b + text + [None] * u, pa.string()),
        ]
        release_heap()
        return pa.table(cols, names=[c.split()[0] for c in COUNTED.split(", ")])

    return run


def _pair(buckets: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The next level of one block: its places that stayed frequent, paired with their neighbours."""

    def run(state: pa.Table, bits: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        if state.num_rows:
            seq = np.frombuffer(state.column("seq")[0].as_py(), "<u4")
            found = sorted(zip(bits.column("bucket").to_pylist(), bits.column("f").to_pylist(), bits.column("bits").to_pylist(), bits.column("names").to_pylist(), strict=True))
            often = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for _, n, x, _ in found]).astype(bool)
            names = np.frombuffer(b"".join(x for *_, x in found), "<u8")
            number = np.concatenate([[0], np.cumsum(often) * often]).astype(np.uint32)
            seq = number[seq]
            seq = seq[(seq > 0) | np.append(True, seq[:-1] > 0)]  # of places that went side by side one zero stays
            at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
            if len(at):
                code, which, counts = np.unique((seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1], return_inverse=True, return_counts=True)
                left, right = names[(code >> np.uint64(32)).astype(np.int64) - 1], names[(code & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1]
                paired = np.zeros(len(seq), np.uint32)
                paired[at] = which + 1
                own = pair_names(left, right)
                order, bucket, paired = by_bucket(own, paired, buckets)
                out.append(_packed(state.column("block")[0].as_py(), state.column("lang")[0].as_py(), None if last else paired, own[order], bucket, counts[order], left[order], right[order]))
        empty = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("lang", pa.string()), *[(n, pa.binary()) for n in ("seq", "names", "lefts", "rights", "counts", "words")]])
        result = pa.Table.from_batches(out, out[0].schema if out else empty)
        release_heap()
        return result

    return run


def _by_kind(df: DataFrame, name: str) -> tuple[Callable[[int], DataFrame], str]:
    """Writes df with a folder for each kind: (reads one kind, the path)."""
    spark, path, schema = df.sparkSession, scratch_path(df.sparkSession, name), df.schema
    with inner_settings(spark):
        df.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return lambda kind: spark.read.schema(schema).parquet(path).where(F.col("kind") == kind), path


def frequent_phrases(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_USES, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """(words of each language: lang, n; for each length from 1: name, parent_left, parent_right, f, lang, word of the frequent phrases)."""
    own = columns_only(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total = text_bytes(own)
    buckets = max(16, min(total // (4 << 20), max(2048, total // (64 << 20)))) + 1
    passed, path = _by_kind(own.mapInArrow(_read(buckets, block_bytes), PASSED), "places-1")
    uses, levels = None, []
    for k in range(1, most_words + 1):
        to_buckets = passed(1).select("block", "bucket", "lang", "names", "lefts", "rights", "counts", "words")
        counted, _ = _by_kind(to_buckets.groupBy("bucket").applyInArrow(_count(least, k < most_words), COUNTED), f"counted-{k}")
        levels.append(counted(1).select("name", "parent_left", "parent_right", "f", "lang", "word"))
        if k == 1:
            uses = counted(2).groupBy("lang").agg(F.sum("f").alias("n"))
        if k < most_words:
            blocks = passed(0).select("block", "lang", "seq").groupBy("block")
            before = path
            passed, path = _by_kind(blocks.cogroup(counted(0).select("block", "bucket", "f", "bits", "names").groupBy("block")).applyInArrow(_pair(buckets, k + 1 == most_words), PASSED), f"places-{k + 1}")
            delete_path(docs.sparkSession, before)
    return uses, levels


def candidates(levels: list[DataFrame]) -> list[DataFrame]:
    """For each length from 2: name, lang, phrase, f, and over its cuts `firsts` and `rests`, the counts of the parts, along the pointers."""
    longs = F.array().cast("array<bigint>")
    shorter = levels[0].select("name", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", longs.alias("firsts"), longs.alias("rests"))
    out = []
    for k, level in enumerate(levels[1:], 2):
        end = lambda side: shorter.select(F.col("name").alias(f"parent_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in shorter.columns if c != "name"])
        rows = level.select("name", "parent_left", "parent_right", "f").join(end("left"), "parent_left").join(end("right"), "parent_right")
        shorter = saved(rows.select(
            "name", F.col("left_lang").alias("lang"), F.concat("left_phrase", F.lit(" "), "right_last").alias("phrase"), F.col("right_last").alias("last"), "f",
            F.concat("left_firsts", F.array("left_f")).alias("firsts"), F.concat(F.array("right_f"), "right_rests").alias("rests"),
        ), f"phrases-{k}")
        out.append(shorter)
    return out


def scored(levels: list[DataFrame], least_covered: int = COVERED_PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one covers. Arithmetic is in decimals of 28 places."""
    rows = None
    for part in candidates(levels):
        rows = part if rows is None else rows.unionByName(part)
    parents = None
    for level in levels[2:]:
        both = level.select(F.explode(F.array("parent_left", "parent_right")).alias("name"), F.col("f").alias("longer"))
        parents = both if parents is None else parents.unionByName(both)
    if parents is not None:  # a phrase inside one that is longer by two words is inside one of its parents, which is as frequent at least
        rows = rows.join(parents.groupBy("name").agg(F.max("longer").alias("longer")), "name", "left")
        rows = rows.where(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(f as decimal(20,0)) * {least_covered}")
    wide = "transform(arrays_zip(firsts, rests), x -> (cast({s} as decimal(7,0)) * cast(f as decimal(20,0))) div (cast(x.firsts as decimal(20,0)) + cast(x.rests as decimal(20,0))))"
    rows = rows.withColumn("scores", F.expr(wide.format(s=SCORE_SCALE))).withColumn("score", F.array_min("scores")).withColumn("cut", F.array_position("scores", F.col("score")).cast("int"))
    return rows.select("lang", "phrase", F.col("f").alias("a"), F.element_at("firsts", F.col("cut")).alias("l"), F.element_at("rests", F.col("cut")).alias("r"), "score")


def best_of_each(rows: DataFrame, shown: int, at_once: int = SORTED_AT_ONCE) -> DataFrame:
    """lang, rank and the columns of scored(): a language's candidates are cut in parts, then parts of parts, so none is gathered whole."""
    salts = -(-rows.count() // at_once) or 1
    best = rows.select("lang", F.struct((-F.col("score")).alias("s"), (-F.col("a")).alias("a"), "phrase", "l", "r").alias("row"))
    salt = F.pmod(F.xxhash64("row.phrase"), F.lit(salts))
    while True:
        tops = best.groupBy("lang", salt.alias("salt")).agg(F.slice(F.sort_array(F.collect_list("row")), 1, shown).alias("rows"))
        if salts == 1:
            ranked = tops.select("lang", F.posexplode("rows").alias("at", "row"))
            return ranked.select("lang", (F.col("at") + 1).cast("long").alias("rank"), "row.phrase", (-F.col("row.a")).alias("a"), "row.l", "row.r", (-F.col("row.s")).alias("score"))
        salts = -(-salts // 8)
        best, salt = tops.select("lang", "salt", F.explode("rows").alias("row")), F.pmod("salt", F.lit(salts))


def collocations(docs: DataFrame, shown: int = SHOWN, most_words: int = MOST_WORDS, least: int = LEAST_USES) -> DataFrame:
    """documents (lang, text) -> lang, rank, phrase, a, l, r, n, score: the `shown` best phrases of 2 to `most_words` words of each language.

    Null texts are empty, a null language is `und`, together with rows that say so. Ties in score and count go by the bytes of the phrase. Repeated rows
    count as often as they come. Very long texts are cut between pieces, so a task holds a piece and BLOCK_BYTES at most; results don't
    change. A language without a candidate has no row; an empty table gives an empty result. Further columns, whatever their names,
    are not read. Names are hashes of 64 bits, and equal names count as equal phrases.
    """
    with scratch(docs.sparkSession) as kept:
        uses, levels = frequent_phrases(docs, most_words, least)
        best = best_of_each(saved(scored(levels), "scored"), shown)
        return saved(best.join(uses, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", keep=kept)


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {k} AS k, w1 || {' || '.join(repr(' ') + f' || w{i}' for i in range(2, k + 1))} AS phrase, {', '.join(f'w{i}' if i <= k else 'NULL AS w' + str(i) for i in range(1, 5))}, count(*) AS a FROM runs WHERE w{k} IS NOT NULL GROUP BY ALL HAVING count(*) >= 30"
    for k in (2, 3, 4)
)
_CUTS = " UNION ALL ".join(
    f"SELECT g.*, {c} AS cut, {' || '.join([f'w{i}' + (chr(32) + '|| chr(32)' if i < c else '') for i in range(1, c + 1)])} AS first_part, {' || '.join([f'w{i}' + (chr(32) + '|| chr(32)' if i < k else '') for i in range(c + 1, k + 1)])} AS rest FROM grams g WHERE k = {k}"
    for k in (2, 3, 4)
    for c in range(1, k)
)
ORACLE = rf"""
WITH texts AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p, generate_subscripts(string_split_regex(t, '[.,;:!?\x0A-\x0D]'), 1) AS nth FROM texts),
places AS (SELECT d, lang, nth, unnest(regexp_extract_all(p, '[^\x20\x09]+')) AS w, generate_subscripts(regexp_extract_all(p, '[^\x20\x09]+'), 1) AS spot FROM pieces),
runs AS (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM places WINDOW o AS (PARTITION BY d, nth ORDER BY spot)),
ones AS (SELECT lang, w AS phrase, count(*) AS a FROM places GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM ones GROUP BY lang),
grams AS ({_GRAMS}),
known AS (SELECT lang, phrase, a FROM ones UNION ALL SELECT lang, phrase, a FROM grams),
cuts AS ({_CUTS}),
summed AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
  FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = c.first_part JOIN known y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM summed QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT lang, a AS longer, unnest(CASE k WHEN 3 THEN [w1 || ' ' || w2, w2 || ' ' || w3]
      ELSE [w1 || ' ' || w2, w2 || ' ' || w3, w3 || ' ' || w4, w1 || ' ' || w2 || ' ' || w3, w2 || ' ' || w3 || ' ' || w4] END) AS inner_phrase FROM grams WHERE k > 2) g
    WHERE g.lang = s.lang AND g.inner_phrase = s.phrase AND 100::HUGEINT * g.longer >= 80::HUGEINT * s.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
