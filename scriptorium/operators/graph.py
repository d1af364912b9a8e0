"""The entity graph: mentions, normalised names, co-occurrence and document edges, and bounded traversal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.text import strip
from scriptorium.session import new_folder, remove_folder, stored

#: Leading articles that are dropped, and entity labels that count.
ARTICLES = ("the", "a", "an", "der", "die", "das", "den", "dem")
LABELS = ("PERSON", "ORG", "GPE", "LOC", "LAW", "NORP", "PRODUCT", "EVENT", "FAC", "WORK_OF_ART")
#: The names of the two relations, and how much of a chunk's text an edge keeps.
DOCUMENT_RELATION, DEFAULT_RELATION = "appears_in", "related_to"
HEAD = 200
Extractor = Callable[[Column], Column]
Relation = Callable[[Column, Column, Column], Column]
CAPITALISED = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*"


def normalise(name: Column) -> Column:
    """White space runs become a space and one leading article goes; case stays. A lone article becomes empty."""
    flat = strip(F.regexp_replace(name, r"(?U)\s+", " "))
    return strip(F.regexp_replace(flat, f"^(?i)({'|'.join(ARTICLES)})( |$)", ""))


def document_node(source: Column) -> Column:
    return strip(F.translate(F.regexp_replace(source, r"(?i)\.pdf$", ""), "_", " "))


def capitalised(text: Column) -> Column:
    """The default extractor, by built-in functions: runs of capitalised words, as an array<struct<surface, label>> for each sentence.

    A model goes in its place as any function of the text that returns such arrays of arrays, sentence by sentence.
    """
    found = lambda s: F.transform(F.regexp_extract_all(s, F.lit(CAPITALISED), F.lit(0)), lambda m: F.struct(m.alias("surface"), F.lit("ORG").alias("label")))
    return F.transform(F.split(text, r"(?<=[.!?])\s+"), found)


def capitalised_mentions(chunks: DataFrame, extract: Extractor = capitalised) -> DataFrame:
    """One row a chunk: chunk_id, source, page, head (the text's first HEAD characters), mentions (an array for each sentence).

    Everything that is derived from mentions stays inside that row, so no text travels and nothing is shuffled.
    """
    return chunks.select("chunk_id", "source", "page", F.left("text", F.lit(HEAD)).alias("head"), extract(F.col("text")).alias("mentions"))


def has_verbs(mentions: DataFrame) -> bool:
    """Whether mentions carry the verb that follows them (see operators.tagging)."""
    return "verb" in mentions.schema["mentions"].dataType.elementType.elementType.names


def _flat(sentences: Column, verbs: bool = False) -> Column:
    """All mentions of a chunk in order, each with its sentence, its place there, and how many there are."""
    more = lambda m: [m[c].alias(c) for c in ("start", "verb", "verb_start")] if verbs else []
    return F.flatten(F.transform(sentences, lambda s, i: F.transform(s, lambda m, at: F.struct(i.alias("sent_idx"), at.alias("at"), F.size(s).alias("n"), m["surface"].alias("surface"), m["label"].alias("label"), *more(m)))))


def mention_rows(mentions: DataFrame) -> DataFrame:
    """One row a mention: chunk_id, source, page, pos (counted along the chunk), sent_idx, surface, label."""
    rows = mentions.select("chunk_id", "source", "page", F.posexplode_outer(_flat(F.col("mentions"))).alias("pos", "m")).where("pos is not null")
    return rows.select("chunk_id", "source", "page", "pos", "m.sent_idx", "m.surface", "m.label")


def relevant(mentions: DataFrame) -> DataFrame:
    """Mentions whose label counts, flat and with normalised names, as the array m of a chunk's row."""
    kept = F.transform("mentions", lambda s: F.filter(s, lambda m: m["label"].isin(*LABELS)))
    verbs = has_verbs(mentions)
    more = lambda m: [m[c].alias(c) for c in ("start", "verb", "verb_start")] if verbs else []
    named = F.transform(_flat(kept, verbs), lambda m: F.struct(m["sent_idx"].alias("sent_idx"), m["at"].alias("at"), m["n"].alias("n"), normalise(m["surface"]).alias("name"), *more(m)))
    return mentions.select("chunk_id", "source", "page", "head", named.alias("m"))


def reject_reason(a: Column, b: Column) -> Column:
    """Why a pair makes no edge, null where it does: empty, then equal but for case, then a trailing hyphen."""
    return F.when((a == "") | (b == ""), "garbage").when(F.lower(a) == F.lower(b), "self_loop").when(a.endswith("-") | b.endswith("-"), "garbage")


def sentence_pairs(mentions: DataFrame) -> DataFrame:
    """All pairs of mentions in a sentence, earlier to later: chunk_id, source, page, head, sent_idx, src, dst, a_pos, b_pos, reason,
    and verb (the first one between the two) where mentions carry verbs.

    A mention is exploded first, then the slice of the row's array that follows it in its sentence, so Spark streams the pairs
    and a row never holds more than its mentions. The outer form keeps Spark from adding a filter that finds all mentions twice more.
    """
    rows = relevant(mentions).select("chunk_id", "source", "page", "head", "m", F.posexplode_outer("m").alias("a_pos", "a")).where("a_pos is not null")
    rows = rows.select("chunk_id", "source", "page", "head", "a", "a_pos", F.posexplode(F.slice("m", F.col("a_pos") + 2, F.col("a.n") - F.col("a.at") - 1)).alias("after", "b"))
    rows = rows.select("chunk_id", "source", "page", "head", "a.sent_idx", F.col("a_pos"), (F.col("a_pos") + F.col("after") + 1).alias("b_pos"), F.col("a.name").alias("src"), F.col("b.name").alias("dst"), *([F.when(F.col("a.verb_start") < F.col("b.start"), F.col("a.verb")).alias("verb")] if has_verbs(mentions) else []))
    return rows.withColumn("reason", reject_reason(F.col("src"), F.col("dst")))


def document_links(mentions: DataFrame) -> DataFrame:
    """Document to entity, once a chunk and name regardless of case, the first spelling: chunk_id, source, page, head, src, dst, pos.

    The row's names are sorted once, and of each run of equal ones the first stays: no pairs, and no array in the exploded rows.
    """
    names = F.sort_array(F.transform("m", lambda a, pos: F.struct(F.lower(a["name"]).alias("low"), pos.alias("pos"), a["name"].alias("dst"))))
    own = relevant(mentions).select("chunk_id", "source", "page", "head", document_node(F.col("source")).alias("src"), names.alias("names"))
    first = F.filter("names", lambda x, i: (i == 0) | (F.element_at("names", F.greatest(i, F.lit(1)))["low"] != x["low"]))
    rows = own.select("chunk_id", "source", "page", "head", "src", F.explode(first).alias("x")).select("chunk_id", "source", "page", "head", "src", "x.dst", "x.pos")
    return rows.where("dst <> '' and not endswith(dst, '-') and lower(dst) <> lower(src)")


def build_edges(mentions: DataFrame, relation: Relation | None = None) -> DataFrame:
    """src, dst, relation, source, page, chunk_text, chunk_id, kind, place_a, place_b: a chunk's pairs first, then its document links.

    (chunk order, kind, place_a, place_b) is the order of insertion. Parallel edges stay. `relation` names a pair's relation from
    its two names and the chunk's head; without it, mentions that carry verbs name it by the first one between the two. Where there is
    none, and by default, it is DEFAULT_RELATION.
    """
    named = F.coalesce("verb", F.lit(DEFAULT_RELATION)) if not relation and has_verbs(mentions) else F.coalesce(relation(F.col("src"), F.col("dst"), F.col("head")), F.lit(DEFAULT_RELATION)) if relation else F.lit(DEFAULT_RELATION)
    pairs = sentence_pairs(mentions).where("reason is null").select("src", "dst", named.alias("relation"), "source", "page", F.col("head").alias("chunk_text"), "chunk_id", F.lit(0).alias("kind"), F.col("a_pos").alias("place_a"), F.col("b_pos").alias("place_b"))
    links = document_links(mentions).select("src", "dst", F.lit(DOCUMENT_RELATION).alias("relation"), "source", "page", F.col("head").alias("chunk_text"), "chunk_id", F.lit(1).alias("kind"), F.col("pos").alias("place_a"), F.lit(0).alias("place_b"))
    return pairs.unionByName(links)


def append_edges(stored: DataFrame, new: DataFrame, dedupe: bool = False) -> DataFrame:
    """Adds edges; a file taken in twice has its edges twice unless dedupe is asked for."""
    if dedupe:
        new = new.join(stored.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return stored.unionByName(new)


def rejections(mentions: DataFrame) -> DataFrame:
    return sentence_pairs(mentions).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def nodes(edges: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Distinct node names: ends of edges, and each document's node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    if chunks is not None:
        ends = ends.unionByName(chunks.select(document_node(F.col("source")).alias("node")).distinct())
    return ends.distinct()


def graph_stats(edges: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """n_nodes, n_edges. Edges are gone through once: each counts a half for either end."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), F.lit(1).alias("n"))
    if chunks is not None:
        ends = ends.unionByName(chunks.select(document_node(F.col("source")).alias("node"), F.lit(0).alias("n")))
    return ends.groupBy("node").agg(F.sum("n").alias("n")).agg(F.count("*").alias("n_nodes"), F.coalesce(F.call_function("div", F.sum("n"), F.lit(2)), F.lit(0)).alias("n_edges"))


def node_index(edges: DataFrame) -> DataFrame:
    """lower-case key -> the spelling whose first edge came last; edges have a running `seq`. Other spellings can't be found by name."""
    ends = edges.select("seq", F.posexplode(F.array("src", "dst")).alias("end", "node"))
    first = ends.groupBy("node").agg(F.min(F.struct("seq", "end")).alias("first"))
    return first.groupBy(F.lower("node").alias("node_key")).agg(F.max_by("node", "first").alias("node"))


def match_entities(named: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, pos, surface) -> query_id, node, start_rank: nodes named in a query, in the order of their first mention."""
    keyed = named.select("query_id", "pos", F.lower(normalise(F.col("surface"))).alias("node_key"))
    found = keyed.join(index, "node_key").groupBy("query_id", "node").agg(F.min("pos").alias("pos"))
    return found.withColumn("start_rank", F.row_number().over(W.partitionBy("query_id").orderBy("pos", "node"))).select("query_id", "node", "start_rank")


def successors(edges: DataFrame, both: bool = False) -> DataFrame:
    """src, dst, succ_rank, back: whom a node leads to, in the order of first edges. both: along edges and against them, ways along first."""
    slim = edges.select("src", "dst", F.lit(False).alias("back"), "seq")
    if both:
        slim = slim.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back"), "seq"))
    firsts = slim.groupBy("src", "dst", "back").agg(F.min("seq").alias("first_seq"))
    return firsts.withColumn("succ_rank", F.row_number().over(W.partitionBy("src").orderBy("back", "first_seq"))).drop("first_seq")


def walk(edges: DataFrame, starts: DataFrame, hops: int, both: bool = False, written: bool | None = None) -> DataFrame:
    """Breadth-first: query_id, start_rank, level, src, dst, back, path, key, fresh, one row for each step from a node that is reached.

    A node keeps the first path that reached it: `key` sorts as the walk went, and `fresh` marks the steps that reached their dst first.
    Beyond two hops (or if `written` says so) successors and every hop's steps go to the shared folder, so each hop's plan is one join and one
    anti-join however many there were, and a lost executor costs one hop. Nodes of very many edges are split by AQE's skew join.
    """
    written = hops > 2 if written is None else written
    spark = edges.sparkSession
    folder = new_folder(spark, "walk") if written else ""
    ranked = successors(edges, both)
    who = ["query_id", "start_rank"]
    start = starts.select(*who, F.col("node").alias("dst"), F.array("node").alias("path"), F.array().cast("array<bigint>").alias("key"))
    if written:
        ranked.write.parquet(f"{folder}/successors")
        ranked = spark.read.schema(ranked.schema).parquet(f"{folder}/successors")
        start.withColumns({"level": F.lit(0), "fresh": F.lit(True)}).write.parquet(f"{folder}/steps/level=0")
    frontier, visited, out = start, start.select(*who, "dst"), None
    for level in range(1, hops + 1):
        step = frontier.select(*who, F.col("dst").alias("at"), "path", "key").join(ranked, F.col("at") == F.col("src"))
        step = step.select(*who, "src", "dst", "back", F.concat("path", F.array("dst")).alias("path"), F.concat("key", F.array(F.col("succ_rank").cast("bigint"))).alias("key"))
        first = step.groupBy(*who, "dst").agg(F.min("key").alias("first_key")).join(visited, [*who, "dst"], "left_anti")
        step = step.join(first, [*who, "dst"], "left").withColumn("fresh", F.coalesce(F.col("key") == F.col("first_key"), F.lit(False))).drop("first_key")
        if written:
            step.write.parquet(f"{folder}/steps/level={level}")
            read = lambda n, schema=step.schema: spark.read.schema(schema).parquet(f"{folder}/steps/level={n}")
            frontier = read(level).where("fresh")
            visited = spark.read.schema(step.schema.add("level", "integer")).parquet(f"{folder}/steps").where("fresh").select(*who, "dst")
            if frontier.isEmpty():
                break
        else:
            frontier, visited = step.where("fresh"), visited.unionByName(step.where("fresh").select(*who, "dst"))
            emitted = step.withColumn("level", F.lit(level))
            out = emitted if out is None else out.unionByName(emitted)
    columns = [*who, "level", "src", "dst", "back", "path", "key", "fresh"]
    if not written:
        return out.select(*columns)
    steps = spark.read.schema(step.schema.add("level", "integer")).parquet(f"{folder}/steps").where("level > 0").select(*columns)
    try:
        return stored(steps, "steps")
    finally:
        remove_folder(spark, folder)


def traverse(edges: DataFrame, starts: DataFrame, hops: int = 2, both: bool = False, written: bool | None = None) -> DataFrame:
    """Every edge whose source is reached within hops - 1, once for each start; both: edges count in either direction.

    starts: query_id, node, start_rank. Returns query_id, start_rank, level, order_key, path (nodes), and the edge's columns.
    order_key sorts as the walk went: level, the order in which nodes joined the frontier, successors in the order of their first edge, parallel
    edges by seq. See walk.
    """
    steps = walk(edges, starts, hops, both, written)
    ends = steps.withColumns({"_from": F.when(F.col("back"), F.col("dst")).otherwise(F.col("src")), "_to": F.when(F.col("back"), F.col("src")).otherwise(F.col("dst"))}).drop("src", "dst")
    own = edges.select("src", "dst", "relation", "source", "page", "chunk_text", "seq")
    met = ends.join(own, (F.col("_from") == F.col("src")) & (F.col("_to") == F.col("dst")))
    return met.select("query_id", "start_rank", "level", F.concat("key", F.array("seq")).alias("order_key"), "path", "src", "dst", "relation", "source", "page", "chunk_text", "seq")


def reached(edges: DataFrame, starts: DataFrame, hops: int, both: bool = False) -> DataFrame:
    """query_id, start_rank, node, level: every node within `hops` of a start, and how far it is; the start itself at 0."""
    steps = walk(edges, starts, hops, both, written=True).where("fresh").select("query_id", "start_rank", F.col("dst").alias("node"), "level")
    return starts.select("query_id", "start_rank", "node", F.lit(0).alias("level")).unionByName(steps)


def ways(edges: DataFrame, both: bool = False) -> DataFrame:
    """The edges as steps: at, to, back, seq, relation, source, page, chunk_text. both: each edge in either direction."""
    rest = ["seq", "relation", "source", "page", "chunk_text"]
    along = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(False).alias("back"), *rest)
    return along.unionByName(edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(True).alias("back"), *rest)) if both else along


def first_pages(steps: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """For each node (at) the first n distinct (source, page, first 50 characters) among its steps: at, to, turn, seq, relation, source, page, chunk_text.

    turn is a struct that sorts a node's successors by their first edge. Steps of other nodes go in the scan; until the few are chosen rows
    carry a hash of the page, and Spark cuts each partition to n rows a node before the shuffle. Only then are texts joined.
    """
    seen = [c for x in ("source", "page") for c in (F.col(x), F.col(x).isNull())] + [F.left("chunk_text", F.lit(50)), F.col("chunk_text").isNull()]
    own = steps.join(nodes, "at", "left_semi").select("at", "to", "back", "seq", F.xxhash64(*seen).alias("place"))
    turns = own.groupBy("at", "to", "back").agg(F.min("seq").alias("first_seq"))
    turned = own.join(turns, ["at", "to", "back"]).withColumn("turn", F.struct("back", "first_seq"))
    once = turned.withColumn("nth", F.row_number().over(W.partitionBy("at", "place").orderBy("turn", "seq"))).where("nth = 1")
    few = once.withColumn("nth", F.row_number().over(W.partitionBy("at").orderBy("turn", "seq"))).where(F.col("nth") <= n).select("at", "to", "back", "seq", "turn", "place")
    whole = steps.withColumn("place", F.xxhash64(*seen)).join(F.broadcast(few), ["at", "to", "back", "seq", "place"])
    return whole.dropDuplicates(["at", "place"]).select("at", "to", "turn", "seq", "relation", "source", "page", "chunk_text")


def graph_retrieve(edges: DataFrame, starts: DataFrame, hops: int = 2, n: int = 5, both: bool = False) -> DataFrame:
    """The first n distinct (source, page, first 50 characters) of each query along the walks of its starts in turn.

    The order is that of traverse, which is not run whole: of a node's edges those of its first n pages are enough, as a walk that has passed
    them has n; and a start that has n pages goes no further, as its later hops come behind them. What a start that goes on leads to
    stands on fewer than n pages, so no frontier grows with the graph. Each hop's hits and frontier are written.
    """
    steps, who, folder = ways(edges, both), ["query_id", "start_rank"], new_folder(edges.sparkSession, "walk")
    kept = lambda df, name: _written(df, f"{folder}/{name}")
    try:
        frontier = kept(starts.select(*who, F.col("node").alias("at"), F.array("node").alias("path"), F.array().cast("array<struct<back:boolean,first_seq:bigint>>").alias("key")), "start")
        visited, hits = frontier.select(*who, "at"), None
        for level in range(1, hops + 1):
            found = first_pages(steps, frontier.select("at").distinct(), n)
            met = frontier.join(found, "at").withColumns({"level": F.lit(level), "path": F.concat("path", F.array("to")), "key": F.concat("key", F.array("turn")), "head": F.left("chunk_text", F.lit(50))}).drop("at", "to", "turn")
            met = kept(met, f"hits-{level}")
            hits = met if hits is None else hits.unionByName(met)
            if level == hops:
                break
            full = hits.select(*who, "source", "page", "head").distinct().groupBy(*who).count().where(F.col("count") >= n)
            on = kept(frontier.join(full, who, "left_anti"), f"open-{level}")
            turns = steps.join(on.select("at").distinct(), "at", "left_semi").groupBy("at", "to", "back").agg(F.min("seq").alias("first_seq"))
            ahead = on.join(turns, "at").select(*who, F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), F.concat("key", F.array(F.struct("back", "first_seq"))).alias("key")).join(visited, [*who, "at"], "left_anti")
            first = F.row_number().over(W.partitionBy(*who, "at").orderBy("key", "path"))
            frontier = kept(ahead.withColumn("nth", first).where("nth = 1").drop("nth"), f"frontier-{level}")
            visited = visited.unionByName(frontier.select(*who, "at"))
            if frontier.isEmpty():
                break
        order = ["start_rank", "level", "key", "seq"]
        once = hits.withColumn("nth", F.row_number().over(W.partitionBy("query_id", "source", "page", "head").orderBy(*order))).where("nth = 1")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
        best = once.withColumn("rank", rank).where(F.col("rank") <= n)
        return stored(best.select("query_id", "rank", "chunk_text", "source", "page", F.array_join("path", " -> ").alias("entity_path"), "relation"), "graph-hits")
    finally:
        remove_folder(edges.sparkSession, folder)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
