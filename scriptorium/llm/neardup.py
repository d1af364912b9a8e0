"""Near-duplicate vectors through a robust-pruned flat graph.

Vectors go to the shards of their nearest centres, so shards overlap. Each shard is built into a flat graph (see vamana) and asked for the
neighbours of the vectors that are at home in it: a beam from the medoids, then range expansion; what is found is verified by its
exact cosine. The shards' adjacency lists are united: a vector that lies in several shards has the neighbours of all. Where such a neighbour
is near enough to matter and unknown to a shard, it becomes a guest there and that shard is searched again, so a group that centres
cut apart is walked through as one. Recall is audited against brute force, and more overlap is taken where it is too low.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from scriptorium.llm import vamana
from scriptorium.llm.common import columns_only, longs, release_heap, saved, scratch
from scriptorium.llm.components import connected_components, join_groups
from scriptorium.log import logger

LEAST_COSINE = 0.98
#: Distinct vectors of a shard, about; a label's centres are as many as this asks for, and all labels' together at most MOST_CENTRES.
SHARD, MOST_CENTRES = 1024, 16_384
#: The sample that centres are fitted on: so many vectors a centre, and so many bytes at most. Centres have so many bytes at most.
SAMPLES, SAMPLE_BYTES, CENTRE_BYTES = 4, 32 << 20, 16 << 20
FITTING_STEPS = 4
#: Centres within so many times the reach of one another become one, so a dense group isn't cut up, as long as no more than this many do.
APART, MERGED = 3.0, 8
#: Shards a vector lies in; the next number is taken where the audited recall is below LEAST_RECALL.
OVERLAPS, LEAST_RECALL = (2, 4, 8), 0.97
#: How often neighbours become guests of shards that don't know them.
GUEST_ROUNDS = 3
#: Vectors whose neighbours are counted by brute force.
AUDITED = 512

NODE = "node long, space string, copies long, v binary"
FOUND = "kind int, a long, b long, cell int, space string"


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one width as rows of length 1."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _pack(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, space, v): v null where a vector links with nothing. Components are scaled by a power of two, which is exact, so squares fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).cast(pa.list_(pa.float64()))
            flat, off = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
            there = column.is_valid().to_numpy(zero_copy_only=False)
            out: list[bytes | None] = []
            for i, label in enumerate(batch.column(1).to_pylist()):
                x = flat[off[i] : off[i + 1]] if there[i] and label is not None else flat[:0]
                top = np.abs(x).max(initial=0.0)
                if top > 0 and np.isfinite(top):
                    if not 1e-15 < top < 1e15:
                        x = np.ldexp(x, -int(np.frexp(top)[1]))
                    out.append(x.astype(kind).tobytes())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["vec_id", "space", "v"])

    return run


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(rows: vec_id, digest; nodes: digest, node, space, copies, least_id, v; kind of the packed numbers). Equal vectors of a label are one node."""
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("space"), F.col("embedding"))
    packed = own.mapInArrow(_pack(kind), "vec_id long, space string, v binary")
    takes_part = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    space = F.concat(F.length("v").cast("string"), F.lit("/"), "space").alias("space")
    key = F.when(takes_part, F.unhex(F.md5(F.concat("v", F.encode(space, "UTF-8"))))).alias("digest")
    rows = saved(packed.select("vec_id", key, space, "v"), "packed")
    nodes = rows.where("digest is not null").groupBy("digest").agg(F.first("space").alias("space"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    nodes = saved(nodes.select("digest", F.monotonically_increasing_id().alias("node"), "space", "copies", "least_id", "v"), "nodes")
    return rows.select("vec_id", "digest"), nodes, kind


def fit_centres(nodes: DataFrame, kind: str, shard: int = SHARD, least: float = LEAST_COSINE) -> dict[str, np.ndarray]:
    """Centres of each space with more vectors than a shard holds, by k-means steps over a sample of bounded size."""
    sizes = nodes.groupBy("space").agg(F.count("*").alias("n"), F.max(F.length("v")).alias("width"))
    large = sizes.where(F.col("n") > shard).orderBy(F.desc("n"), "space").limit(MOST_CENTRES // 2).collect()
    if not large:
        return {}
    wide = max(r.width for r in large)
    asked = sum(-(-r.n // shard) for r in large)
    most = min(MOST_CENTRES, CENTRE_BYTES // (2 * wide)) or 1
    share = min(1.0, most / asked)
    count = {r.space: max(2, int(-(-r.n // shard) * share)) for r in large}
    each = max(1.0, min(SAMPLES, SAMPLE_BYTES / wide / sum(count.values())))
    rates = nodes.sparkSession.createDataFrame([(r.space, min(1.0, each * count[r.space] / r.n)) for r in large], "space string, rate double")
    drawn = F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample: dict[str, list] = {}
    for r in nodes.join(F.broadcast(rates), "space").where(drawn < F.col("rate")).select("space", "digest", "v").collect():
        sample.setdefault(r.space, []).append((bytes(r.digest), bytes(r.v)))
    return {space: _merged(_means(unit_rows([v for _, v in sorted(found)], kind), count[space]), APART * reach_of(least)) for space, found in sample.items()}


def reach_of(least: float) -> float:
    """The distance of vectors of length 1 that have this cosine."""
    return float(np.sqrt(2 - 2 * least))


def _merged(centres: np.ndarray, apart: float) -> np.ndarray:
    kept, weight, n = centres.copy(), np.ones(len(centres), np.int64), 1
    for c in centres[1:]:
        near = (vamana.distances(kept[:n], c[None])[:, 0] < apart) & (weight[:n] < MERGED)
        if near.any():
            weight[near.argmax()] += 1
        else:
            kept[n] = c
            n += 1
    return kept[:n]


def _means(x: np.ndarray, k: int) -> np.ndarray:
    centres = x[:k].copy()
    for _ in range(FITTING_STEPS):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(1))
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return centres


def _assign(centres: dict[str, np.ndarray], overlap: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each vector to the `overlap` nearest centres of its space; the nearest is its home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces, raw = np.array(batch.column(1).to_pylist(), object), batch.column(3).to_pylist()
            rows, cells, home = [], [], []
            for space in dict.fromkeys(spaces.tolist()):
                own = np.flatnonzero(spaces == space)
                have = centres.get(space)
                if have is None:
                    rows += own.tolist()
                    cells += [0] * len(own)
                    home += [True] * len(own)
                    continue
                near = np.argsort(-(unit_rows([raw[i] for i in own], kind) @ have.T), axis=1, kind="stable")[:, :overlap]
                rows += np.repeat(own, near.shape[1]).tolist()
                cells += near.ravel().tolist()
                home += np.tile(np.arange(near.shape[1]) == 0, len(own)).tolist()
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells, pa.int32()), pa.array(home, pa.bool_())], names=["node", "space", "copies", "v", "cell", "home"])

    return run


def _search(least: float, kind: str) -> Callable[[pa.Table], pa.Table]:
    """One shard: builds its graph and searches it. kind 0: a pair a < b that is linked, both at home here; 1: one that is a guest;
    2: an edge a -> b of the graph that is short enough to lead to a link elsewhere."""
    reach = reach_of(least)

    def run(table: pa.Table) -> pa.Table:
        # of a vector that came several ways the row at home counts
        order = np.lexsort((~table.column("home").to_numpy(zero_copy_only=False), table.column("node").to_numpy()))
        node = table.column("node").to_numpy()[order]
        order = order[np.append(True, node[1:] != node[:-1])]
        node, home = table.column("node").to_numpy()[order], table.column("home").to_numpy(zero_copy_only=False)[order]
        raw = table.column("v").take(pa.array(order)).to_pylist()
        x = unit_rows(raw, kind)
        graph, starts = vamana.build(x)
        out_a, out_b, out_kind = [], [], []
        for a, b, _ in vamana.range_search(x, graph, starts, np.flatnonzero(home), reach + 1e-3):
            exact = _cosines(raw, kind, a, b)
            a, b = a[exact >= least], b[exact >= least]
            out_a.append(node[a])
            out_b.append(node[b])
            out_kind.append(np.where(home[b], 0, 1))
        a, b, what = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (out_a, out_b, out_kind))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), what], 1), axis=0) if len(a) else np.zeros((0, 3), np.int64)
        from_, place = np.nonzero(graph >= 0)
        to = graph[from_, place]
        short = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nd->n", x[from_], x[to]), 0)) <= 2 * reach
        edges = np.stack([node[from_[short]], node[to[short]]], 1)
        cell, space = table.column("cell")[0].as_py(), table.column("space")[0].as_py()
        n, m = len(pairs), len(edges)
        release_heap()
        return pa.table(
            {
                "kind": pa.array(np.concatenate([pairs[:, 2], np.full(m, 2)]).astype(np.int32)),
                "a": pa.array(np.concatenate([pairs[:, 0], edges[:, 0]])),
                "b": pa.array(np.concatenate([pairs[:, 1], edges[:, 1]])),
                "cell": pa.array([cell] * (n + m), pa.int32()),
                "space": pa.array([space] * (n + m), pa.string()),
            }
        )

    return run


def _cosines(raw: list[bytes], kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In double precision, from the numbers as they were given."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    length = np.sqrt(np.einsum("nd,nd->n", x, x))
    out = np.empty(len(a))
    for i in range(0, len(a), 65_536):
        p, q = a[i : i + 65_536], b[i : i + 65_536]
        out[i : i + 65_536] = np.einsum("nd,nd->n", x[p], x[q]) / (length[p] * length[q])
    return out


def graph_links(nodes: DataFrame, kind: str, least: float, overlap: int, centres: dict[str, np.ndarray]) -> DataFrame:
    """(a, b): linked pairs of nodes, a < b, each once."""
    own = nodes.select("node", "space", "copies", "v")
    members = saved(own.mapInArrow(_assign(centres, overlap, kind), f"{NODE}, cell int, home boolean").select("node", "space", "cell", "home"), "members")
    links, again = None, None
    for round_ in range(1 + GUEST_ROUNDS):
        shard_rows = members if again is None else members.join(again, ["space", "cell"], "left_semi")
        filled = shard_rows.join(own.select("node", "v"), "node")
        found = saved(filled.groupBy("space", "cell").applyInArrow(_search(least, kind), FOUND), "found")
        new = found.where("kind < 2").select("a", "b")
        links = new if links is None else links.unionByName(new)
        if not centres or round_ == GUEST_ROUNDS:
            break
        # united adjacency: a's neighbours in one shard are news to the other shards that a lies in
        edges = found.where("kind = 2").select("a", "b").distinct()
        news = edges.join(members.select(F.col("node").alias("a"), "space", "cell"), "a").select(F.col("b").alias("node"), "space", "cell").distinct()
        guests = saved(news.join(members.select("node", "space", "cell"), ["node", "space", "cell"], "left_anti").withColumn("home", F.lit(False)), "guests")
        if guests.isEmpty():
            break
        again = guests.select("space", "cell").distinct()
        members = members.unionByName(guests.select("node", "space", "cell", "home"))
    return saved(links.distinct(), "links")


def audit_recall(nodes: DataFrame, links: DataFrame, kind: str, least: float = LEAST_COSINE, count: int = AUDITED) -> tuple[int, int]:
    """(links of `count` nodes by brute force over all nodes of their label, those of them that are among `links`)."""
    asked = nodes.orderBy(F.xxhash64("digest"), "node").limit(count).select("node", "space", "v").collect()
    by_space: dict[str, tuple[list[int], np.ndarray]] = {}
    for space in {r.space for r in asked}:
        own = [r for r in asked if r.space == space]
        by_space[space] = [r.node for r in own], unit_rows([bytes(r.v) for r in own], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces, raw, node = np.array(batch.column(1).to_pylist(), object), batch.column(2).to_pylist(), longs(batch, "node")
            for space in set(spaces.tolist()) & set(by_space):
                own = np.flatnonzero(spaces == space)
                names, q = by_space[space]
                near, which = np.nonzero(unit_rows([raw[i] for i in own], kind) @ q.T >= least)
                a, b = node[own[near]], np.array(names, np.int64)[which]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[a != b]), pa.array(np.maximum(a, b)[a != b])], names=["a", "b"])

    true = nodes.select("node", "space", "v").mapInArrow(run, "a long, b long").distinct().withColumn("true", F.lit(1))
    row = true.join(links.withColumn("found", F.lit(1)), ["a", "b"], "left").agg(F.coalesce(F.sum("true"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, shard: int = SHARD) -> DataFrame:
    """embeddings (vec_id, embedding, label) -> vec_id, n_links, component_id, kept: one row for each row.

    Rows are linked where their labels are equal and their cosine is `least` or more. Vectors that are null, empty, zero or hold a null or
    non-finite component, and rows without label or vec_id, link with nothing: they have no links, are their own component and are kept (without
    a vec_id component_id is null). Vectors of unequal length are not linked. Rows that repeat a vec_id are each a vector. Equal
    vectors of a label are one node of the graph with a count, so copies are never expanded into pairs. Ties can't arise. An empty table
    gives an empty result. Further columns, whatever their names, are not read.
    """
    with scratch(vectors.sparkSession) as kept:
        return saved(_near_duplicates(columns_only(vectors, "vec_id", "embedding", "label"), least, shard), "near-duplicates", keep=kept)


def _near_duplicates(vectors: DataFrame, least: float, shard: int) -> DataFrame:
    rows, nodes, kind = distinct_vectors(vectors)
    centres = fit_centres(nodes, kind, shard, least)
    for overlap in OVERLAPS:
        links = graph_links(nodes, kind, least, overlap, centres)
        true, found = audit_recall(nodes, links, kind, least)
        logger().info("overlap %d: %d of %d audited links found", overlap, found, true)
        if not centres or found >= LEAST_RECALL * true:
            break
    slim = nodes.select("digest", "node", "copies", "least_id")
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    counted = ends.join(slim.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("others"))
    members = saved(connected_components(links).select(F.col("doc_id").alias("node"), "component"), "components")
    joined = slim.join(counted, "node", "left").join(members, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = saved(joined.select("digest", "component", "least_id", F.col("copies").alias("size"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "linked")
    firsts = saved(joined.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("size")), "firsts")
    whole = saved(join_groups(joined.drop("size"), firsts, ["component"], joined.count()).select("digest", "component_id", "n_links"), "whole")
    sized = saved(whole.join(nodes.select("digest", F.col("copies").alias("size")), "digest"), "sized")
    linked = join_groups(rows.where("digest is not null"), sized, ["digest"], rows.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
