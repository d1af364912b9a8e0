"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the block transfers that move the fewest bytes.

The old layout is a folder of files: each shard is cut into blocks by a hash of the document's id, and runs of blocks are its
pieces, a folder of files each. Only the sizes of blocks come to the driver, MAX_BLOCKS at most, whatever the input's size. A flow
from old sizes to new capacities, where staying costs nothing, says how many bytes go from each shard to each other. Blocks are
laid along those flows; a block at a border is cut at a point of its hash range. Then only pieces that lose a block, or a part of
one, are read and written again; the others stay as they are, and the new layout takes their files over.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.common import inner_settings, saved, scratch_path
from scriptorium.log import logger

SHARDS = 16
MAX_BLOCKS = 65_536
LEAST_BLOCKS = 256
BLOCK_BYTES = 64 << 20
#: A piece holds about this many bytes of text; a shard has so many pieces at least, and one for each block at most.
PIECE_BYTES, LEAST_PIECES = 64 << 20, 16
#: Above this relative error whole documents are moved after the plan; at most REPAIR of each shard are looked at.
TOLERANCE = 0.001
REPAIR = 512
_U = 1 << 31


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """{(i, j): amount} that ships all supply to demand (equal sums) at the least cost. Successive shortest paths with potentials."""
    n, m = len(supply), len(demand)
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    source, sink = n + m, n + m + 1
    to: list[int] = []
    capacity: list[int] = []
    price: list[int] = []
    arcs: dict[int, list[int]] = defaultdict(list)

    def arc(u: int, v: int, c: int, p: int) -> None:
        for a, b, x, y in ((u, v, c, p), (v, u, 0, -p)):
            arcs[a].append(len(to))
            to.append(b)
            capacity.append(x)
            price.append(y)

    for i, x in enumerate(supply):
        arc(source, i, x, 0)
    for j, x in enumerate(demand):
        arc(n + j, sink, x, 0)
    between = len(to)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, min(supply[i], demand[j]), cost[i][j])
    potential = [0] * (n + m + 2)
    while True:
        best, via, done = {source: 0}, {}, set()
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            for e in arcs[u]:
                if capacity[e] and (x := d + price[e] + potential[u] - potential[to[e]]) < best.get(to[e], float("inf")):
                    best[to[e]], via[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if sink not in best:
            break
        farthest = max(best.values())
        potential = [p + min(best.get(v, farthest), farthest) for v, p in enumerate(potential)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        amount = min(capacity[e] for e in path)
        for e in path:
            capacity[e] -= amount
            capacity[e ^ 1] += amount
    return {(i, j): moved for i in range(n) for j in range(m) if (moved := capacity[between + 2 * (i * m + j) + 1])}


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _spot(doc_id: Column, alone: Column, place: Column) -> Column:
    """A number in [0, 2**62) that depends on the id alone if no other row has it, else on the row's place in the table too, so many
    rows of one id can be cut apart; its high half picks the block, its low half the place inside."""
    return F.xxhash64(F.lit("reshard"), doc_id.cast("string"), F.when(~alone, place)).bitwiseAND((1 << 62) - 1)


def plan(blocks: dict[tuple[int, int], int], old_sizes: list[int], capacities: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(old shard, block, from, to, new shard): hash ranges [from, to) of each block and where they go. What stays comes first."""
    flow = min_cost_flow(old_sizes, capacities, [[int(i != j) for j in range(len(capacities))] for i in range(len(old_sizes))])
    rows = []
    by_shard: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (shard, block), size in sorted(blocks.items()):
        by_shard[shard].append((block, size))
    for shard, own in by_shard.items():
        legs = sorted(((j != shard, j, x) for (i, j), x in flow.items() if i == shard))
        border, ends = 0, []
        for _, j, x in legs:
            border += x
            ends.append((border, j))
        at, leg = 0, 0
        for block, size in own:
            low = 0
            while leg + 1 < len(ends) and ends[leg][0] <= at + size:
                cut = min(_U, round(_U * (ends[leg][0] - at) / size)) if size else 0
                if cut > low:
                    rows.append((shard, block, low, cut, ends[leg][1]))
                low = max(low, cut)
                leg += 1
            if low < _U:
                rows.append((shard, block, low, _U, ends[leg][1]))
            at += size
    return rows


def _repairs(assigned: DataFrame, sizes: dict[int, int], capacities: list[int]) -> tuple[dict[tuple[int, int], int], dict[int, int]]:
    """({(piece, pos): shard}, {shard: bytes over its capacity after them}): moves of whole documents that even out what cutting blocks
    left over, the largest that fits first. Bounded by REPAIR of each shard, picked by hash, so they are of all sizes."""
    over = {j: sizes.get(j, 0) - c for j, c in enumerate(capacities)}
    order = W.partitionBy("shard").orderBy(F.xxhash64("piece", "pos"), "piece", "pos")
    some = assigned.withColumn("n", F.row_number().over(order)).where(F.col("n") <= REPAIR).collect()
    pool: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for r in some:
        pool[r.shard].append((r.size, r.piece, r.pos))
    for own in pool.values():
        own.sort()
    moves: dict[tuple[int, int], int] = {}
    while True:
        high, low = max(over, key=lambda j: (over[j], -j)), min(over, key=lambda j: (over[j], j))
        room = min(over[high], -over[low])
        own = pool[high]
        fits = next((k for k in range(len(own) - 1, -1, -1) if own[k][0] <= max(room, (over[high] - over[low]) // 2)), None)
        if over[high] <= 0 or fits is None or over[high] - over[low] < 2:
            return moves, over
        size, *row = own.pop(fits)
        moves[tuple(row)] = low
        over[high] -= size
        over[low] += size


@dataclass(frozen=True)
class Layout:
    """Shards in a folder: piece=N/ folders of files with doc_id, text, size, block, at, and pos, the running place in the piece.
    A shard has `pieces` pieces and `per_shard` blocks; piece // pieces is the shard."""

    folder: str
    shards: int
    pieces: int
    per_shard: int


FILES = "doc_id long, text string, size long, block int, at long, pos long, piece int"


def lay_out(docs: DataFrame, old_shard: Column, folder: str, shards: int = SHARDS) -> Layout:
    """Writes docs (doc_id, text, and what old_shard needs) to a folder as they lie before."""
    total = int(docs.agg(F.sum(text_size(F.col("text")))).first()[0] or 0)
    per_shard = max(LEAST_BLOCKS, min(MAX_BLOCKS // shards, total // BLOCK_BYTES // shards))
    pieces = min(per_shard, max(LEAST_PIECES, -(-total // 3 // PIECE_BYTES)))  # a shard may hold a third of all bytes
    layout = Layout(folder, shards, pieces, per_shard)
    rows = docs.select("doc_id", "text", text_size(F.col("text")).alias("size"), old_shard.cast("int").alias("old"), F.monotonically_increasing_id().alias("place"))
    repeated = saved(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("repeated_id")), "repeated")
    alone = F.col("doc_id").isNotNull()
    if not repeated.isEmpty():
        rows, alone = rows.join(repeated, F.col("doc_id") == F.col("repeated_id"), "left"), alone & F.col("repeated_id").isNull()
    rows = rows.withColumn("spot", _spot(F.col("doc_id"), alone, F.col("place")))
    rows = rows.withColumn("block", F.pmod(F.shiftright("spot", 31), F.lit(per_shard)).cast("int")).withColumn("at", F.col("spot").bitwiseAND(_U - 1))
    rows = rows.withColumn("piece", (F.col("old") * pieces + F.floor(F.col("block") * pieces / per_shard)).cast("int"))
    order = W.partitionBy("piece").orderBy("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    own = rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).select("doc_id", "text", "size", "block", "at", "pos", "piece")
    with inner_settings(docs.sparkSession):
        own.write.option("compression", "zstd").partitionBy("piece").parquet(folder)
    return layout


def affected_pieces(layout: Layout, ranges: list[tuple[int, int, int, int, int]]) -> list[int]:
    """The pieces that lose a block or a part of one; only their files are rewritten."""
    return sorted({i * layout.pieces + block * layout.pieces // layout.per_shard for i, block, _, _, j in ranges if i != j})


def reshard(spark: SparkSession, layout: Layout, folder: str, capacities: list[int] | None = None) -> tuple[DataFrame, dict]:
    """Brings a layout to new capacities, equal shares of all bytes by default; rewritten pieces go to a folder of their own.

    Returns (doc_id, text, old_shard, shard, slot, rewritten: whether the row's file is a new one) as read from the files of the new
    layout, and a report: old_sizes, capacities, planned_moved_bytes (the flow's), affected pieces, repairs, and
    uneven, the largest deviation as a share of a capacity; above TOLERANCE it is logged too.
    """
    old = spark.read.schema(FILES).parquet(layout.folder)
    shards, pieces = layout.shards, layout.pieces
    found = old.groupBy("piece", "block").agg(F.sum("size").alias("size")).collect()  # MAX_BLOCKS rows at most
    blocks = {(r.piece // pieces, r.block): r.size for r in found}
    old_sizes = [sum(x for (i, _), x in blocks.items() if i == j) for j in range(shards)]
    total = sum(old_sizes)
    capacities = capacities or [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    ranges = plan(blocks, old_sizes, capacities)
    affected = affected_pieces(layout, ranges)
    planned = sum(max(0, a - b) for a, b in zip(old_sizes, capacities, strict=True))
    moves: dict[tuple[int, int], int] = {}
    over = {j: 0 for j in range(shards)}
    if affected:
        # At most MAX_BLOCKS ranges and one more for each flow: a proven bound for the broadcast.
        table = F.broadcast(spark.createDataFrame(ranges, "p_old int, p_block int, p_from long, p_to long, shard int"))
        here = (F.floor(F.col("piece") / pieces) == F.col("p_old")) & (F.col("block") == F.col("p_block")) & (F.col("at") >= F.col("p_from")) & (F.col("at") < F.col("p_to"))
        wider = 1
        while True:  # once, but for small tables, where the documents of the affected pieces may not do to even out the shards
            placed = old.where(F.col("piece").isin(affected)).join(table, here).select("doc_id", "text", "size", "piece", "pos", "shard")
            light, lost = placed.select("shard", "piece", "pos", "size"), set(affected)
            sizes = {r.shard: r.size for r in light.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
            for (i, block), x in blocks.items():
                if i * pieces + block * pieces // layout.per_shard not in lost:
                    sizes[i] = sizes.get(i, 0) + x
            allowed = TOLERANCE * max(capacities)
            over = {j: sizes.get(j, 0) - c for j, c in enumerate(capacities)}
            if max(map(abs, over.values())) <= allowed:
                break
            moves, over = _repairs(light, sizes, capacities)
            there = {r.piece for r in found} - lost
            more = [p for j, x in over.items() if x > allowed for p in sorted(p for p in there if p // pieces == j)[:wider]]
            wider *= 2
            if max(map(abs, over.values())) <= allowed or not more:
                break
            affected += more
        if moves:
            fixes = F.broadcast(spark.createDataFrame([(*row, j) for row, j in sorted(moves.items())], "piece int, pos long, m_shard int"))  # at most shards * REPAIR rows
            placed = placed.join(fixes, ["piece", "pos"], "left").withColumn("shard", F.coalesce("m_shard", "shard"))
        again = F.row_number().over(W.partitionBy("piece", "shard").orderBy("pos")) - 1
        with inner_settings(spark):
            placed.select("doc_id", "text", "piece", "shard", again.cast("long").alias("pos")).write.option("compression", "zstd").partitionBy("shard", "piece").parquet(folder)
    stays = old.where(~F.col("piece").isin(affected))
    result = stays.select("doc_id", "text", "piece", F.floor(F.col("piece") / pieces).cast("int").alias("shard"), "pos", F.lit(False).alias("rewritten"))
    if affected:
        new = spark.read.schema("doc_id long, text string, pos long, shard int, piece int").parquet(folder)
        result = result.unionByName(new.withColumn("rewritten", F.lit(True)))
    # A row for each piece, and for each shard that a piece went to: MAX_BLOCKS, one more for each flow, and the repairs at most.
    before = W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    counts = result.groupBy("shard", "piece").count()
    offsets = F.broadcast(counts.select("shard", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")))
    slots = result.join(offsets, ["shard", "piece"]).select("doc_id", "text", F.floor(F.col("piece") / pieces).cast("int").alias("old_shard"), "shard", (F.col("first") + F.col("pos")).cast("long").alias("slot"), "rewritten")
    uneven = max(map(abs, over.values())) / max(1, *capacities)
    if uneven > TOLERANCE and max(map(abs, over.values())) > 1:
        logger().warning("shards differ from their capacities by up to %.2f %%", 100 * uneven)
    return slots, {"uneven": uneven, "old_sizes": old_sizes, "capacities": capacities, "planned_moved_bytes": planned, "affected": affected, "repairs": len(moves)}


def reshard_documents(docs: DataFrame, folder: str | None = None, shards: int = SHARDS) -> DataFrame:
    """documents -> doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, rewritten, read back from the files of the new layout.

    The old layout keeps a source together (crc32 of the source modulo the shard count), so a hot source overfills a shard.
    Null text: size 1, crc32 0. Null source: the shard of the empty name. Rows without doc_id, first in their piece, and rows
    that repeat one are placed each for itself, so they can fill several shards. Law `bytes`: sizes near equal, to about a document's size.
    A very long text is moved whole. An empty table gives an empty result. Further columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "shards")
    own = docs.select(F.col("doc_id").cast("long"), "text", "source")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(shards))
    rows, _ = reshard(spark, lay_out(own, old, f"{folder}/old", shards), f"{folder}/new")
    return rows.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "rewritten")
