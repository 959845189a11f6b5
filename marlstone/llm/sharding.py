"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 16 places or more for each virtual node, and 2**RING_BITS at least; of nodes at one place the one with the lower
hash stays.  Each shard owns the arcs that end at its virtual nodes; a row belongs to the arc in which the hash of its key
lies.  Loads are bounded: a shard takes at most its share of the rows (times 1 + headroom), and
what a full shard can't take continues clockwise to the owner of the next arc.  With no headroom the shares add up to
the number of rows, so all shards end up full and their counts differ by one at most.

Spark counts the rows of each cell, which is an arc and one of SPLITS parts of its rows, so a key that holds a third of
all rows is spread over as many tasks.  The cells are shards * VIRTUAL_NODES * SPLITS at most whatever the data, so
their running counts are broadcast.  From the counts of the arcs, of which there are shards * VIRTUAL_NODES at most, the
driver works out which ranks of an arc go to which shard.  Rows get their rank in the cell by a window, add what lies
before the cell, and find their shard by a broadcast of those few ranges.

Cases: a null or empty text has size 1; a null key hashes to one place like any key; repeated rows are dealt out like
different ones; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

#: The least size of the ring, enough for 64 shards.
RING_BITS = 16
SPLITS = 16
VIRTUAL_NODES = 64


def ring_bits(shards: int, nodes: int = VIRTUAL_NODES) -> int:
    return max(RING_BITS, (16 * shards * nodes - 1).bit_length())


def ring(shards: int, nodes: int = VIRTUAL_NODES, bits: int | None = None) -> list[int]:
    """The owner of each place: the shard whose virtual node is the next clockwise, the place itself included."""
    bits = bits or ring_bits(shards, nodes)
    at: dict[int, tuple[bytes, int]] = {}
    for s in range(shards):
        for v in range(nodes):
            h = hashlib.sha256(f"{s}/{v}".encode()).digest()
            place = int.from_bytes(h[:8], "big") >> (64 - bits)
            at[place] = min((h[8:], s), at.get(place, (h[8:], s)))
    owners, owner = [0] * (1 << bits), at[min(at)][1]
    for place in reversed(range(1 << bits)):
        owner = at[place][1] if place in at else owner
        owners[place] = owner
    return owners


def arcs_of(owners: list[int]) -> list[tuple[int, int, int]]:
    """(first place, end, owner) of each run of places with one owner, in ring order."""
    out: list[tuple[int, int, int]] = []
    for place, owner in enumerate(owners):
        if out and out[-1][2] == owner:
            out[-1] = (out[-1][0], place + 1, owner)
        else:
            out.append((place, place + 1, owner))
    return out


def capacities(rows: int, shards: int, headroom: float = 0.0) -> list[int]:
    if headroom > 0:
        return [-int(-(1 + headroom) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def flows(demand: list[int], owners: list[int], room: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc the (shard, rows) to which its rows go: its owner first, then the owners clockwise that have room."""
    room, left, out = [*room], [*demand], [[] for _ in demand]
    waiting = [i for i, d in enumerate(left) if d]
    for step in range(len(owners)):
        still = []
        for i in waiting:
            s = owners[(i + step) % len(owners)]
            take = min(left[i], room[s])
            if take:
                out[i].append((s, take))
                left[i] -= take
                room[s] -= take
            if left[i]:
                still.append(i)
        waiting = still
        if not waiting:
            break
    if waiting:
        raise ValueError("the shards have less room than there are rows")
    return out


def ranges(demand: list[int], arcs: list[tuple[int, int, int]], shards: int, headroom: float = 0.0) -> list[tuple[int, int, int, int, int, int]]:
    """(arc, first rank, end, shard, slot of the first rank, home shard): which ranks of each arc go where."""
    dealt = flows(demand, [o for *_, o in arcs], capacities(sum(demand), shards, headroom))
    slot, out = [0] * shards, []
    for arc, ((_, _, home), going) in enumerate(zip(arcs, dealt, strict=True)):
        rank = 0
        for s, n in going:
            out.append((arc, rank, rank + n, s, slot[s], home))
            slot[s] += n
            rank += n
    return out


def assign_shards(docs: DataFrame, shards: int = 16, headroom: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless in the shard), home_shard (where the ring alone would put it)."""
    spark, text = docs.sparkSession, text_or_empty(text_col)
    arcs = arcs_of(ring(shards))
    arc_of = [k for k, (a, b, _) in enumerate(arcs) for _ in range(a, b)]
    keyed = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("uid"))
    keyed = materialise(keyed, "shard-keys")  # from here on the uid of a row is fixed
    hashed = F.xxhash64("doc_id")
    place = F.shiftrightunsigned(hashed, 64 - ring_bits(shards)).cast("int")
    arc = F.element_at(F.split(F.lit(",".join(map(str, arc_of))), ",").cast("array<int>"), place + 1)
    cell = keyed.withColumns({"arc": arc, "split": F.pmod(F.xxhash64("uid"), F.lit(SPLITS)).cast("int"), "hash": hashed})
    # At most arcs * SPLITS cells, each with the rows of its arc that come before it.
    cells = materialise(cell.groupBy("arc", "split").count(), "ring-cells")
    before = cells.select("arc", "split", (F.sum("count").over(Window.partitionBy("arc").orderBy("split")) - F.col("count")).alias("before"))
    demand = {r["arc"]: r["n"] for r in cells.groupBy("arc").agg(F.sum("count").alias("n")).collect()}
    rows = ranges([demand.get(k, 0) for k in range(len(arcs))], arcs, shards, headroom) or [(-1, 0, 0, 0, 0, 0)]
    found = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t(of_arc, first, end, shard, first_slot, home_shard)")
    ranked = cell.withColumn("rank", F.row_number().over(Window.partitionBy("arc", "split").orderBy("hash", "uid")) - 1)
    placed = ranked.join(F.broadcast(before), ["arc", "split"]).withColumn("rank", F.col("rank") + F.col("before"))
    joined = placed.join(F.broadcast(found), (F.col("arc") == F.col("of_arc")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("first")).alias("slot"), "home_shard")


def op2_bounded_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
