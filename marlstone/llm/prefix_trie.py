"""The prefix trie of rebuilt conversations, by fingerprints that compose.

A conversation is rebuilt from the first h turns of its base conversation and its own turns after the first h.  A run of
turns has as fingerprint its length and two sums of turn hashes times powers of a base, each modulo a prime; the
fingerprint of two runs one after the other follows from theirs: (s, n) and (t, m) give (s + t * base^n, n + m).  So each
stored conversation gets the fingerprints of its own prefixes once, and any prefix of a rebuilt one is the product of a
base's head and the difference of two of its own; no rebuilt text is ever put together.

Prefixes with the same depth, fingerprint and last turn are one node.  Turns are references: the number of the first row
that holds the very same role and text.  A group is sound if its members agree in that reference and their prefixes one
turn shorter are one group, so by induction all turns agree; if any group is not, everything is done again with another base.

Everything above a conversation's first node of its own belongs to smaller ids, so a node is named by its smallest member and its
depth, each conversation owns one path, and sums over subtrees need no walk: what hangs below a node is the rest of its
own path and the whole paths of its other members.

Cases: turns are ordered by turn (null first), then role, the first 256 code points of the text, and its hash; null role or text is empty; rows without conv_id belong to
no conversation and are left out; a repeated row is a turn more.  The remainder by 100 has the sign of the id.  Numbering
and sums over a conversation go by ranges and blocks, the digest of members by blocks of ids, so neither a conversation nor
a node with a large part of all rows meets in one task.  An empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, ship

ship(__name__)

#: Two primes under 2^31, so products fit a long, and bases to try for them.
PRIMES = (2147483647, 2147483629)
BASES = [(1103515245, 1220703125), (69621, 950706376), (742938285, 1343714438)]
#: Bits of a position within its block, and of an id within its block of members.
BLOCK_BITS, ID_BITS = 10, 12
EMPTY = hashlib.sha256(b"").hexdigest()


def power(exponent: Column, base: int, prime: int) -> Column:
    """base^exponent modulo prime, for exponents under 2^40, from the squares."""
    out, square = F.lit(1).cast("bigint"), base
    for bit in range(40):
        out = out * F.when(exponent.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(square)).otherwise(F.lit(1)) % prime
        square = square * square % prime
    return out


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), role, text, hash: each conversation's turns in order.

    Rows are dealt by ranges of the whole order and numbered there; the counts of earlier ranges are added.
    """
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Ranges are cut by samples, so keys are short; rows that are the same in all columns are told apart by any number.
    rows = rows.withColumns({"begin": F.substring("text", 1, 256), "hash": F.xxhash64("role", "text"), "some": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("turn"), "role", "begin", "hash", "some"]
    dealt = materialise(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns", "zstd")
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("conv_id", "part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before"))
    own = dealt.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    return own.join(before, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("k") - 1).alias("pos"), "role", "text", "hash")


def running(rows: DataFrame, key: str, place: str, sums: dict[str, Column], backwards: bool = False) -> DataFrame:
    """`rows` with running sums over `place` (ascending, or from the end) within `key`: within blocks, and of blocks."""
    blocks = rows.withColumn("_block", F.shiftright(place, BLOCK_BITS))
    order = F.desc if backwards else F.asc
    inner = Window.partitionBy(key, "_block").orderBy(order(place))
    blocks = blocks.withColumns({c: F.sum(x).over(inner) for c, x in sums.items()})
    totals = rows.groupBy(key, F.shiftright(place, BLOCK_BITS).alias("_block")).agg(*(F.sum(x).alias(f"_{c}") for c, x in sums.items()))
    outer = Window.partitionBy(key).orderBy(order("_block"))
    totals = totals.select(key, "_block", *((F.sum(f"_{c}").over(outer) - F.col(f"_{c}")).alias(f"_{c}") for c in sums))
    return blocks.join(totals, [key, "_block"]).withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).drop("_block", *(f"_{c}" for c in sums))


def turn_references(turns: DataFrame) -> DataFrame:
    """conv_id, pos, hash, cps, ref_conv, ref_pos: each turn with its text's code points and the place of the first turn
    with the very same role and text.  Contents are told apart by their bytes; where that leaves one for each hash, turns
    find theirs by the hash alone."""
    contents = turns.groupBy("role", "text", "hash").agg(F.min(F.struct("conv_id", "pos")).alias("first"))
    place = [F.col("first.conv_id").alias("ref_conv"), F.col("first.pos").alias("ref_pos")]
    short = materialise(contents.select("hash", *place), "contents")
    rows = turns.select("conv_id", "pos", "hash", F.length("text").cast("bigint").alias("cps"), "role", "text")
    if short.groupBy("hash").count().filter("count > 1").isEmpty():
        return rows.drop("role", "text").join(short.hint("merge"), "hash")
    return rows.join(contents.select("role", "text", *place), ["role", "text"]).drop("role", "text")


def with_prefixes(turns: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """`turns` with p0, p1: the sums of each conversation's turns up to and with this one, modulo the primes."""
    # Sums of terms under 2^31 fit a long up to 2^32 turns of one conversation.
    terms = {f"p{i}": F.pmod(F.col("hash"), F.lit(p)) * power(F.col("pos"), b, p) % p for i, (b, p) in enumerate(zip(bases, PRIMES, strict=True))}
    summed = running(turns, "conv_id", "pos", terms)
    return summed.withColumns({f"p{i}": F.col(f"p{i}") % p for i, p in enumerate(PRIMES)}).drop("hash")


def rebuilt_prefixes(prefixes: DataFrame, bases: tuple[int, int], heads: int = 6, every: int = 100) -> DataFrame:
    """conv_id, depth, size (turns of the whole), f0, f1, last turn's reference and cps, for each prefix of each rebuilt conversation.

    `heads` bounds h (h = crc32 of the id modulo it), `every` is how many ids share a base.
    """
    sizes = prefixes.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"))
    c = F.col("conv_id")
    asked = sizes.select("conv_id", "n", (c - c % every).alias("base"), (F.crc32(c.cast("string").cast("binary")) % heads).alias("h"))
    bases_n = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    asked = asked.join(bases_n, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0).cast("bigint"))))
    asked = asked.withColumn("size", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    # Heads: turns under `heads` of base conversations; at most `every` conversations have the same base.
    head = prefixes.filter(F.col("pos") < heads - 1).select(F.col("conv_id").alias("base"), "pos", "p0", "p1", "ref_conv", "ref_pos", "cps")
    turned = asked.join(head, "base").filter("pos < k")
    from_base = turned.select("conv_id", (F.col("pos") + 1).alias("depth"), "size", F.col("p0").alias("f0"), F.col("p1").alias("f1"), "ref_conv", "ref_pos", "cps")
    # What stands before the own suffix: the sums of the base's first k turns, and of the own first h.
    ends = prefixes.filter(F.col("pos") < heads - 1).select("conv_id", (F.col("pos") + 1).alias("at"), "p0", "p1")
    zero = F.lit(0).cast("bigint")
    own = asked.filter("n > h").join(ends.select(F.col("conv_id").alias("base"), F.col("at").alias("k"), F.col("p0").alias("b0"), F.col("p1").alias("b1")), ["base", "k"], "left")
    own = own.join(ends.select("conv_id", F.col("at").alias("h"), F.col("p0").alias("o0"), F.col("p1").alias("o1")), ["conv_id", "h"], "left")
    own = materialise(own.select("conv_id", "h", "k", "size", *(F.coalesce(x, zero).alias(x) for x in ("b0", "b1", "o0", "o1"))), "suffixes")
    suffix = prefixes.join(own.hint("merge"), "conv_id").filter("pos >= h")
    made = {}
    for i, (base, prime) in enumerate(zip(bases, PRIMES, strict=True)):
        # The suffix stood h turns in and now stands k turns in, k <= h: divide by base^(h - k).
        inverse = pow(base, -1, prime)
        moved = F.pmod(F.col(f"p{i}") - F.col(f"o{i}"), F.lit(prime)) * power(F.col("h") - F.col("k"), inverse, prime) % prime
        made[f"f{i}"] = (F.col(f"b{i}") + moved) % prime
    from_own = suffix.withColumns(made).select("conv_id", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("depth"), "size", "f0", "f1", "ref_conv", "ref_pos", "cps")
    null = F.lit(None).cast("bigint")
    root = asked.select("conv_id", zero.alias("depth"), "size", zero.alias("f0"), zero.alias("f1"), null.alias("ref_conv"), null.alias("ref_pos"), zero.alias("cps"))
    return root.union(from_base).union(from_own)


KEY = ["depth", "f0", "f1", "ref_conv", "ref_pos"]


def group_prefixes(rebuilt: DataFrame) -> DataFrame:
    """`rebuilt` with node (the smallest conv_id of its group) and n_convs.  The root, one group of all, is no join's key;
    groups are stored, so that the join with a large one can be split."""
    rebuilt = materialise(rebuilt, "rebuilt")
    below = rebuilt.filter("depth > 0")
    groups = materialise(below.groupBy(*KEY).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs")), "groups")
    found = below.join(groups.hint("merge"), KEY)
    whole = rebuilt.filter("depth = 0").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"))
    top = rebuilt.filter("depth = 0").join(F.broadcast(whole))  # one row
    columns = ["conv_id", "depth", "size", "node", "n_convs", "cps"]
    return found.select(*columns).union(top.select(*columns))


def unsound(grouped: DataFrame) -> DataFrame:
    """Groups whose members' shorter prefixes are not all in one group.  (Their last turns are the same by the key.)"""
    parents = grouped.filter("depth > 0").select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("node").alias("child"))
    pairs = parents.join(grouped.select("conv_id", "depth", "node"), ["conv_id", "depth"])
    told = pairs.groupBy("child", "depth").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    return told.filter("a <> b")


def ends_digests(grouped: DataFrame) -> DataFrame:
    """node, depth, ends_sha256: of the ids of the conversations that end at each node, ascending.

    Ids are gathered by blocks of 2^ID_BITS numbers, which bounds a row; a node's blocks then go through its digest in order.
    """
    ends = grouped.filter("depth = size")
    blocks = ends.groupBy("node", "depth", F.shiftright("conv_id", ID_BITS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches):
        key, sha = None, None
        for batch in itertools.chain(batches, [None]):
            out: list[tuple] = []
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True) if batch is not None else [(None, None, None)]
            for node, depth, ids in rows:
                if key != (node, depth):
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = ((node, depth), hashlib.sha256()) if node is not None else (None, None)
                elif sha is not None:
                    sha.update(b",")
                if sha is not None:
                    sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["node", "depth", "ends_sha256"])

    return blocks.repartition("node", "depth").sortWithinPartitions("node", "depth", "block").mapInArrow(digest, "node bigint, depth bigint, ends_sha256 string")


def trie(grouped: DataFrame) -> DataFrame:
    """One row for each node, with its counts and the sums over its subtree."""
    mine = F.col("node") == F.col("conv_id")
    paths = materialise(grouped.groupBy("conv_id").agg(F.min(F.when(mine, F.col("depth"))).alias("top"), F.first("size").alias("size")), "paths")
    nodes = grouped.filter(mine).select("conv_id", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("cps")).alias("saves"))
    # Where a path leaves another one: the prefix above its first own node.
    leaves_at = grouped.join(paths.filter("top > 0").select("conv_id", (F.col("top") - 1).alias("depth")), ["conv_id", "depth"]).select("conv_id", "depth", F.col("node").alias("parent"))
    branches = leaves_at.groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("branches"))
    nodes = running(nodes, "conv_id", "depth", {"below": F.col("saves")}, backwards=True)
    nodes = nodes.join(paths.select("conv_id", "top", "size"), "conv_id").join(branches, ["conv_id", "depth"], "left")
    zero = F.lit(0).cast("bigint")
    nodes = nodes.withColumn("n_children", F.coalesce("branches", zero) + (F.col("depth") < F.col("size")).cast("bigint"))
    nodes = materialise(nodes.drop("branches", "saves"), "nodes")
    # A path's whole: what it saves, and whether its end is a leaf.
    whole = nodes.filter("depth = top").select("conv_id", F.col("below").alias("saves"))
    whole = materialise(whole.join(nodes.filter("depth = size").select("conv_id", (F.col("n_children") == 0).cast("bigint").alias("leaf")), "conv_id"), "whole-paths")
    others = grouped.filter(~mine).join(whole, "conv_id").groupBy(F.col("node").alias("conv_id"), "depth").agg(F.sum("leaf").alias("more_leaves"), F.sum("saves").alias("more_saves"))
    out = nodes.join(whole.select("conv_id", "leaf"), "conv_id").join(others, ["conv_id", "depth"], "left")
    out = out.join(leaves_at.select("conv_id", (F.col("depth") + 1).alias("depth"), "parent"), ["conv_id", "depth"], "left")
    out = out.join(ends_digests(grouped).withColumnRenamed("node", "conv_id"), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (F.col("leaf") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
        (F.col("below") + F.coalesce("more_saves", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, heads: int = 6, every: int = 100) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    turns = materialise(turn_references(numbered(conversations)), "references")
    for bases in BASES:
        prefixes = materialise(with_prefixes(turns, bases), "prefixes")
        grouped = materialise(group_prefixes(rebuilt_prefixes(prefixes, bases, heads, every)), "grouped")
        if unsound(grouped).isEmpty():
            return trie(grouped)
    raise RuntimeError("fingerprints collide for every base")


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
