"""Near copies by exact Jaccard similarity of word shingles, nominated by fingerprints and by shared minima.

SimHash alone can't find them all: at a similarity of 0.8 two 64-bit fingerprints differ in some ten bits, and no index of
byte positions is complete at that radius.  So two indexes nominate pairs, and every nominated pair is verified on its
whole texts:

* the byte-position index of `simhash.links`, which misses no pair of fingerprints at three bits or fewer;
* shared minima: BANDS keys for each text, each made of MINIMA minima of its shingle hashes under different
  permutations.  Two texts at 0.8 share a key with a chance of 1 - (1 - 0.8**4)**12 = 0.998, whatever the number of texts,
  and texts that have only a passage in common hardly ever do.

A list of texts that share a key is never expanded into pairs.  First it becomes a minimum spanning forest by the distance of
fingerprints (`nearest_forest`), whose links are verified.  Links that fail leave texts apart that another pair could join, so
the lists that still have several components are gone through once more, with the shingles of their texts beside them
(`joined_within`): each text is tried with its partners in other components, the likeliest first, and what joins is one component at
once, so partners that it brings along are not tried.  Only the links that join come out, fewer than a list has texts.
Partners are told by sketches, a byte of each minimum: two texts at 0.8 agree in 38 of 48 bytes on average, and those that
agree in fewer than LEAST_ALIKE, which happens to some five such pairs in 100,000, are not tried.  Lists whose texts are all
in one component are done, and a pair that shares several keys is tried under the first.

A list longer than LONG_LIST is dealt into parts, and each part is compared with each: no pair of a list is left out,
however long it is, and no task holds more than two parts.

Equal texts are one node from the start.  Cases: as in `simhash`; texts without words are alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, materialise, ship, text_or_empty
from .components import components
from .simhash import links, shingle_hashes, simhash_of

ship(__name__)

BANDS, MINIMA = 12, 4
#: Links of the first forests differ in so many bits at most; what they leave out `joined_within` finds.
FAR = 24
LONG_LIST = 4096
LEAST_ALIKE = 27


def multipliers(n: int = BANDS * MINIMA) -> np.ndarray:
    """Odd numbers; multiplied by them, hashes come in as many different orders."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def band_keys(hashes: np.ndarray, times: np.ndarray) -> tuple[list[int], bytes]:
    """BANDS signed 64-bit keys of a set of shingle hashes, and a byte of each minimum."""
    import xxhash

    least = np.array([(hashes * m).min() for m in times]) if len(hashes) else np.zeros(len(times), np.uint64)
    raw = least.astype("<u8").tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * MINIMA * b : 8 * MINIMA * (b + 1)], b) - (1 << 63) for b in range(BANDS)], raw[::8]


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, node (MD5 of the text), fp, the keys and the sketch of every row."""

    def made(batches):
        times = multipliers()
        for batch in batches:
            fps, keys, bytes_of = [], [], []
            for text in batches_of(["text"], batch)[0]:
                hashes = np.unique(shingle_hashes(text, size))
                fps.append(simhash_of(hashes))
                own, sketch = band_keys(hashes, times)
                keys.append(own)
                bytes_of.append(sketch)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_hash", "node")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_of, pa.binary())], ["doc_id", "text_hash", "node", "fp", "keys", "sketch"])

    text = text_or_empty(text_col)
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    return given.mapInArrow(made, "doc_id bigint, text_hash bigint, node binary, fp bigint, keys array<bigint>, sketch binary")


def nearest_forest(fps: np.ndarray, far: int = FAR) -> list[tuple[int, int]]:
    """(parent, child) of a minimum spanning forest by differing bits, without links over `far`.

    Nodes join in the order of their distance to what has joined, each by its nearest node there (Prim's algorithm).
    """
    near = np.bitwise_count(fps ^ fps[0])
    parent, waiting, out = np.zeros(len(fps), np.int64), np.ones(len(fps), bool), []
    waiting[0] = False
    for _ in range(len(fps) - 1):
        x = int(np.where(waiting, near, 255).argmin())
        if near[x] <= far:
            out.append((int(parent[x]), x))
        waiting[x] = False
        d = np.bitwise_count(fps ^ fps[x])
        closer = d < near
        near = np.where(closer, d, near)
        parent[closer] = x
    return out


def _forests(batches):
    """Links a, b from lists of members sorted by node."""
    for batch in batches:
        a, b = [], []
        for members in batches_of(["members"], batch)[0]:
            nodes, fps = [m["node"] for m in members], np.array([m["fp"] for m in members], np.int64)
            for p, x in nearest_forest(fps.view(np.uint64)):
                a.append(nodes[p])
                b.append(nodes[x])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _forests_of(posted: DataFrame) -> DataFrame:
    """Links within the parts of the lists of `posted`."""
    lists = posted.groupBy("key", "part").agg(F.sort_array(F.collect_set(F.struct("node", "fp"))).alias("members"))
    return lists.filter("size(members) > 1").select("members").mapInArrow(_forests, "a binary, b binary")


def nominated(nodes: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """key, node, fp, keys, sketch, part, parts of `nodes` that share a key with another; parts hold some `long_list` nodes."""
    posted = nodes.select(F.explode("keys").alias("key"), "node", "fp", "keys", "sketch")
    counts = materialise(posted.groupBy("key").count().filter("count > 1"), "key-counts")
    parts = F.ceil(F.col("count") / long_list).cast("int")
    told = posted.join(counts, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    return materialise(told.drop("count"), "posted")


def likeliest(sketches: np.ndarray, roots: np.ndarray, sides: np.ndarray, crossing: bool, most: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs (i, j) of members of different roots: for each member outside the largest component the `most` partners whose
    sketches agree best, in the other part if `crossing`; and whether some member has more.

    Of two members of different components one at least is outside the largest, so no pair is left out, and in a list that
    one component has nearly all of only the few at its rim look for partners."""
    out, more = set(), False
    counts = np.bincount(roots)
    for i in np.flatnonzero(roots != counts.argmax()).tolist():
        agree = (sketches == sketches[i]).sum(axis=1)
        agree[(roots == roots[i]) | (sides == sides[i] if crossing else False)] = 0
        found = np.flatnonzero(agree >= LEAST_ALIKE)
        if len(found) > most:
            more = True
            found = found[np.argpartition(-agree[found], most - 1)[:most]]
        out |= {(min(i, int(j)), max(i, int(j))) for j in found}
    return sorted(out), more


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of shingle hashes (sorted, each once) are as similar as that; empty ones are alike."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def joined_within(key: int, keys: np.ndarray, sketches: np.ndarray, roots: np.ndarray, sides: np.ndarray, crossing: bool, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of members of one list that join its components, as far as pairs of that similarity do.

    Every pair of different components that agrees enough is tried, or has been joined by others meanwhile."""
    links, parent = [], list(range(int(roots.max()) + 1))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def tried(i: int, j: int) -> bool:
        a, b = find(int(roots[i])), find(int(roots[j]))
        if a == b or not alike(sets[i], sets[j], similarity):
            return False
        parent[max(a, b)] = min(a, b)
        links.append((i, j))
        return True

    for i, j in likeliest(sketches, roots, sides, crossing, 1)[0]:
        tried(i, j)
    now = lambda: np.array([find(x) for x in range(len(parent))])[roots]
    own = now()
    # One of two members of different components is outside the largest.
    outside = own != np.bincount(own).argmax()
    place = keys == key
    for i in np.flatnonzero(outside).tolist():
        shared = keys == keys[i]
        worth = (own != own[i]) & (place & shared).any(axis=1) & (shared.argmax(axis=1) == place[i].argmax())
        worth[:i] &= ~outside[:i]  # those have tried this one
        if crossing:
            worth &= sides != sides[i]
        near = np.flatnonzero(worth)
        agree = (sketches[near] == sketches[i]).sum(axis=1)
        near, agree = near[agree >= LEAST_ALIKE], agree[agree >= LEAST_ALIKE]
        if any([tried(i, j) for j in near[np.argsort(-agree, kind="stable")].tolist()]):
            own = now()
    return links


def further_links(posted: DataFrame, roots: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that join components (`roots`: node, root; others are their own) within each list."""

    def joined(group: tuple, rows: list[dict]) -> list[tuple[bytes, bytes]]:
        numbers: dict[bytes, int] = {}
        own = np.array([numbers.setdefault(r["root"], len(numbers)) for r in rows])
        if len(numbers) < 2:
            return []
        keys, bytes_of = np.array([r["keys"] for r in rows], np.int64), np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1)
        found = joined_within(group[0], keys, bytes_of, own, np.array([r["part"] for r in rows]), group[1] != group[2], [np.frombuffer(r["hashes"], "<u8") for r in rows], similarity)
        return [(rows[x]["node"], rows[y]["node"]) for x, y in found]

    def made(batches):
        last, waiting = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                group = (r["key"], r["i"], r["j"])
                if group != last:
                    out += joined(last, waiting) if waiting else []
                    last, waiting = group, []
                waiting.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])
        out = joined(last, waiting) if waiting else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    told = posted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = told.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    # Every part meets every part; lists of one part, nearly all, meet once.
    meets = told.join(apart, "key").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meets = meets.withColumns({"i": F.least("part", "with"), "j": F.greatest("part", "with")}).join(shingles, "node")
    dealt = meets.select("key", "i", "j", "node", "root", "part", "keys", "sketch", "hashes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return dealt.mapInArrow(made, "a binary, b binary")


def further_joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`roots` (node, root) after some links more: components of the few roots that these join, not of all links again."""
    own = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(roots, "node", "left_anti")
    every = roots.unionByName(own.select("node", F.col("node").alias("root")))
    ends = links.join(every.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(every.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    moved = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return materialise(every.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")


def shingles_of(members: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """node, hashes: the shingle hashes of some nodes' texts, sorted, each once, in eight bytes."""

    def made(batches):
        for batch in batches:
            own, texts = batches_of(["end", "t"], batch)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([np.unique(shingle_hashes(t, size)).astype("<u8").tobytes() for t in texts], pa.binary())], ["node", "hashes"])

    # Texts are fetched by their least doc_id as well, so the copies of one text are dealt to many tasks and drop out there.
    ends = members.distinct().join(nodes, "node").select(F.col("node").alias("end"), F.coalesce("least", F.lit(0)).alias("at"))
    text = text_or_empty(text_col)
    known = docs.select(F.unhex(F.md5(text)).alias("n"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("d"), text.alias("t"))
    once = known.join(ends, (known.n == ends.end) & (known.d == ends["at"]), "left_semi").groupBy(F.col("n").alias("end")).agg(F.min("t").alias("t"))
    return materialise(once.mapInArrow(made, "node binary, hashes binary"), "shingles")


def verified(edges: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The links whose texts are as similar as that."""

    def told(batches):
        for batch in batches:
            sets = ([np.frombuffer(x, "<u8") for x in column] for column in batches_of(["ha", "hb"], batch))
            yield batch.filter(pa.array([alike(x, y, similarity) for x, y in zip(*sets, strict=True)], pa.bool_())).select(["a", "b"])

    first = edges.join(shingles.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    return first.join(shingles.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b").select("a", "b", "ha", "hb").mapInArrow(told, "a binary, b binary")


def similar_texts(docs: DataFrame, size: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of `simhash.near_duplicates`, with texts linked at a Jaccard similarity of their shingle sets or more."""
    given = materialise(sketches(docs, size, id_col, text_col), "sketches")
    nodes = materialise(given.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("fp", "keys", "sketch"))), "nodes")
    # Of texts with one fingerprint the first stands for the rest.
    by_fp = materialise(nodes.groupBy("fp").agg(F.min("node").alias("node")), "distinct-fingerprints")
    rep = lambda c: by_fp.select(F.col("fp").alias(c), F.col("node").alias(f"n{c}"))
    by_bytes = links(by_fp.select("fp")).join(rep("a"), "a").join(rep("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    same = nodes.select("fp", F.col("node").alias("b")).join(by_fp.select("fp", F.col("node").alias("a")), "fp").filter("a <> b").select("a", "b")
    posted = nominated(nodes)
    edges = by_bytes.union(same).union(_forests_of(posted))
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialise(edges, "nominated-links")
    members = posted.select("node").union(edges.select("a")).union(edges.select("b"))
    shingles = shingles_of(members, nodes, docs, size, id_col, text_col)
    roots = components(materialise(verified(edges, shingles, similarity), "links"))
    roots = further_joined(roots, materialise(further_links(posted, roots, shingles, similarity).distinct(), "links"))
    named = materialise(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "root").select("node", "root", "component_id")
    return given.join(of_node, "node").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "text_hash")
