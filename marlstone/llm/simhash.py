"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

Two 64-bit fingerprints at 3 differing bits or fewer differ in at most 3 of their 8 bytes, so they share at least 5
positional bytes.  A posting list for one positional byte would hold 1/256 of all fingerprints, so the index posts each
fingerprint under sets of four positional bytes; the 14 sets are chosen so that any five positions contain one of them,
hence no pair with five shared bytes is missed.  Inside a posting list the shared bytes of pairs are tallied, pairs
under five are dropped, and the rest are verified bit by bit.  Only a spanning forest of each list is emitted, never
all its pairs.

Posting lists are bounded.  One longer than `LONG_LIST` is posted again under what else its pairs must share: one of the
four remaining bytes, and three of the six half bytes then left (three differing bits spoil at most three).  That fixes
52 of 64 bits, so such a list can hold 4096 different fingerprints at most.

Equal fingerprints are one entry from the start (map-side combined), so copies cost one row for each task.

Cases: a null or empty text has the fingerprint zero and is linked like any other; a null doc_id takes part but never
names a component unless all its members are null; repeated rows are repeated in the result; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, materialise, ship, text_or_empty
from .components import components

ship(__name__)

MAX_BITS = 3
LEAST_BYTES = 8 - MAX_BITS
LONG_LIST = 4096
SEED = 42


def position_sets() -> list[tuple[int, ...]]:
    """14 sets of four of the eight byte positions; every five positions contain one of them.

    With the positions in two halves: either half, and two pairs from the same perfect matching of each half.  Three
    positions of a half contain one pair of each matching, so a 3 + 2 split is covered as well as a 4 + 1 split.
    """
    matchings = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    return [(0, 1, 2, 3), (4, 5, 6, 7)] + [(*p, *(4 + x for x in q)) for m in matchings for p in m for q in m]


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included (fewer words: of all of them), as uint64."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)


def simhash_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero where there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str, size: int = 3) -> int:
    """SimHash of the word shingles of a text, as an unsigned 64-bit number."""
    return simhash_of(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, and fp, the fingerprint as a signed long, of every row."""

    def hashed(batches):
        for batch in batches:
            ids, hashes, texts = batches_of(["doc_id", "text_hash", "text"], batch)
            fps = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), text_or_empty(text_col).alias("text")).mapInArrow(hashed, "doc_id bigint, text_hash bigint, fp bigint")


def spanning_links(members: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints (uint64): one row of tallies at a time."""
    links, left = [], members
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            differ = left ^ x
            near = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= LEAST_BYTES
            near[near] = np.bitwise_count(differ[near]) <= MAX_BITS
            if near.any():
                found = left[near]
                links += [(x, y) for y in found]
                queue += list(found)
                left = left[~near]
    return links


def _links_of_lists(batches):
    for batch in batches:
        a, b = [], []
        for members in batches_of(["members"], batch)[0]:
            for x, y in spanning_links(np.array(members, np.int64).view(np.uint64)):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], ["a", "b"])


def _posted_again(batches):
    """Entries of long lists under every refined key: 80 for each, vectorised over a batch."""
    sets = position_sets()
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False)
        which = (keys >> 32).astype(np.int64)
        for s, chosen in enumerate(sets):
            own_keys, own = keys[which == s].astype(np.uint64), fps[which == s].view(np.uint64)
            if not len(own):
                continue
            rest = [j for j in range(8) if j not in chosen]
            for e, same in enumerate(rest):
                nibbles = [8 * j + h for j in rest if j != same for h in (0, 4)]
                byte = (own >> np.uint64(8 * same)) & np.uint64(0xFF)
                for c, trio in enumerate(combinations(nibbles, 3)):
                    key = own_keys & np.uint64(0xFFFFFFFF)
                    key = (key << np.uint64(8)) | byte
                    for at in trio:
                        key = (key << np.uint64(4)) | ((own >> np.uint64(at)) & np.uint64(15))
                    key |= np.uint64((s * 4 + e) * 20 + c) << np.uint64(52)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own.view(np.int64))], ["key", "fp"])


def links(distinct: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """a, b: links among the different fingerprints `fp` that join all that a chain of links joins."""
    byte = [F.shiftrightunsigned(F.col("fp"), 8 * j).bitwiseAND(F.lit(0xFF)) for j in range(8)]
    keys = [sum((F.shiftleft(byte[j], 8 * k) for k, j in enumerate(reversed(chosen))), F.lit(s << 32).cast("bigint")) for s, chosen in enumerate(position_sets())]
    posted = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    counts = materialise(posted.groupBy("key").count().filter("count > 1"), "posting-counts")
    short = posted.join(counts.filter(F.col("count") <= long_list).select("key"), "key").repartition("key")
    long = posted.join(counts.filter(F.col("count") > long_list).select("key"), "key").select("key", "fp")
    again = long.mapInArrow(_posted_again, "key bigint, fp bigint")
    lists = [x.groupBy("key").agg(F.collect_set("fp").alias("members")).filter("size(members) > 1").select("members") for x in (short, again)]
    return lists[0].union(lists[1]).mapInArrow(_links_of_lists, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that a chain of links reaches),
    root (a number of the component, also where no doc_id names it), text_hash.

    Without a similarity, fingerprints link at MAX_BITS bits or fewer.  With one, texts link where the Jaccard similarity of
    their sets of word shingles reaches it (`similar.similar_texts`); fingerprints then only nominate.
    """
    if similarity is not None:
        from .similar import similar_texts

        return similar_texts(docs, size, similarity, id_col, text_col)
    given = materialise(fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = materialise(given.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.join(least, "root").select("fp", "root", "component_id")
    return given.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "text_hash")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("root", "text_hash")
