"""Packing documents into sequences by a grouping genetic algorithm.

Only pieces of a document longer than a sequence are cut.  Pieces that fill a sequence stand alone; the others are dealt
into groups of bounded size.  Each group is packed by several islands, each with its own population: best-fit packings
of differently perturbed orders.  A crossover injects whole well-filled bins of one parent into the other, removes the
bins that hold the same pieces, and places the displaced pieces best-fit, largest first.  Between epochs the elite of
each island migrates to the next.  The best packing of a group keeps its well-filled bins; what lies in the others is
dealt into groups again, now of all such rests, until one group holds them.  So the sequences lost to grouping do not
grow with the number of groups.

Token ids are made in one pass that keeps only lengths and checksums, so the packing moves a few bytes a piece;
`sequences` joins ids to places where the sequences themselves are wanted.

Cases: a null or empty text is the end id alone; a null doc_id and repeated rows are packed like any other row; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, materialise, ship, text_or_empty
from .tokens import WordTokenizer, vocabulary_path

ship(__name__)

CAPACITY = 4096
END_ID = 1
GROUP = 2000  # pieces in a group, about
#: What a group costs where best-fit does not reach the least number of bins at once; where it does, nothing evolves.
ISLANDS = 3
EPOCHS = 2
POPULATION = 8
CHILDREN = 24  # of an island in an epoch
WELL_FILLED = 0.995


# ---- one packing ----------------------------------------------------------------------------------------------


class Bins:
    """A packing that is being built: bins by room left, and which amounts of room there are as bits of a number."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.room = capacity, [], []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0

    def _file(self, b: int) -> None:
        r = self.room[b]
        self.by_room[r].append(b)
        self.rooms |= 1 << r

    def add_bin(self, items: list[int], used: int) -> None:
        self.items.append(items)
        self.room.append(self.capacity - used)
        self._file(len(self.items) - 1)

    def best_fit(self, item: int, size: int) -> None:
        fits = self.rooms >> size
        if not fits:
            self.add_bin([item], size)
            return
        r = size + (fits & -fits).bit_length() - 1
        b = self.by_room[r].pop()
        if not self.by_room[r]:
            self.rooms ^= 1 << r
        self.items[b].append(item)
        self.room[b] = r - size
        self._file(b)

    def packing(self) -> list[list[int]]:
        return self.items


def best_fit(order, sizes: list[int], capacity: int, start: list[list[int]] = ()) -> list[list[int]]:
    bins = Bins(capacity)
    for b in start:
        bins.add_bin(list(b), sum(sizes[i] for i in b))
    for i in order:
        bins.best_fit(int(i), sizes[i])
    return bins.packing()


def fitness(packing: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean of squared fills: the more uneven the fills, the more room is left together."""
    return -len(packing), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in packing)


def crossover(into: list[list[int]], donor: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Whole well-filled bins of the donor, the bins of `into` that share nothing with them, and the displaced best-fit."""
    full = [b for b in donor if sum(sizes[i] for i in b) >= WELL_FILLED * capacity] or donor
    first, last = sorted(rng.integers(0, len(full) + 1, 2).tolist())
    injected = full[first:last]
    inside = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in into:
        if inside.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in inside]
    # Dissolve the emptiest of the kept bins as well, else their room is never used better.
    kept.sort(key=lambda b: -sum(sizes[i] for i in b))
    for _ in range(min(2, len(kept))):
        displaced += kept.pop()
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(displaced, sizes, capacity, injected + kept)


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]], children: int = CHILDREN, population: int = POPULATION) -> list[list[int]]:
    """One epoch of one island; returns its elite."""
    rng, least = np.random.default_rng(seed), -(-sum(sizes) // capacity)
    size = np.array(sizes)
    people = [*elites]
    if not people:
        people.append(best_fit(np.argsort(-size, kind="stable"), sizes, capacity))
    rank = lambda p: fitness(p, sizes, capacity)
    if max(map(rank, people))[0] == -least:
        return max(people, key=rank)  # no packing has fewer bins
    while len(people) < population:
        people.append(best_fit(np.argsort(-size * rng.uniform(0.9, 1.1, len(size)), kind="stable"), sizes, capacity))
    scored = sorted(((rank(p), k, p) for k, p in enumerate(people)), reverse=True)
    for k in range(children):
        if scored[0][0][0] == -least:
            break
        a, b = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[min(a, b)][2], scored[max(a, b)][2], sizes, capacity, rng)
        scored = sorted([*scored[:-1], (rank(child), len(people) + k, child)], reverse=True)
    return scored[0][2]


def as_numbers(packing: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(packing):
        for i in b:
            out[i] = k
    return out


def as_bins(numbers: list[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(numbers, default=-1) + 1)]
    for i, k in enumerate(numbers):
        bins[k].append(i)
    return bins


# ---- islands over groups --------------------------------------------------------------------------------------


def _epoch(capacity: int, epoch: int):
    def run(batches):
        for batch in batches:
            groups, islands, sizes, elites = batches_of(["g", "island", "sizes", "elites"], batch)
            best = [as_numbers(evolve(s, capacity, hash((g, i, epoch)) & 0xFFFFFFFF, [as_bins(e) for e in es or []]), len(s)) for g, i, s, es in zip(groups, islands, sizes, elites, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("g", "island", "uids", "sizes")), pa.array(best, pa.list_(pa.int32()))], ["g", "island", "uids", "sizes", "elite"])

    return run


def _best(capacity: int, level: int):
    """uid, sequence_id, offset and the fill of the sequence, from the best of each group's islands."""

    def run(batches):
        for batch in batches:
            for g, uids, sizes, elites in zip(*batches_of(["g", "uids", "sizes", "elites"], batch), strict=True):
                packing = max((as_bins(e) for e in elites), key=lambda p: fitness(p, sizes, capacity))
                out: list[tuple] = []
                for k, b in enumerate(packing):
                    fill, at = sum(sizes[i] for i in b), 0
                    for i in b:
                        out.append((uids[i], (level << 56) + (g << 16) + k, at, fill))
                        at += sizes[i]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["uid", "sequence_id", "offset", "fill"])

    return run


def pack_groups(pieces: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """uid, sequence_id, offset, fill of all `pieces` (uid, length), packed within groups by their islands."""
    dealt = pieces.groupBy(F.pmod(F.xxhash64(F.col("uid"), F.lit(level)), F.lit(groups)).alias("g")).agg(F.sort_array(F.collect_list(F.struct(F.col("length").cast("int").alias("n"), "uid"))).alias("p"))
    state = dealt.select("g", F.col("p.uid").alias("uids"), F.col("p.n").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(None).cast("array<array<int>>").alias("elites"))
    schema = "g bigint, island int, uids array<bigint>, sizes array<int>, elite array<int>"
    state = state.repartition("g", "island").mapInArrow(_epoch(capacity, 0), schema)
    for epoch in range(1, EPOCHS):
        state = materialise(state, "islands")
        migrants = state.select("g", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("migrant"))
        state = state.join(migrants, ["g", "island"]).select("g", "island", "uids", "sizes", F.array("elite", "migrant").alias("elites")).mapInArrow(_epoch(capacity, epoch), schema)
    best = state.groupBy("g").agg(F.first("uids").alias("uids"), F.first("sizes").alias("sizes"), F.collect_list("elite").alias("elites"))
    return best.mapInArrow(_best(capacity, level), "uid bigint, sequence_id bigint, offset bigint, fill bigint")


def pack_lengths(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """uid, sequence_id, offset for pieces (uid, length), where uid differs from row to row and length is 1..capacity."""
    done = [pieces.filter(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    rest, level = pieces.filter(F.col("length") < capacity).select("uid", "length"), 1
    while True:
        groups = -(-rest.count() // group)
        if not groups:
            break
        placed = materialise(pack_groups(rest, groups, capacity, level), "placed")
        if groups == 1:
            done.append(placed.select("uid", "sequence_id", "offset"))
            break
        full = F.col("fill") >= WELL_FILLED * capacity
        done.append(placed.filter(full).select("uid", "sequence_id", "offset"))
        left = placed.filter(~full).join(rest, "uid").select("uid", "length")
        rest, level = materialise(left, "rest"), level + 1
        if -(-rest.count() // group) >= groups:  # nothing was won by dealing anew
            done.append(placed.filter(~full).select("uid", "sequence_id", "offset"))
            break
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


# ---- documents ------------------------------------------------------------------------------------------------


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of unsigned 32-bit ids), and the ids themselves if asked for."""

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def cut(batches):
        model = WordTokenizer.of_process(vocabulary)
        for batch in batches:
            doc_ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("d", "t"))
            for at, ids, starts in model.encode_ended(texts, end_id):
                # All columns at once: which text a piece is of, its number there, and where it lies.
                whole = np.diff(starts)
                pieces = -(-whole // capacity)
                row = np.repeat(np.arange(len(whole)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length, begin = np.minimum(capacity, whole[row] - start), starts[row] + start
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [doc_ids.take(pa.array(row + at)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array([*begin, starts[-1]], pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    keyed = docs.select(F.col(id_col).cast("bigint").alias("d"), text_or_empty(text_col).alias("t"))
    return keyed.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, **columns) -> DataFrame:
    """Every piece of every document with its sequence_id and the offset in it."""
    pieces = materialise(token_pieces(docs, vocabulary, capacity, end_id, with_ids, **columns).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = pack_lengths(pieces.select("uid", "length"), capacity)
    return pieces.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, from `pack_documents(..., with_ids=True)`; a sequence has bounded length."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
