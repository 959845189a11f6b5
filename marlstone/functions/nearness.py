"""Excerpts and the queries of a batch within a task: similarities in blocks, of which only the pairs that are wanted leave it.

A row is a review with its excerpts and a group of queries that may see it.  Nothing that has the size of all pairs is sent on: the
best of a part, what reaches a bound, or how many pairs stand ahead of a few keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from . import ship

ship(__name__)

#: Pairs that a task has in hand at once, and queries and excerpts whose sums stay in a processor's cache.
PAIRS, TILE = 1 << 21, (128, 256)
#: A row of pairs that are sent on, besides the columns of the review and the excerpt.
FOUND = ["query_id", "similarity", "kw_rank", "lexical", "below_floor", "head"]


@dataclass(frozen=True)
class Asking:
    """A batch's queries: numbers in order, vectors, floors, the question each asks, and the queries of each group of filters."""

    ids: np.ndarray
    vectors: list[np.ndarray]
    lengths: np.ndarray
    floors: np.ndarray
    lows: np.ndarray
    questions: np.ndarray
    groups: dict[int, np.ndarray]
    both: bool
    #: By question the word rank that ends its list by words.
    ends: dict[int, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Block:
    """Some excerpts, whole reviews, and the queries that see them: (queries, excerpts) similarities and word ranks.

    A word rank is -1 where words don't match and 0 where they match in part.  `rows` is each excerpt's review among `reviews`.
    """

    queries: np.ndarray
    reviews: pa.RecordBatch
    excerpts: dict[str, pa.Array]
    rows: np.ndarray
    orders: tuple[np.ndarray, np.ndarray, np.ndarray]
    similarity: np.ndarray
    ranks: np.ndarray
    kept: np.ndarray
    over: np.ndarray


def similarities(x: np.ndarray, x_lengths: np.ndarray, q: np.ndarray, q_lengths: np.ndarray) -> np.ndarray:
    """Cosines (queries, excerpts); products are summed in the order of dimensions, as `vector.dot` does, so the numbers are the same."""
    out, columns = np.zeros((len(q), len(x))), np.ascontiguousarray(x.T)
    for a in range(0, len(q), TILE[0]):
        for b in range(0, len(x), TILE[1]):
            some = np.ascontiguousarray(q[a : a + TILE[0]].T)
            total = np.zeros((some.shape[1], min(TILE[1], len(x) - b)))
            product = np.empty_like(total)
            for k in range(x.shape[1]):
                np.multiply(some[k][:, None], columns[k, b : b + TILE[1]], out=product)
                total += product
            out[a : a + TILE[0], b : b + TILE[1]] = total
    length = x_lengths * q_lengths[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(length == 0, 0.0, out / length)


def after(a: tuple, b: tuple) -> np.ndarray:
    """Whether of equally similar excerpts those of order `a` (date, breadth, id) come before `b`."""
    return (a[0] > b[0]) | ((a[0] == b[0]) & ((a[1] > b[1]) | ((a[1] == b[1]) & (a[2] > b[2]))))


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _of_reviews(reviews: pa.RecordBatch, asking: Asking, queries: np.ndarray) -> Iterator[Block]:
    lists = reviews.column("excerpts")
    sizes = _numbers(lists.value_lengths()).astype(np.int64)
    flat = lists.flatten()
    parts = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    rows = np.repeat(np.arange(reviews.num_rows), sizes)
    dimensions = _numbers(parts["embedding"].value_lengths())
    for d in np.unique(dimensions).tolist():
        seeing = queries[[len(asking.vectors[k]) == d for k in queries.tolist()]]
        mine = np.flatnonzero(dimensions == d)
        if len(seeing):
            yield _block(reviews, {name: v.take(pa.array(mine)) for name, v in parts.items()}, rows[mine], asking, seeing, d)


def _block(reviews: pa.RecordBatch, parts: dict[str, pa.Array], rows: np.ndarray, asking: Asking, queries: np.ndarray, d: int) -> Block:
    values = _numbers(parts["embedding"].flatten()).astype(np.float64).reshape(len(rows), d)
    found = similarities(values, _numbers(parts["norm"]), np.stack([asking.vectors[k] for k in queries.tolist()]), asking.lengths[queries])
    orders = (_numbers(reviews.column("o"))[rows], -_numbers(parts["breadth"]).astype(np.int64), -_numbers(parts["id"]).astype(np.int64))
    ranks = _word_ranks(parts["told"], asking.questions[queries], len(rows))
    floors, lows = asking.floors[queries][:, None], asking.lows[queries][:, None]
    # What is no number is the greatest, as for Spark.
    high, low = ~(found < floors), ~(found < lows)
    return Block(queries, reviews, parts, rows, orders, found, ranks, np.ones_like(low) if asking.both else low, high | ((ranks >= 0) & low))


def _word_ranks(told: pa.Array, questions: np.ndarray, excerpts: int) -> np.ndarray:
    sizes = told.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    question, rank = told.flatten().flatten()
    asked, of_query = np.unique(questions, return_inverse=True)
    question = _numbers(question)
    at = np.searchsorted(asked, question)
    there = asked[np.minimum(at, len(asked) - 1)] == question
    table = np.full((len(asked), excerpts), -1, np.int32)
    table[at[there], np.repeat(np.arange(excerpts), sizes)[there]] = _numbers(rank.fill_null(0))[there]
    return table[of_query]


def blocks(batches: Iterator[pa.RecordBatch], asking: Asking) -> Iterator[Block]:
    for batch in batches:
        groups = _numbers(batch.column("q_group"))
        for group in np.unique(groups).tolist():
            queries = asking.groups[group]
            mine = batch.take(pa.array(np.flatnonzero(groups == group)))
            sizes = np.cumsum(_numbers(mine.column("excerpts").value_lengths()))
            # Whole reviews, so that what one of them is worth is told within a block.
            part = sizes // max(1, PAIRS // len(queries))
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), mine.num_rows]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b > a:
                    yield from _of_reviews(mine.slice(a, b - a).take(pa.array(range(b - a))), asking, queries)


def _sides(block: Block, both: bool) -> dict[tuple[bool, bool], np.ndarray]:
    """Pairs that may be shown, by whether they are below the floor and whether their words match in full."""
    over = block.kept & block.over
    sides = {False: over}
    if both:
        # What is above the floor on one of its excerpts is not shown below it.
        heads = np.flatnonzero(np.diff(block.rows, prepend=-1))
        any_over = over if len(heads) == len(block.rows) else np.repeat(np.logical_or.reduceat(over, heads, axis=1), np.diff(heads, append=len(block.rows)), axis=1)
        sides[True] = block.kept & ~any_over
    full = block.ranks > 0
    return {(below, in_full): mask & (full if in_full else ~full) for below, mask in sides.items() for in_full in (False, True)}


def _sent(block: Block, asking: Asking, at: np.ndarray, k: np.ndarray, head: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    rank = block.ranks[at, k]
    made = {
        "query_id": pa.array(asking.ids[block.queries[at]]),
        "similarity": pa.array(block.similarity[at, k]),
        "kw_rank": pa.array(rank, pa.int32(), mask=rank <= 0),
        "lexical": pa.array(rank >= 0),
        "below_floor": pa.array(~block.over[at, k]),
        "head": pa.array(head),
    }
    excerpt, row = pa.array(k), pa.array(block.rows[k])
    arrays = [made[c] if c in made else block.excerpts[c].take(excerpt) if c in block.excerpts else block.reviews.column(c).take(row) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, columns)


def _best_excerpts(block: Block, mask: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, reviews) the similarity of each review's best excerpt of `mask`, -inf where it has none, and which it is."""
    shown = np.where(mask, block.similarity, -np.inf)
    heads = np.flatnonzero(np.diff(block.rows, prepend=-1))
    if len(heads) == len(block.rows):
        return shown, np.broadcast_to(heads, shown.shape)
    most = np.maximum.reduceat(shown, heads, axis=1)
    first = ~(shown < np.repeat(most, np.diff(heads, append=len(block.rows)), axis=1))
    by_place = np.empty_like(places)
    by_place[places] = np.arange(len(places))
    return most, by_place[np.maximum.reduceat(np.where(first, places, -1), heads, axis=1)]


def best(asking: Asking, limit: int, cut: int, columns: list[str]):
    """Of each block a query's best reviews on each side by their best excerpts, `limit` without and `cut` with a full match."""

    def run(batches):
        for block in blocks(batches, asking):
            places = np.empty(len(block.rows), np.int64)
            places[np.lexsort(block.orders[::-1])] = np.arange(len(places))
            for (_, in_full), mask in _sides(block, asking.both).items():
                many = cut if in_full else limit
                if not many or not mask.any():
                    continue
                most, excerpt = _best_excerpts(block, mask, places)
                chosen = most > -np.inf
                if most.shape[1] > many:
                    least = np.partition(most, most.shape[1] - many, axis=1)[:, most.shape[1] - many][:, None]
                    above = most > least
                    equal, left = chosen & (most == least), many - above.sum(axis=1)
                    for j in np.flatnonzero(equal.sum(axis=1) > left).tolist():
                        tied = np.flatnonzero(equal[j])
                        equal[j, tied[np.argsort(-places[excerpt[j, tied]])[left[j] :]]] = False
                    chosen = above | equal
                at, review = np.nonzero(chosen)
                if len(at):
                    yield _sent(block, asking, at, excerpt[at, review], np.zeros(len(at), bool), columns)

    return run


def near(asking: Asking, bounds: dict[tuple[bool, bool], tuple[np.ndarray, ...]], columns: list[str]):
    """The pairs that reach the bound of their side (similarity, date, breadth, id by query) or are in the list by words."""

    def run(batches):
        end = np.array([asking.ends.get(int(x), 1 << 31) for x in asking.questions], np.int64)
        for block in blocks(batches, asking):
            for side, mask in _sides(block, asking.both).items():
                least, *order = (b[block.queries] for b in bounds[side])
                reached = mask & ~(block.similarity < least[:, None])
                at, k = np.nonzero(reached & (block.similarity == least[:, None]))
                behind = after(tuple(o[at] for o in order), tuple(o[k] for o in block.orders))
                reached[at[behind], k[behind]] = False
                head = mask & (block.ranks <= end[block.queries][:, None]) if side[1] else np.zeros_like(mask)
                at, k = np.nonzero(reached | head)
                if len(at):
                    yield _sent(block, asking, at, k, head[at, k], columns)

    return run


def ahead(asking: Asking, keys: list[tuple[np.ndarray, ...]]):
    """query_id, counts: how many pairs of a task stand ahead of each of a query's `keys` (similarity, date, breadth, id; rising)."""

    def run(batches):
        counts = [np.zeros(len(k[0]), np.int64) for k in keys]
        for block in blocks(batches, asking):
            ordered, ids = np.sort(block.similarity, axis=1), np.sort(block.orders[2])
            for j, q in enumerate(block.queries.tolist()):
                if not len(keys[q][0]):
                    continue
                above = np.searchsorted(ordered[j], keys[q][0], "right")
                counts[q] += len(ordered[j]) - above
                # Each key is that of an excerpt of one block; what else is as similar is looked at one by one.
                own = ids[np.minimum(np.searchsorted(ids, keys[q][3]), len(ids) - 1)] == keys[q][3]
                equal = above - np.searchsorted(ordered[j], keys[q][0], "left") - own
                if equal.any():
                    _add_ties(block, j, keys[q], equal, counts[q])
        some = [q for q, c in enumerate(counts) if c.any()]
        if some:
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(counts[q]) for q in some)]), pa.int32()), pa.array(np.concatenate([counts[q] for q in some])))
            yield pa.RecordBatch.from_arrays([pa.array(asking.ids[some]), lists], ["query_id", "counts"])

    return run


def _add_ties(block: Block, j: int, keys: tuple[np.ndarray, ...], equal: np.ndarray, counts: np.ndarray) -> None:
    """Equally similar excerpts stand ahead of a key by date, breadth and id; each key meets those of its similarity in one order."""
    tied = np.flatnonzero(equal)
    places = np.flatnonzero(np.isin(block.similarity[j], keys[0][tied]))
    similar = np.concatenate((keys[0][tied], block.similarity[j][places]))
    orders = [np.concatenate((k[tied], o[places])) for k, o in zip(keys[1:], block.orders, strict=True)]
    own = np.arange(len(similar)) < len(tied)
    # Rising, an excerpt before the key that is itself; ahead of a key is what follows it within its similarity.
    rising = np.lexsort((own, orders[2], orders[1], orders[0], similar))
    passed = np.cumsum(~own[rising])
    ends = np.searchsorted(similar[rising], keys[0][tied], "right") - 1
    at = np.empty(len(similar), np.int64)
    at[rising] = np.arange(len(similar))
    counts[tied] += passed[ends] - passed[at[: len(tied)]]
