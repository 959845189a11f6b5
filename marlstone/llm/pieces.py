"""SentencePiece segmentations sampled without replacement, and their decoding.

A text's lattice has an arc for every vocabulary piece that matches somewhere; a piece of rank r weighs (2 + r)**-alpha,
so a path's weight over the sum of all is its probability.  Gumbel top-k: give every path its log-probability plus
Gumbel noise; the k largest are a sample without replacement.  Paths are never listed.  A region is a set of paths: the
choices before some unit fixed, some of that unit's segmentations excluded, all after it free.  The noisy maximum of a
region is a Gumbel variable located at the log of the region's mass, which the lattice's forward sums give exactly; that is
the A* priority, and no heuristic is needed.  The best region is popped, its maximum is drawn as a path, and what is left of
the region splits by the first unit at which a path departs from it; each part draws its own maximum below the popped one.

A unit is a stretch that no piece crosses: a word with the spaces before it, or a line end.  Units of a batch are put in
one array each, so forward sums and draws are vector operations over all texts of the batch at once.

Every draw is a hash of the seed, the row's key, the place and the turn, so a row's samples depend on nothing else.

Draws look chances up in single precision, and where that could decide otherwise, in double; what is left of a unit is the
difference to 1, and where that is small, the sum of what no emitted path takes.  So no segmentation is too rare to come.

The inclusion score of a path with log-probability p is 1 - exp(-exp(p - t)), t being the noisy maximum of what was not
emitted: the chance that a path with its probability gets above t.

Cases: a null or empty text has one segmentation, the empty one; a text with fewer than k segmentations emits them all;
characters outside the vocabulary become their bytes; a literal meta symbol (U+2581) decodes to a space, as in the library;
rows that repeat a doc_id and text repeat their samples; an empty table gives no rows; other columns are not read.  A batch
needs some 256 bytes for each character of its different units; a text is never split over batches.

`encode_documents` gives the library's own segmentation of each text, and `decode_documents` the text of ids.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, process_store, ship, text_or_empty

ship(__name__)

META = "▁"
UNIT = re.compile(f"\n|{META}*[^{META}\n]+|{META}+")
LONG_UNIT = 40  # characters from which forward sums are kept as logarithms
SAMPLES = 2
CLOSE = 2.0**-20  # a draw so near to a bound in single precision is decided in double precision
SMALL_REST = 1e-10  # what is left of a unit's mass below this is summed path by path, since a difference would be rounding
BATCH_CHARS = 300_000  # so that the lattices of a batch stay near the processor


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(key: np.ndarray, *parts: int) -> np.ndarray:
    """Further keys from keys and whole numbers."""
    for p in parts:
        key = mix(key + np.uint64((p * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
    return key


def uniform_of(key: int, *parts: int) -> float:
    """As `uniform`, of one key."""
    full = 0xFFFFFFFFFFFFFFFF
    for p in parts:
        x = (key + (p * 0x9E3779B97F4A7C15 + 1)) & full
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        key = x ^ (x >> 31)
    return ((key >> 11) + 0.5) * 2.0**-53


def uniform(key: np.ndarray, *parts: int) -> np.ndarray:
    """Numbers in (0, 1) from keys and whole numbers."""
    x = keyed(key, *parts)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Model:
    """The vocabulary as tables for vector look-up."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.plain: list[bytes] = []
        by_length: dict[int, list[tuple[str, int]]] = {}
        log_weight = np.zeros(sp.get_piece_size())
        self.length = np.zeros(sp.get_piece_size(), np.int64)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.plain.append(bytes([int(piece[3:5], 16)]))
                self.length[i] = 1  # of an ASCII character; others stay apart until their ids are made
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.plain.append(b"")
            else:
                self.plain.append(piece.replace(META, " ").encode())
                by_length.setdefault(len(piece), []).append((piece, i))
                self.length[i] = len(piece)
                log_weight[i] = -alpha * np.log(2 + min(-sp.get_score(i), sp.get_piece_size()))
        self.weight = np.exp(log_weight)
        #: The bytes of all pieces one after the other, and where each has its own.
        self.plain_size = np.array([len(p) for p in self.plain], np.int32)
        self.plain_at = (np.cumsum(self.plain_size) - self.plain_size).astype(np.int32)
        self.plain_all = np.frombuffer(b"".join(self.plain), np.uint8)
        self.longest = -(-max(by_length) // 8) * 8  # padded, so that a row of flags is whole words
        self.known = frozenset(p for p, _ in by_length[1])
        hashes, ids = [], []
        #: Whether some piece begins so and goes on, by the leading bits of the hash.
        self.goes_on = np.zeros(1 << 20, bool)
        for n, pieces in by_length.items():
            codes = np.frombuffer("".join(p for p, _ in pieces).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.uint64)
            h = np.zeros(len(pieces), np.uint64)
            for j in range(n):
                self.goes_on[(h >> np.uint64(44)).astype(np.int64)] = True
                h = self.roll(h, codes[:, j])
            hashes.append(h)
            ids += [i for _, i in pieces]
        self.hashes, self.of_hash = np.concatenate(hashes), np.array(ids)
        # One piece for each slot of a table; pieces whose slot another has are kept in a short sorted list.
        slots = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[slots] = np.arange(len(slots))
        #: Which leading bits any piece has: small enough for the nearest cache, it settles most look-ups.
        self.some = np.zeros(1 << 18, bool)
        self.some[(self.hashes >> np.uint64(46)).astype(np.int64)] = True
        over = np.flatnonzero(self.slot[slots] != np.arange(len(slots)))
        over = over[np.argsort(self.hashes[over])]
        self.over_hash, self.over_id = self.hashes[over], self.of_hash[over]

    @staticmethod
    def roll(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (h ^ code) * np.uint64(0x9E3779B97F4A7C15) + (h >> np.uint64(29))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes belong to pieces, and to which."""
        maybe = np.flatnonzero(self.some[(h >> np.uint64(46)).astype(np.int64)])
        k = self.slot[(h[maybe] >> np.uint64(44)).astype(np.int64)]
        there = k >= 0
        maybe, k = maybe[there], k[there]
        same = self.hashes[k] == h[maybe]
        hit, ids = maybe[same], self.of_hash[k[same]]
        if len(self.over_hash):
            maybe = maybe[~same]
            k = np.minimum(np.searchsorted(self.over_hash, h[maybe]), len(self.over_hash) - 1)
            same = self.over_hash[k] == h[maybe]
            if same.any():
                hit, ids = np.concatenate((hit, maybe[same])), np.concatenate((ids, self.over_id[k[same]]))
        return hit, ids

    @classmethod
    def of_process(cls, path: str, alpha: float) -> Model:
        store = process_store("pieces")
        if (path, alpha) not in store:
            store[path, alpha] = cls(path, alpha)
        return store[path, alpha]


class Lattices:
    """The lattices of different units: for each place the chance of every length of the last piece before it.

    Units are ordered by falling length, and the rows for the first t characters of all units that have so many lie side
    by side, so the sums over all units are operations on slices.  Long units come after them, one by one.
    """

    def __init__(self, model: Model, units: list[str]):
        self.model = model
        self.length = np.array([len(u) for u in units], np.int64)
        order = np.argsort(-self.length, kind="stable")
        first = int((self.length > LONG_UNIT).sum())
        short = order[first:]
        longest = int(self.length[short[0]]) if len(short) else 0
        #: How many short units have t characters or more, and where their rows for t characters begin.
        self.many = np.searchsorted(-self.length[short], -np.arange(longest + 2), side="right")
        self.off = np.concatenate(([0, 0], np.cumsum(self.many[1:])))[: longest + 2]
        total = int(self.many[1 : longest + 1].sum())
        self.shift = np.zeros(len(units), np.int64)
        self.shift[short] = np.arange(len(short))
        for u in order[:first]:
            self.shift[u], total = total, total + int(self.length[u])
        self.is_long = self.length > LONG_UNIT if first else None
        self.piece = np.full((total, model.longest), -1, np.int32)
        self.chance = np.zeros((total, model.longest))
        self.unknown: dict[int, str] = {}
        if len(short):
            self._short(units, short, longest)
        for u in order[:first]:
            self._long(units[u], int(self.shift[u]))
        arcs = np.count_nonzero(self.chance, axis=1)
        #: Units with one segmentation: every character stands alone.
        self.single = np.ones(len(units), bool)
        for t in range(1, longest + 1):
            m = int(self.many[t])
            self.single[short[:m]] &= arcs[self.off[t] : self.off[t] + m] == 1
        for u in order[:first]:
            self.single[u] = bool((arcs[self.shift[u] : self.shift[u] + self.length[u]] == 1).all())
        # Draws look up in single precision, in which a row is one cache line.
        self.upto = self.chance.astype(np.float32) @ np.triu(np.ones((model.longest, model.longest), np.float32))

    def _short(self, units: list[str], short: np.ndarray, longest: int) -> None:
        model, many, off, width = self.model, self.many, self.off, self.model.longest
        codes = np.frombuffer("".join([units[u] for u in short]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        start = np.cumsum(self.length[short]) - self.length[short]
        code = [codes[start[: many[t]] + t - 1] for t in range(1, longest + 1)]
        # From each place, all pieces that begin there carry its mass to where they end; places come in order, so the mass
        # at a place is whole when its turn comes.
        mass = np.zeros(int(many[1 : longest + 1].sum()))
        for a in range(longest):
            m = int(many[a + 1])
            here = mass[off[a] : off[a] + m] if a else np.ones(m)
            h, alive = np.zeros(m, np.uint64), None  # alive: the units in which a piece may still go on
            for n in range(1, min(width, longest - a) + 1):
                m, end = int(many[a + n]), int(off[a + n])
                if alive is None:
                    h = model.roll(h[:m], code[a + n - 1])
                    hit, ids = model.look_up(h)
                else:
                    alive = alive[: np.searchsorted(alive, m)]
                    h = model.roll(h[: len(alive)], code[a + n - 1][alive])
                    hit, ids = model.look_up(h)
                    hit = alive[hit]
                joint = here[hit] * model.weight[ids]
                if n == 1 and len(hit) < m:
                    alone = np.ones(m, bool)
                    alone[hit] = False
                    alone = np.flatnonzero(alone)
                    mass[end + alone] += here[alone]
                    self.chance[end + alone, 0] = here[alone]
                if len(hit):
                    at = end + hit
                    mass[at] += joint
                    self.chance[at, n - 1] = joint
                    self.piece[at, n - 1] = ids
                if n >= 2:
                    going = np.flatnonzero(model.goes_on[(h >> np.uint64(44)).astype(np.int64)])
                    alive, h = going if alive is None else alive[going], h[going]
                    if not len(alive):
                        break
        self.chance[: len(mass)] /= mass[:, None]
        self._alone(np.concatenate(code), 0)

    def _alone(self, codes: np.ndarray, base: int) -> None:
        """A character that is no piece stands alone in every path, so its weight cancels out."""
        alone = np.flatnonzero(self.piece[base : base + len(codes), 0] < 0)
        one_byte = alone[codes[alone] < 128]
        self.piece[base + one_byte, 0] = np.array(self.model.bytes)[codes[one_byte].astype(np.int64)]
        self.unknown |= {base + int(i): chr(int(codes[i])) for i in alone[codes[alone] >= 128]}

    def _long(self, unit: str, base: int) -> None:
        """Forward sums kept as logarithms: the mass of a long unit's paths is below any number."""
        model, width, length = self.model, self.model.longest, len(unit)
        codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        h = np.zeros(length, np.uint64)
        for n in range(1, min(width, length) + 1):
            h = model.roll(h[: length - n + 1], codes[n - 1 :])
            hit, ids = model.look_up(h)
            self.piece[base + hit + n - 1, n - 1] = ids
        unknown = self.piece[base : base + length, 0] < 0
        self._alone(codes, base)
        piece = self.piece[base : base + length]
        with np.errstate(divide="ignore"):
            weight = np.where(piece >= 0, np.log(model.weight[np.maximum(piece, 0)]), -np.inf)
            weight[unknown, 0] = 0.0
        log = np.full(length + width + 1, -np.inf)
        log[width] = 0.0
        for t in range(1, length + 1):
            joint = weight[t - 1] + log[t : width + t][::-1]
            top = joint.max()
            part = np.exp(joint - top)
            total = part.sum()
            log[width + t] = top + np.log(total)
            self.chance[base + t - 1] = part / total

    def row(self, unit: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The rows for the first `left` characters of the units."""
        if self.is_long is None:
            return self.shift[unit] + self.off[left]
        return self.shift[unit] + np.where(self.is_long[unit], left - 1, self.off[np.minimum(left, len(self.off) - 1)])

    def draw(self, unit: np.ndarray, key: np.ndarray, turn: int) -> tuple[np.ndarray, list]:
        """For each given unit: the log-probability of a drawn path, and its pieces by steps from the end."""
        left, logp = self.length[unit].copy(), np.zeros(len(unit))
        live, steps = np.argsort(self.shift[unit], kind="stable"), []  # equal units side by side, so their rows are fetched once
        key, step = keyed(key, turn), 0
        while len(live):
            row = self.row(unit[live], left[live])
            u = uniform(key[live], step)
            passed = self.upto[row] <= u.astype(np.float32)[:, None]
            n = np.bitwise_count(passed.view(np.uint64)).astype(np.int64).reshape(len(row), -1)
            n = np.minimum(sum(n[:, k] for k in range(n.shape[1])), self.model.longest - 1)
            p, upper = self.chance[row, n], self.upto[row, n]
            near = np.flatnonzero((np.abs(upper - u) < CLOSE) | (u - (upper - p) < CLOSE) | (p == 0))
            if len(near):
                exact = np.cumsum(self.chance[row[near]], axis=1)
                n[near] = np.minimum((exact <= (u[near] * exact[:, -1])[:, None]).sum(axis=1), self.model.longest - 1)
                p[near] = self.chance[row[near], n[near]]
            logp[live] += np.log(p)
            steps.append((live, row, n))
            left[live] -= n + 1
            live, step = live[left[live] > 0], step + 1
        return logp, steps

    def _tree(self, unit: int, excluded: list[tuple[int, ...]]) -> list[list]:
        """The excluded paths (lengths from the end) as nodes [row's chances, row, child by length, mass not excluded]."""
        nodes, left = [[None, 0, {}, 0.0]], [int(self.length[unit])]
        for path in excluded:
            at = 0
            for n in path:
                child = nodes[at][2].get(n)
                if child is None:
                    child = nodes[at][2][n] = len(nodes)
                    nodes.append([None, 0, {}, 0.0])
                    left.append(left[at] - n)
                at = child
        inner = [k for k, rest in enumerate(left) if rest]
        rows = self.row(np.full(len(inner), unit), np.array([left[k] for k in inner])).tolist()
        for k, row in zip(inner, rows, strict=True):
            nodes[k][0], nodes[k][1] = self.chance[row].tolist(), row
        for node in reversed(nodes):  # children come after their parents
            if node[0] is not None:
                node[3] = sum(c for n, c in enumerate(node[0], 1) if n not in node[2]) + sum(node[0][n - 1] * nodes[child][3] for n, child in node[2].items())
        return nodes

    def rest(self, unit: int, excluded: list[tuple[int, ...]]) -> float:
        """The mass of the unit's paths without the excluded ones, summed without differences."""
        return self._tree(unit, excluded)[0][3]

    def draw_other(self, unit: int, key: int, turn: int, excluded: list[tuple[int, ...]]) -> tuple[float, list[int]]:
        """A path drawn among those not excluded: its log-probability and rows' pieces.

        Going from the end, each arc is taken by the mass of the paths behind it that are not excluded.
        """
        nodes, at = self._tree(unit, excluded), 0
        left, logp, out, step = int(self.length[unit]), 0.0, [], 0
        while left:
            if at is not None:
                chances, row, children, _ = nodes[at]
                weights = [c * nodes[children[n]][3] if n in children else c for n, c in enumerate(chances, 1)]
            else:
                row, children = int(self.row(np.array([unit]), np.array([left]))[0]), {}
                chances = weights = self.chance[row].tolist()
            u, upto, last = uniform_of(key, turn, (1 << 21) + step) * sum(weights), 0.0, 0
            for n, w in enumerate(weights, 1):
                if w > 0:
                    upto, last = upto + w, n
                    if u < upto:
                        break
            at = children.get(last)
            logp += math.log(chances[last - 1])
            found = int(self.piece[row, last - 1])
            out.append(found if found >= 0 else -1 - row)
            left, step = left - last, step + 1
        return logp, out[::-1]

    def lengths(self, ids: np.ndarray) -> tuple[int, ...]:
        """The lengths of a unit's pieces from the end."""
        return tuple(np.where(ids < 0, 1, self.model.length[np.maximum(ids, 0)])[::-1].tolist())

    def ids(self, count: int, steps: list) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all drawn paths one after the other (unknown characters as -1 - place), and how many each has."""
        many = np.zeros(count, np.int64)
        for live, _, _ in steps:
            many[live] += 1
        end = np.cumsum(many)
        out = np.empty(int(end[-1]) if count else 0, np.int64)
        for k, (live, row, n) in enumerate(steps):
            found = self.piece[row, n].astype(np.int64)
            out[end[live] - 1 - k] = np.where(found < 0, -1 - row, found)
        return out, many


def gumbel_below(location, bound, u) -> np.ndarray:
    """A Gumbel variable at `location`, conditioned to be at most `bound`; minus infinity where there is no mass."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = location - np.log(np.exp(location - bound) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, out)


def sample_batch(model: Model, keys: np.ndarray, texts: list[str], k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k (ids, log-probability, noisy log-probability), then the noisy maximum of the rest."""
    unit_lists = [UNIT.findall(META + t.replace(" ", META)) if t else [] for t in texts]
    every = [u for units in unit_lists for u in units]
    index = dict.fromkeys(every)
    for k_th, u in enumerate(index):
        index[u] = k_th
    flat = list(map(index.__getitem__, every))
    unit, count = np.array(flat, np.int64), np.array([len(x) for x in unit_lists], np.int64)
    begin = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(texts)), count)
    ordinal = np.arange(len(unit)) - begin[doc] if len(unit) else np.empty(0, np.int64)
    lattices = Lattices(model, list(index))
    unit_key = mix(keys[doc] + ordinal.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    emitted: list[list] = [[] for _ in texts]
    regions: list[list] = [[] for _ in texts]  # (noisy maximum, turn it departs from, unit, paths excluded there, their chance)
    bound = -np.log(-np.log(uniform(keys, 0, 0)))
    turns: list[dict] = []
    popped: list[tuple | None] = [None] * len(texts)
    active = np.ones(len(texts), bool)
    for turn in range(k):
        if turn:
            for d in np.flatnonzero(active):
                if regions[d] and regions[d][0][0] > -np.inf:
                    popped[d] = regions[d].pop(0)
                    bound[d] = popped[d][0]
                else:
                    active[d] = False
        if not active.any():
            break
        depart = np.array([p[2] if p else -1 for p in popped], np.int64)
        fresh = active[doc] & (ordinal >= depart[doc])
        where = np.flatnonzero(fresh)
        logp, steps = lattices.draw(unit[where], unit_key[where], turn)
        out, many = lattices.ids(len(where), steps)
        now = {"where": where, "logp": logp, "out": out, "end": np.cumsum(many), "many": many, "instead": {}}
        at_departure = depart[doc[where]] == ordinal[where]
        for j in np.flatnonzero(at_departure).tolist():
            i = where[j]
            logp[j], own = lattices.draw_other(int(unit[i]), int(unit_key[i]), turn, popped[doc[i]][3])
            now["instead"][j] = np.array(own, np.int64)
        turns.append(now)
        # The rest of each popped region, by the unit at which a path departs.
        taken = np.exp(now["logp"])
        spent = np.array([p[4] if p else 0.0 for p in popped])
        # Fixed choices before the departure, and the mass of the choices since.
        prefix = np.array([_prefix(turns, p, d, begin) if p else 0.0 for d, p in enumerate(popped)])
        own = np.concatenate(([0.0], np.cumsum(now["logp"])))
        first_of = np.searchsorted(doc[where], np.arange(len(texts)))
        upto = own[:-1] - own[first_of[doc[where]]] + prefix[doc[where]] if len(where) else np.empty(0)
        rest = 1.0 - (taken + np.where(at_departure, spent[doc[where]], 0.0))
        rest[lattices.single[unit[where]]] = 0.0
        known: dict[tuple, float] = {}  # what one path leaves of a unit depends on its chance alone
        for j in np.flatnonzero((rest < SMALL_REST) & ~lattices.single[unit[where]]).tolist():
            own_ids = now["instead"].get(j)
            same = None if at_departure[j] else (unit[where[j]], logp[j])
            if same not in known:
                path = lattices.lengths(_slice(now, j, j + 1) if own_ids is None else own_ids)
                known[same] = lattices.rest(int(unit[where[j]]), [*(popped[doc[where[j]]][3] if at_departure[j] else []), path])
            rest[j] = known.pop(None) if same is None else known[same]
        with np.errstate(divide="ignore"):
            location = upto + np.log(rest)
        g = gumbel_below(location, bound[doc[where]], uniform(unit_key[where], turn, 1 << 20))
        edges = np.searchsorted(doc[where], np.arange(len(texts) + 1))
        for d in np.flatnonzero(active):
            a, b = int(edges[d]), int(edges[d + 1])
            p = popped[d]
            emitted[d].append((_ids(turns, turn, popped[d], d, begin, edges, lattices), float((prefix[d] if p else 0.0) + own[b] - own[a]), float(bound[d])))
            mine = g[a:b]
            best = np.argpartition(-mine, k)[: k + 1] if len(mine) > k + 1 else np.arange(len(mine))
            for j in best:
                if mine[j] > -np.inf:
                    o = int(ordinal[where[a + j]])
                    same = p is not None and o == p[2]
                    own_ids = now["instead"].get(a + j)
                    path = lattices.lengths(_slice(now, a + j, a + j + 1) if own_ids is None else own_ids)
                    regions[d].append((float(mine[j]), turn, o, [*(p[3] if same else []), path], float(taken[a + j]) + (p[4] if same else 0.0)))
            regions[d].sort(key=lambda r: -r[0])
            del regions[d][k + 1 :]
        now["popped"], now["edges"] = [*popped], edges
    return [[(ids, lp, g, regions[d][0][0] if regions[d] else -np.inf) for ids, lp, g in e] for d, e in enumerate(emitted)]


def _chain(turns: list, turn: int, popped, d: int) -> list[tuple[int, int]]:
    """(turn, first unit) of the stretches of which the text's path at `turn` is made, the last stretch first."""
    out, p = [], popped
    while True:
        out.append((turn, p[2] if p else 0))
        if p is None:
            return out
        turn, p = p[1], turns[p[1]]["popped"][d]


def _prefix(turns: list, popped: tuple, d: int, begin) -> float:
    """The log-probability of the choices before the departure."""
    total, end = 0.0, popped[2]
    for turn, first in _chain(turns, popped[1], turns[popped[1]]["popped"][d], d):
        if first < end:
            a = int(turns[turn]["edges"][d])
            total += float(turns[turn]["logp"][a : a + end - first].sum())
            end = first
    return total


def _ids(turns: list, turn: int, popped, d: int, begin, edges, lattices: Lattices) -> np.ndarray:
    """The pieces of the text's path at `turn`, stretch by stretch; unknown characters as their bytes."""
    parts, end = [], int(begin[d + 1] - begin[d])
    for t, first in _chain(turns, turn, popped, d):
        if first < end:
            now = turns[t]
            a = int((edges if t == turn else now["edges"])[d])
            b = a + end - first
            if a in now["instead"]:  # a stretch begins with the unit of departure
                parts.append(np.concatenate((now["instead"][a], _slice(now, a + 1, b))))
            else:
                parts.append(_slice(now, a, b))
            end = first
    out = np.concatenate(parts[::-1]) if parts else np.empty(0, np.int64)
    if len(out) and out.min() < 0:
        spelled = [[int(i)] if i >= 0 else [lattices.model.bytes[b] for b in lattices.unknown[-1 - int(i)].encode("utf-8", "replace")] for i in out]
        out = np.array([i for x in spelled for i in x], np.int64)
    return out.astype(np.int32)


def _slice(now: dict, a: int, b: int) -> np.ndarray:
    if a >= b:
        return np.empty(0, np.int64)
    return now["out"][int(now["end"][a] - now["many"][a]) : int(now["end"][b - 1])]


def row_keys(ids: list, seed: int) -> np.ndarray:
    given = np.array([i if i is not None else -(1 << 62) for i in ids], np.int64).view(np.uint64)
    return mix(mix(given + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed))


def decode_bytes(model: Model, ids) -> bytes:
    """The text of ids in UTF-8: pieces and bytes joined, without the space put before the first word."""
    ids = np.asarray(ids, np.int64)
    sizes = model.plain_size[ids]
    ends = np.cumsum(sizes, dtype=np.int64)
    at = np.arange(int(ends[-1]) if len(ids) else 0) + np.repeat(model.plain_at[ids] - (ends - sizes), sizes)
    return model.plain_all[at].tobytes()[1:]


def decode(model: Model, ids: list[int]) -> str:
    return decode_bytes(model, ids).decode("utf-8", "replace")


def sample_segmentations(docs: DataFrame, model_path: str, samples: int = SAMPLES, alpha: float = 1.0, seed: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sample (0.. by falling noisy log-probability), n_pieces, ids_crc32 (of unsigned 32-bit ids), log_prob, inclusion, its logarithm (of use
    where the score is too small for a number, as in long texts), decoded_crc32, and the ids."""

    def run(batches):
        model = Model.of_process(model_path, alpha)
        for batch in batches:
            doc_ids, texts = batches_of(["d", "t"], batch)
            a = 0
            while a < len(texts):
                b, chars = a, 0
                while b < len(texts) and (b == a or chars + len(texts[b]) <= BATCH_CHARS):
                    chars += len(texts[b])
                    b += 1
                rows = []
                for d, found in zip(doc_ids[a:b], sample_batch(model, row_keys(doc_ids[a:b], seed), texts[a:b], samples), strict=True):
                    for s, (ids, logp, _, rest) in enumerate(found):
                        above = min(700.0, logp - rest) if rest > -np.inf else 700.0
                        inclusion = -np.expm1(-np.exp(above))
                        log_inclusion = above if above < -30 else float(np.log(inclusion))  # the score itself runs out of range
                        plain = decode_bytes(model, ids)
                        rows.append((d, s, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), logp, float(inclusion), log_inclusion, zlib.crc32(plain), *([ids] if with_ids else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "inclusion", "log_inclusion", "decoded_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names[: 8 + with_ids])
                a = b

    keyed = docs.select(F.col(id_col).cast("bigint").alias("d"), text_or_empty(text_col).alias("t"))
    return keyed.mapInArrow(run, "doc_id bigint, sample int, n_pieces bigint, ids_crc32 bigint, log_prob double, inclusion double, log_inclusion double, decoded_crc32 bigint" + ", ids array<int>" * with_ids)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids that the library gives the whole text; a null text counts as empty and has none."""

    def run(batches):
        library = library_of_process(model_path)
        for batch in batches:
            ids = library.encode(batch.column(1).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("t")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str, alpha: float = 1.0) -> DataFrame:
    """doc_id and the text of its `ids`, whichever segmentation they are; null ids give a null text."""

    def run(batches):
        model = Model.of_process(model_path, alpha)
        for batch in batches:
            texts = [None if ids is None else decode(model, ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def library_of_process(path: str):
    import sentencepiece

    store = process_store("sentencepiece")
    if path not in store:
        store[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return store[path]


def op6_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import vocabulary_path

    return sample_segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("piece_bpe_32k.model"), with_ids=False)
