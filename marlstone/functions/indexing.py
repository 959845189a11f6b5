"""Excerpts with their lexemes and hashed vectors, a few texts at a time.

An excerpt is a run of whole sentences, so its words are those of its sentences: each sentence is taken apart once, each different
word is stemmed and hashed once, and what an excerpt has is put together from number arrays, as Arrow columns.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from . import ship
from .text import AT_ONCE, excerpt_ranges, lexeme, sentences, tokens, utf16
from .vector import TOKEN, fnv1a

ship(__name__)

#: Within such a run lie both kinds of words, those of lexemes (text.WORD) and those of vectors (vector.TOKEN), whole.
RUN = re.compile(r"[\w'-]+")
#: Two characters that a word may go over.
INSIDE = re.compile(r"[\w'-]{2}")
#: Characters that are taken apart together, and runs that a task remembers.
CHARS, RUNS = 1 << 18, 1_000_000


class Runs(dict):
    """Numbers of runs; for each its lexemes by position (-1 for a stop word) and the hashes of its tokens, told once."""

    def __init__(self) -> None:
        super().__init__()
        self.numbers: dict[str, int] = {}
        self.names: list[str] = []
        self.places, self.place_ends, self.hashes, self.common, self.token_ends = array("q"), array("q", [0]), array("q"), array("b"), array("q", [0])

    def __missing__(self, run: str) -> int:
        self[run] = number = len(self)
        plain = run.isalnum()
        for word in (run,) if plain else [word for word, _ in tokens(run)]:
            lex = lexeme(word)
            if lex and lex not in self.numbers:
                self.numbers[lex] = len(self.names)
                self.names.append(lex)
            self.places.append(self.numbers[lex] if lex else -1)
        self.place_ends.append(len(self.places))
        for token in (run,) if plain else TOKEN.findall(run):
            self.hashes.append(fnv1a(token))
            self.common.append(token in C.EMBED_STOP_WORDS)
        self.token_ends.append(len(self.hashes))
        return number


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _values(runs: np.ndarray, of_units: np.ndarray, ends: array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of the runs lie, and how many of them stand before each unit (a run's lie between two of `ends`)."""
    bounds = np.frombuffer(ends, np.int64)
    sizes = bounds[runs + 1] - bounds[runs]
    return _ranges(bounds[runs], sizes), np.concatenate(([0], np.cumsum(sizes)))[of_units]


def parts_of(text: str) -> tuple[list[tuple[str, str, int]], list[str], list[tuple[int, int]]]:
    """A text's excerpts (text.excerpts), units in lower case whose words are theirs, and the units of each excerpt.

    Units are sentences, or where one could end within a word, or a letter's lower case depend on what follows, the excerpts themselves.
    """
    spans = sentences(text)
    offsets, ranges = utf16(text, [a for a, _ in spans]), excerpt_ranges(spans, len(text))
    out = [(kind, text, 0) if kind == "full" else (kind, text[spans[a][0] : spans[b - 1][1]], offsets[a]) for kind, a, b in ranges]
    whole = any(a == b and INSIDE.fullmatch(text, b - 1, b + 1) for (_, b), (a, _) in zip(spans, spans[1:], strict=False))
    if whole or "Σ" in text:
        return out, [e.lower() for _, e, _ in out], [(k, k + 1) for k in range(len(out))]
    return out, [text[a:b].lower() for a, b in spans], [(a, b) for _, a, b in ranges]


def lexeme_maps(flat: np.ndarray, before: np.ndarray, first: np.ndarray, end: np.ndarray, names: list[str]) -> pa.Array:
    """Each excerpt's map from lexemes, in order, to positions; `flat` has the lexeme of each position of all units."""
    used, at = np.unique(flat, return_inverse=True)
    words = [names[i] if i >= 0 else "" for i in used.tolist()]
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    starts, sizes = before[first], before[end] - before[first]
    places = _ranges(starts, sizes)
    keys = np.repeat(np.arange(len(first)) * len(words), sizes) + rank[at[places]]
    positions = places - np.repeat(starts, sizes) + 1
    kept = flat[places] >= 0
    keys, positions = keys[kept], positions[kept].astype(np.int32)
    by_key = np.argsort(keys, kind="stable")
    keys = keys[by_key]
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(keys)), pa.int32()), pa.array(positions[by_key]))
    of_excerpts = np.bincount(keys[heads] // max(len(words), 1), minlength=len(first))
    lexemes = pa.array([words[i] for i in order], pa.string()).take(pa.array(keys[heads] % max(len(words), 1)))
    return pa.MapArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(of_excerpts))), pa.int32()), lexemes, lists)


def hashed_vectors(hashes: np.ndarray, common: np.ndarray, before: np.ndarray, first: np.ndarray, end: np.ndarray, dimensions: int) -> pa.Array:
    """Each excerpt's vector (vector.hashed_vector), null where it has no token."""
    units, bucket = np.repeat(np.arange(len(before) - 1), np.diff(before)), hashes % dimensions
    rare = common == 0
    counts = np.bincount(units[rare] * dimensions + bucket[rare], minlength=(len(before) - 1) * dimensions).reshape(-1, dimensions)
    sums = np.concatenate((np.zeros((1, dimensions), np.int64), np.cumsum(counts, axis=0)))
    vectors = (sums[end] - sums[first]).astype(np.float64)
    for k in np.flatnonzero(~vectors.any(axis=1)).tolist():  # nothing but very common words
        vectors[k] = np.bincount(bucket[before[first[k]] : before[end[k]]], minlength=dimensions)
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    some = lengths > 0
    values = (vectors[some] / lengths[some, None]).astype(np.float32)
    ends = np.concatenate(([0], np.cumsum(some) * dimensions))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~some, False)), pa.array(values.ravel()))


def _columns(ids: pa.Array, texts: list[str | None], runs: Runs, dimensions: int) -> pa.RecordBatch:
    which, parts, units, first, end = [], [], [], [], []
    for k, text in enumerate(texts):
        if text and text.strip():
            own, of_text, ranges = parts_of(text)
            which += [k] * len(own)
            parts += own
            first += [len(units) + a for a, _ in ranges]
            end += [len(units) + b for _, b in ranges]
            units += of_text
    found = [RUN.findall(u) for u in units]
    of_units = np.concatenate(([0], np.cumsum([len(f) for f in found], dtype=np.int64)))
    numbers = np.fromiter(map(runs.__getitem__, chain.from_iterable(found)), np.int64, of_units[-1])
    first, end = np.array(first, np.int64), np.array(end, np.int64)
    at, before = _values(numbers, of_units, runs.place_ends)
    lexemes = lexeme_maps(np.frombuffer(runs.places, np.int64)[at] if len(at) else at, before, first, end, runs.names)
    at, before = _values(numbers, of_units, runs.token_ends)
    hashes, common = (np.frombuffer(runs.hashes, np.int64)[at], np.frombuffer(runs.common, np.int8)[at]) if len(at) else (at, at)
    vectors = hashed_vectors(hashes, common, before, first, end, dimensions)
    of_parts = [pa.array([p[k] for p in parts], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int64())), *of_parts, vectors, lexemes], ["review_id", "kind", "text", "start_offset", "embedding", "lexemes"])


def _together(texts: list[str | None]):
    """Bounds of texts that are taken apart together."""
    a = size = 0
    for k, text in enumerate(texts):
        if k > a and (size > CHARS or k - a == AT_ONCE):
            yield a, k
            a, size = k, 0
        size += len(text or "")
    if texts:
        yield a, len(texts)


def indexed(reviews: DataFrame, dimensions: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """review_id, kind, text, start_offset, embedding, lexemes: what text.chunked gives with vector.embedded and text.lexemes."""

    def run(batches):
        runs = Runs()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _together(texts):
                yield _columns(batch.column(0).slice(a, b - a), texts[a:b], runs, dimensions)
                if len(runs) > RUNS:
                    runs = Runs()

    kind = reviews.select(id_col).schema[0].dataType.simpleString()
    schema = f"review_id {kind}, kind string, text string, start_offset int, embedding array<float>, lexemes map<string,array<int>>"
    return reviews.select(F.col(id_col).alias("review_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
