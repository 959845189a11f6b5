"""Vectors: cosine similarity, the FNV hash, and the hashed bag-of-words embedding."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from . import arrow, ship

ship(__name__)

TOKEN = re.compile(r"(?:[^\W_]|')+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; 0 where either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


# ---- half precision -------------------------------------------------------------------------------------------


def half_bits(x: Column) -> Column:
    """The binary16 nearest to a number (ties to the even one), as its 16 bits in a short; too large ones are infinite, null stays null.

    The exponent is the power of two at or below the size; within it, and below 2^-14, numbers lie a fixed step apart, and
    counting steps gives the bits: a carry from the last of them into the exponent is the next number anyway.
    """
    size = F.abs(x.cast("double"))
    near = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size).otherwise(1.0)))
    # The logarithm may be off by a rounding beside a power of two.
    exact = near + (size >= F.pow(F.lit(2.0), near + 1)).cast("int") - (size < F.pow(F.lit(2.0), near)).cast("int")
    exponent = F.greatest(exact, F.lit(-14))
    steps = F.rint(size * F.pow(F.lit(2.0), 10 - exponent)).cast("bigint")
    finite = F.when(size < F.pow(F.lit(2.0), F.lit(-14)), steps).otherwise((exponent + 15) * 1024 + steps - 1024)
    bits = F.when(F.isnan(x), 0x7E00).when(size >= 65520.0, 0x7C00).otherwise(finite)
    negative = (x < 0) | (x.cast("string") == "-0.0")
    return F.when(negative & ~F.isnan(x), bits - 0x8000).otherwise(bits).cast("smallint")


def half_value(bits: Column) -> Column:
    """The number that 16 bits stand for."""
    low = F.pmod(bits.cast("int"), F.lit(0x8000))
    exponent, part = F.floor(low / 1024).cast("int"), low % 1024
    size = F.when(exponent == 31, F.when(part == 0, float("inf")).otherwise(float("nan"))).when(exponent == 0, part * 2.0**-24).otherwise((1024 + part) * F.pow(F.lit(2.0), exponent - 25))
    return F.when(bits < 0, -size).otherwise(size)


def to_half(vector: Column) -> Column:
    """A vector stored as shorts, half of its size in single precision."""
    return F.transform(vector, half_bits)


def from_half(vector: Column) -> Column:
    """Its numbers as doubles, for products."""
    return F.transform(vector, half_value)


# ---- stand-in embeddings --------------------------------------------------------------------------------------


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = 0x811C9DC5
    for unit in text.encode() if text.isascii() else np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
    return h


def embed_tokens(text: str) -> list[str]:
    """Lower-cased words without the very common ones, unless nothing else is there."""
    every = TOKEN.findall(text.lower())
    return [t for t in every if t not in C.EMBED_STOP_WORDS] or every


class Hashes(dict):
    """The hashes of words; each word of some texts is hashed once."""

    def __missing__(self, word: str) -> int:
        self[word] = found = fnv1a(word)
        return found


def hashed_vector(text: str, dimensions: int = C.EMBEDDING_DIMENSIONS, hashes: Hashes | None = None) -> list[float]:
    tokens = embed_tokens(text)
    if not tokens:
        raise ValueError("an empty text has no embedding")
    v = np.zeros(dimensions)
    for t in tokens:
        v[(fnv1a(t) if hashes is None else hashes[t]) % dimensions] += 1
    return (v / np.sqrt((v * v).sum())).tolist()


def embedded(texts: pd.Series, dimensions: int = C.EMBEDDING_DIMENSIONS) -> list:
    """The vectors of texts; those without words have none."""
    hashes = Hashes()
    return [hashed_vector(t, dimensions, hashes) if t and TOKEN.search(t.lower()) else None for t in texts]


def hashed_embedding(dimensions: int = C.EMBEDDING_DIMENSIONS):
    """A vectorised function from texts to vectors; texts without words have none."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(embedded(texts, dimensions), dtype=object)

    return embed


@arrow("bigint")
def fnv(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fnv1a(t)).astype("Int64")


def shuffle_order(seed: str, ident: Column) -> Column:
    """A fixed pseudo-random order: the hash of seed and id (with the id itself as the tie-break)."""
    return fnv(F.concat(F.lit(seed + "\0"), ident.cast("string")))
