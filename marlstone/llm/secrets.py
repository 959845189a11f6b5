"""Secrets in texts, by patterns and by zstandard novelty in sensitive contexts.

Patterns find assignments to secret-like names, access keys and long hexadecimal strings.  Beyond those, each string
that stands in a sensitive context is measured: a compressor primed with the text around it and with a dictionary of
identifiers compresses the surrounding text with and without the candidate, and the difference is the candidate's
marginal size in bytes.  Identifiers, paths and prose compress against what surrounds them or against the dictionary; a
random string costs nearly its entropy.  Candidates that stay incompressible are reported as `novel`.

Strings with letters and figures, and strings of figures alone, are measured in bytes against a raw dictionary.  A string of letters
alone takes whole bytes there whether it is a word or not, so it is measured in bits against a dictionary trained on
identifiers, which carries the letters' frequencies: words cost less than letters drawn at random, and those cost more than
the entropy of their alphabet.

A candidate has `least_length` characters or more and begins within `reach` characters after a context word; both are
parameters of the operator.  The search is linear in the text.

Cases: a null text counts as empty and has no spans; repeated rows are repeated in the result; a null doc_id is kept; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, process_store, ship, text_or_empty
from .spans import Span, digest, outside, written

ship(__name__)

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: The words with which an assignment begins, in lower case; none in a text, no assignment.
ASSIGN_WORDS = ("passw", "secret", "token", "api_key", "apikey")

#: Words that make what follows them sensitive.
CONTEXT_WORDS = ("password", "passphrase", "passwd", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "private_key", "privatekey", "signing_key", "encryption_key", "client_key", "auth", "authorization", "bearer", "credential", "credentials", "session_id", "sessionid", "webhook")
#: The text on either side of a candidate that primes the compressor, in characters.
SURROUNDING = 256
#: Parameter: a candidate starts within so many characters after its context word.
REACH = 40
#: Marginal bytes a character from which a candidate is incompressible.  Random base64 takes 0.75 and random hexadecimal
#: 0.5 where the literals are entropy-coded, and both nearly 1 where the surroundings are too short for that.
NOVEL, NOVEL_HEX = 0.7, 0.5
#: Bits a character, as a multiple of the alphabet's, from which a string of letters alone is incompressible: against the
#: trained dictionary words and identifiers take 1.03 at most as a rule, random letters 1.16 or more.
NOVEL_LETTERS = 1.12
#: Parameter: what is shorter is no candidate.
LEAST_LENGTH = 16
CONTEXT = re.compile(r"(?<![A-Za-z])(?:" + "|".join(sorted(map(re.escape, CONTEXT_WORDS), key=len, reverse=True)) + r")(?![a-z])", re.I | re.A)
CONTEXT_STEMS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "session", "webhook")
#: Parts of which identifiers are made; with the context words they are the identifier dictionary.
IDENTIFIER_PARTS = """
get set put add remove delete create update insert select find search load save read write open close start stop run
init make build parse format encode decode encrypt decrypt hash sign verify check test assert validate convert render
config configuration settings options default value values name names key keys index count size length width height
user users account accounts client clients server servers service services manager handler controller factory builder
request response session sessions message messages event events queue stream buffer cache store storage database table
column row rows record records field fields string number integer float double boolean object array list map dict tuple
file files path paths folder directory url uri host port address domain email phone date time timestamp zone version
public private protected static final const class interface function method return import export module package
example placeholder changeme your-key-here xxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
http https www com org net json xml html yaml toml http://localhost:8080/ https://www.example.com/ /usr/local/bin/
"""


def plain(text: str) -> list[Span]:
    """All base spans by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _tools(kind: str, make):
    """Compressors and the like, made once in a process."""
    store = process_store("secrets")
    if kind not in store:
        store[kind] = make()
    return store[kind]


def compressor():
    """The compressor primed with the identifier dictionary."""

    def make():
        import zstandard

        parts = IDENTIFIER_PARTS.split()
        joined = [a + b.title() for a in parts[:40] for b in parts[40:90:3]] + [f"{a}_{b}" for a in parts[40:80] for b in parts[80:120:4]]
        words = " ".join([*joined, *parts, *(p.title() for p in parts), *CONTEXT_WORDS])
        primed = zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_dict_id=False)

    return _tools("raw", make)


def identifier_samples(n: int = 1500, each: int = 40, seed: int = 7) -> list[bytes]:
    """Invented identifiers, dates and numbers, made of the identifier parts by a fixed rule."""
    import random

    rng, parts = random.Random(seed), [p for p in IDENTIFIER_PARTS.split() if p.isalpha()]
    number = lambda: str(rng.randrange(10 ** rng.randint(1, 18)))
    shapes = [
        "_".join, " ".join, "-".join, lambda w: "_".join(w).upper(), lambda w: "".join(x.title() for x in w), lambda w: w[0] + "".join(x.title() for x in w[1:]),
        lambda w: "/".join(w) + number()[:3], lambda w: number(), lambda w: f"{rng.randint(1990, 2040)}-{rng.randint(1, 12):02d}-{rng.randint(1, 31):02d}T{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00Z",
    ]
    return [" ".join(rng.choice(shapes)([rng.choice(parts) for _ in range(rng.randint(1, 4))]) for _ in range(each)).encode() for _ in range(n)]


def letter_compressor():
    """The compressor with the dictionary trained on identifiers, and a text to begin with.

    Every block begins with it, so that the frequencies of letters are always in use: words spelled backwards, which match nothing.
    """

    def make():
        import zstandard

        trained = zstandard.train_dictionary(16 << 10, identifier_samples(), level=9)
        words = [p[::-1] for p in IDENTIFIER_PARTS.split() if p.isalpha()][:110]
        shown = [w if k % 4 else w.title() if k % 8 else f"{w.upper()}_{k * 7919 * 7919 % 1_000_003}" for k, w in enumerate(words)]
        return zstandard.ZstdCompressor(level=9, dict_data=trained, write_content_size=False, write_dict_id=False), (" ".join(shown) + " ").encode()

    return _tools("letters", make)


def marginal_bytes(text: str, start: int, end: int) -> int:
    """What the candidate adds to the compressed size of the text around it."""
    before, after = text[max(0, start - SURROUNDING) : start], text[end : end + SURROUNDING]
    c = compressor()
    around = (before + " " + after + " ").encode("utf-8", "replace")
    return len(c.compress(around + text[start:end].encode())) - len(c.compress(around))


def letter_bits(text: str, start: int, end: int) -> float:
    """Marginal bits a character of a string without figures, as a multiple of what its alphabet's entropy would be."""
    own = text[start:end]
    before, after = text[max(0, start - SURROUNDING) : start], text[end : end + SURROUNDING]
    c, lead = letter_compressor()
    around = lead + (before + " " + after + " ").encode("utf-8", "replace")
    alphabet = sum(n for part, n in (("[a-z]", 26), ("[A-Z]", 26), ("[+/_.=~-]", 3)) if re.search(part, own))
    return 8 * (len(c.compress(around + own.encode())) - len(c.compress(around))) / (len(own) * math.log2(alphabet))


def is_novel(text: str, start: int, end: int) -> bool:
    own = text[start:end]
    if not re.search("[0-9]", own):
        return letter_bits(text, start, end) >= NOVEL_LETTERS
    return marginal_bytes(text, start, end) >= (NOVEL_HEX if re.fullmatch("[0-9a-fA-F]+", own) else NOVEL) * len(own)


def candidates(text: str, least_length: int = LEAST_LENGTH, reach: int = REACH) -> list[Span]:
    """Strings that begin within `reach` after a context word; contexts and candidates are walked once, side by side."""
    candidate = _tools(f"candidate {least_length}", lambda: re.compile(r"[A-Za-z0-9+/_.=~-]{%d,}" % least_length))
    found, end, c = [], 0, None
    for m in CONTEXT.finditer(text):
        at = max(m.end(), end)
        if c is None or c.start() < at:
            c = candidate.search(text, at)
        # The candidate may begin within the reach and run on beyond it.
        while c and c.start() <= m.end() + reach:
            a, b = c.span()
            while b > a and text[b - 1] in ".=-":
                b -= 1
            if b - a >= least_length:
                found.append(("novel", a, b))
            end = c.end()
            c = candidate.search(text, end)
        if c is None:
            break
    return found


def novel(text: str, base: list[Span], least_length: int = LEAST_LENGTH, reach: int = REACH) -> list[Span]:
    """Incompressible candidates in sensitive contexts that no base span touches."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_STEMS):
        return []
    return [s for s in outside(candidates(text, least_length, reach), base) if is_novel(text, s[1], s[2])]


def all_spans(text: str, least_length: int = LEAST_LENGTH, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    base = plain(text)
    more = novel(text, base, least_length, reach)
    order = {k: i for i, k in enumerate((*KINDS, "novel"))}
    return base, sorted(base + more, key=lambda s: (s[1], order[s[0]])) if more else base


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, reach: int = REACH) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256, spans, and the count of novel strings."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_novel"]

    def run(batches):
        for batch in batches:
            ids, texts = batches_of(["d", "t"], batch)
            rows = []
            for d, text in zip(ids, texts, strict=True):
                base, every = all_spans(text, least_length, reach)
                rows.append((d, *(sum(s[0] == k for s in base) for k in KINDS), digest(base), written(every), len(every) - len(base)))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names)

    keyed = docs.select(F.col(id_col).cast("bigint").alias("d"), text_or_empty(text_col).alias("t"))
    return keyed.mapInArrow(run, ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'bigint'}" for n in names))


def op3_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
