"""Personal data in texts, plain and disguised, with offsets into the source.

Plain identifiers (e-mail, ip, card, phone) are found by patterns.  Disguised ones are found in a normalised copy of the
text: transducers rewrite homoglyphs and invisible characters, spelled digits, and "at" / "dot" disguises, and keep for
every character of the copy the source characters it stands for.  What the patterns find in the copy is mapped back, so
a span always covers source characters.  A disguised span counts only if it contains a rewritten character and overlaps
no plain span.

All searches are linear in the text, however long its runs of digits or letters are.

Cases: a null text counts as empty and has no spans; repeated rows are repeated in the result; a null doc_id is kept; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, process_store, ship, text_or_empty
from .spans import Span, digest, outside, written

ship(__name__)

KINDS = ("email", "ip", "card", "phone")

# ---- plain identifiers ----------------------------------------------------------------------------------------

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Local part: the run of its characters that ends at an @; so each @ needs one look to either side."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)  # no match can begin in a run that ends at an @ and fails
        at = text.find("@", max(end, at + 1))
    return out


def plain(text: str) -> list[Span]:
    """All base spans by kind, then start."""
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


# ---- transducers ----------------------------------------------------------------------------------------------

#: Letters of other scripts that look like these Latin letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "∙": ".", "·": ".", "＠": "@", "﹫": "@",
}
#: Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿᠎"
#: Names of digits.
DIGIT_NAMES = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Characters of the words of a local part, and the length of the longest dot between them.
WORD_CHARS = LOCAL_CHARS - {"."}
LONGEST_DOT = len(" ( punto ) ") + 1
#: Parameter: names of digits count when so many stand together, with figures or dots between them or not, or when names and
#: figures together have the digits of the shortest phone number; else they are words.
LEAST_SPELLED, LEAST_DIGITS = 4, 9


@dataclass(frozen=True)
class Evidence:
    """What tells an address from a place where a bare "at" and bare dots stand ("jan at firma.hu", "look at github.com").

    Points are added up, and `least` of them make an address: one for a top-level name that is known or has two letters,
    as all of countries have; two for a word of writing among the three before; none for a host that begins with www.  Two
    are taken off for a word of place before "at", three for a pronoun that something stands before ("write to us at").
    All are parameters; the words are English.
    """

    top_names: frozenset[str] = frozenset("com org net edu gov mil int info biz name pro dev app xyz online site tech store blog cloud email agency company digital group media network".split())
    writing: frozenset[str] = frozenset("mail email e-mail mailto write wrote writing ask asking contact message ping send sent reply cc bcc address from to forward".split())
    places: frozenset[str] = frozenset(
        """look looking looked looks see seen meet meeting met visit find found available hosted is are was were be been being here there online
        website site page pages more out up only now live lives work works working worked stay arrive arrived start end read download buy contact
        reach stop shop sign log login or and not that this these those also even all""".split()
    )
    pronouns: frozenset[str] = frozenset("me us you him her them it".split())
    least: int = 1

    def is_address(self, before: str, local: str, host: str, spaced: bool) -> bool:
        """`before` is what stands before the local part; `spaced` whether spaces stand around "at"."""
        if host.lower().startswith("www."):
            return False
        top, word = host.rpartition(".")[2].lower(), re.split("[^A-Za-z]", local.lower())[-1]
        words = re.findall(r"[a-z-]+", before[-80:].lower())[-3:]
        first = not before.strip() or before.rstrip(" \t")[-1:] in ":;,.!?\n\r("
        points = int(top in self.top_names or (len(top) == 2 and top.isalpha()))
        if spaced and not first and self.writing & set(words):
            points += 2
        if word in self.pronouns and not first:
            points -= 3
        elif word in self.places and not (first and word == "contact"):
            points -= 2
        return points >= self.least


EVIDENCE = Evidence()


def glyphs() -> dict[int, str]:
    """Code point to ASCII: look-alikes, invisible characters, and what compatibility forms reduce to one ASCII character."""
    table = {ord(c): v for c, v in LOOKALIKES.items()} | {ord(c): "" for c in INVISIBLE}
    ranges = [(0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2070, 0x2090), (0x2460, 0x24EB), (0x00B2, 0x00BA), (0x0660, 0x066A), (0x06F0, 0x06FA), (0x0966, 0x0970)]
    for first, end in ranges:
        for c in range(first, end):
            plain_form = unicodedata.normalize("NFKC", chr(c))
            digit = unicodedata.digit(chr(c), None)
            if digit is not None:
                plain_form = str(digit)
            if len(plain_form) == 1 and plain_form.isascii():
                table.setdefault(c, plain_form)
    return table


def tools() -> dict:
    """Tables and patterns of the transducers, made once in a process."""
    store = process_store("pii")
    if not store:
        table = glyphs()
        store["table"] = table
        # Runs of code points: beyond the basic plane each item of a class is tried by itself.
        firsts, lasts = (sorted(c for c in table if c + k not in table) for k in (-1, 1))
        store["glyph"] = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(firsts, lasts, strict=True)) + "]")
        name = "(?:" + "|".join(sorted(DIGIT_NAMES, key=len, reverse=True)) + ")"
        store["name"] = re.compile(rf"(?<![A-Za-z]){name}(?![A-Za-z])", re.I | re.A)
        atom = rf"(?:{name}(?![A-Za-z])|[0-9]++|(?:plus|dot)(?![A-Za-z]))"
        store["spelled"] = re.compile(rf"(?<![A-Za-z]){atom}(?:[ ,.-]{{1,2}}{atom})++", re.I | re.A)
        store["atom"] = re.compile(rf"{name}|[0-9]|plus|dot|[ ,.-]++", re.I | re.A)
        dot = r"(?: ?[\[({<] ?(?:dot|punto|punkt|point) ?[\])}>] ?|[ _-]dot[ _-]| ?[\[({<] ?\. ?[\])}>] ?)"
        at = r"(?: ?[\[({<] ?(?:at|@|arroba|ät) ?[\])}>] ?|[ _-]at[ _-]| @ )"
        host = r"(?:(?![_-]dot[_-])[A-Za-z0-9-])++"
        # A plain " at " or " dot " is a disguise only if a whole address stands around it.
        store["at"] = re.compile(rf"@|{at}", re.I)
        store["domain"] = re.compile(rf"{host}(?P<more>(?:(?:\.|{dot}){host})++)?+", re.I)
        store["dot_before"] = re.compile(rf"(?:\.|{dot})\Z", re.I)
        store["dotted"] = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{dot})[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
        store["dot"] = re.compile(dot, re.I)
        # A look that costs little: brackets around a disguise's words, a spelled dot, or a plain " at " before a dotted host.
        store["hint"] = re.compile(r"[\[({<] ?(?:at|@|arroba|ät|dot|punto|punkt|point|\.) ?[\])}>]|[ _-](?:dot[ _-]|at[ _-][A-Za-z0-9-]++\.[A-Za-z0-9-])| @ ", re.I)
    return store


class Copy:
    """A normalised copy: its text, and for each of its characters the first and last source character it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.first = range(len(text))
        self.last = range(1, len(text) + 1)
        self.rewritten: set[int] = set()  # source characters that a transducer changed

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace parts (start, end, new) of the copy, in order and apart from each other."""
        parts, first, last, at = [], [], [], 0
        for a, b, new in changes:
            parts += [self.text[at:a], new]
            first += self.first[at:a]
            last += self.last[at:a]
            sa, sb = self.first[a], self.last[b - 1]
            self.rewritten.update(range(sa, sb))
            first += [sa] * len(new)
            last += [sb] * len(new)
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.first = [*first, *self.first[at:]]
        self.last = [*last, *self.last[at:]]


def homoglyphs(copy: Copy) -> None:
    """Only words that hold ASCII as well, or stand in an address, could be meant; the patterns decide that later."""
    t = tools()
    copy.rewrite([(m.start(), m.end(), t["table"][ord(m[0])]) for m in t["glyph"].finditer(copy.text)])


def spelled_digits(copy: Copy, least_spelled: int = LEAST_SPELLED) -> None:
    t, changes = tools(), []
    for m in t["spelled"].finditer(copy.text):
        atoms = [(x.start(), x.end(), x[0]) for x in t["atom"].finditer(m[0])]
        names = sum(a[2].lower() in DIGIT_NAMES for a in atoms)
        if names < least_spelled and not (names and names + sum(a[2].isdigit() for a in atoms) >= LEAST_DIGITS):
            continue
        for k, (a, b, what) in enumerate(atoms):
            a, b, low = a + m.start(), b + m.start(), what.lower()
            inside = 0 < k < len(atoms) - 1
            if low in DIGIT_NAMES:
                changes.append((a, b, DIGIT_NAMES[low]))
            elif low == "plus":
                changes.append((a, b, "+"))
            elif low == "dot":
                if inside:
                    changes.append((a, b, "."))
            elif not what[0].isdigit() and inside:
                joins = all(atoms[j][2].lower() in DIGIT_NAMES or atoms[j][2].lower() == "plus" for j in (k - 1, k + 1))
                by_dot = any(atoms[j][2].lower() == "dot" and 0 < j < len(atoms) - 1 for j in (k - 1, k + 1))
                if (joins or by_dot) and "." not in what:
                    changes.append((a, b, ""))
    copy.rewrite(changes)


def local_start(text: str, floor: int, at: int) -> int:
    """Where the dotted words that end at `at` begin, not before `floor`; `at` itself if there are none."""
    start = p = at
    while True:
        end = p
        while p > floor and text[p - 1] in WORD_CHARS:
            p -= 1
        if p == end:
            return start
        start = p
        dot = tools()["dot_before"].search(text, max(floor, p - LONGEST_DOT), p)
        if not dot:
            return start
        p = dot.start()


BARE_AT = frozenset(p + "at" + q for p in " _-" for q in " _-")


def counts(text: str, start: int, at: tuple[int, int], host: str, evidence: Evidence) -> bool:
    """Whether a bare "at" makes an address: with a disguised dot beside it always, else by the evidence."""
    local = text[start : at[0]]
    if tools()["dot"].search(local) or tools()["dot"].search(host):
        return True
    return evidence.is_address(text[max(0, start - 80) : start], local, host, text[at[0] : at[1]].lower() == " at ")


def addresses(copy: Copy, evidence: Evidence = EVIDENCE) -> None:
    """At and dot disguises of e-mail addresses, and dot disguises of ip addresses.

    Each at sign is taken by itself, with one look to either side, as in `emails`; nothing else in the text matters.
    """
    t, changes, floor, dead = tools(), [], 0, 0
    for m in t["at"].finditer(copy.text):
        a, b = m.span()
        if a < dead:
            continue  # within a host
        found = t["domain"].match(copy.text, b)
        dead = found.end() if found else b
        start = local_start(copy.text, floor, a) if found and found["more"] else a
        floor = b
        if start == a or (m[0].lower() in BARE_AT and not counts(copy.text, start, (a, b), found[0], evidence)):
            continue
        floor = dead
        changes += [(start + d.start(), start + d.end(), ".") for d in t["dot"].finditer(copy.text[start:a])]
        if b - a > 1:
            changes.append((a, b, "@"))
        changes += [(b + d.start(), b + d.end(), ".") for d in t["dot"].finditer(copy.text[b:dead])]
    copy.rewrite(changes)
    copy.rewrite([(m.start() + d.start(), m.start() + d.end(), ".") for m in t["dotted"].finditer(copy.text) for d in t["dot"].finditer(m[0])])


def disguised(text: str, base: list[Span], least_spelled: int = LEAST_SPELLED, evidence: Evidence = EVIDENCE) -> list[Span]:
    """Spans that show only after normalisation, mapped back to the source."""
    t = tools()
    glyph = not text.isascii() and t["glyph"].search(text)
    name = t["name"].search(text)
    hint = t["hint"].search(text)
    if not (glyph or name or hint):
        return []
    copy = Copy(text)
    if glyph:
        homoglyphs(copy)
    spelled_digits(copy, least_spelled)
    if hint or t["hint"].search(copy.text):
        addresses(copy, evidence)
    if not copy.rewritten:
        return []
    found = []
    for kind, a, b in plain(copy.text):
        start, end = copy.first[a], copy.last[b - 1]
        if any(i in copy.rewritten for i in range(start, end)):
            found.append((kind, start, end))
    return outside(found, base)


def all_spans(text: str, least_spelled: int = LEAST_SPELLED, evidence: Evidence = EVIDENCE) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and disguised spans together; both by kind as listed, then start."""
    base = plain(text)
    more = disguised(text, base, least_spelled, evidence)
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + more, key=lambda s: (order[s[0]], s[1])) if more else base


# ---- documents ------------------------------------------------------------------------------------------------


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_spelled: int = LEAST_SPELLED, evidence: Evidence = EVIDENCE) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256, spans, and counts of the disguised spans."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"]

    def run(batches):
        for batch in batches:
            ids, texts = batches_of(["d", "t"], batch)
            rows = []
            for d, text in zip(ids, texts, strict=True):
                base, every = all_spans(text, least_spelled, evidence)
                rows.append((d, *(sum(s[0] == k for s in base) for k in KINDS), digest(base), written(every), len(every) - len(base)))
            kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)

    keyed = docs.select(F.col(id_col).cast("bigint").alias("d"), text_or_empty(text_col).alias("t"))
    return keyed.mapInArrow(run, ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'bigint'}" for n in names))


def masked(text: str, least_spelled: int = LEAST_SPELLED, evidence: Evidence = EVIDENCE) -> str:
    """The text with every span replaced by the name of its kind; spans that overlap are replaced as one."""
    spans = sorted(all_spans(text, least_spelled, evidence)[1], key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, text_col: str = "text", least_spelled: int = LEAST_SPELLED, evidence: Evidence = EVIDENCE) -> DataFrame:
    """All columns and rows of `docs`, with personal data in the text column replaced; a null text stays null."""

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = [t if t is None else masked(t, least_spelled, evidence) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def op1_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
