"""Full text: lexemes with positions, web-style queries, matching, cover-density rank, sentences and excerpts.

Offsets count UTF-16 code units, so they agree with what stores and browsers count.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from . import arrow, ship
from . import stemmer as S

ship(__name__)
ship(S.__name__)

WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
PART = re.compile(r"[^\W_]+")

# ---- lexemes --------------------------------------------------------------------------------------------------


def tokens(text: str, compounds: bool = True) -> Iterator[tuple[str, int]]:
    """Words with their positions from 1; a hyphenated word counts as itself (`compounds`) and then as each of its parts."""
    at = 0
    for m in WORD.finditer(text.lower()):
        parts = PART.findall(m[0])
        for w in [m[0], *parts] if compounds and len(parts) > 1 else parts:
            at += 1
            yield w, at


def lexeme(word: str) -> str | None:
    """The stem of a word, or nothing for a stop word."""
    return None if word in C.ENGLISH_STOP_WORDS else S.stem(word)


def vector_of(text: str, stems: dict[str, str | None] | None = None, lexeme: Callable[[str], str | None] = lexeme, compounds: bool = True) -> dict[str, list[int]]:
    """Each lexeme with its positions; stop words leave gaps.  Texts that share `stems` stem each word once."""
    stems = {} if stems is None else stems
    out: dict[str, list[int]] = {}
    for word, at in tokens(text or "", compounds):
        if word not in stems:
            stems[word] = lexeme(word)
        lex = stems[word]
        if lex:
            out.setdefault(lex, []).append(at)
    return dict(sorted(out.items()))


@arrow("map<string,array<int>>")
def lexemes(texts: pd.Series) -> pd.Series:
    stems: dict[str, str | None] = {}
    return texts.map(lambda t: None if t is None else vector_of(t, stems))


#: Words whose stems a task remembers.
STEMS = 1_000_000


def places_of(texts: list[str | None], lexemes: frozenset[str], stems: dict[str, str | None]) -> Iterator[tuple[int, str, list[int]]]:
    """(number of the text, lexeme, positions) of some lexemes, as `vector_of` gives them; `stems` says which word is one of them."""
    for k, text in enumerate(texts):
        found: dict[str, list[int]] = {}
        at = 0
        for word in WORD.findall((text or "").lower()):
            for w in [word, *PART.findall(word)] if "-" in word else (word,):
                at += 1
                if w not in stems:
                    stem = lexeme(w)
                    stems[w] = stem if stem in lexemes else None
                if lex := stems[w]:
                    found.setdefault(lex, []).append(at)
        yield from ((k, lex, places) for lex, places in found.items())
        if len(stems) > STEMS:
            stems.clear()


def lexeme_places(texts: DataFrame, lexemes: list[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, lexeme, positions: where some lexemes stand in each text; of the others nothing leaves Python."""
    wanted = frozenset(lexemes)

    def run(batches):
        stems: dict[str, str | None] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                rows = list(places_of(part.column(1).to_pylist(), wanted, stems))
                k, lex, places = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(k, pa.int64())), pa.array(lex, pa.string()), pa.array(places, pa.list_(pa.int32()))], ["id", "lexeme", "positions"])

    kind = texts.select(id_col).schema[0].dataType.simpleString()
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lexeme string, positions array<int>")


# ---- queries --------------------------------------------------------------------------------------------------

#: A query is a list of alternatives; each is a list of (negated, phrase), a phrase being lexemes with their distances.
Phrase = tuple[tuple[str, int], ...]
Alternatives = list[list[tuple[bool, Phrase]]]


def _phrase(text: str, lexeme: Callable[[str], str | None], compounds: bool) -> Phrase:
    found = [(lex, at) for word, at in tokens(text, compounds) if (lex := lexeme(word))]
    first = found[0][1] if found else 0
    return tuple((lex, at - first) for lex, at in found)


def parse_query(text: str, lexeme: Callable[[str], str | None] = lexeme, compounds: bool = True) -> Alternatives:
    """Words are all wanted; "quoted words" stand together; `or` separates alternatives; a leading minus excludes."""
    alternatives: Alternatives = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|([^\s"]+)', text):
        quoted, word = m[2], m[3] or ""
        minus = m[1] or (word[:1] if word.startswith("-") else "")
        if quoted is None and word.lower() == "or":
            if alternatives[-1]:
                alternatives.append([])
            continue
        phrase = _phrase(quoted if quoted is not None else word.lstrip("-"), lexeme, compounds)
        if phrase:
            alternatives[-1].append((bool(minus), phrase))
    return [a for a in alternatives if a]


def _has_phrase(vector: dict[str, list[int]], phrase: Phrase) -> bool:
    if not all(lex in vector for lex, _ in phrase):
        return False
    return any(all(at + d in set(vector[lex]) for lex, d in phrase) for at in vector[phrase[0][0]])


def matches(vector: dict[str, list[int]], query: Alternatives) -> bool:
    """Whether all of one alternative holds; an empty query matches nothing."""
    return any(all(_has_phrase(vector, p) != negated for negated, p in a) for a in query)


def cover_rank(vector: dict[str, list[int]], query: Alternatives) -> float:
    """Cover density: each shortest span with all wanted lexemes adds the mean weight over its length.

    A span of n lexemes that covers m positions counts 0.1 / (m - n + 1); 0.1 is the weight of plain text.
    """
    total = 0.0
    for wanted in query:
        names = {lex for negated, p in wanted if not negated for lex, _ in p}
        if not names or not all(n in vector for n in names):
            continue
        places = sorted((at, n) for n in names for at in vector[n])
        seen: dict[str, int] = {}
        last_start = -1
        for k, (at, n) in enumerate(places):
            seen[n] = k
            if len(seen) == len(names):
                start = min(seen.values())
                if start > last_start:
                    noise = (at - places[start][0]) - (k - start)
                    total += 0.1 / (1 + max(noise, 0))
                    last_start = start
    return round(total, 9)  # equal densities are equal, whatever order they were summed in


def lexical(vector: dict[str, list[int]], query_text: str, rule: str = "half-specific", generic: list[str] = ()) -> bool:
    """Whether words match by one of the rules: all, any, half, or half of what is not generic."""
    if matches(vector, parse_query(query_text)):
        return True
    if rule == "all":
        return False
    names = set(vector_of(query_text))
    if rule == "any":
        return any(n in vector for n in names)
    if rule == "half-specific":
        names -= set(vector_of(" ".join(generic)))
    present = sum(n in vector for n in names)
    return bool(names) and 2 * present >= len(names)


def match_columns(rows: DataFrame, column: str, texts: dict[int, tuple[str, list[str]]], rule: str = "half-specific") -> DataFrame:
    """full_match, word_rank and lexical of each row for its query (query_id), from its lexeme positions.

    Only rows that have one of the query's lexemes are looked into, unless the query asks for what lacks a word.
    """
    parsed = {i: (parse_query(t), t, g) for i, (t, g) in texts.items()}
    lexemes_of = {i: sorted({lex for a in q for _, p in a for lex, _ in p} | set(vector_of(t))) for i, (q, t, _) in parsed.items()}
    lacking = {i for i, (q, _, _) in parsed.items() if any(all(negated for negated, _ in a) for a in q)}
    wanted = rows.sparkSession.createDataFrame([(i, names, i in lacking) for i, names in lexemes_of.items()] or [(0, [], False)], "query_id bigint, _names array<string>, _lacking boolean")
    # A row a query, and there are MAX_BATCH queries at most.
    told = rows.join(F.broadcast(wanted), "query_id", "left")
    worth = F.col("_lacking") | F.arrays_overlap(F.map_keys(F.col(column)), F.col("_names"))

    @F.pandas_udf("struct<full_match:boolean,word_rank:double,lexical:boolean>")
    def judge(ids: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        out = []
        for i, v in zip(ids, vectors, strict=True):
            query, text, generic = parsed[i]
            if v is None or not text:
                out.append((False, 0.0, False))
                continue
            vector = {k: list(p) for k, p in v.items()}
            full = matches(vector, query)
            out.append((full, cover_rank(vector, query) if full else 0.0, full or lexical(vector, text, rule, generic)))
        return pd.DataFrame(out, columns=["full_match", "word_rank", "lexical"])

    empty = F.lit(None).cast("map<string,array<int>>")
    looked = F.when(worth, F.coalesce(F.col(column), F.create_map().cast("map<string,array<int>>"))).otherwise(empty)
    return told.withColumn("_m", judge("query_id", looked)).select(*rows.columns, "_m.*")


# ---- sentences ------------------------------------------------------------------------------------------------


def _kind(c: str) -> str:
    """The class of a character in the sentence rules."""
    if c in "\n\r\x85\u2028\u2029":
        return "sep"
    if c in ".․﹒．":
        return "aterm"
    if c in "!?‼⁇⁈⁉。！？":
        return "sterm"
    if c.isspace():
        return "sp"
    if c in ",-:;–—、":
        return "cont"
    cat = unicodedata.category(c)
    if cat in ("Ps", "Pe", "Pi", "Pf") or c in "\"'":
        return "close"
    return {"Lu": "upper", "Lt": "upper", "Ll": "lower", "Lo": "other", "Lm": "other", "Nd": "digit", "Mn": "ext", "Me": "ext", "Mc": "ext", "Cf": "ext"}.get(cat, "any")


class _Kinds(dict):
    """The class of each character, told once."""

    def __missing__(self, c: str) -> str:
        self[c] = found = _kind(c)
        return found


KINDS = _Kinds()
#: What can end a sentence; between these nothing has to be looked at.
ENDING = re.compile("[\n\r\x85\u2028\u2029.\u2024\ufe52\uff0e!?\u203c\u2047\u2048\u2049\u3002\uff01\uff1f]")


def boundaries(text: str) -> list[int]:
    """Where sentences end, by the rules of Unicode text segmentation (code points)."""
    kinds, out, i, n = KINDS, [], 0, len(text)
    while found := ENDING.search(text, i):
        i = found.start()
        k = kinds[text[i]]
        if k == "sep":
            i += 2 if text[i : i + 2] == "\r\n" else 1
            out.append(i)
            continue
        j = i + 1
        if k == "aterm" and j < n and (kinds[text[j]] == "digit" or (kinds[text[j]] == "upper" and i and kinds[text[i - 1]] in ("upper", "lower"))):
            i = j  # inside a number or an abbreviation
            continue
        while j < n and kinds[text[j]] in ("close", "ext"):
            j += 1
        while j < n and kinds[text[j]] in ("sp", "ext"):
            j += 1
        if j < n and kinds[text[j]] in ("cont", "aterm", "sterm"):
            i = j if kinds[text[j]] != "cont" else j + 1
            continue
        if k == "aterm":
            m = j
            while m < n and kinds[text[m]] not in ("other", "upper", "lower", "sep", "aterm", "sterm"):
                m += 1
            if m < n and kinds[text[m]] == "lower":
                i = j
                continue
        if j < n and kinds[text[j]] == "sep":
            j += 2 if text[j : j + 2] == "\r\n" else 1
        out.append(j)
        i = j
    if not out or out[-1] < n:
        out.append(n)
    return out


TRAILING = re.compile(r"(?:^|[^\w.]|[\d_])([^\W\d_]+(?:\.[^\W\d_]+)*)\.$")


def sentences(text: str) -> list[tuple[int, int]]:
    """Trimmed spans of sentences (code points), those cut after an abbreviation or an initial joined again."""
    spans, at = [], 0
    for end in boundaries(text):
        part = text[at:end]
        a, b = at + len(part) - len(part.lstrip()), at + len(part.rstrip())
        if a < b:
            spans.append((a, b))
        at = end
    out: list[tuple[int, int]] = []
    last = (0, 0)
    for span in spans:
        if out and _goes_on(text, last, span):
            out[-1] = (out[-1][0], span[1])
        else:
            out.append(span)
        last = span
    return out


def _goes_on(text: str, a: tuple[int, int], b: tuple[int, int]) -> bool:
    ending = text[a[0] : a[1]]
    if len(ending) == 2 and ending[1] == "." and ending[0].isupper():
        return True
    # A token has no spaces, so only the last word can end in one.
    m = TRAILING.search(ending.rsplit(None, 1)[-1]) if ending.endswith(".") else None
    token = m[1].lower() if m else ""
    return token in C.ALWAYS_MERGED or (token in C.ABBREVIATIONS and text[b[0]].islower())


def windows(count: int, width: int = 3, step: int = 2) -> list[tuple[int, int]]:
    """Overlapping windows over sentences; a single last sentence joins the window before."""
    if not 1 <= step <= width:
        raise ValueError("a step larger than the window would skip sentences")
    out: list[tuple[int, int]] = []
    for a in range(0, count, step):
        b = min(a + width, count)
        if b == count and count - a < 2 and out:
            out[-1] = (out[-1][0], count)
            break
        out.append((a, b))
        if b == count:
            break
    return out


def utf16(text: str, places: list[int]) -> list[int]:
    """Rising places of a text (code points) in UTF-16 units; the text is gone through once."""
    units = lambda a, b: len(text[a:b].encode("utf-16-le", "surrogatepass")) // 2
    if units(0, len(text)) == len(text):
        return list(places)
    out, at, n = [], 0, 0
    for place in places:
        n, at = n + units(at, place), place
        out.append(n)
    return out


def excerpt_ranges(spans: list[tuple[int, int]], length: int, width: int = 3, step: int = 2, least: int = 4, single: bool = True) -> list[tuple[str, int, int]]:
    """(kind, first sentence, end) of the excerpts of a text with these sentences."""
    out, n = [("full", 0, len(spans))], len(spans)
    if n >= least:
        out += [("window", a, b) for a, b in windows(n, width, step) if (a, b) != (0, n)]
    if single and n >= 2:
        out += [("sentence", k, k + 1) for k, span in enumerate(spans) if span != (0, length)]
    return out


def excerpts(text: str, width: int = 3, step: int = 2, least: int = 4, single: bool = True) -> list[tuple[str, str, int]]:
    """(kind, text, UTF-16 offset): the whole, windows from four sentences on, sentences from two on; none twice."""
    if not text.strip():
        raise ValueError("an empty text has no excerpts")
    spans = sentences(text)
    offsets = utf16(text, [a for a, _ in spans])
    ranges = excerpt_ranges(spans, len(text), width, step, least, single)
    return [(kind, text, 0) if kind == "full" else (kind, text[spans[a][0] : spans[b - 1][1]], offsets[a]) for kind, a, b in ranges]


def is_verbatim(text: str, excerpt: str, offset: int) -> bool:
    raw, own = text.encode("utf-16-le", "surrogatepass"), excerpt.encode("utf-16-le", "surrogatepass")
    return bool(own) and offset >= 0 and raw[2 * offset : 2 * offset + len(own)] == own


#: Texts whose excerpts Python has in hand at once.
AT_ONCE = 64
EXCERPT = pa.struct([("kind", pa.string()), ("text", pa.string()), ("start_offset", pa.int32())])


def _excerpts_of(texts: list[str | None]) -> pa.Array:
    """The excerpts of some texts, put together as columns."""
    each = [excerpts(t) if t and t.strip() else [] for t in texts]
    ends = [0]
    for e in each:
        ends.append(ends[-1] + len(e))
    flat = [x for e in each for x in e]
    parts = [pa.array([x[k] for x in flat], EXCERPT[k].type) for k in range(3)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(EXCERPT)))


def excerpted(reviews: DataFrame, id_col: str = "id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """review_id, excerpts (kind, text, start_offset) and, if asked for, the text of every review, a few at a time."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                columns = [*part.columns[: 1 + with_text], _excerpts_of(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(columns, ["review_id", *(["text"] if with_text else []), "excerpts"])

    kind = reviews.select(id_col).schema[0].dataType.simpleString()
    schema = f"review_id {kind}, " + "text string, " * with_text + "excerpts array<struct<kind:string,text:string,start_offset:int>>"
    return reviews.select(F.col(id_col).alias("review_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def chunked(reviews: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """review_id, kind, text, start_offset: the excerpts of every review with text."""
    return excerpted(reviews, id_col, text_col).select("review_id", F.explode("excerpts").alias("e")).select("review_id", "e.*")


def sentiment_of(text: str, threshold: float = C.NEUTRAL_THRESHOLD) -> tuple[str, float]:
    """By counts of words with a known ring; a tie, or too small a share, is neutral."""
    words = re.findall(r"(?:[^\W_]|')+", text.lower())
    good, bad = sum(w in C.POSITIVE_WORDS for w in words), sum(w in C.NEGATIVE_WORDS for w in words)
    if good == bad:
        return "neutral", 0.5
    share = max(good, bad) / (good + bad)
    return ("neutral" if share < threshold else "positive" if good > bad else "negative"), share


@arrow("struct<sentiment:string,confidence:double>")
def lexicon_sentiment(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sentiment_of(t or "") for t in texts], columns=["sentiment", "confidence"])


def content_words(text: Column) -> Column:
    """Words of three letters or more that carry meaning, possessives taken off."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}']+)"), F.lit(1))
    bare = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, "^'+|'+$", ""), "'s$", ""))
    stop = F.array(*[F.lit(w) for w in sorted(C.ENGLISH_STOP_WORDS)])
    return F.filter(bare, lambda w: (F.length(w) >= 3) & ~F.rlike(w, F.lit(r"^\d+$")) & ~F.array_contains(stop, w))


def rerank_score(query: str, passage: str) -> float:
    """The share of the query's words of three letters or more that the passage has."""
    words = lambda t: set(re.findall(r"[^\W_]{3,}", t.lower()))
    wanted = words(query)
    return len(wanted & words(passage)) / len(wanted) if wanted else 0.0
