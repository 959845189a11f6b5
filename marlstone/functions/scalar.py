"""Scalar functions as column expressions: ratings, dates, names, identifiers, clocks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from . import arrow, ship

ship(__name__)

#: White space as browsers and stores trim it: as a class of a pattern, and the characters themselves.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lookup(column: Column, table: dict) -> Column:
    """The value of a small fixed table, null where it has none."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[column] if table else F.lit(None)


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def group(text: Column, pattern: str, i: int) -> Column:
    """A group of a pattern, null where it isn't there."""
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


# ---- ratings --------------------------------------------------------------------------------------------------


#: Glyphs that stand for stars, and of these the filled ones.
GLYPHS, FILLED = "★☆⭐✩✭✮✯*", "★⭐✭*"


def parse_rating(cell: Column) -> Column:
    """1..5 from stars, words, "a/b", "a out of b", "n stars" or a number up to 10; else null.

    The cell is taken apart once: its numbers, and its form, in which a # stands for each number and every other mark stays.
    """
    low = F.lower(trimmed(cell))
    number = r"[0-9]+(?:[.,][0-9]+)?"
    parts = F.struct(F.regexp_extract_all(low, F.lit(number), F.lit(0)).alias("n"), F.regexp_replace(low, number, "#").alias("form"), low.alias("v"))
    gap = f"{SPACE}*"

    def value(x: Column) -> Column:
        form, second = x["form"], F.get(x["n"], F.lit(1))
        first = F.translate(F.get(x["n"], F.lit(0)), ",", ".").try_cast("double")
        whole = F.substring_index(second, ",", 1).try_cast("double")  # below the line a comma ends the number
        without = lambda c, chars: F.translate(c, chars, "")
        names = {"one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0} | {str(i): float(i) for i in range(1, 6)}
        word = lookup(F.regexp_replace(x["v"], f"(?:{SPACE}|[_-])*stars?$", ""), names)
        scaled = F.when((first > 5) & (first <= 10), first / 2).otherwise(first)
        single = F.rlike(form, F.lit(f"^(?:rated{gap})?#(?:{gap}(?:stars?|★))?$")) | (F.rlike(form, F.lit(f"^rated{gap}#{gap}/#$")) & (second == "5"))
        return (
            F.when((form != "") & (without(form, GLYPHS) == ""), (F.length(x["v"]) - F.length(without(x["v"], FILLED))).cast("double"))
            .when(F.rlike(form, F.lit(f"^#{gap}(?:/|out of|of){gap}#")), half_up(F.try_divide(first, whole) * 5).cast("double"))
            .when(single, half_up(scaled).cast("double"))
            .otherwise(word)
        )

    found = let(let(parts, value), lambda found: F.when((found >= 1) & (found <= 5), found.cast("int")))
    return F.when(~F.rlike(cell, F.lit(WORDS_FIRST)), found)


def rating_from_stars(name: Column) -> Column:
    return lookup(name, {n: i + 1 for i, n in enumerate(C.STAR_NAMES)})


def sentiment_from_rating(rating: Column) -> Column:
    return F.when(rating >= 4, "positive").when(rating == 3, "neutral").when(rating.isNotNull(), "negative")


def sentiment_judgment(sentiment: Column, source: Column) -> Column:
    """The label with where it comes from."""
    return F.concat_ws(" · ", sentiment, F.when(sentiment.isNotNull(), F.when(source == "rating", "from rating").when(source == "model", "model")))


def review_status(indexed: Column, attempts: Column) -> Column:
    return F.when(indexed.isNotNull(), "indexed").when(attempts >= C.MAX_INDEX_ATTEMPTS, "stuck").otherwise("indexing")


def sentiment_result(label: Column, confidence: Column, threshold: float = C.NEUTRAL_THRESHOLD) -> Column:
    return F.when(confidence < threshold, "neutral").otherwise(label)


def stars(rating: Column) -> Column:
    n = F.when(rating.isNotNull(), star_count(rating))
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 5 - n))


# ---- dates ----------------------------------------------------------------------------------------------------


MONTH_NUMBERS = {m: i + 1 for i, m in enumerate(C.MONTHS)} | {m[:3]: i + 1 for i, m in enumerate(C.MONTHS)} | {"sept": 9}


#: A letter before lower case; two others become some of a to z.
LETTER = r"[A-Za-z\u0130\u212a]"
#: Seven words besides those that a date may repeat.  A date has two at most, its clock a t before and three after ("p. m. z"), so prose ends here.
MANY_WORDS = rf"^(?:(?:[^A-Za-z\u0130\u212a]+|(?i:at|st|nd|rd|th)(?!{LETTER}))*+{LETTER}++){{7}}"
#: Four words before any figure: no rating begins so.
WORDS_FIRST = rf"^(?:[^A-Za-z\u0130\u212a0-9]*+{LETTER}++){{4}}"


def parse_date_ms(cell: Column) -> Column:
    """Milliseconds since 1970, from ISO 8601, m/d/y, d.m.yyyy, "Jan 5, 2026 at 3:04 PM", "5 Jan 2026" or Unix time; else null.

    The cell is split into numbers, words and marks once.  What stands before the hour is the date; its words and marks decide
    the form, and the form decides which number is what.
    """
    tokens = F.regexp_extract_all(F.regexp_replace(F.lower(trimmed(cell)), f"{SPACE}+", " "), F.lit("[0-9]+|[a-z]+|[^0-9a-z]"), F.lit(0))
    parsed = let(tokens, lambda t: F.when(F.size(t) == 1, _unix_ms(F.get(t, F.lit(0)))).otherwise(let(_two_parts(t), _date_and_clock)))
    return F.when(~F.rlike(cell, F.lit(MANY_WORDS)), parsed)


def _unix_ms(figures: Column) -> Column:
    """Seconds (9 or 10 figures) or milliseconds (13) since 1970, within 1990 to 2100."""
    n, size = figures.try_cast("bigint"), F.length(figures)
    ms = F.when(size == 13, n).when(size.isin(9, 10), n * 1000)
    return F.when(F.year(F.timestamp_millis(ms)).between(1990, 2100), ms)


def _is_word(x: Column) -> Column:
    return (x >= "a") & (x < "{")


def _is_number(x: Column) -> Column:
    return (x >= "0") & (x < ":")


def _two_parts(t: Column) -> Column:
    """The numbers, words and marks of the date, whether it begins with a number, and the tokens of the clock."""
    colon = F.array_position(t, ":").cast("int")
    date = F.when(colon == 0, t).otherwise(F.slice(t, F.lit(1), F.greatest(F.lit(0), colon - 2)))
    clock = F.when(colon > 1, F.slice(t, colon - 1, F.size(t))).otherwise(F.when(colon == 1, t))
    return let(date, lambda d: F.struct(
        F.filter(d, _is_number).alias("numbers"), F.filter(d, _is_word).alias("words"), F.array_join(F.filter(d, lambda x: ~_is_number(x) & ~_is_word(x) & (x != " ")), "").alias("marks"),
        _is_number(F.get(d, F.lit(0))).alias("number_first"), d.alias("all"), clock.alias("clock"),
    ))


def _date_and_clock(p: Column) -> Column:
    n = lambda i: F.get(p["numbers"], F.lit(i))
    size = lambda i: F.length(n(i))
    bare = (F.size(p["words"]) == 0) | ((F.size(p["words"]) == 1) & (F.get(p["words"], F.lit(0)) == "t") & p["clock"].isNotNull())
    three = p["number_first"] & (F.size(p["numbers"]) == 3) & bare
    short = (size(0) <= 2) & (size(1) <= 2)
    # Words of a written date: a weekday perhaps, the month, and after the day its ordinal ending.
    own = F.array_remove(p["words"], "at")
    own = F.when(p["number_first"], own).otherwise(F.filter(own, lambda w: ~w.isin("st", "nd", "rd", "th")))
    written = (F.size(p["numbers"]) == 2) & (size(0) <= 2) & (size(1) == 4) & (F.translate(p["marks"], ".,", "") == "")
    month = lookup(F.element_at(own, -1), MONTH_NUMBERS)
    in_order = F.array_position(p["all"], F.element_at(own, -1)) < F.array_position(p["all"], n(1))
    day = lambda form, y, m, d: F.struct(F.lit(form).alias("form"), y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
    century = F.when(size(2) == 2, n(2).cast("int") + 2000).otherwise(n(2).cast("int"))
    found = (
        F.when(three & (p["marks"] == "--") & (size(0) == 4) & (size(1) == 2) & (size(2) == 2), day("iso", n(0), n(1), n(2)))
        .when(three & p["marks"].isin("//", "//,") & short & size(2).isin(2, 4), day("halves", century, n(0), n(1)))
        .when(three & (p["marks"] == "..") & short & (size(2) == 4) & p["clock"].isNull(), day("plain", n(2), n(1), n(0)))
        .when(written & p["number_first"] & (F.size(own) == 1) & in_order, day("plain", n(1), month, n(0)))
        .when(written & ~p["number_first"] & F.size(own).between(1, 2) & in_order, day("halves", n(1), month, n(0)))
    )
    return let(F.struct(found.alias("date"), p["clock"].alias("clock")), _instant)


def _instant(x: Column) -> Column:
    """Milliseconds of a date and a clock; null for what does not exist."""
    d, c = x["date"], x["clock"]
    iso_date = F.concat_ws("-", F.lpad(d["y"].cast("string"), 4, "0"), F.lpad(d["m"].cast("string"), 2, "0"), F.lpad(d["d"].cast("string"), 2, "0"))
    days = F.datediff(F.when(d["m"].isNotNull(), F.try_to_date(iso_date, "yyyy-MM-dd")), F.lit("1970-01-01").cast("date")).cast("bigint")
    return F.when(c.isNull(), days * 86_400_000).otherwise(days * 86_400_000 + _clock_ms(d["form"], c))


def _clock_ms(form: Column, c: Column) -> Column:
    """Milliseconds of hour:minute[:second[.fraction]] and what follows: halves of the day, or for ISO dates a zone."""
    at = lambda i: F.get(c, F.lit(i))
    seconds = F.coalesce(at(3) == ":", F.lit(False))
    fraction = seconds & F.coalesce((at(5) == ".") & (form == "iso"), F.lit(False))
    rest = F.array_join(F.filter(F.slice(c, F.when(fraction, 8).when(seconds, 6).otherwise(4), F.size(c)), lambda w: w != " "), "")
    two = lambda v: F.when(F.length(v) == 2, v.try_cast("int"))
    hour, minute = F.when(F.length(at(0)) <= 2, at(0).try_cast("int")), two(at(2))
    second = F.when(seconds, two(at(4))).otherwise(0)
    millis = F.when(fraction, F.when(F.length(at(6)) <= 9, half_up(F.concat(F.lit("0."), at(6)).try_cast("double") * 1000))).otherwise(0)

    def shifted(r: Column) -> Column:
        half = F.translate(r, ".", "")
        digits = F.translate(F.substring(r, 2, 9), ":", "")
        sign = lookup(F.substring(r, 1, 1), {"+": 1, "-": -1})
        offset = F.when(F.length(digits).isin(2, 4), sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).try_cast("int"), F.lit(0))))
        minutes = F.when(r.isin("", "z", "utc"), 0).otherwise(offset)
        turned = F.when((half == "am") & (hour == 12), 0).when((half == "pm") & (hour < 12), hour + 12).otherwise(hour)
        known = F.when(form == "iso", minutes).when(form == "halves", F.when(half.isin("", "am", "pm"), 0)).otherwise(F.when(r == "", 0))
        own = F.when(form == "halves", turned).otherwise(hour)
        return F.when((own <= 23) & (minute <= 59) & (second <= 59), ((own * 60 + minute - known) * 60 + second).cast("bigint") * 1000 + millis)

    return let(rest, shifted)


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_date(cell: Column) -> Column:
    return iso(parse_date_ms(cell))


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "MM")


def seconds_to_month_end(ts: Column) -> Column:
    """Whole seconds, one at least."""
    return F.greatest(F.lit(1), F.unix_timestamp(F.add_months(month_start(ts), 1).cast("timestamp")) - F.unix_timestamp(ts))


def seconds_to_midnight(ts: Column) -> Column:
    return F.greatest(F.lit(1), F.unix_timestamp(F.date_add(F.to_date(ts), 1).cast("timestamp")) - F.unix_timestamp(ts))


def seconds_to_next_period(seconds: Column, period: int = C.RATE_PERIOD_SECONDS) -> Column:
    return F.greatest(F.lit(1), period - F.pmod(seconds, F.lit(period)))


def tick(seconds: Column, every: int = 300) -> Column:
    """The start of the five minutes in which an instant lies."""
    return seconds - F.pmod(seconds, F.lit(every))


def jobs_due(seconds: Column) -> Column:
    """What runs at a tick, in order: the sweep always, the poll every six hours, the refresh at 03:30, the purge at 04:15."""
    t = F.timestamp_seconds(tick(seconds))
    at = lambda h, m: (F.hour(t) == h) & (F.minute(t) == m)
    poll = (F.minute(t) == 0) & (F.hour(t) % 6 == 0)
    return F.array_compact(F.array(F.lit("sweep"), F.when(poll, "google_poll"), F.when(at(3, 30), "places_refresh"), F.when(at(4, 15), "account_purge")))


def retry_delay(attempt: Column) -> Column:
    return F.least(F.lit(300.0), 30 * F.pow(F.lit(2.0), attempt - 1)).cast("int")


def poll_delay_ms(elapsed_ms: Column) -> Column:
    """How long to wait before asking again: longer as time goes by, and null when it is time to stop."""
    return F.when(elapsed_ms < 60_000, 2_000).when(elapsed_ms < 300_000, 10_000).when(elapsed_ms < 1_800_000, 30_000)


# ---- names and identifiers ------------------------------------------------------------------------------------


def normalize_q(text: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(text), f"{SPACE}+", " "))


def header_key(header: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(trimmed(header)), "[^a-z0-9.]+", " "))


def metadata_key(header: Column) -> Column:
    key = F.substring(F.regexp_replace(F.regexp_replace(F.lower(trimmed(header)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 64)
    return F.when(key == "", "column").otherwise(key)


def normalize_source(raw: Column) -> Column:
    v = F.lower(trimmed(raw))
    has = lambda s: F.contains(v, F.lit(s))
    return F.when(has("google"), "google").when(has("yelp"), "yelp").when(has("facebook") | (v == "fb") | has("meta"), "facebook").when(has("trustpilot"), "trustpilot").otherwise("custom")


def source_name(source: Column) -> Column:
    """What a source is called; null for the customer's own reviews."""
    key = F.lower(trimmed(source))
    known = lookup(key, {"google": "Google", "yelp": "Yelp", "facebook": "Facebook", "trustpilot": "Trustpilot"})
    return F.when((key != "") & (key != "custom"), F.coalesce(known, F.concat(F.upper(F.substring(key, 1, 1)), F.substring(key, 2, 1 << 20))))


def source_label(source: Column) -> Column:
    return F.concat(source_name(source), F.lit(" review"))


def star_count(rating: Column) -> Column:
    return F.when(rating.isNotNull(), F.least(F.lit(5), F.greatest(F.lit(0), half_up(rating)))).cast("int")


def clip(text: Column, most: int = 512) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def short_excerpt(text: Column, most: int = 120) -> Column:
    """One line, cut at a space if that leaves most of it, with an ellipsis."""
    flat = F.regexp_replace(trimmed(text), f"{SPACE}+", " ")
    head = F.substring(flat, 1, most + 1)
    space = F.length(head) - F.instr(F.reverse(head), " ")  # the place of the last space, from 0
    cut = F.when((F.instr(head, " ") > 0) & (space > 0.6 * most), F.substring(head, F.lit(1), space)).otherwise(F.substring(head, 1, most))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def review_suffix(name: Column) -> Column:
    return group(name, r"(?:^|/)(locations/[^/]+/reviews/[^/]+)$", 1)


def location_id(name: Column) -> Column:
    return group(name, r"(?:^|/)locations/([^/]+)/reviews/[^/]+$", 1)


def external_id(source: Column, author: Column, occurred: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("|", source, author, occurred, F.substring(text, 1, C.EXTERNAL_ID_PREFIX)).cast("binary"))


def original_comment(comment: Column) -> Column:
    """The reviewer's own words of a comment that comes with a machine translation."""
    text = trimmed(F.coalesce(comment, F.lit("")))
    original = trimmed(F.regexp_extract(text, r"\(Original\)\s*\n([\s\S]*)$", 1))
    return F.when(F.contains(text, F.lit("(Translated by Google)")) & (original != ""), original).otherwise(text)


def category_from_type(kind: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(trimmed(kind)), "^categories/", ""), "^gcid:", "")
    table = {t: c for c, (_, types) in C.CATEGORIES.items() for t in types.split()}
    return F.coalesce(lookup(bare, table), F.when(F.endswith(bare, F.lit("_restaurant")), "restaurant"))


def is_http_url(url: Column) -> Column:
    return F.coalesce(F.rlike(url, F.lit(r"(?i)^https?://[^\s/?#]+")), F.lit(False))


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case, the usual port left out; null for what is no web address."""
    low = F.lower(trimmed(url))
    scheme, host, port = (group(low, r"^(https?)://([^/?#:\s]+)(?::(\d+))?/?$", i) for i in (1, 2, 3))
    usual = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    return F.concat(scheme, F.lit("://"), host, F.when(port.isNull() | usual, "").otherwise(F.concat(F.lit(":"), port)))


def escape_like(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def key_parts(key: Column, prefix: str = "ml") -> Column:
    """kind and environment of an API key of the form prefix_kind_environment_secret; tested before anything is hashed."""
    p = rf"^{prefix}_(sk|pk)_(live|test)_([0-9A-Za-z]{{32}})$"
    return F.struct(F.when(F.regexp_extract(key, p, 1) == "sk", "secret").when(F.regexp_extract(key, p, 1) == "pk", "publishable").alias("kind"), group(key, p, 2).alias("environment"))


def same_map(a: Column, b: Column) -> Column:
    return F.sort_array(F.map_entries(a)).eqNullSafe(F.sort_array(F.map_entries(b)))


def contains_all(metadata: Column, wanted: dict[str, str]) -> Column:
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.coalesce(metadata[k] == v, F.lit(False))
    return out


def without_key(metadata: Column, key: str) -> Column:
    return F.map_filter(metadata, lambda k, _: k != key)


def usage_percent(used: Column, limit: Column) -> Column:
    return F.when(limit <= 0, 100).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), half_up(F.try_divide(used, limit) * 100)))).cast("int")


def usage_tone(used: Column, limit: Column) -> Column:
    return F.when(used >= limit, "full").when(usage_percent(used, limit) >= 80, "caution").otherwise("normal")


def plan_limit(plan: Column, what: str) -> Column:
    """A limit of the plan; an unknown plan is the free one."""
    return F.coalesce(lookup(plan, {p: v[what] for p, v in C.PLANS.items()}), F.lit(C.PLANS["free"][what]))


def highlight(text: Column, start: Column, length: Column) -> Column:
    """The text before, in and after a marked span."""
    return F.struct(F.substring(text, F.lit(1), start).alias("before"), F.substring(text, start + 1, length).alias("mark"), F.substring(text, start + length + 1, F.length(text)).alias("after"))


@arrow("string")
def slugify(names: pd.Series) -> pd.Series:
    """Lower-case ASCII words joined by hyphens, accents dropped, at most 48 characters."""
    import re

    def one(name):
        bare = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c)).lower()
        return re.sub(r"^-+|-+$", "", re.sub("[^a-z0-9]+", "-", bare))[:48].rstrip("-")

    return names.map(one)
