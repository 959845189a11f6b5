"""Words by a stored index: postings of lexemes with their positions, searched by joins and array functions in the JVM.

A posting is (lexeme, tenant, excerpt, positions).  The table lies in folders by a hash of the lexeme and is sorted by
lexeme within its files, so a batch of queries reads the folders and row groups of its own words.  Each folder is written by
several tasks, by a hash of the excerpt: a word that is in every excerpt is dealt over them.

A batch of queries (bounded, search.MAX_BATCH) is broadcast to its postings; those of an excerpt and a query meet in one row, a
map from the query's lexemes to their positions, on which phrases, negation, alternatives and cover density are array
functions.  The partial rules are a division: query lexemes as rows, generic ones taken off, matches counted against a share.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalar import let
from ..storage import written

#: Folders of a stored index, and tasks (and files) that write one.
BUCKETS, SPLITS = 64, 4
TENANT = ("project_id", "environment")
#: Runs of letters and figures; the plain words of a text, for languages without stems.
PLAIN = r"([\p{L}\p{N}]+)"


def plain_words(text: Column) -> Column:
    """The lower-case words of a text in order, by built-in functions."""
    return F.regexp_extract_all(F.lower(text), F.lit(PLAIN), F.lit(1))


@dataclass(frozen=True)
class Words:
    """How an index tells words: `lexeme` gives a word's lexeme or nothing, `compounds` says whether hyphenated words count too."""

    lexeme: Callable[[str], str | None] = T.lexeme
    compounds: bool = True

    def vector(self, text: str) -> dict[str, list[int]]:
        return T.vector_of(text, lexeme=self.lexeme, compounds=self.compounds)


#: Stems without stop words (functions.text.lexemes), and plain words (`plain_words`).
ENGLISH, SIMPLE = Words(), Words(lambda word: word, False)


def _texts(rows: DataFrame, text: str, keys: tuple[str, ...]) -> DataFrame:
    """keys, id, texts: an excerpt's text, and where rows repeat an id all of theirs; dealt by the id alone, as results are."""
    return rows.select(*keys, "id", F.col(text).alias("text")).repartition("id").groupBy(*keys, "id").agg(F.collect_list("text").alias("texts"))


def postings_of(rows: DataFrame, lexemes: str | None = None, text: str = "text", keys: tuple[str, ...] = TENANT, only: list[str] | None = None) -> DataFrame:
    """lexeme, keys, id, positions (from 1) of excerpts (keys, id): of a column of lexeme positions, or else of a text's plain words.

    The words of an excerpt are put in order within its row, where each lexeme's places then stand side by side; texts move, words don't.
    With `only`, texts are cut whole as well, and of their words these lexemes' are put in order.
    """
    if lexemes:
        if only is not None:
            rows = rows.withColumn(lexemes, F.map_filter(lexemes, lambda k, _: k.isin(only)))
        return rows.select(F.explode(lexemes).alias("lexeme", "positions"), *keys, "id").select("lexeme", *keys, "id", "positions")
    placed = lambda w, i: F.struct(w.alias("lexeme"), (i + 1).alias("at"))
    if only is None:
        each_text = lambda t: F.transform(plain_words(t), placed)
    else:
        # Other words become nothing at once and are taken out together.
        each_text = lambda t: F.array_compact(F.transform(plain_words(t), lambda w, i: F.when(w.isin(only), placed(w, i))))

    def of_starts(words: Column, starts: Column) -> Column:
        end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(words)) - 1
        return F.transform(starts, lambda i, j: F.struct(F.get(words, i)["lexeme"].alias("lexeme"), F.transform(F.sequence(i, end(j)), lambda k: F.get(words, k)["at"]).alias("positions")))

    def of_words(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i)["lexeme"] != F.get(words, i - 1)["lexeme"]))
        return F.when(F.size(words) > 0, let(starts, lambda s: of_starts(words, s)))

    each = let(F.sort_array(F.flatten(F.transform("texts", each_text))), of_words)
    return _texts(rows, text, keys).select(*keys, "id", F.explode(each).alias("p")).select("p.lexeme", *keys, "id", "p.positions")


def words_of(rows: DataFrame, text: str = "text", keys: tuple[str, ...] = TENANT) -> DataFrame:
    """lexeme, keys, id of excerpts: each plain word once, without its places."""
    once = F.array_distinct(F.flatten(F.transform("texts", plain_words)))
    return _texts(rows, text, keys).select(F.explode(once).alias("lexeme"), *keys, "id")


def _bucket(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


def store_postings(postings: DataFrame, path: str, buckets: int = BUCKETS, splits: int = SPLITS) -> None:
    """Write the index; `read_postings` must be given the same number of folders."""
    rows = postings.withColumn("bucket", _bucket(F.col("lexeme"), buckets))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(splits)))
    dealt.sortWithinPartitions("bucket", "lexeme").write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_postings(spark: SparkSession, path: str, lexemes: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of some lexemes: only their folders are listed, and within files row groups are skipped by their bounds."""
    table = spark.read.parquet(path)
    if not lexemes:
        return table.limit(0).drop("bucket")
    asked = spark.createDataFrame([(x,) for x in lexemes], "lexeme string")  # of one batch of queries
    folders = sorted({r.b for r in asked.select(_bucket(F.col("lexeme"), buckets).alias("b")).collect()})
    return table.filter(F.col("bucket").isin(folders) & F.col("lexeme").isin(lexemes)).drop("bucket")


@dataclass(frozen=True)
class Asked:
    """What a query asks of the words of its tenant."""

    query_id: int
    project_id: int | str
    environment: str
    text: str
    generic: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Parsed:
    asked: Asked
    alternatives: T.Alternatives
    content: list[str]
    specific: list[str]

    @property
    def lexemes(self) -> list[str]:
        return sorted({lex for a in self.alternatives for _, p in a for lex, _ in p} | set(self.content))

    @property
    def matches_nothing(self) -> bool:
        """Whether an excerpt with none of the query's lexemes matches, as "-word" does."""
        return T.matches({}, self.alternatives)


def parse(queries: list[Asked], words: Words = ENGLISH) -> list[Parsed]:
    """Queries by the rules of functions.text.parse_query, with words told as the index tells them."""
    out = []
    for q in queries:
        content, generic = list(words.vector(q.text)), words.vector(" ".join(q.generic))
        out.append(Parsed(q, T.parse_query(q.text, words.lexeme, words.compounds), content, [x for x in content if x not in generic]))
    return out


QUERY_SCHEMA = (
    "query_id bigint, project_id {kind}, environment string, lexemes array<string>, specific array<string>, "
    "alternatives array<struct<phrases:array<struct<negated:boolean,terms:array<struct<lexeme:string,off:int>>>>,names:array<string>>>"
)


def _frame(spark: SparkSession, parsed: list[Parsed], specific: Callable[[Parsed], list[str]]) -> DataFrame:
    rows = []
    for p in parsed:
        alternatives = [([(bool(negated), list(phrase)) for negated, phrase in a], sorted({lex for negated, phrase in a if not negated for lex, _ in phrase})) for a in p.alternatives]
        rows.append((p.asked.query_id, p.asked.project_id, p.asked.environment, p.lexemes, specific(p), alternatives))
    kind = "string" if parsed and isinstance(parsed[0].asked.project_id, str) else "bigint"
    return spark.createDataFrame(rows, QUERY_SCHEMA.format(kind=kind))


def has_phrase(vector: Column, terms: Column) -> Column:
    """Whether a phrase's lexemes stand at their distances: the places where each would let it begin have one in common."""
    none = F.array().cast("array<int>")
    begins = F.transform(terms, lambda t: F.transform(F.coalesce(F.try_element_at(vector, t["lexeme"]), none), lambda at: at - t["off"]))
    common = F.aggregate(F.slice(begins, 2, 1 << 30), F.get(begins, F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return F.size(common) > 0


def matches(vector: Column, alternatives: Column) -> Column:
    """Whether all of one alternative holds."""
    return F.exists(alternatives, lambda a: F.forall(a["phrases"], lambda p: has_phrase(vector, p["terms"]) != p["negated"]))


def cover_rank(vector: Column, alternatives: Column) -> Column:
    """Cover density, as functions.text.cover_rank: each shortest span of all wanted lexemes adds 0.1 over its length's surplus."""

    def of_places(names: Column, places: Column) -> Column:
        indexed = F.transform(places, lambda x, i: F.struct(x["at"].alias("at"), x["name"].alias("name"), i.alias("i")))
        start = F.struct(F.transform(names, lambda _: F.lit(-1)).alias("seen"), F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

        def added(state: Column, x: Column, seen: Column, first: Column) -> Column:
            noise = (x["at"] - F.get(places, first)["at"]) - (x["i"] - first)
            new = first > state["last"]
            return F.struct(seen.alias("seen"), F.greatest(first, state["last"]).alias("last"), (state["sum"] + F.when(new, 0.1 / (1 + F.greatest(noise, F.lit(0)))).otherwise(0.0)).alias("sum"))

        def step(state: Column, x: Column) -> Column:
            seen = F.transform(state["seen"], lambda k, j: F.when(j == x["name"], x["i"]).otherwise(k))
            return let(seen, lambda s: let(F.array_min(s), lambda first: added(state, x, s, first)))

        return F.aggregate(indexed, start, step, lambda s: s["sum"])

    def of_alternative(names: Column) -> Column:
        marked = F.flatten(F.transform(names, lambda n, j: F.transform(F.try_element_at(vector, n), lambda at: F.struct(at.alias("at"), j.alias("name")))))
        # Sorted once: a step looks into the places by number, so its cost does not depend on how many there are.
        several = let(F.sort_array(marked), lambda places: of_places(names, places))
        single = 0.1 * F.size(F.try_element_at(vector, F.get(names, F.lit(0))))
        complete = (F.size(names) > 0) & F.forall(names, lambda n: F.map_contains_key(vector, n))
        return F.when(~complete, 0.0).when(F.size(names) == 1, single).otherwise(several)

    # Rounded, so that equal densities are equal whatever order they were summed in.
    return F.round(F.aggregate(alternatives, F.lit(0.0), lambda total, a: total + of_alternative(a["names"])), 9)


def vectors(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, and the map from the query's lexemes to positions, for excerpts of its tenant that have one of them."""
    # A row a query and lexeme: bounded by the batch.
    terms = queries.select("query_id", *TENANT, F.explode("lexemes").alias("lexeme"))
    hits = postings.join(F.broadcast(terms), ["lexeme", *TENANT])
    # At most one row for each of the query's lexemes meets here, however common the words are.
    return hits.groupBy("query_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "positions"))).alias("vector"))


def judge(postings: DataFrame, parsed: list[Parsed], rule: str = "half-specific") -> DataFrame:
    """query_id, id, full_match, word_rank, lexical for excerpts with one of the query's lexemes; others match if `matches_nothing`.

    Rules: all (the query as it is), any, half of its lexemes, or half of those that are not generic.
    """
    wanted = {"all": lambda p: [], "any": lambda p: p.content, "half": lambda p: p.content, "half-specific": lambda p: p.specific}[rule]
    # Queries of a tenant with the same words are judged once; the lists are of one batch.
    first: dict[tuple, Parsed] = {}
    same = [(p.asked.query_id, first.setdefault((p.asked.project_id, p.asked.environment, p.asked.text, tuple(p.asked.generic)), p).asked.query_id) for p in parsed]
    queries = _frame(postings.sparkSession, list(first.values()), wanted)
    told = vectors(postings, queries).join(F.broadcast(queries.select("query_id", "alternatives", "specific")), "query_id")
    # Each verdict goes through a generator, below which no filter moves that would judge again.
    told = told.withColumn("full_match", F.explode(F.array(matches(F.col("vector"), F.col("alternatives")))))
    present = F.size(F.filter("specific", lambda x: F.map_contains_key(F.col("vector"), x)))
    partial = (F.size("specific") > 0) & ((present > 0) if rule == "any" else (2 * present >= F.size("specific")))
    told = told.withColumn("lexical", F.col("full_match") | partial)
    judged = told.select(F.col("query_id").alias("judged"), "id", "lexical", F.explode(F.array(F.struct("full_match", F.when(F.col("full_match"), cover_rank(F.col("vector"), F.col("alternatives"))).otherwise(0.0).alias("word_rank")))).alias("j"))
    ids = postings.sparkSession.createDataFrame(same, "query_id bigint, judged bigint")
    return judged.join(F.broadcast(ids), "judged").select("query_id", "id", "j.full_match", "j.word_rank", "lexical")


def partial_matches(postings: DataFrame, query_lexemes: DataFrame, generic: DataFrame | None = None, share: float = 0.5, least: int = 1) -> DataFrame:
    """query_id, id, present, wanted: excerpts that have enough of a query's lexemes, as a division by joins and counts.

    `query_lexemes` (query_id, tenant, lexeme) and `generic` (query_id, lexeme) are tables of any size; what is generic is
    taken off first, and a query with nothing left matches nothing.  Enough: `least` of them, and `share` of all.
    Of the postings only lexeme, tenant and id are read (`words_of`).
    """
    asked = query_lexemes.dropDuplicates(["query_id", "lexeme"])
    if generic is not None:
        asked = asked.join(generic.select("query_id", "lexeme"), ["query_id", "lexeme"], "left_anti")
    # Written, so that its size is known before any posting moves.
    asked = written(asked, "asked")
    counts = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    found = postings.select("lexeme", *TENANT, "id").join(asked, ["lexeme", *TENANT]).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("present"))
    return found.join(counts, "query_id").filter((F.col("present") >= least) & (F.col("present") >= share * F.col("wanted")))


def content_rows(queries: DataFrame, text: str = "text") -> DataFrame:
    """query_id, tenant, lexeme: the plain words of a table of queries (query_id, tenant, text), each once."""
    return queries.select("query_id", *TENANT, F.explode(F.array_distinct(plain_words(F.col(text)))).alias("lexeme"))


def generic_rows(queries: DataFrame, words: list[str]) -> DataFrame:
    """query_id, lexeme: some words for every query, to be taken off by `partial_matches`."""
    return queries.select("query_id", F.explode(F.lit(words)).alias("lexeme"))
