"""The stored index against the same functions on whole lexeme maps, and its plans."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import postings as P
from marlstone.operators import search
from marlstone.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
WORDS = ["roof", "roofs", "leak", "the", "repair", "fast", "slow", "state-of-the-art", "team", "fixed", "my"]
QUERIES_ASKED = ["roof repair", '"leaking roof" fast', "roof -slow", "-roof", "fast or repair team", "the my", "", '"the art" or "state of"', "repair repair roof fast", "-roof or -leak"]


def made(seed, n):
    rng = random.Random(seed)
    return [(i, i % 2, "live", " ".join(rng.choices(WORDS, k=rng.randint(0, 14)))) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(1, 120), "id bigint, project_id bigint, environment string, text string")


@pytest.mark.parametrize("rule", ["all", "any", "half", "half-specific"])
@pytest.mark.parametrize("words", [P.ENGLISH, P.SIMPLE], ids=["english", "simple"])
def test_judged_as_the_whole_lexeme_maps_are(spark, rows, rule, words):
    indexed = P.postings_of(rows.withColumn("lexemes", T.lexemes("text")), "lexemes") if words is P.ENGLISH else P.postings_of(rows)
    parsed = P.parse([P.Asked(10 * p + k, p, "live", t, ["team"]) for p in (0, 1) for k, t in enumerate(QUERIES_ASKED)], words)
    got = {(r.query_id, r.id): (r.full_match, pytest.approx(r.word_rank), r.lexical) for r in P.judge(indexed, parsed, rule).collect()}
    for p in parsed:
        for i, project, _, text in made(1, 120):
            if project != p.asked.project_id:
                assert (p.asked.query_id, i) not in got
                continue
            vector = words.vector(text)
            full = T.matches(vector, p.alternatives)
            names = p.specific if rule == "half-specific" else p.content
            present = sum(x in vector for x in names)
            partial = rule != "all" and bool(names) and (present > 0 if rule == "any" else 2 * present >= len(names))
            want = (full, T.cover_rank(vector, p.alternatives) if full else 0.0, full or partial)
            if (p.asked.query_id, i) in got:
                assert want == got[p.asked.query_id, i], (p.asked.text, text)
            else:
                assert not set(vector) & set(p.lexemes) and want == (p.matches_nothing, 0.0, p.matches_nothing)


def test_stored_index_reads_only_its_folders(spark, rows, tmp_path):
    P.store_postings(P.postings_of(rows), f"{tmp_path}/index", 8)
    some = P.read_postings(spark, f"{tmp_path}/index", ["roof", "leak", "absent"], 8)
    assert {r.lexeme for r in some.select("lexeme").distinct().collect()} == {"roof", "leak"}
    assert sorted(map(str, some.collect())) == sorted(map(str, P.postings_of(rows).filter("lexeme IN ('roof', 'leak')").select(some.columns).collect()))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "In(lexeme" in plan
    assert P.read_postings(spark, f"{tmp_path}/index", [], 8).count() == 0


def test_a_word_in_every_excerpt_is_dealt_evenly(spark, tmp_path):
    """One lexeme is a third of all postings and spreads over several files; ranks with one value only over several ranges."""
    rows = spark.range(6000).select("id", F.lit(1).alias("project_id"), F.lit("live").alias("environment"), F.concat(F.lit("roof w"), "id", F.lit(" v"), "id").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with data that fill their partitions
    try:
        P.store_postings(P.postings_of(rows), f"{tmp_path}/index", 4)
        files = [r.n for r in spark.read.parquet(f"{tmp_path}/index").filter("lexeme = 'roof'").groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(files) > 1 and sum(files) == 6000
        same = rows.select(F.lit(1).alias("query_id"), "id", F.lit(0.1).alias("word_rank"))
        ranked = search.counted_rank(same, "kw_rank", F.col("word_rank").desc(), "id")
        assert ranked.filter("kw_rank <> id + 1").count() == 0
        parts = [r.n for r in spark.read.parquet(ranked.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(parts) > 1 and max(parts) <= 2 * 6000 / len(parts)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hybrid_by_index_equals_hybrid_by_lexeme_maps(spark, rows):
    reviews = rows.select("id", "project_id", "environment", F.lit("s").alias("source"), F.lit(5).cast("bigint").alias("rating"), F.lit(None).cast("string").alias("sentiment"), F.lit(False).alias("hidden"), (F.col("id") % 7).alias("occurred_s"))
    chunks = rows.select("id", F.col("id").alias("review_id"), F.lit("full").alias("kind"), F.lit(0).alias("start_offset"), F.array(F.lit(1.0), F.col("id") / 40.0).alias("embedding"), T.lexemes("text").alias("lexemes"))
    asked = [search.Query(10 * p + k, p, "live", 20, 1, 0.9, vector=[1.0, 0.5], text=t) for p in (0, 1) for k, t in enumerate(QUERIES_ASKED) if t]
    index = P.postings_of(rows.withColumn("lexemes", T.lexemes("text")), "lexemes")
    for find in (search.hybrid, search.debug):
        by_map = sorted(map(str, find(reviews, chunks, asked).collect()))
        assert by_map and by_map == sorted(map(str, find(reviews, chunks, asked, postings=index).collect()))


def test_no_python_in_the_plan(spark):
    plan = QUERIES["search_hybrid_words"](spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_are_cut_within_their_rows(spark, rows):
    """No word moves before it is asked for; ids that rows repeat count once, with the places of all their rows."""
    plan = P.postings_of(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    twice = spark.createDataFrame([(1, 0, "live", "b a b"), (1, 0, "live", "a c"), (2, 0, "live", None), (3, 0, "live", " . ")], rows.schema)
    assert sorted((r.lexeme, r.id, r.positions) for r in P.postings_of(twice).collect()) == [("a", 1, [1, 2]), ("b", 1, [1, 3]), ("c", 1, [2])]
    assert sorted((r.lexeme, r.id) for r in P.words_of(twice).collect()) == [("a", 1), ("b", 1), ("c", 1)]
    asked = spark.createDataFrame([(7, 0, "live", "a"), (7, 0, "live", "b")], "query_id bigint, project_id bigint, environment string, lexeme string")
    assert [tuple(r) for r in P.partial_matches(P.words_of(twice), asked).collect()] == [(7, 1, 2, 2)]


def test_density_of_common_words_takes_time_in_proportion(spark):
    """Places were sorted anew at every step: 20,000 of them took minutes."""
    import time

    text = "roof of leak " * 20_000
    one = spark.createDataFrame([(1, 0, "live", text)], "id bigint, project_id bigint, environment string, text string")
    asked = P.parse([P.Asked(1, 0, "live", "roof leak")], P.SIMPLE)
    began = time.time()
    got = P.judge(P.postings_of(one), asked, "all").first()
    assert got.word_rank == pytest.approx(T.cover_rank(T.vector_of(text, lexeme=lambda w: w, compounds=False), asked[0].alternatives)) and time.time() - began < 40


def test_an_index_of_some_lexemes_has_their_postings_of_all_texts(spark, rows):
    """What a search never asks for is not put in order, written or moved; places are those in the whole text."""
    told = lambda p: sorted((r.lexeme, r.project_id, r.id, r.positions) for r in p.collect())
    for more in ((rows,), (rows.withColumn("lexemes", T.lexemes("text")), "lexemes")):
        want = [x for x in told(P.postings_of(*more)) if x[0] in ("roof", "my")]
        assert want and told(P.postings_of(*more, only=["roof", "my", "zzz"])) == want
