import random

import pytest

from marlstone.functions import text as T
from marlstone.functions.stemmer import stem
from marlstone.functions.vector import cosine, fnv1a, hashed_vector
from pyspark.sql import functions as F


@pytest.mark.parametrize("word, want", [
    ("running", "run"), ("roofs", "roof"), ("consistently", "consist"), ("generalization", "general"), ("happily", "happili"), ("ponies", "poni"), ("ties", "tie"), ("national", "nation"), ("relational", "relat"), ("communication", "communic"),
    ("hopping", "hop"), ("hoping", "hope"), ("skies", "sky"), ("bias", "bias"), ("cried", "cri"), ("agreed", "agre"), ("bed", "bed"), ("kitty's", "kitti"), ("knightly", "knight"), ("knots", "knot"), ("consolingly", "consol"), ("generously", "generous"), ("by", "by"), ("say", "say"), ("cry", "cri"),
])
def test_stems(word, want):
    assert stem(word) == want


def test_lexemes_have_positions_and_stop_words_leave_gaps():
    assert T.vector_of("The roof leak repair was quick") == {"leak": [3], "quick": [6], "repair": [4], "roof": [2]}
    assert T.vector_of("well-known plumber") == {"known": [3], "plumber": [4], "well": [2], "well-known": [1]}
    assert T.vector_of("") == {}


@pytest.mark.parametrize("query, hit", [("roof", True), ("roofs leaking", True), ('"leak repair"', True), ('"repair leak"', False), ("roof -quick", False), ("roof -slow", True), ("chimney or roof", True), ("chimney", False), ("the", False), ("", False), ('"roof repair"', False)])
def test_web_queries(query, hit):
    vector = T.vector_of("The roof leak repair was quick")
    assert T.matches(vector, T.parse_query(query)) is hit


def test_closer_words_rank_higher():
    rank = lambda text: T.cover_rank(T.vector_of(text), T.parse_query("roof repair"))
    assert rank("roof repair") == pytest.approx(0.1)
    assert rank("roof repair") > rank("roof leak repair") > rank("roof one two three leak repair") > 0
    assert rank("roof repair and roof repair") > rank("roof repair")


def test_rules_from_strict_to_lenient():
    vector = T.vector_of("great roofing work")
    rules = lambda q, generic=(): [T.lexical(vector, q, r, list(generic)) for r in ("all", "any", "half", "half-specific")]
    assert rules("roofing work") == [True] * 4
    assert rules("roofing chimney") == [False, True, True, True]
    assert rules("roofing chimney gutter") == [False, True, False, False]
    assert rules("roofing company chimney", ["company"]) == [False, True, False, True]
    assert rules("company", ["company"]) == [False, False, False, False]


@pytest.mark.parametrize("text, want", [
    ("Dr. Smith was great. He fixed it!", ["Dr. Smith was great.", "He fixed it!"]),
    ('"Really?" she asked. Yes.', ['"Really?"', "she asked.", "Yes."]),
    ("It cost $4.50 today. Fine", ["It cost $4.50 today.", "Fine"]),
    ("We pay e.g. cash. J. Doe came.\nNew line", ["We pay e.g. cash.", "J. Doe came.", "New line"]),
    ("One etc. and more. Two etc. Three.", ["One etc. and more.", "Two etc.", "Three."]),
    ("  only one  ", ["only one"]),
    ("Wait... what? No!!", ["Wait... what?", "No!!"]),
])
def test_sentences(text, want):
    assert [text[a:b] for a, b in T.sentences(text)] == want


def test_windows():
    assert T.windows(4) == [(0, 3), (2, 4)]
    assert T.windows(5) == [(0, 3), (2, 5)]
    assert T.windows(6) == [(0, 3), (2, 5), (4, 6)]
    assert T.windows(3) == [(0, 3)]
    with pytest.raises(ValueError):
        T.windows(4, 2, 3)


def test_excerpts_are_verbatim_and_none_repeats():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["A b. ", "C😀 d! ", "e? ", "Mr. X. ", "\n", "ﬁ​ ", "  "]) for _ in range(rng.randint(1, 12)))
        if not text.strip():
            continue
        found = T.excerpts(text)
        assert found[0] == ("full", text, 0) and all(T.is_verbatim(text, e, at) for _, e, at in found)
        assert len({(k, at) for k, _, at in found}) == len(found) and sum(e == text for _, e, _ in found) == 1
        assert [k for k, *_ in found] == sorted((k for k, *_ in found), key=("full", "window", "sentence").index)
    with pytest.raises(ValueError):
        T.excerpts(" ")
    assert not T.is_verbatim("abc", "", 0) and not T.is_verbatim("a😀b", "b", 2) and T.is_verbatim("a😀b", "b", 3)


def test_sentiment_by_words():
    assert T.sentiment_of("Great, friendly, helpful") == ("positive", 1.0)
    assert T.sentiment_of("rude and slow but kind")[0] == "negative"
    assert T.sentiment_of("good bad") == ("neutral", 0.5) and T.sentiment_of("") == ("neutral", 0.5)
    assert T.sentiment_of("good good bad", 0.7) == ("neutral", 2 / 3)


def test_rerank_score():
    assert T.rerank_score("roof leak of", "The roof was fine") == 0.5 and T.rerank_score("a of", "x") == 0.0


def test_hash_and_embedding(spark):
    assert fnv1a("") == 0x811C9DC5 and fnv1a("a") == 0xE40C292C and fnv1a("foobar") == 0xBF9CF968
    a, b = hashed_vector("a great roof", 64), hashed_vector("roof great", 64)
    assert sum(x * x for x in a) == pytest.approx(1) and sum(x * y for x, y in zip(a, b, strict=True)) == pytest.approx(1)
    assert hashed_vector("the and", 64) != [0] * 64
    with pytest.raises(ValueError):
        hashed_vector("!!", 64)
    frame = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in frame.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.707107, 0.0]


def test_excerpts_of_a_long_text_take_time_in_proportion():
    """Offsets were counted from the start for every sentence: minutes for a text like this one."""
    import time

    text = "\U0001f600 came on time. Mr. Fox left at 3.15 p.m. sharp! " * 20_000
    began = time.time()
    found = T.excerpts(text)
    assert time.time() - began < 20 and len(found) > 60_000
    raw = text.encode("utf-16-le")
    for _, own, at in found[1::997]:
        assert raw[2 * at : 2 * at + 2 * len(own.encode("utf-16-le")) // 2].startswith(own.encode("utf-16-le"))


def test_a_few_texts_are_in_hand_at_once(spark):
    """What Python returns of a batch does not follow its size, and nothing is listed row by row."""
    import pyarrow as pa

    rows = spark.range(300).select("id", F.lit("One is here. Two is there. Three.").alias("text"))
    made = T.excerpted(rows)
    assert made.count() == 300 and "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    assert T._excerpts_of(["One. Two.", None, " "]).to_pylist() == [[dict(zip(("kind", "text", "start_offset"), e, strict=True)) for e in T.excerpts("One. Two.")], [], []]
    assert isinstance(T._excerpts_of(["One. Two."]), pa.ListArray)


def test_places_of_some_lexemes_are_those_of_all(spark):
    texts = ["Well-known roofs - a ROOF leak_leak", None, "", "no such word", "re-roof re-re-roof leaking leaks " * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {(r.id, r.lexeme): r.positions for r in T.lexeme_places(rows, ["roof", "leak", "re-roof"]).collect()}
    assert got == {(i, lex): at for i, t in enumerate(texts) for lex, at in T.vector_of(t).items() if lex in ("roof", "leak", "re-roof")} and len(got) == 5


def test_hybrid_batch_carries_no_words_to_pairs(spark):
    from marlstone.plans.queries import QUERIES

    plan = QUERIES["search_hybrid_batch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "lexemes" not in plan and "ArrowEvalPython" not in plan
