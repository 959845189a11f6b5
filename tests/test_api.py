import json
from datetime import UTC, datetime

import pytest

from marlstone.plans import api
from pyspark.sql import functions as F


def test_requests():
    r = api.parse_request({"q": " roof  leak ", "limit": 3, "include": "text", "filters": {"metadata.place": "n", "source": "google", "since": "2025-01-01", "min_rating": 4}})
    assert (r.q, r.limit, r.include, r.sources, r.metadata, r.since) == ("roof  leak", 3, ("text",), ("google",), {"place": "n"}, datetime(2025, 1, 1, tzinfo=UTC))
    assert api.parse_params({"q": "roof  leak", "limit": "3", "include": "text", "filters.source": "google", "filters.since": "2025-01-01", "filters.metadata.place": "n", "min_rating": "4"}) == r
    with pytest.raises(api.Invalid) as e:
        api.parse_request({"q": " ", "limit": 21, "mode": "x", "odd": 1, "include": ["y"], "filters": {"since": "soon", "min_rating": 9, "z": 1}})
    assert {p for p, _ in e.value.issues} == {"q", "limit", "mode", "odd", "include", "filters.since", "filters.min_rating", "filters.z"}
    assert api.fold_metadata({"metadata.a": 1, "metadata": {"b": 2}, "x": 3}) == {"metadata": {"b": 2, "a": 1}, "x": 3}


def test_cursors():
    assert api.decode_cursor(api.encode_cursor("2026-01-05T00:00:00Z", "id")) == ("2026-01-05T00:00:00Z", "id")
    assert api.decode_cursor(api.encode_cursor(None, "id")) == (None, "id")
    assert [api.decode_cursor(x) for x in ("!", "abc", "e30", api.encode_cursor("x", "i"))] == [None] * 4


def test_cache_keys_and_generations():
    a, b = api.parse_request({"q": "Roof  LEAK", "filters": {"source": ["b", "a"]}}), api.parse_request({"q": "roof leak", "filters": {"source": ["a", "b", "a"]}})
    policy = {"similarity_floor": 0.66, "category": "roofing", "min_rating": 4}
    assert api.cache_key(a, "p", "live", 1, policy) == api.cache_key(b, "p", "live", 1, policy) != api.cache_key(b, "p", "live", 2, policy)
    assert api.cache_key(a, "p", "live", 1, policy) != api.cache_key(a, "p", "live", 1, {**policy, "category": None})
    assert api.canonical_json({"b": [1, {"d": 1, "c": None}], "a": datetime(2026, 1, 5, tzinfo=UTC)}) == '{"a":"2026-01-05T00:00:00.000Z","b":[1,{"c":null,"d":1}]}'
    c = api.ResultCache(10)
    assert c.get("k", 0) is None and not c.put("k", "v", 0) and c.get("k", 1) is None and c.put("k", "v", 1) and c.get("k", 2) == "v" and c.get("k", 12) is None
    c.bump({"p"})
    assert c.generations == {"p": 1}


def test_answers(spark):
    row = ("c", "r", "b😀c", 2, 0.7, 5, "Ann", None, "google", None, None, {"k": "v"}, "a b😀c d")
    rows = spark.createDataFrame([row], "chunk_id string, review_id string, excerpt string, start_offset int, similarity double, rating int, author_name string, author_avatar_url string, source string, occurred_at timestamp, url string, metadata map<string,string>, review_text string")
    got = json.loads(api.answer(rows, api.Request(q="x"), "query").first().json)
    assert got["highlight"] == {"start": 2, "end": 6} and got["matched"] and "text" not in got["review"] and got["review"]["url"] is None
    assert json.loads(api.answer(rows.withColumn("similarity", F.lit(None).cast("double")), api.Request(mode="reviews"), "recent").first().json)["highlight"] is None
    empty = rows.limit(0)
    assert api.with_fallback(api.Request(q="x", fallback="recent"), empty, lambda: rows)[1] == "fallback" and api.with_fallback(api.Request(q="x"), empty, lambda: rows)[1] == "none"
    assert api.with_fallback(api.Request(q="x", fallback="recent"), rows, lambda: empty)[1] == "query" and api.with_fallback(api.Request(), empty, lambda: rows)[1] == "recent"


def test_pushed_reviews(spark):
    from marlstone import schema

    good = ("id", "google", 5, "text", "Ann", None, "2026-01-05T00:00:00Z", None, "en", {"k": "v"})
    bad = (" ", "zomato", 9, "x" * 20_001, None, "ftp://x", "2026-01-05", "nope", "e", {"k" * 65: "v"})
    got = [{i.path for i in r.issues} for r in api.checked(spark.createDataFrame([good, bad], schema.REVIEW_INPUT)).collect()]
    assert got == [set(), {"external_id", "source", "rating", "text", "author_name", "author_avatar_url", "occurred_at", "url", "language", "metadata"}]


def test_runs_batches_and_marks(spark):
    records = spark.createDataFrame([(1, "running", 1, 10, 5, 1, 0, 0), (1, "succeeded", 2, 5, 3, 0, 1, 1)], "run_id int, status string, at int, received int, created int, updated int, skipped int, failed int")
    r = api.run_totals(records).first()
    assert (r.status, r.received, r.processed) == ("succeeded", 15, 11)
    assert api.send_batches(list(range(5)), lambda b: 4 not in b, 2) == ([0, 1, 2, 3], [4]) and api.send_batches([1], lambda b: True) == ([1], [])
    rows, marks = spark.createDataFrame([(1,), (2,)], "chunk_id int"), spark.createDataFrame([(1, True)], "chunk_id int, lexical boolean")
    assert api.annotate(rows.filter("chunk_id = 1"), marks).first().lexical
    with pytest.raises(Exception, match="no mark for 2"):
        api.annotate(rows, marks).collect()


def test_a_request_is_searched_and_answered(spark):
    schema = "id bigint, project_id bigint, environment string, rating int, sentiment string, hidden boolean, source string, occurred_s bigint, occurred_at timestamp, metadata map<string,string>, author_name string, author_avatar_url string, url string, text string"
    when = datetime(2026, 1, 5, tzinfo=UTC)
    reviews = spark.createDataFrame([(i, 1, "live", 5, None, False, "google", 1000 - i, when, {"place": "north" if i % 2 else "south"}, f"Ann {i}", None, "https://x.y", f"Text {i} roof") for i in range(6)], schema)
    chunks = spark.createDataFrame([(10 + i, i, "full", 0, f"Text {i} roof", [1.0, i / 10], {"roof": [3]}) for i in range(6)], "id bigint, review_id bigint, kind string, start_offset int, text string, embedding array<double>, lexemes map<string,array<int>>")
    project = {"project_id": 1, "min_rating": 4, "similarity_floor": 0.66}
    ask = lambda body, vector=None: [json.loads(r.json) for r in api.search_and_answer(api.parse_request(body), project, reviews, chunks, vector).collect()]
    got = ask({"q": "roof", "limit": 2, "filters": {"metadata.place": "north"}}, [1.0, 0.0])
    assert [x["review"]["id"] for x in got] == [1, 3] and got[0]["matched"] and got[0]["excerpt"] == "Text 1 roof" and got[0]["review"]["author_name"] == "Ann 1" and got[0]["review"]["metadata"] == {"place": "north"}
    assert [x["review"]["id"] for x in ask({"limit": 3})] == [0, 1, 2]
    none = {"q": "door", "filters": {"metadata.place": "west"}}
    assert ask(none, [1.0, 0.0]) == [] and [x["matched"] for x in ask({**none, "fallback": "recent", "filters": {}}, [0.0, -1.0])][:1] == [False]
    assert api.to_query(api.parse_request({"filters": {"min_rating": 2}}), 1, project).min_rating == 4
