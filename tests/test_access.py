import hashlib
import json

import pytest

from marlstone.operators import access, evals
from marlstone.plans import api, generate
from marlstone.sources import mapping
from pyspark.sql import functions as F


def test_keys(spark):
    h = lambda k: hashlib.sha256(k.encode()).hexdigest()
    keys = spark.createDataFrame([(h("a"), "secret", "live", 1, None), (h("b"), "secret", "live", 1, "x"), (h("c"), "secret", "live", 2, None)], "key_hash string, kind string, environment string, project_id int, revoked_at string")
    projects = spark.createDataFrame([(1, 7, 4, 0.66, None), (2, 8, 4, 0.66, None)], "id int, account_id int, min_rating int, similarity_floor double, category string")
    accounts = spark.createDataFrame([(7, "paid", None), (8, "free", "x")], "id int, plan string, deleted_at string")
    asked = spark.createDataFrame([("a", "secret", "live"), ("a", "secret", "test"), ("b", "secret", "live"), ("c", "secret", "live"), ("z", "secret", "live")], "key string, kind string, environment string")
    got = access.key_lookup(keys, projects, accounts, asked).collect()
    assert [(r.project_id, r.plan) for r in got] == [(1, "paid")]


def test_freshness_resume_and_keys(spark):
    export = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10)], "suffix string, edited_ms int")
    assert sorted(r.suffix for r in access.fresher_than_stored(export, spark.createDataFrame([("a", 11), ("b", 10)], "suffix string, as_of_ms int")).collect()) == ["b", "c"]
    assert access.resume(spark.range(1, 6).select(F.col("id").alias("row")), 3).count() == 2
    rows = access.with_fixture_keys(spark.createDataFrame([(1,), (2,)], "review_id int"), spark.createDataFrame([(1, "k")], "review_id int, key string"))
    assert sorted(r.key for r in rows.collect()) == ["?2", "k"]


def test_vectors_by_text(spark):
    texts = access.corpus_texts(spark.createDataFrame([("a",), ("b",)], "text string"), spark.createDataFrame([("b",)], "q string"))
    vectors = spark.createDataFrame([("a", [1.0])], "text string, embedding array<float>")
    assert texts.count() == 2 and access.attach_vectors(texts.filter("text = 'a'"), vectors).first().embedding == [1.0]
    with pytest.raises(Exception, match="no vector for: b"):
        access.attach_vectors(texts, vectors).collect()


def test_replay(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"id": "q1", "q": "x", "kind": "positive", "tags": ["cross-language"], "expect": ["a"], "rows": [{"key": "a", "similarity": 0.7}, {"key": "b", "similarity": 0.6, "lexical": True}]}))
    rows, queries = generate.replay(spark, str(tmp_path))
    assert [(r.rank, r.key, r.lexical) for r in rows.orderBy("rank").collect()] == [(0, "a", None), (1, "b", True)] and queries.first().cross_language and queries.first().acceptable == []
    assert evals.verdicts(rows, queries, 0.5).first().hits == ["a"]


def test_entries_by_shape(spark):
    pages = [("r", json.dumps({"reviews": [{"name": "accounts/1/locations/2/reviews/3", "createTime": "x"}, {"name": "odd"}]})), ("e", json.dumps({"reviews": [{"name": "odd"}]})), ("l", json.dumps({"attributes": []})), ("m", json.dumps({"type": "FeatureCollection", "features": []})), ("o", json.dumps({"x": 1}))]
    got = {r.path: (r.kind, r.valid, r.invalid, r.error) for r in mapping.classify_entries(spark.createDataFrame(pages, "path string, text string")).collect()}
    assert got == {"r": ("reviews", 1, 1, False), "e": ("reviews", 0, 1, True), "l": ("location-data", 0, 0, False), "m": ("maps-reviews", 0, 0, False), "o": ("other", 0, 0, False)}


def test_addresses_lists_and_location_cursors(spark):
    assert api.query_url("/v1/query", {"q": "a b", "limit": 99, "metadata": {"z": "1", "a": "2"}}) == "/v1/query?q=a+b&limit=20&metadata.a=2&metadata.z=1" and api.query_url("/x", {}) == "/x"
    assert api.parse_list_params({"limit": "x", "min_rating": "7", "source": "yelp", "hidden": "all", "since": "2025-01-01"}) == {"limit": 20, "min_rating": None, "source": "yelp", "hidden": "all", "indexed": None, "since": api.parse_since("2025-01-01"), "cursor": None}
    rows = spark.createDataFrame([('{"l1": "t"}',), ("bad",), (None,)], "c string").select(api.location_cursors(F.col("c")).alias("m")).collect()
    assert [dict(r.m) for r in rows] == [{"l1": "t"}, {}, {}]
