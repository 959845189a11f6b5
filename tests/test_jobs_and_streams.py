import json

import pytest

from marlstone import constants as C
from marlstone.operators import dml, evals, jobs, search
from marlstone.sources import tables
from marlstone.streaming import index
from pyspark.sql import functions as F


def test_floors_and_generic_words():
    assert C.lexical_floor(0.66) == 0.53 and C.lexical_floor(0.1) == 0.0
    assert C.generic_words("roofing")[-1] == "contractor" and C.generic_words("x") == list(C.UNIVERSAL_GENERIC_WORDS)
    assert search.effective_min_rating(4, 2) == 4 and search.effective_min_rating(4, 5) == 5 and search.effective_min_rating(4, None) == 4


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 21}, {"text": "x"}])
def test_parameters(bad):
    with pytest.raises(ValueError):
        search.Query(**{"query_id": 1, "project_id": 1} | bad).check()
    with pytest.raises(ValueError):
        search.Query(1, 1, vector=[1.0]).check(2)


def test_unrated_negative_reviews_are_not_published(spark):
    rows = spark.createDataFrame([(1, None, "negative", False), (2, None, None, False), (3, 5, "negative", False), (4, 3, None, False), (5, 5, None, True)], "id int, rating int, sentiment string, hidden boolean")
    assert [r.id for r in rows.filter(search.publishable(4)).orderBy("id").collect()] == [2, 3]


def test_hybrid_words_lift_rows_to_the_lower_floor(spark):
    reviews = spark.createDataFrame([(i, 1, "live", 5, None, False, "google", 100 - i) for i in range(4)], "id bigint, project_id bigint, environment string, rating int, sentiment string, hidden boolean, source string, occurred_s bigint")
    sims = {0: [1.0, 0.0], 1: [0.6, 0.8], 2: [0.6, 0.8], 3: [0.2, 0.98]}
    words = {0: {}, 1: {"roof": [1]}, 2: {"door": [1]}, 3: {"roof": [1]}}
    chunks = spark.createDataFrame([(10 + i, i, "full", 0, sims[i], words[i]) for i in range(4)], "id bigint, review_id bigint, kind string, start_offset int, embedding array<double>, lexemes map<string,array<int>>")
    q = search.Query(1, 1, limit=5, vector=[1.0, 0.0], text="roof", similarity_floor=0.66)
    got = {r.review_id: r for r in search.hybrid(reviews, chunks, [q]).collect()}
    assert set(got) == {0, 1} and got[1].lexical and not got[0].lexical
    assert got[1].rrf == pytest.approx(1 / 62 + 1 / 61) and got[0].rrf == pytest.approx(1 / 61)
    both = {r.review_id: r.below_floor for r in search.debug(reviews, chunks, [q]).collect()}
    assert both == {0: False, 1: False, 2: True, 3: True}
    plain = search.vector_search(reviews, chunks, [search.Query(1, 1, vector=[1.0, 0.0], similarity_floor=0.5)]).collect()
    assert sorted(r.review_id for r in plain) == [0, 1, 2]


def test_caps(spark):
    rows = spark.createDataFrame([(1, "insert", 3), (1, "insert", 1), (1, "insert", 2), (1, "update", 4), (2, "insert", 5)], "project_id int, action string, ordinal int")
    room = spark.createDataFrame([(1, 2), (2, 9)], "project_id int, room int")
    assert sorted(r.ordinal for r in dml.capped(rows, room).filter("over").collect()) == [3]
    assert sorted(r.ordinal for r in dml.capped(rows, room, "reject").filter("over").collect()) == [1, 2, 3, 4]


def test_plan_change_and_newest(spark):
    a, p = dml.change_plan(spark.createDataFrame([(1, "free"), (2, "free")], "id int, plan string"), spark.createDataFrame([(7, 1, True), (8, 2, True)], "id int, account_id int, show_badge boolean"), 1, "paid", False)
    assert {r.id: r.plan for r in a.collect()} == {1: "paid", 2: "free"} and {r.id: r.show_badge for r in p.collect()} == {7: False, 8: True}
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c")], "key string, t int, v string")
    assert dml.newest_wins(rows, ["key"], "t", "v").first().v == "c"


def test_folds_in_time():
    ok, kept = jobs.limit_fold([0, 1, 2, 59, 60.5, 61.5], 2, 60)
    assert ok == [True, True, False, False, True, True] and kept == [60.5, 61.5]
    assert jobs.penalty_fold([0, 1, 2, 3, 61], [True, True, False, True, False], most=2) == [False, False, True, True, False]
    assert jobs.pace_fold([0, 0, 0, 0], 1, 3) == [0, 1, 2, 60]
    assert [jobs.sweep_gate(*x) for x in ((True, False), (False, None), (False, True), (False, False))] == ["full", "kv_unavailable", "pending", "idle"]


def test_rate_limit_is_the_fold_of_each_key(spark):
    rows = [(i, i % 3, 1_700_000_000 + i * 7 % 200) for i in range(120)]
    frame = spark.createDataFrame(rows, "event_id bigint, user_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.allowed for r in jobs.rate_limited(frame, "user_id", 4).collect()}
    for k in range(3):
        mine = sorted((s, i) for i, u, s in rows if u == k)
        want, _ = jobs.limit_fold([s for s, _ in mine], 4)
        assert [got[i] for _, i in mine] == want


def test_suggested_query(spark):
    texts = ["The implant by Patel was great"] * 12 + ["Patel did my implant"] * 3 + ["parking was easy"] * 6
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert jobs.suggested_query(frame, ["the", "was", "did", "great"]).first().suggestion == "implant patel"
    assert jobs.suggested_query(frame.limit(5), []).first().suggestion is None


def test_recommendation():
    assert evals.floor_steps(0.5, 0.8, 0.01)[:2] == [0.5, 0.51] and len(evals.floor_steps(0.5, 0.8, 0.01)) == 31
    with pytest.raises(ValueError):
        evals.floor_steps(0, 1, 0)


def test_curve_recommends_the_first_floor_that_does_both(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0.7, False), (1, 2, "x", 0.55, False), (2, 1, "y", 0.52, True)], "query_id int, rank int, key string, similarity double, lexical boolean")
    queries = spark.createDataFrame([(1, "positive", False, ["a"], []), (2, "negative", False, [], []), (3, "positive", True, ["q"], [])], "query_id int, kind string, cross_language boolean, expect array<string>, acceptable array<string>")
    r = evals.recommendation(evals.floor_curve(rows, queries, evals.floor_steps(0.5, 0.8, 0.01))).first()
    assert (r.lowest_safe, r.highest_recall, r.recommended, r.chosen) == (0.53, 0.7, 0.53, 0.53)
    p = rows.groupBy("query_id").agg(evals.nearest_rank(F.col("similarity")).alias("p")).orderBy("query_id").first().p
    assert (p.n, p.p10, p.p50, p.p90) == (2, 0.55, 0.55, 0.7)


def test_index_stream_replaces_excerpts_and_puts_odd_messages_aside(spark, tmp_path):
    queue = tmp_path / "queue"
    queue.mkdir()
    reviews = spark.createDataFrame([(1, "One. Two. Three. Four.", None, False), (2, "hidden", 5, True), (3, " ", 5, False), (4, "Great work!", None, False)], "id bigint, text string, rating int, hidden boolean")
    def send(name, *messages):
        (queue / name).write_text("\n".join(map(json.dumps, messages)))
    send("a.json", {"type": "review.index", "reviewId": "1"}, {"type": "review.index", "reviewId": "2"}, {"type": "review.index", "reviewId": "3"}, {"type": "odd"})
    run = lambda: index.index_stream(index.messages(spark, str(queue)), lambda: reviews, str(tmp_path / "chunks"), str(tmp_path / "failed"), str(tmp_path / "cp"), 32).awaitTermination()
    run()
    first = spark.read.parquet(str(tmp_path / "chunks")).collect()
    assert {r.review_id for r in first} == {1} and len(first) == 7 and all(len(r.embedding) == 32 for r in first)
    send("b.json", {"type": "review.index", "reviewId": "1"}, {"type": "review.index", "reviewId": "4"})
    run()
    again = spark.read.parquet(str(tmp_path / "chunks")).collect()
    assert sorted((r.review_id, r.kind, r.start_offset) for r in again if r.review_id == 1) == sorted((r.review_id, r.kind, r.start_offset) for r in first) and {r.review_id for r in again} == {1, 4}
    assert spark.read.json(str(tmp_path / "failed")).filter("type = 'odd'").count() == 1
    _, judged = jobs.index_step(reviews, spark.createDataFrame([(4,), (1,)], "review_id bigint"))
    assert {r.id: (r.sentiment, r.sentiment_source) for r in judged.collect()}[4] == ("positive", "model")


def index_once(spark, tmp_path, reviews, name, *ids):
    queue = tmp_path / "queue"
    queue.mkdir(exist_ok=True)
    (queue / name).write_text("\n".join(json.dumps({"type": "review.index", "reviewId": str(i)}) for i in ids))
    index.index_stream(index.messages(spark, str(queue)), lambda: reviews, str(tmp_path / "chunks"), str(tmp_path / "failed"), str(tmp_path / "cp"), 16).awaitTermination()
    return {r.review_id for r in spark.read.parquet(str(tmp_path / "chunks")).collect()}


def test_index_stream_touches_only_what_is_named(spark, tmp_path):
    schema = "id bigint, text string, rating int, hidden boolean"
    reviews = spark.createDataFrame([(i, f"Review {i}. It was good.", 5, False) for i in range(1, 6)], schema)
    assert index_once(spark, tmp_path, reviews, "a.json", 1, 2, 3, 4) == {1, 2, 3, 4}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "chunks").rglob("*.parquet")}
    assert index_once(spark, tmp_path, reviews, "b.json", 5) == {1, 2, 3, 4, 5}
    assert sum(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items()) >= len(before) - 1
    gone = spark.createDataFrame([(1, "Review 1. It was good.", 5, True), (2, "  ", 5, False), (3, "New words.", 5, False)], schema)
    assert index_once(spark, tmp_path, gone, "c.json", 1, 2, 3) == {3, 4, 5}
    # A damaged partition that the batch needs ends the stream and loses nothing.
    part = spark.range(1).select(index.part_of(F.lit(4))).first()[0]
    hurt = next((tmp_path / "chunks" / f"part={part}").glob("*.parquet"))
    whole = hurt.read_bytes()
    hurt.write_bytes(b"damaged")
    for crc in hurt.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):  # noqa: B017
        index_once(spark, tmp_path, reviews, "d.json", 4)
    hurt.write_bytes(whole)
    assert {r.review_id for r in spark.read.parquet(str(tmp_path / "chunks")).collect()} == {3, 4, 5}


@pytest.mark.parametrize("parts", [False, True])
@pytest.mark.parametrize("renames", [0, 1])
def test_a_replacement_that_breaks_off_is_finished(spark, tmp_path, monkeypatch, parts, renames):
    path = str(tmp_path / "table")
    old, new = (spark.createDataFrame([(i, v, i % 2) for i in range(4)], "id int, v string, part int") for v in ("old", "new"))
    old.write.partitionBy("part").parquet(path) if parts else old.write.parquet(path)
    real, done = tables._files, []

    class Breaks:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            def call(*a):
                if name == "rename":
                    if len(done) == renames:
                        raise OSError("gone")
                    done.append(a)
                return getattr(self.fs, name)(*a)

            return call

    monkeypatch.setattr(tables, "_files", lambda s, p: (lambda fs, at: (Breaks(fs), at))(*real(s, p)))
    with pytest.raises(OSError):
        tables.swap_parts(new, path, "part", [0, 1]) if parts else tables.swap(new, path)
    monkeypatch.setattr(tables, "_files", real)
    tables.recover(spark, path)
    got = spark.read.parquet(path).collect()
    assert len(got) == 4 and {r.v for r in got} <= {"old", "new"} and (renames == 0 or any(r.v == "new" for r in got))
    assert [p.name for p in tmp_path.iterdir()] == ["table"]
    tables.recover(spark, path)
    assert spark.read.parquet(path).count() == 4


def test_only_pending_excerpts_are_embedded(spark):
    chunks = spark.createDataFrame([(i, f"text {i}", [float(i)] if i % 3 else None) for i in range(200)], "id int, text string, embedding array<float>")
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        assert len(texts) <= 50
        calls.add(len(texts))
        return [[-1.0]] * len(texts)

    got = {r.id: r.embedding for r in jobs.embed_pending(chunks.coalesce(1), embed).collect()}
    assert all(got[i] == ([float(i)] if i % 3 else [-1.0]) for i in range(200)) and calls.value == 67


def test_buffered_counts_wait_for_a_flush_that_succeeds(spark):
    rows = [(1, 0, True), (1, 1, True), (1, 6, False), (1, 12, True), (1, 17, False), (2, 3, True)]
    events = spark.createDataFrame(rows, "project_id int, s bigint, flushed boolean").select("project_id", F.timestamp_seconds("s").alias("ts"), "flushed", F.lit(1).alias("cache_hit"))
    got = {(r.project_id, r.flush): r.queries for r in jobs.buffered_flush(events).collect()}
    assert got == {(1, 1): 2, (1, 3): 2, (1, None): 1, (2, 1): 1}


def test_flushes_are_found_across_blocks_looking_at_each_row_once(spark):
    rows = [(1, 3, False), (1, 20_000, False), (1, 20_001, True), (1, 90_000, False), (1, None, True), (None, 3, True)]
    events = spark.createDataFrame(rows, "project_id int, s bigint, flushed boolean").select("project_id", F.timestamp_seconds("s").alias("ts"), "flushed", F.lit(1).alias("cache_hit"))
    out = jobs.buffered_flush(events)
    got = {(r.project_id, r.flush): r.n for r in out.groupBy("project_id", "flush").agg(F.sum("queries").alias("n")).collect()}
    assert got == {(1, 4001): 3, (1, None): 2, (None, None): 1}
    # A frame that ends at the last row is summed anew for every row.
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()


def test_sweep_markers_expire(spark):
    marks = spark.createDataFrame([(1, "mark", 100), (2, "mark", 100), (2, "clear", 150), (3, "mark", 5000)], "project_id int, kind string, at_s bigint")
    assert {r.project_id: r.pending for r in jobs.marker_state(marks, 5100).collect()} == {1: False, 2: False, 3: True}


def test_limits_and_usage_as_streams(spark, tmp_path):
    source = str(tmp_path / "events")
    rows = [(i, i % 2, i % 3, 1_700_000_000 + i) for i in range(30)]
    batch = spark.createDataFrame(rows, "event_id bigint, user_id bigint, project_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s")).withColumn("cache_hit", F.lit(1)).drop("s")
    batch.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    q = index.limited_stream(stream, "user_id", 5).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id: r.allowed for r in spark.sql("SELECT * FROM limited").collect()}
    for k in (0, 1):
        mine = [i for i, u, *_ in rows if u == k]
        assert [got[i] for i in mine] == jobs.limit_fold([1_700_000_000 + i for i in mine], 5)[0]
    q = index.usage_stream(stream).writeStream.format("memory").queryName("used").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.queries for r in spark.sql("SELECT * FROM used").collect()) == [10, 10, 10]


def test_poll_takes_what_is_newer_and_moves_the_cursor(spark):
    page = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 5)], "location string, id int, update_ms bigint")
    fresh, moved = index.poll(page, spark.createDataFrame([("a", 10), ("c", 1)], "location string, cursor_ms bigint"))
    assert sorted(r.id for r in fresh.collect()) == [2, 3] and {r.location: r.cursor_ms for r in moved.collect()} == {"a": 20, "b": 5, "c": 1}


def test_suggested_query_takes_texts_apart_once(spark):
    frame = spark.createDataFrame([("The crew's roof leak. Roof!",)] * 21 + [("A leak.",)], "text string")
    plan = jobs.suggested_query(frame, ["the"])
    assert plan.first().suggestion == "roof leak" and "regexp_extract_all" not in plan._jdf.queryExecution().optimizedPlan().toString()
