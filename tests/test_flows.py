"""Snapshot tables, deliveries with retries, the outbox, polling and resumed imports: stopped at each step and started again."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import outbox, resumable
from marlstone.sources import polling, snapshots
from marlstone.streaming import delivery


@pytest.fixture
def table(spark, tmp_path):
    return lambda *partition: snapshots.SnapshotTable(spark, str(tmp_path / "table"), partition)


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id int, part string, v string")


def got(df):
    return sorted(map(tuple, df.collect()))


def test_versions_parts_and_records(spark, table):
    t = table("part")
    assert t.version() == 0 and t.read() is None and t.record() == {}
    t.commit(rows(spark, (1, "a", "x"), (2, "b/=c", "x"), (3, None, "n")), record={"n": 1})
    t.commit(rows(spark, (4, "a", "y")), keep="others")
    assert got(t.read().filter("part IS NOT NULL")) == [(2, "b/=c", "x"), (4, "a", "y")] and t.read().count() == 3
    assert t.read(1).count() == 3 and t.record() == {"n": 1}
    assert got(t.read(where={"part": "a"})) == [(4, "a", "y")]
    files = t.read(where={"part": "a"}).inputFiles()
    assert len(files) == 1 and "part=a" in files[0]
    t.commit(rows(spark, (5, "d", "z")), keep="others", replaced=[("a",)])
    assert sorted(r.id for r in t.read().collect()) == [2, 3, 5]
    t.commit(t.read().withColumn("v", F.lit("w")), keep="none", record={"n": 2})  # computed from itself
    assert {r.v for r in t.read().collect()} == {"w"} and t.read(3).count() == 3
    assert t.sweep(versions=1, older_than_s=-60) > 0 and t.read().count() == 3 and t._versions() == [4]


@pytest.mark.parametrize("step", ["write", "mkdirs", "create", "rename"])
def test_a_commit_that_breaks_off_leaves_the_old_version(spark, table, monkeypatch, step):
    t = table("part")
    t.commit(rows(spark, (1, "a", "old"), (2, "b", "old")), record={"n": 1})

    class Breaks:
        def __getattr__(self, name):
            def call(*a):
                if name == step:
                    raise OSError("gone")
                return getattr(real, name)(*a)

            return call

    real, new = t.files, rows(spark, (3, "a", "new"))
    if step in ("mkdirs", "create"):
        t.files = Breaks()
    elif step == "write":
        monkeypatch.setattr(t, "_write", lambda r: (_ for _ in ()).throw(OSError("gone")))
    else:
        monkeypatch.setattr(t, "_name", lambda v, own=t._name: own(v) if v < 2 else "/proc/absent/x.json")
    with pytest.raises(Exception):  # noqa: B017
        t.commit(new, keep="others", record={"n": 2})
    after = table("part")
    assert got(after.read()) == [(1, "a", "old"), (2, "b", "old")] and after.record() == {"n": 1}
    after.commit(new, keep="others", record={"n": 2})
    assert got(after.read()) == [(2, "b", "old"), (3, "a", "new")]
    after.sweep(older_than_s=-60)
    assert got(after.read()) == [(2, "b", "old"), (3, "a", "new")] and got(after.read(1)) == [(1, "a", "old"), (2, "b", "old")]


def test_of_two_commits_at_once_one_is_done_again(spark, table):
    t, other, tries = table(), table(), []
    t.commit(rows(spark, (1, "a", "x")))

    def change(old):
        if not tries:
            other.commit(rows(spark, (9, "o", "other")), keep="all")
        tries.append(1)
        return old.withColumn("v", F.concat("v", F.lit("!")))

    with pytest.raises(snapshots.CommitConflict):
        t.commit(rows(spark, (2, "b", "y")), base=0)
    snapshots.upsert_version(t, change)
    assert len(tries) == 2 and got(t.read()) == [(1, "a", "x!"), (9, "o", "other!")]


# ---- deliveries -----------------------------------------------------------------------------------------------


def test_waits_grow_to_five_minutes(spark):
    at = spark.range(1, 8).select("id", delivery.waited(F.col("id")).alias("w"))
    assert {r.id: r.w for r in at.collect()} == {1: 0, 2: 30, 3: 90, 4: 210, 5: 450, 6: 750, 7: 1050}
    assert [delivery.delay_after(k) for k in range(1, 7)] == [30, 60, 120, 240, 300, 300]


def test_deliveries_are_repeated_when_due_and_put_aside_at_last(spark, tmp_path):
    """A loop: what comes out is tried, and what happens to it goes in again; the stream is stopped and restarted each time."""
    source, state = tmp_path / "events", str(tmp_path / "checkpoint")
    source.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = []
    failing = {"m1": 99, "m2": 2, "m3": 0}

    def step(name, events):
        (source / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("review_id", "message_id", "kind", "attempt", "at"), e, strict=True))) for e in events))
        stream = delivery.deliveries(spark.readStream.schema(delivery.EVENT).json(str(source)))
        new = []
        q = stream.writeStream.foreachBatch(lambda b, _: new.extend(b.collect())).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        out.extend(new)
        return new

    stamp = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    new = step("0", [("r1", "m1", "sent", 0, stamp(0)), ("r1", "m2", "sent", 0, stamp(0)), ("r2", "m3", "sent", 0, stamp(0)), ("r1", "m1", "sent", 0, stamp(0))])
    assert sorted((r.message_id, r.action, r.attempt) for r in new) == [("m1", "deliver", 1), ("m2", "deliver", 1), ("m3", "deliver", 1)]
    clock = 0
    for k in range(1, 8):
        events = []
        for r in new:
            if r.action == "deliver":
                bad = failing[r.message_id] >= r.attempt
                events += [(r.review_id, r.message_id, "failed" if bad else "done", r.attempt, stamp(clock + 1))] * 2  # twice
        events += [("r9", f"tick{k}", "sent", 0, stamp(clock + 301))]  # time goes on
        new = [r for r in step(str(k), events) if r.review_id != "r9"]
        clock += 301
    mine = [(r.message_id, r.action, r.attempt) for r in out if r.review_id != "r9"]
    assert sorted(mine) == sorted([("m1", "deliver", 1), ("m1", "deliver", 2), ("m1", "deliver", 3), ("m1", "deliver", 4), ("m1", "dead", 4), ("m2", "deliver", 1), ("m2", "deliver", 2), ("m2", "deliver", 3), ("m3", "deliver", 1)])
    due = {(r.message_id, r.attempt): int(r.due.timestamp()) for r in out if r.action == "deliver" and r.message_id == "m1"}
    assert due["m1", 2] - due["m1", 1] == 1 + 30 and due["m1", 3] - due["m1", 2] > 60


# ---- the outbox -----------------------------------------------------------------------------------------------


def messages(spark, ids):
    return spark.createDataFrame([(i, 1, i) for i in ids], "id bigint, index_attempts int, updated_s bigint")


def test_whole_batches_go_and_the_rest_is_as_it_was(spark):
    told = outbox.with_quota(outbox.planned(messages(spark, range(250)), ["updated_s", "id"]), 230).collect()
    assert sorted(r.id for r in told if r.sent) == list(range(200)) and {(r.sent, r.index_attempts) for r in told} == {(True, 2), (False, 1)}
    assert all(r.sent for r in outbox.with_quota(outbox.planned(messages(spark, range(250)), ["id"], 250), 250).collect())
    assert outbox.with_quota(outbox.planned(messages(spark, []), ["id"]), 5).count() == 0


def test_a_micro_batch_that_is_repeated_sends_nothing_twice(spark, tmp_path, monkeypatch):
    t = snapshots.SnapshotTable(spark, str(tmp_path / "outbox"))
    box = outbox.Outbox(t, 150)
    monkeypatch.setattr(t, "_publish", lambda m: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        box.send(messages(spark, range(100)), 0)
    box = outbox.Outbox(snapshots.SnapshotTable(spark, str(tmp_path / "outbox")), 150)
    assert box.sent() is None
    assert box.send(messages(spark, range(100)), 0) == {"sent": 100, "deferred": 0, "repeated": 0}
    assert box.send(messages(spark, range(100)), 0)["repeated"] == 1
    assert box.send(messages(spark, range(100, 160)), 1) == {"sent": 0, "deferred": 60, "repeated": 0}
    assert box.sent().count() == 100 and {(r.id, r.index_attempts) for r in box.deferred().collect()} == {(i, 1) for i in range(100, 160)}


def test_what_was_put_off_is_offered_again(spark, tmp_path):
    source = tmp_path / "in"
    path = str(tmp_path / "outbox")

    def run(ids, quota):
        messages(spark, ids).write.mode("append").parquet(str(source))
        box = outbox.Outbox(snapshots.SnapshotTable(spark, path), quota)
        stream = spark.readStream.schema("id bigint, index_attempts int, updated_s bigint").parquet(str(source))
        outbox.outbox_stream(stream, box, str(tmp_path / "cp")).awaitTermination()
        return sorted(r.id for r in box.sent().collect())

    assert run(range(120), 100) == list(range(100))
    assert run(range(120, 130), 1000) == list(range(130))


# ---- imports --------------------------------------------------------------------------------------------------


def test_a_killed_import_goes_on_with_exact_totals(spark, tmp_path, monkeypatch):
    upload = spark.createDataFrame([(i, i % 7 if i % 11 else None, f"v{i // 20}", i % 5 != 0) for i in range(1, 101)], "row int, key int, v string, ok boolean")
    whole = resumable.ResumableImport(snapshots.SnapshotTable(spark, str(tmp_path / "whole")), "key", ["v"], F.col("ok"))
    want = whole.run(upload, 30)
    assert want["received"] == 100 and want["status"] == "succeeded" and sum(want[c] for c in resumable.COUNTS[1:]) == 100
    path, kills = str(tmp_path / "killed"), 0
    while True:
        t = snapshots.SnapshotTable(spark, path)
        run = resumable.ResumableImport(t, "key", ["v"], F.col("ok"))
        if run.progress()["status"] == "succeeded":
            break
        done, real = [], t._publish

        def publish(m, done=done, real=real):
            if done:
                raise OSError("killed")
            done.append(real(m))

        monkeypatch.setattr(t, "_publish", publish)
        try:
            run.run(upload, 30)
        except OSError:
            kills += 1
    assert kills >= 4 and run.progress() == want
    assert sorted(map(tuple, run.current().collect())) == sorted(map(tuple, whole.current().collect()))
    paused = resumable.ResumableImport(snapshots.SnapshotTable(spark, str(tmp_path / "paused")), "key", ["v"], F.col("ok"))
    assert paused.run(upload, 30, 1)["status"] == "paused" and paused.progress()["received"] == 30
    assert paused.run(upload, 30) == want


# ---- polling --------------------------------------------------------------------------------------------------


def test_polling_restarts_without_loss_or_repetition(spark, tmp_path):
    path, out = str(tmp_path / "store"), str(tmp_path / "out")

    def add(*reviews):
        polling.store_reviews(spark.createDataFrame([(l, n, u, 0, "FIVE", f"{n}@{u}") for l, n, u in reviews], "location string, name string, update_ms bigint, create_ms bigint, stars string, comment string"), path)

    def poll():
        q = polling.polled(spark, path, 2).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.location, r.name, r.update_ms) for r in spark.read.schema(polling.REVIEW).parquet(out).collect())

    first = [("a", f"r{i}", i) for i in range(7)] + [("b", "r9", 5)]
    add(*first)
    assert poll() == sorted(first)
    assert poll() == sorted(first)
    more = [("a", "r2", 50), ("a", "r8", 40), ("c", "new", 1)]  # one edited, one new, one location more
    add(*more, ("b", "late", 4))  # not newer than its location's cursor
    assert poll() == sorted(first + more)
    state = {(r.location, r.name): r.comment for r in polling.as_upserts(spark.read.schema(polling.REVIEW).parquet(out)).collect()}
    assert state["a", "r2"] == "r2@50" and len(state) == 10


def test_pages_have_tokens_and_a_walk_stops_at_its_cursor(spark, tmp_path):
    path = str(tmp_path / "store")
    polling.store_reviews(spark.createDataFrame([("a", f"r{i}", i // 2, i % 3, None, None) for i in range(9)], "location string, name string, update_ms bigint, create_ms bigint, stars string, comment string"), path)
    asked = []

    class Counted(polling.StoredConnector):
        def page(self, location, token=None):
            asked.append(token)
            return super().page(location, token)

    c = Counted(path, 2)
    seen = [(r[3], r[4], r[2]) for r in polling.walk(c, "a")]
    assert seen == sorted(seen, key=lambda r: (-r[0], -r[1], r[2])) and len(seen) == 9 and len(asked) == 5
    asked.clear()
    assert [r[2] for r in polling.walk(c, "a", since=3)] == ["r8"] and len(asked) == 1


def test_a_walk_reads_the_files_of_its_location_once(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "location string, name string, update_ms bigint, create_ms bigint, stars string, comment string"
    polling.store_reviews(spark.createDataFrame([("a", f"r{i % 40}", i // 2, i % 3, None, str(i)) for i in range(60)] + [("b", "x", 1, 1, None, "y")], schema).coalesce(1), path)
    opened = []

    class Opened(polling.StoredConnector):
        def _files(self):
            system, base, fs = super()._files()

            class System:
                get_file_info = system.get_file_info

                def open_input_stream(self, at):
                    opened.append(at)
                    return system.open_input_stream(at)

            return System(), base, fs

    c = Opened(path, 3)
    want = list(polling.walk(c, "a"))
    assert len(want) == 40 and len(opened) == 1
    got = sorted(map(tuple, polling.pages(spark, path, 3).filter("location = 'a'").collect()))
    assert got == sorted(want)
    polling.store_reviews(spark.createDataFrame([("a", "new", 99, 0, None, None)], schema), path)
    assert next(polling.walk(c, "a"))[2] == "new"
