"""Scans in time against folds, half precision against numpy, nested JSON against a recursive walk, ratings cell by cell."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalar as S
from marlstone.functions import vector as V
from marlstone.operators import jobs, pacing
from marlstone.sources import files, variants


@pytest.mark.parametrize("spacing, most, period", [(200, 3, 1000), (200, 5, 1000), (0, 4, 1000), (500, 1, 300), (7, 60, 60_000)])
def test_paced_as_one_after_the_other(spark, spacing, most, period, monkeypatch):
    monkeypatch.setattr(pacing, "BLOCK", 4)
    rng = random.Random(spacing + most)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), rng.randint(0, 30_000)) for i in range(400)]
    got = pacing.paced(spark.createDataFrame(rows, "event_id bigint, k bigint, at_ms bigint"), "k", spacing, most, period).collect()
    for k in (0, 1, 2):
        mine = sorted((t, i) for i, u, t in rows if u == k)
        want = jobs.pace_fold([t for t, _ in mine], spacing, most, period)
        assert [r.start_ms for r in sorted((r for r in got if r.k == k), key=lambda r: r.n)] == want
        assert [r.event_id for r in sorted((r for r in got if r.k == k), key=lambda r: r.n)] == [i for _, i in mine]


def attempts_of(seed, n=500):
    rng = random.Random(seed)
    times = sorted(rng.randint(0, 200_000) for _ in range(n))
    return [(i, rng.choice([0, 0, 1]), t, rng.random() < 0.6) for i, t in enumerate(times)]


def folded(rows, most):
    out = {}
    for k in (0, 1):
        mine = [r for r in rows if r[1] == k]
        out |= dict(zip([r[0] for r in mine], jobs.penalty_fold([1_700_000_040 + r[2] / 1000 for r in mine], [r[3] for r in mine], most), strict=True))
    return out


def attempts(spark, rows):
    return spark.createDataFrame(rows, "ident bigint, k bigint, ms bigint, failed boolean").withColumn("ts", F.timestamp_millis(F.lit(1_700_000_040_000) + F.col("ms"))).drop("ms")


def test_penalties_as_one_after_the_other(spark):
    rows = attempts_of(4)
    got = {r.ident: r.blocked for r in pacing.penalised(attempts(spark, rows), "k", 5, ident="ident").collect()}
    assert got == folded(rows, 5) and 0 < sum(got.values()) < len(got)


def test_penalties_as_a_stream_that_is_restarted(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, got = attempts_of(5, 200), {}
    schema = attempts(spark, rows[:1]).schema
    for part in (rows[:90], rows[90:]):
        attempts(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = pacing.penalty_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 5)
        q = stream.writeStream.foreachBatch(lambda b, _: got.update({r.ident: r.blocked for r in b.collect()})).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert got == folded(rows, 5) and any(got.values())


def test_half_precision_as_numpy(spark):
    rng = np.random.default_rng(3)
    bits = np.concatenate([np.arange(0, 65536, 37), [0, 1, 0x3FF, 0x400, 0x401, 0x7BFF, 0x7C00, 0xFC00, 0x8000, 0x8001]]).astype(np.uint16)
    exact = bits.view(np.float16).astype(np.float64)
    exact = exact[~np.isnan(exact)]
    finite = exact[np.isfinite(exact)]
    halfway = (finite[:-1] + finite[1:]) / 2
    values = np.concatenate([exact, halfway, rng.normal(size=500), rng.normal(size=500) * 1e-6, rng.normal(size=200) * 1e5, 2.0 ** np.arange(-30, 17), np.nextafter(2.0 ** np.arange(-20, 16), 0), [65504, 65519.999, 65520, -65520, 1e300, 1e-300, 5e-324, -0.0, math.inf, -math.inf]])
    want = values.astype(np.float16).view(np.int16)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double").select("i", V.half_bits(F.col("x")).alias("b")).withColumn("y", V.half_value(F.col("b")))
    got = df.orderBy("i").collect()
    assert [r.b for r in got] == want.tolist()
    assert [r.y for r in got] == values.astype(np.float16).astype(np.float64).tolist()
    odd = spark.createDataFrame([(float("nan"),), (None,)], "x double").select(V.half_value(V.half_bits(F.col("x"))).alias("y")).collect()
    assert math.isnan(odd[0].y) and odd[1].y is None
    v = spark.createDataFrame([([0.1, 2.0, -3.3],)], "v array<double>").select(V.from_half(V.to_half(F.col("v"))).alias("h")).first().h
    assert v == np.array([0.1, 2.0, -3.3]).astype(np.float16).astype(float).tolist()


def nested(rng, depth):
    kinds = ["x", 'quo"te', 1, 1.5, 2.0, True, None, [1, {"a": 2}], [], {}]
    return {rng.choice(["b", "a", "z.y", "é", "long name"]) + str(i): nested(rng, depth - 1) if depth and rng.random() < 0.4 else rng.choice(kinds) for i in range(rng.randint(0, 4))}


def test_cells_as_a_walk_over_each_record(spark):
    rng = random.Random(6)
    records = [nested(rng, 6) for _ in range(80)] + [{"s": '{"not": "nested"}', "deep": {"a": {"b": {"c": {"d": {"e": {"f": "end"}}}}}}}]
    lines = [(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records)]
    odd = [(900, "no json"), (901, "[1, 2]"), (902, '"text"'), (903, None), (904, "")]
    table = variants.cells(spark.createDataFrame(lines + odd, "row bigint, json string"))
    got = {}
    for r in table.collect():
        assert (r.row, r.name) not in got
        got[r.row, r.name] = r.value
    want = {(i, k): v for i, r in enumerate(records) for k, v in files.flatten(r).items()}
    assert got == want
    order = [r.name for r in variants.headers(table).orderBy("first").collect()]
    assert order == list(dict.fromkeys(k for r in records for k in files.flatten(r)))
    assert {r.row for r in variants.broken(spark.createDataFrame(lines + odd, "row bigint, json string")).collect()} == {900, 901, 902, 903, 904}


def test_lines_are_split_over_tasks(spark, tmp_path):
    path = tmp_path / "big.json"
    path.write_text("﻿" + "\n".join(json.dumps({"n": i, "in": {"x": "y" * 200}}) for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        lines = variants.json_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 4 and lines.count() == 4000
        table = variants.cells(lines)
        assert table.count() == 8000 and [r.cells["n"] for r in variants.rows_of(table).orderBy("row").limit(3).collect()] == ["0", "1", "2"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


#: Cells of all kinds and what they say, by hand.
RATINGS = {
    "5": 5, "5.0": 5, "4.5": 5, "4,4": 4, "0": None, "6": 3, "10": 5, "8.5": 4, "11": None, "-5": None, "3-": None, "+4": None, "fi ve": None, "five": 5, "FIVE": 5, "Five stars": 5, "five-star": 5, "five_stars": 5,
    "Rated 4/5": 4, "rated 4": 4, "Rated4": 4, "rated 4 stars": 4, "rated 4/6": None, "rated 4 /5": 4, "rated -4": None, "4/5": 4, "8 / 10": 4, "4 out of 5": 4, "4out of5": 4, "4 outof 5": None, "4.5 of 5": 5, "4/0": None, "4/5 stars": 4, "/5": None,
    "★★★★☆": 4, "★ ★": None, "☆☆": None, "***": 3, "4★": 4, "4 ★": 4, "4 ★★": None, "4 stars": 4, "4-stars": 4, "8-stars": None, "4 - stars": 4, "4..5": None, "1 000": None, "": None, "  3  ": 3, "4 5": None, "four point five": None, "6 stars": 3, "5stars!": None, "4,5/5": 5, "4/5,9": 4, " 5 ": 5,
}


def test_ratings_cell_by_cell(spark):
    rows = spark.createDataFrame([(c,) for c in RATINGS], "c string").select("c", S.parse_rating(F.col("c")).alias("r")).collect()
    assert {r.c: r.r for r in rows} == RATINGS


def test_each_level_of_nested_json_is_parsed_once(spark):
    deep = spark.createDataFrame([(1, '{"a": {"b": {"c": {"d": {"e": 1.50}}}}, "f": null}')], "row bigint, json string")
    table = variants.cells(deep)
    assert "parse_json" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.name, r.value, r.place) for r in table.collect()) == [("a.b.c.d.e", "1.5", [1, 1, 1, 1, 1]), ("f", "", [2])]


def test_prose_is_no_date_and_no_rating(spark):
    """Dates and ratings in the longest forms are read still; texts of many words are refused before they are taken apart."""
    dates = ["sunday at at Jan 5 th , 2026 at 3:04 p . m .", "jan 5, 2026", "2026-01-05T10:00:00 u t c", "one two three four five six seven 5 jan 2026", "İ Jan 5, 2026"]
    ratings = ["4 out of 5 and many more words than these here", "five stars", "Rated 4/5", "it is a good four", "rated 4 stars", "three _-stars"]
    from marlstone.functions import scalar as S

    got = spark.createDataFrame([(i, d, r) for i, (d, r) in enumerate(zip([*dates, ""], ratings, strict=True))], "i int, d string, r string").select(S.parse_date_ms(F.col("d")).isNotNull().alias("d"), S.parse_rating(F.col("r")).alias("r"), F.rlike("d", F.lit(S.MANY_WORDS)).alias("prose")).collect()
    assert [r.r for r in got] == [4, 5, 4, None, 4, 3]
    assert [r.prose for r in got] == [False, False, False, True, False, False] and got[1].d and not got[3].d
