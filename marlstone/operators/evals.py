"""Evaluation of relevance: verdicts, floor curves, two-tier grids, percentiles.

Observed rows are (query_id, rank, key, similarity, lexical); queries are (query_id, kind, cross_language, expect,
acceptable).  Sweeps join the observations with a small fixed grid of floors and sum once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_N = 3
MIN_RECALL, MAX_NEGATIVE_RATE = 0.9, 0.05


def floor_steps(first: float, last: float, step: float) -> list[float]:
    """An inclusive grid, rounded as the step is."""
    if step <= 0:
        raise ValueError("step must be positive")
    decimals = max(0, math.ceil(-math.log10(step)))
    return [round(first + i * step, decimals) for i in range(int(math.floor((last - first) / step + 0.5)) + 1)]


def nearest_rank(values: Column) -> Column:
    """n, p10, p50, p90, min, max of a column by nearest rank, for small groups; nulls where there are no values."""
    ordered = F.sort_array(F.collect_list(values))
    n = F.size(ordered)
    at = lambda p: F.get(ordered, F.greatest(F.lit(0), F.ceil(p * n).cast("int") - 1))
    return F.struct(n.alias("n"), at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.get(ordered, F.lit(0)).alias("min"), F.get(ordered, n - 1).alias("max"))


def ranked_values(rows: DataFrame, value: str, keys: Sequence[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Of each group its size n, min, max, and the values at some ranks (from 1, given n), without a list of all values.

    Equal values are counted first (map-side combined), so what is left to sort are a group's different values; a rank is in the
    first value whose running count reaches it.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).count()
    w = Window.partitionBy(*keys)
    upto = F.sum("count").over(w.orderBy("_v"))
    told = counted.withColumn("_upto", upto).withColumn("_n", F.sum("count").over(w))
    found = told.groupBy(*keys).agg(F.max("_n").alias("n"), *[F.min(F.when(F.col("_upto") >= rank(F.col("_n")), F.col("_v"))).alias(name) for name, rank in ranks.items()], F.min("_v").alias("min"), F.max("_v").alias("max"))
    return found


def percentiles(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Exact nearest-rank percentiles of groups; a group without values has n = 0 and nulls."""
    at = lambda p: lambda n: F.greatest(F.lit(1), F.ceil(p * n))
    found = ranked_values(rows, value, keys, {f"p{round(100 * p)}": at(p) for p in (0.1, 0.5, 0.9)})
    return rows.select(*keys).distinct().join(found, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bench_stats(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Median and p95 as the element at floor(q * n) of the sorted values."""
    at = lambda q: lambda n: F.least(n, F.floor(q * n) + 1)
    return ranked_values(rows, value, keys, {"median": at(0.5), "p95": at(0.95)}).select(*keys, "median", "p95", "max", "n")


def judged(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Observed rows of scored queries with what each is: hit, ok (acceptable) or wrong; `side` is positive or negative."""
    q = queries.filter("kind IN ('positive', 'negative', 'policy-filtered') AND NOT (kind = 'positive' AND cross_language)")
    side = F.when(F.col("kind") == "positive", "positive").otherwise("negative")
    is_hit = F.array_contains("expect", F.col("key")) & (F.col("kind") == "positive")
    is_ok = F.array_contains("acceptable", F.col("key")) & (F.col("kind") == "positive")
    return q.join(rows, "query_id", "left").select("query_id", side.alias("side"), F.when(F.col("kind") == "positive", F.size("expect")).otherwise(0).alias("wanted"), "rank", "key", "similarity", "lexical", F.coalesce(is_hit, F.lit(False)).alias("hit"), F.coalesce(is_ok & ~is_hit, F.lit(False)).alias("ok"))


def points(rows: DataFrame, queries: DataFrame, settings: list[tuple[float, float]], *keys: str) -> DataFrame:
    """Pooled precision and recall, answered and clean queries, and the rate of negatives hit, for each of the `settings`.

    A setting is (high, low), named by `keys`: a row passes at `high`, or at `low` if its words match.  So what a row passes
    is told by how many of its tier's thresholds it reaches: observed rows are counted once by query, tier and that
    number, with the first TOP_N of each, and only these counts, as many a query as there are thresholds, meet the settings.
    """
    highs, lows = sorted({h for h, _ in settings}), sorted({min(h, low) for h, low in settings})
    reached = lambda bounds: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda t: t <= F.col("similarity")))
    words = F.coalesce("lexical", F.lit(False))
    each = judged(rows, queries).select("query_id", "side", "wanted", "rank", "hit", "ok", words.alias("words"), F.when(F.col("similarity").isNull(), 0).when(words, reached(lows)).otherwise(reached(highs)).alias("at"))
    bins = each.groupBy("query_id", "side", "wanted", "words", "at").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit") & ~F.col("ok")).alias("fp"), F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("query_id", "words", "at").orderBy("rank", F.col("hit") | F.col("ok"), "hit"))
    tops = each.withColumn("place", first).filter(F.col("place") <= TOP_N).groupBy("query_id", "words", "at").agg(F.collect_list(F.struct("rank", (F.col("hit") | F.col("ok")).alias("fine"), "hit")).alias("top"))
    grid = rows.sparkSession.createDataFrame([(h, low, highs.index(h) + 1, lows.index(min(h, low)) + 1) for h, low in settings], "high double, low double, high_at int, low_at int")
    met = bins.join(tops, ["query_id", "words", "at"], "left").join(F.broadcast(grid), F.lit(True))
    passes = F.col("at") >= F.when(F.col("words"), F.col("low_at")).otherwise(F.col("high_at"))
    counted = lambda c: F.coalesce(F.sum(F.when(passes, F.col(c))), F.lit(0))
    head = F.slice(F.sort_array(F.flatten(F.collect_list(F.when(passes, F.col("top"))))), 1, TOP_N)
    per = met.groupBy(*keys, "query_id", "side").agg(
        F.first("wanted").alias("wanted"), counted("tp").alias("tp"), counted("fp").alias("fp"), counted("n").alias("n"),
        ((F.size(head) > 0) & F.forall(head, lambda x: x["fine"]) & F.exists(head, lambda x: x["hit"])).alias("clean"),
    )
    pos, neg = F.col("side") == "positive", F.col("side") == "negative"
    out = per.groupBy(*keys).agg(
        F.sum(F.when(pos, F.col("tp")).otherwise(0)).alias("true_positives"), F.sum(F.when(pos, F.col("fp")).otherwise(0)).alias("false_positives"), F.sum(F.when(pos, F.col("wanted") - F.col("tp")).otherwise(0)).alias("misses"),
        F.count_if(pos & (F.col("n") == 0)).alias("empty_positives"), F.count_if(pos & (F.col("tp") > 0)).alias("answered"), F.count_if(pos & F.col("clean")).alias("top_clean"), F.count_if(pos).alias("positives"),
        F.count_if(neg & (F.col("n") > 0)).alias("negative_hits"), F.sum(F.when(neg, F.col("n")).otherwise(0)).alias("negative_rows"), F.count_if(neg).alias("negatives"),
    )
    share = lambda a, b, empty: F.when(b == 0, F.lit(empty).cast("double")).otherwise(F.try_divide(a, b))
    tp, fp, miss = (F.col(c) for c in ("true_positives", "false_positives", "misses"))
    return out.withColumns({"precision": share(tp, tp + fp, None), "recall": share(tp, tp + miss, 1.0), "answered_rate": share(F.col("answered"), F.col("positives"), 1.0), "negative_rate": share(F.col("negative_hits"), F.col("negatives"), 0.0)})


def floor_curve(rows: DataFrame, queries: DataFrame, floors: list[float]) -> DataFrame:
    return points(rows, queries, [(float(f), float(f)) for f in floors], "high").withColumnRenamed("high", "floor")


def recommendation(curve: DataFrame, min_recall: float = MIN_RECALL, max_negative_rate: float = MAX_NEGATIVE_RATE) -> DataFrame:
    """The lowest safe floor, the highest that recalls enough, and the first that does both; the choice falls back to the safe one."""
    safe, recalling = F.col("negative_rate") <= max_negative_rate, F.col("recall") >= min_recall
    out = curve.agg(F.min(F.when(safe, F.col("floor"))).alias("lowest_safe"), F.max(F.when(recalling, F.col("floor"))).alias("highest_recall"), F.min(F.when(safe & recalling, F.col("floor"))).alias("recommended"))
    return out.withColumn("chosen", F.coalesce("recommended", "lowest_safe"))


def two_tier(rows: DataFrame, queries: DataFrame, highs: list[float], lows: list[float], max_negative_rate: float = MAX_NEGATIVE_RATE) -> DataFrame:
    """All pairs low <= high that keep negatives quiet, the best first (`place`)."""
    settings = [(float(h), float(low)) for h in highs for low in lows if low <= h]
    found = points(rows, queries, settings, "high", "low").filter(F.col("negative_rate") <= max_negative_rate)
    return found.orderBy(F.col("answered_rate").desc(), "negative_rate", F.coalesce("precision", F.lit(0.0)).desc(), F.col("low").desc(), "high")


def verdicts(rows: DataFrame, queries: DataFrame, floor: float) -> DataFrame:
    """Per query at a floor: hits, wrong keys, missed keys with the similarity they had; clean when there is neither."""
    passes = F.coalesce(F.col("similarity") >= floor, F.lit(False))
    each = queries.join(rows, "query_id", "left")
    positive = F.col("kind") == "positive"
    expect = F.when(positive, F.col("expect")).otherwise(F.array().cast("array<string>"))
    fine = F.when(positive, F.concat("expect", "acceptable")).otherwise(F.array().cast("array<string>"))
    got = F.collect_set(F.when(passes & F.array_contains(expect, F.col("key")), F.col("key")))
    wrong = F.count_if(passes & ~F.array_contains(fine, F.col("key")))
    out = each.groupBy("query_id").agg(F.first(expect).alias("e"), F.sort_array(got).alias("hits"), wrong.alias("wrong"))
    return out.select("query_id", "hits", "wrong", F.sort_array(F.array_except("e", "hits")).alias("missed")).withColumn("clean", (F.size("missed") == 0) & (F.col("wrong") == 0))


def reranker_curve(scored: DataFrame, queries: DataFrame, cuts: list[float]) -> DataFrame:
    """As the floor curve, with a reranker's score (`rerank`) in place of the similarity; rows it has not scored never pass."""
    rows = scored.select("query_id", "rank", "key", F.col("rerank").alias("similarity"), F.lit(False).alias("lexical"))
    return floor_curve(rows, queries, cuts).withColumnRenamed("floor", "cut")


def failures_first(told: DataFrame) -> DataFrame:
    """Verdicts in the order in which they are read: what went wrong first, then by query."""
    return told.orderBy("clean", "query_id")


def write_back(runs: DataFrame, results: DataFrame, run_id: str, now_s: int) -> DataFrame:
    """The saved runs with the rows of this one in place of what it had, stamped; other runs stay as they are."""
    own = results.withColumns({"run_id": F.lit(run_id), "saved_s": F.lit(now_s).cast("bigint")})
    return runs.filter(F.col("run_id") != run_id).unionByName(own, allowMissingColumns=True)
