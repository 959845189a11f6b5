"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Every text gets counts (words, symbols, repeated lines and word windows) and from them scores between 0 and 1; a rule
rejects a document whose score reaches the rule's cutoff.  The labelled documents are the holdout: the candidate cutoffs
are a fixed grid and nothing is fitted to the labels beforehand.  In each stratum (language) and for each rule, a cutoff is
admissible if the number of good documents it rejects there shows, by the exact binomial tail, that the true rate is
below the rule's share of `MAX_FALSE_REJECTION`.  Along the grid the tests are nested, from loosest to strictest, so
they are one fixed sequence; over rules and strata the error `DELTA` is split evenly (Bonferroni).  Hence, with
probability 1 - DELTA, all rules together reject at most MAX_FALSE_REJECTION of the good texts of every stratum.
Among admissible cutoffs the one that rejects the most bad documents for the good ones lost is used, the loosest of equals; a stratum with
too few labels to prove anything gets no rule.

What is counted are different labelled texts that pass the base rule, since neither rows that repeat a doc_id nor equal texts
under other doc_ids are further evidence: each counts once, as good only if no label of it is bad, and a doc_id with several
texts counts once by its worst scores.  So the bound is one on the different good texts that pass the base rule; what the
base rule itself rejects is fixed and not part of it.

Counts stay in the row: nothing is exploded and no text is shuffled.

Cases: a null text has no words and fails the base rule; a null or unlisted language is the stratum `other`; null labels
don't count; repeated rows are judged alike, each on its own; with no labels only the base rule holds; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

STRATA = ("de", "en", "es", "fr")
MAX_FALSE_REJECTION = 0.05
DELTA = 0.05
GRID = 100
#: Among admissible cutoffs, a good document lost counts as much as so many bad ones (as shares of either).
FALSE_COST = 50
WINDOW = 8
#: Scores between 0 and 1, large is bad: what is divided by what, and whether one less that is the score.
RULES = {
    "symbols": ("n_symbols", "word_chars", False),
    "bangs": ("n_bangs", "n_words", False),
    "repeated_lines": ("n_dup_lines", "n_lines", False),
    "repeated_words": ("n_repeat_words", "n_words", False),
    "few_different_words": ("n_different_words", "n_words", True),
}
SYMBOLS = "#*$%&|<>"
SPACES = r"[ \x09-\x0D]+"


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, text_hash, stratum and the counts of every row."""
    text = text_or_empty(text_col)
    # Each step is used more than once by the next, so Catalyst keeps them apart and nothing is evaluated per element.
    a = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.when(F.col(lang_col).isin(*STRATA), F.col(lang_col)).otherwise("other").alias("stratum"), F.array_remove(F.split(text, SPACES), "").alias("words"), F.split(text, "\n").alias("lines"))
    b = a.select("doc_id", "text_hash", "stratum", F.size("words").alias("n"), F.array_distinct("words").alias("different"), F.array_join("words", "").alias("solid"), F.filter("lines", lambda x: F.rlike(x, F.lit(r"[^ \x09-\x0D]"))).alias("lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    h = F.col("hashes")
    windows = F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    c = b.select("doc_id", "text_hash", "stratum", "n", "different", "solid", "lines", windows.alias("windows"))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    d = c.withColumn("ordered", F.when(twice, F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    o = F.col("ordered")
    same = lambda j, k: F.coalesce(F.get(o, j)["w"] == F.get(o, k)["w"], F.lit(False))
    e = d.withColumn("starts", F.array_sort(F.transform(F.filter(F.transform(o, lambda x, j: F.struct(x["i"].alias("i"), (same(j, j - 1) | same(j, j + 1)).alias("r"))), lambda x: x["r"]), lambda x: x["i"])))
    s = F.col("starts")
    covered = F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda x, y: x + y)
    without = lambda chars: F.length("solid") - F.length(F.translate("solid", chars, ""))
    long = lambda x: x.cast("bigint")
    return e.select(
        "doc_id", "text_hash", "stratum", long(F.col("n")).alias("n_words"), long(F.length("solid")).alias("word_chars"), long(without(SYMBOLS)).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"), long(without("!")).alias("n_bangs"), long(F.size("different")).alias("n_different_words"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def steps(rule: str) -> Column:
    """The number of grid cutoffs that reject the document by this rule: cutoff c of 1..GRID rejects from score c / GRID."""
    part, whole, inverse = RULES[rule]
    score = F.try_divide(part, whole)
    return F.coalesce(F.least(F.lit(GRID), F.floor((1 - score if inverse else score) * GRID + 1e-9)), F.lit(0)).cast("int")


#: The tail is summed from so many standard deviations below the mean, where it is under 1e-30, so large n stays cheap.
DEVIATIONS = 12


def critical_count(n: Column, rate: float, error: Column) -> Column:
    """The largest k with P(Binomial(n, rate) <= k) <= error, or -1: that few rejections prove a rate below `rate`.

    The tail is summed term by term from its beginning, which for large n is DEVIATIONS below the mean: some
    DEVIATIONS * sqrt(n * rate) terms.  Terms are kept as logarithms; the first comes from Stirling's series.
    """
    first = F.floor(n * rate - DEVIATIONS * F.sqrt(n * rate * (1 - rate))).cast("bigint")
    begin = F.when(first >= 50, first).otherwise(F.lit(0).cast("bigint"))
    m, j = n.cast("double"), F.greatest(begin, F.lit(1)).cast("double")
    share = j / m
    far = -m * (share * F.log(share / rate) + (1 - share) * F.log((1 - share) / (1 - rate))) - 0.5 * F.log(2 * math.pi * j * (1 - share)) + 1 / (12 * m) - 1 / (12 * j) - 1 / (12 * (m - j))
    log = F.when(begin == 0, n * math.log1p(-rate)).otherwise(far)
    state = lambda log, tail, k: F.named_struct(F.lit("log"), log, F.lit("tail"), tail, F.lit("k"), k.cast("bigint"))
    start = state(log, F.exp(log), F.when(F.exp(log) <= error, begin).otherwise(-1))

    def step(s: Column, j: Column) -> Column:
        log = s["log"] + F.log((n - j + 1) / j) + math.log(rate / (1 - rate))
        tail = s["tail"] + F.exp(log)
        return state(log, tail, F.when(tail <= error, j).otherwise(s["k"]))

    last = F.greatest(F.lit(0), F.floor(n * rate)).cast("bigint")
    upto = F.when(last > begin, F.sequence(begin + 1, last)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(upto, start, step, lambda s: s["k"])


def holdout(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, good, and the steps of each rule for each different labelled text that passes the base rule."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    worst = lambda: [F.max(r).alias(r) for r in RULES]
    # Combined before the join, so a doc_id of very many rows is one row of each task.
    documents = counted.filter("NOT base_failed").select("doc_id", "text_hash", "stratum", *[steps(r).alias(r) for r in RULES])
    documents = documents.groupBy("doc_id").agg(F.min(F.struct("text_hash", "stratum")).alias("t"), *worst()).join(known, "doc_id")
    return documents.groupBy("t").agg(F.min("quality").alias("quality"), *worst()).select("t.stratum", (F.col("quality") >= 1).alias("good"), *RULES)


def cutoffs(counted: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff (1..GRID), good, bad, good_rejected, bad_rejected: the cutoff chosen for each, if any is admissible."""
    rate, tests = max_false_rejection / len(RULES), len(RULES) * (len(STRATA) + 1)
    each = holdout(counted, labels).select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES])).alias("x")).select("stratum", "good", "x.*")
    # From here on at most strata x rules x grid rows.
    binned = each.groupBy("stratum", "rule", "step").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    per_rule = binned.groupBy("stratum", "rule").agg(F.sum("g").alias("good"), F.sum("b").alias("bad"), F.collect_list(F.struct("step", "g", "b")).alias("bins"))
    tail = lambda c, what: F.aggregate(F.filter("bins", lambda x: x["step"] >= c), F.lit(0).cast("bigint"), lambda s, x: s + x[what])
    tried = per_rule.select("stratum", "rule", "good", "bad", critical_count(F.col("good"), rate, F.lit(delta / tests)).alias("most"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(GRID)), lambda c: F.struct(c.alias("cutoff"), tail(c, "g").alias("good_rejected"), tail(c, "b").alias("bad_rejected")))).alias("x")).select("stratum", "rule", "good", "bad", "most", "x.*")
    gain = F.coalesce(F.try_divide("bad_rejected", "bad"), F.lit(0.0)) - FALSE_COST * F.coalesce(F.try_divide("good_rejected", "good"), F.lit(0.0))
    best = tried.filter("good_rejected <= most").withColumn("gain", gain).filter("gain > 0").groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "good", "bad", "good_rejected", "bad_rejected"), F.struct("gain", "cutoff")).alias("x"))
    return best.select("stratum", "rule", "x.*")


def judge(docs: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA, **columns: str) -> DataFrame:
    """The counts of every document with base_failed, kept, and the rules that reject it."""
    counted = materialise(counts(docs, **columns), "quality-counts")
    chosen = cutoffs(counted, labels, max_false_rejection, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    # One row for each stratum, of which there are len(STRATA) + 1.
    told = counted.join(F.broadcast(chosen.withColumnRenamed("stratum", "s")), F.col("stratum") == F.col("s"), "left").drop("s")
    failed = F.filter(F.array(*[F.when(steps(r) >= F.try_element_at("cuts", F.lit(r)), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    told = told.withColumn("failed_rules", F.array_join(failed, ",")).drop("cuts")
    return told.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def op5_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "failed_rules")
