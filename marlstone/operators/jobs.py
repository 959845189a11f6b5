"""Scheduled jobs: the sweep of stuck reviews, the refresh of places, usage, limits in time, and the index step."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import ship
from ..storage import written

ship(__name__)


def stuck(now_s: int, minutes: int = 15) -> Column:
    return F.col("indexed_s").isNull() & ~F.col("hidden") & (F.col("updated_s") < now_s - 60 * minutes) & (F.col("index_attempts") < C.MAX_INDEX_ATTEMPTS)


def exhausted(now_s: int, minutes: int = 15) -> Column:
    return F.col("indexed_s").isNull() & ~F.col("hidden") & (F.col("updated_s") < now_s - 60 * minutes) & (F.col("index_attempts") >= C.MAX_INDEX_ATTEMPTS)


def sweep(reviews: DataFrame, now_s: int, limit: int = 500, batch: int = 100, minutes: int = 15) -> DataFrame:
    """The reviews to enqueue again, oldest first, with one more attempt and the batch they go in.

    The limit is taken first, so the numbering runs over that many rows."""
    due = reviews.filter(stuck(now_s, minutes)).orderBy("updated_s", "id").limit(limit)
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("updated_s", "id"))
    return due.select("id", "project_id", "environment", (F.col("index_attempts") + 1).alias("index_attempts"), F.floor((n - 1) / batch).cast("int").alias("batch"))


def sweep_gate(full_tick: bool, marker: bool | None) -> str:
    """Why the sweep runs, or that it need not: marker is None where the store that keeps it is down."""
    return "full" if full_tick else "kv_unavailable" if marker is None else "pending" if marker else "idle"


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each artifact's last run by its start."""
    return runs.groupBy("project_id", "environment", "artifact").agg(F.max_by(F.struct("id", "status", F.coalesce("finished_s", "started_s").alias("ran_s")), F.struct("started_s", "id")).alias("r")).select("project_id", "environment", "artifact", "r.*")


def refresh_candidates(runs: DataFrame, active: DataFrame, imported: DataFrame, present: DataFrame, failed_before_s: int, done_before_s: int, limit: int) -> DataFrame:
    """Artifacts due again: last run old enough (sooner after a failure), no active connection of the project, no succeeded
    import for project and environment, and still something stored; oldest first."""
    due = latest_runs(runs).filter(F.col("ran_s") < F.when(F.col("status") == "failed", failed_before_s).otherwise(done_before_s))
    due = due.join(active.select("project_id").distinct(), "project_id", "left_anti").join(imported.select("project_id", "environment").distinct(), ["project_id", "environment"], "left_anti")
    return due.join(present.select("project_id", "environment").distinct(), ["project_id", "environment"], "left_semi").orderBy("ran_s", "id").limit(limit)


def usage_totals(events: DataFrame, period: str = "day") -> DataFrame:
    """Queries and cache hits by project and period."""
    return events.groupBy("project_id", period).agg(F.count(F.lit(1)).alias("queries"), F.sum("cache_hit").alias("cache_hits"))


def quota(usage: DataFrame, limit: Column) -> DataFrame:
    """Queries that the cache didn't answer, against the limit."""
    uncached = F.col("queries") - F.col("cache_hits")
    return usage.withColumns({"uncached": uncached, "allowed": uncached < limit})


def generation_bumps(messages: DataFrame) -> DataFrame:
    """One more generation for each project that a batch touches, however many messages it has."""
    return messages.select("project_id").distinct().withColumn("bump", F.lit(1))


# ---- limits in time: folds over each key's events in order ----------------------------------------------------


def limit_fold(times: list[float], limit: int, period: float = C.RATE_PERIOD_SECONDS, kept: list[float] = ()) -> tuple[list[bool], list[float]]:
    """Sliding window: an event passes if fewer than `limit` passed within the period before it; rejected ones don't count."""
    window, verdicts = [*kept], []
    for t in times:
        window = [x for x in window if x > t - period]
        ok = len(window) < limit
        if ok:
            window.append(t)
        verdicts.append(ok)
    return verdicts, window


def penalty_fold(times: list[float], failed: list[bool], most: int = 30, period: float = C.RATE_PERIOD_SECONDS) -> list[bool]:
    """Whether each attempt is blocked: after so many failures in a period, until that period ends."""
    start, count, out = None, 0, []
    for t, bad in zip(times, failed, strict=True):
        own = t - t % period
        if own != start:
            start, count = own, 0
        blocked = count >= most
        out.append(blocked)
        if bad and not blocked:
            count += 1
    return out


def pace_fold(times: list[float], spacing: float, most: int, period: float = C.RATE_PERIOD_SECONDS) -> list[float]:
    """When each request may go: not sooner than `spacing` after the last, and not as the (most + 1)th of a period."""
    slots: list[float] = []
    for t in times:
        at = t
        if slots:
            at = max(at, slots[-1] + spacing)
        if len(slots) >= most:
            at = max(at, slots[-most] + period)
        slots.append(at)
    return slots


def rate_limited(events: DataFrame, key: str, limit: int, period: float = C.RATE_PERIOD_SECONDS, ident: str = "event_id") -> DataFrame:
    """key, event id, allowed.

    A key's events fall into stretches between which a whole period is empty, so no stretch matters to the next.  Stretches of
    `limit` events or fewer pass without being looked at.  Only the bursts that are left are folded in time order, each by
    itself; they are sorted by Spark and streamed through, and only the timestamps of one period are held.
    """
    import pyarrow as pa

    def fold(batches):
        last, window = None, []
        for batch in batches:
            keys, stretches, idents, times = (batch.column(i).to_pylist() for i in range(4))
            allowed = []
            for k, s, t in zip(keys, stretches, times, strict=True):
                if (k, s) != last:
                    last, window = (k, s), []
                ok, window = limit_fold([t], limit, period, window)
                allowed += ok
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(idents, pa.int64()), pa.array(allowed, pa.bool_())], ["k", "ident", "allowed"])

    rows = events.select(F.col(key).cast("bigint").alias("k"), F.col(ident).cast("bigint").alias("ident"), (F.unix_micros("ts") / 1e6).alias("t")).withColumn("p", F.floor(F.col("t") / period))
    # A period in which nothing happens lies between two stretches; periods, not events, are put in order.
    w = Window.partitionBy("k").orderBy("p")
    periods = rows.groupBy("k", "p").agg(F.count(F.lit(1)).alias("own"))
    begins = F.coalesce((F.col("p") - F.lag("p").over(w) > 1).cast("int"), F.lit(1))
    periods = periods.withColumn("begins", begins).withColumn("stretch", F.sum("begins").over(w))
    periods = periods.withColumn("n", F.sum("own").over(Window.partitionBy("k", "stretch"))).select("k", "p", "stretch", "n")
    counted = rows.join(periods, ["k", "p"])
    quiet = counted.filter(F.col("n") <= limit).select("k", "ident", F.lit(True).alias("allowed"))
    bursts = counted.filter(F.col("n") > limit).select("k", "stretch", "ident", "t").repartition("k", "stretch").sortWithinPartitions("k", "stretch", "t", "ident")
    told = quiet.union(bursts.mapInArrow(fold, "k bigint, ident bigint, allowed boolean"))
    return told.select(F.col("k").alias(key), F.col("ident").alias(ident), "allowed")


# ---- the index step -------------------------------------------------------------------------------------------


def embed_pending(chunks: DataFrame, embed, per_call: int = 50) -> DataFrame:
    """Excerpts with vectors where they had none; those that have one are not embedded again.

    `embed` is a vectorised function of texts; it gets the pending ones only, `per_call` at a time.
    """
    @F.pandas_udf("array<float>")
    def in_calls(texts: pd.Series) -> pd.Series:
        out, waiting = pd.Series([None] * len(texts), dtype=object), texts[texts.notna()]
        for k in range(0, len(waiting), per_call):
            part = waiting.iloc[k : k + per_call]
            for i, v in zip(part.index, embed(part), strict=True):
                out[i] = v
        return out

    vector = F.coalesce("embedding", in_calls(F.when(F.col("embedding").isNull(), F.col("text"))))
    return chunks.withColumn("embedding", vector)


def index_step(reviews: DataFrame, messages: DataFrame, dimensions: int = C.EMBEDDING_DIMENSIONS, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """For the reviews that messages name: their excerpts with vectors and lexemes, and their sentiment.

    Unknown, hidden and empty reviews are skipped.  The same messages give the same rows, so a batch can be repeated.
    `known` are excerpts that are stored: those that are the same again keep their vectors, and only the rest are embedded.
    """
    from ..functions.indexing import indexed
    from ..functions.text import chunked, lexemes, lexicon_sentiment
    from ..functions.vector import embedded

    named = messages.select(F.col("review_id").alias("id")).distinct()
    wanted = reviews.join(named, "id", "left_semi").filter(~F.col("hidden") & F.rlike("text", F.lit(r"\S")))
    # Dealt out, since words cost more than moving and a file may be one task.
    dealt = wanted.repartition("id")
    if known is None:
        parts = indexed(dealt, dimensions)
    else:
        parts, same = chunked(dealt), ["review_id", "kind", "start_offset"]
        old = known.filter(F.col("embedding").isNotNull()).select(*[F.col(c).cast(parts.schema[c].dataType).alias(c) for c in same], F.col("text").alias("_text"), F.col("embedding").cast("array<float>").alias("_old")).dropDuplicates(same)
        parts = parts.join(old, same, "left").withColumn("embedding", F.when(F.col("_text") == F.col("text"), F.col("_old"))).drop("_text", "_old")
        parts = embed_pending(parts, lambda texts: embedded(texts, dimensions)).withColumn("lexemes", lexemes("text"))
    judged = wanted.select("id", F.when(F.col("rating").isNotNull(), F.when(F.col("rating") >= 4, "positive").when(F.col("rating") == 3, "neutral").otherwise("negative")).alias("r"), lexicon_sentiment("text")["sentiment"].alias("m"))
    return parts, judged.select("id", F.coalesce("r", "m").alias("sentiment"), F.when(F.col("r").isNotNull(), "rating").otherwise("model").alias("sentiment_source"))


#: Slots that are put in order together: a table of blocks is as long as the time that passed, whatever happened in it.
FLUSH_BLOCK = 1000


def buffered_flush(events: DataFrame, every_s: int = 5) -> DataFrame:
    """Counts gathered by project and month and written every few seconds: one row for each flush.

    Events of a flush that failed (`flushed` false) stay and are counted in the next one that succeeds; those still waiting at
    the end are lost, and are in rows whose `flush` is null.
    """
    slot = F.floor(F.unix_seconds("ts") / every_s) + 1
    marked = events.select("project_id", F.trunc("ts", "MM").alias("month"), slot.alias("slot"), "cache_hit", F.when(F.col("flushed"), slot).alias("ok"))
    waiting = marked.groupBy("project_id", "month", "slot").agg(F.count(F.lit(1)).alias("queries"), F.sum("cache_hit").alias("cache_hits"), F.max("ok").alias("ok")).withColumn("block", F.floor(F.col("slot") / FLUSH_BLOCK))
    # The next flush at or after a slot: backwards within its block, so that each row is looked at once, or else the first of a later block.
    own = F.min("ok").over(Window.partitionBy("project_id", "block").orderBy(F.col("slot").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    behind = F.min("first").over(Window.partitionBy("project_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1))
    later = waiting.groupBy("project_id", "block").agg(F.min("ok").alias("first")).select("project_id", "block", behind.alias("later"))
    taken = waiting.withColumn("own", own).join(later, ["project_id", "block"], "left")
    # What has no project or time waits for no flush.
    flush = F.when(F.col("project_id").isNotNull() & F.col("slot").isNotNull(), F.coalesce("own", "later"))
    return taken.groupBy("project_id", "month", flush.alias("flush")).agg(F.sum("queries").alias("queries"), F.sum("cache_hits").alias("cache_hits"))


def marker_state(marks: DataFrame, now_s: int, ttl_s: int = 3600) -> DataFrame:
    """Whether a sweep is pending for each project: marked and neither cleared since nor older than its time to live."""
    last = marks.groupBy("project_id").agg(F.max_by("kind", F.struct("at_s", F.col("kind") == "clear")).alias("kind"), F.max("at_s").alias("at_s"))
    return last.select("project_id", ((F.col("kind") == "mark") & (F.col("at_s") + ttl_s > now_s)).alias("pending"))


def suggested_query(texts: DataFrame, stop_words: list[str], least: int = 20, text_col: str = "text") -> DataFrame:
    """Two words that describe the texts: the one in most of them, and the one most often found with it; in their usual order.

    Texts are taken apart once, and what is counted is written: vocabulary and the different words of each text.  Stop words, short
    words and numbers are told among the words counted, not in every text; only the winning words, one row each, are carried on.
    """
    marks = lambda w: F.regexp_replace(F.regexp_replace(w, "^'+|'+$", ""), "'s$", "")
    words = F.transform(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"([\p{L}\p{N}']+)"), F.lit(1)), lambda w: F.when(F.contains(w, F.lit("'")), marks(w)).otherwise(w))
    docs = written(texts.select(words.alias("w")).select("w", F.array_distinct("w").alias("d")), "words")
    tf = docs.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("tf"))
    df = docs.select(F.explode("d").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    telling = (F.length("word") >= 3) & ~F.rlike("word", F.lit(r"^\d+$")) & ~F.col("word").isin(stop_words)
    counts = written(df.join(tf, "word").filter(telling), "counts")
    best = lambda rows, c: rows.orderBy(F.col(c).desc(), F.col("tf").desc(), F.length("word").desc(), "word").limit(1)
    first = best(counts, "df").select(F.col("word").alias("first"))
    with_first = docs.select("d").join(F.broadcast(first), F.array_contains("d", F.col("first")))
    co = with_first.select(F.explode("d").alias("word"), "first").filter("word <> first").groupBy("word").agg(F.count(F.lit(1)).alias("co")).join(counts, "word")
    together = best(co, "co").filter("co >= 2").select(F.col("word").alias("second"), F.lit(0).alias("o"))
    overall = best(counts.join(F.broadcast(first), F.col("word") != F.col("first")), "df").select(F.col("word").alias("second"), F.lit(1).alias("o"))
    second = together.union(overall).orderBy("o").limit(1).select("second")
    pair = written(first.join(F.broadcast(second), F.lit(True), "left"), "pair")  # one row against one row
    # Different words stand in the order in which they first appear, so they say which comes first.
    place = lambda c: F.array_position("d", F.col(c))
    both = docs.select("d").join(F.broadcast(pair), F.array_contains("d", F.col("first")) & F.array_contains("d", F.col("second")))
    lead = both.agg(F.sum(F.when(place("first") < place("second"), 1).otherwise(-1)).alias("lead"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    told = pair.join(F.broadcast(lead), F.lit(True)).join(F.broadcast(total), F.lit(True))
    return told.select(F.when(F.col("n") >= least, F.when(F.col("second").isNull(), F.col("first")).when(F.coalesce("lead", F.lit(0)) >= 0, F.concat_ws(" ", "first", "second")).otherwise(F.concat_ws(" ", "second", "first"))).alias("suggestion"))
