"""Who may ask, what is kept how long, and small joins around evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_lookup(keys: DataFrame, projects: DataFrame, accounts: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked keys (key, kind, environment) that are known by their hash, not revoked and of the kind and environment they claim,
    with their project's policy and account's plan; keys of deleted accounts are not."""
    hashed = asked.withColumn("key_hash", F.sha2("key", 256)).select("key_hash", "kind", "environment")
    live = keys.filter(F.col("revoked_at").isNull()).select("key_hash", "kind", "environment", "project_id")
    p = projects.select(F.col("id").alias("project_id"), "account_id", "min_rating", "similarity_floor", "category")
    a = accounts.filter(F.col("deleted_at").isNull()).select(F.col("id").alias("account_id"), "plan")
    return hashed.join(live, ["key_hash", "kind", "environment"]).join(p, "project_id").join(a, "account_id")


def retired(written_s: Column, now_s: int, days: int) -> Column:
    """Whether something was written longer ago than it is kept."""
    return written_s < now_s - days * 86_400


def fresher_than_stored(export: DataFrame, stored: DataFrame) -> DataFrame:
    """Export rows to take: new ones, and those edited after the stored row's as-of time (`suffix`, `edited_ms`, `as_of_ms`)."""
    known = stored.select("suffix", "as_of_ms")
    return export.join(known, "suffix", "left").filter(F.col("as_of_ms").isNull() | (F.col("as_of_ms") <= F.col("edited_ms"))).drop("as_of_ms")


def cap_info(counts: DataFrame, incoming: Column, limit: Column) -> DataFrame:
    """The room a project has left, and whether a batch would not fit."""
    room = F.greatest(F.lit(0), limit - F.col("review_count"))
    return counts.withColumns({"room": room, "would_reject": incoming > room})


def resume(rows: DataFrame, processed: int) -> DataFrame:
    """What is left of an import of which so many rows are done."""
    return rows.filter(F.col("row") > processed)


def rejected_rows(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """The row number of each rejected key, its last in the upload (`source`, `external_id`, `row`)."""
    last = rows.groupBy("source", "external_id").agg(F.max("row").alias("row"))
    return rejected.join(last, ["source", "external_id"])


def corpus_texts(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """All texts that need a vector, each once."""
    return chunks.select("text").union(queries.select(F.col("q").alias("text"))).distinct()


def attach_vectors(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Texts with their precomputed vectors; one without is an error."""
    joined = texts.join(vectors.select("text", "embedding"), "text", "left")
    return joined.withColumn("embedding", F.coalesce("embedding", F.raise_error(F.concat(F.lit("no vector for: "), F.substring("text", 1, 60))).cast("array<float>")))


def with_fixture_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Result rows with the key of their review in the labelled set; unknown ones as ?id."""
    return rows.join(keys.select("review_id", "key"), "review_id", "left").withColumn("key", F.coalesce("key", F.concat(F.lit("?"), F.col("review_id").cast("string"))))
