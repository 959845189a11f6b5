"""Review tables seen in the test tables, once as DataFrames and once as SQL for the oracle.

The moduli are pairwise coprime, so project, environment, source, rating, visibility and date vary independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1_704_067_200  # 2024-01-01 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    source = F.when(i % 5 == 0, "google").when(i % 5 == 1, "yelp").when(i % 5 == 2, "facebook").when(i % 5 == 3, "trustpilot").otherwise("custom")
    return d.join(labels, "doc_id", "left").select(
        i.alias("id"), (i % 3).alias("project_id"), F.when(i % 7 == 0, "test").otherwise("live").alias("environment"), source.alias("source"),
        F.when(i % 4 != 0, 1 + F.floor(i / 5) % 5).cast("bigint").alias("rating"), F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").alias("sentiment"),
        (i % 13 == 0).alias("hidden"), F.when(i % 17 != 0, F.lit(EPOCH) + i * 3600).alias("occurred_s"), F.col("lang").alias("language"),
        F.concat(F.lit("locations/"), i % 11, F.lit("/reviews/"), i).alias("external_id"), F.concat(F.lit("place"), i % 6).alias("place_name"), "text",
        F.when(i % 9 != 0, F.lit(EPOCH) + i * 60).alias("indexed_s"), (i % 8).alias("index_attempts"), (F.lit(EPOCH) + i * 30).alias("updated_s"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as excerpts, dealt over all documents in the order of ids."""
    v, n = F.col("vec_id"), max(1, table(spark, sf_dir, "documents").count())
    return table(spark, sf_dir, "embeddings").select(
        v.alias("id"), (v % n).alias("review_id"), F.when(v % 3 == 0, "full").when(v % 3 == 1, "window").otherwise("sentence").alias("kind"),
        (v % 5 * 10).alias("start_offset"), F.when(v % 19 != 0, F.col("embedding").cast("array<double>")).alias("embedding"), "label",
    )


def spread_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir)


def with_metadata(reviews: DataFrame) -> DataFrame:
    """Reviews with their place and language as metadata."""
    return reviews.withColumn("metadata", F.create_map(F.lit("place"), F.col("place_name"), F.lit("lang"), F.col("language")))


def labelled_words(chunks: DataFrame) -> DataFrame:
    """Excerpts with the lexeme positions of a text that says their label's word once, or twice if the id is even."""
    word = F.concat(F.lit("w"), F.col("label").cast("string"))
    return chunks.withColumn("lexemes", F.create_map(word, F.when(F.col("id") % 2 == 0, F.array(F.lit(1), F.lit(9))).otherwise(F.array(F.lit(1)))))


def vectors_asked(spark: SparkSession, sf_dir: str) -> list[tuple[int, list[float]]]:
    """Every hundredth embedding, by id, to ask with."""
    rows = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select("vec_id", "embedding").collect()
    return sorted((r.vec_id, [float(x) for x in r.embedding]) for r in rows)


def query_vectors(spark: SparkSession, sf_dir: str, ids: list[int]) -> list[list[float]]:
    """The embeddings of a few given rows, to ask with."""
    found = {r.vec_id: [float(x) for x in r.embedding] for r in table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isin(ids)).collect()}
    return [found[i] for i in ids]


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each query answered: project, day, and whether the cache had it."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("project_id"), F.to_date("ts").alias("day"), (F.col("event_type") == "view").cast("bigint").alias("cache_hit"), "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "props")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    status = F.when(key % 5 == 0, "failed").when(key % 5 == 1, "running").otherwise("succeeded")
    return o.select(key.alias("id"), (F.col("o_custkey") % 40).alias("project_id"), F.when(key % 7 == 0, "test").otherwise("live").alias("environment"), status.alias("status"), (F.col("o_custkey") % 9).alias("artifact"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("started_s"), F.when(key % 5 != 1, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + key % 100).alias("finished_s"), (key % 50).alias("received"), (key % 20).alias("created"))


REVIEWS_SQL = f"""reviews_v AS (
  SELECT d.doc_id AS id, d.doc_id % 3 AS project_id, CASE WHEN d.doc_id % 7 = 0 THEN 'test' ELSE 'live' END AS environment,
         CASE d.doc_id % 5 WHEN 0 THEN 'google' WHEN 1 THEN 'yelp' WHEN 2 THEN 'facebook' WHEN 3 THEN 'trustpilot' ELSE 'custom' END AS source,
         CASE WHEN d.doc_id % 4 <> 0 THEN 1 + (d.doc_id // 5) % 5 END AS rating,
         CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' END AS sentiment,
         d.doc_id % 13 = 0 AS hidden, CASE WHEN d.doc_id % 17 <> 0 THEN {EPOCH} + d.doc_id * 3600 END AS occurred_s, d.lang AS language,
         'locations/' || (d.doc_id % 11) || '/reviews/' || d.doc_id AS external_id, 'place' || (d.doc_id % 6) AS place_name, d.text,
         CASE WHEN d.doc_id % 9 <> 0 THEN {EPOCH} + d.doc_id * 60 END AS indexed_s, d.doc_id % 8 AS index_attempts, {EPOCH} + d.doc_id * 30 AS updated_s
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
CHUNKS_SQL = """chunks_v AS (
  SELECT vec_id AS id, vec_id % (SELECT count(*) FROM documents) AS review_id, CASE vec_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'window' ELSE 'sentence' END AS kind,
         vec_id % 5 * 10 AS start_offset, CASE WHEN vec_id % 19 <> 0 THEN embedding::DOUBLE[] END AS embedding, label
  FROM embeddings)"""
USAGE_SQL = """usage_v AS (
  SELECT user_id % 3 AS project_id, ts::DATE AS day, (event_type = 'view')::BIGINT AS cache_hit, event_id, user_id, ts, event_type, value, props FROM events)"""
RUNS_SQL = """runs_v AS (
  SELECT o_orderkey AS id, o_custkey % 40 AS project_id, CASE WHEN o_orderkey % 7 = 0 THEN 'test' ELSE 'live' END AS environment,
         CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'succeeded' END AS status, o_custkey % 9 AS artifact,
         epoch(o_orderdate)::BIGINT AS started_s, CASE WHEN o_orderkey % 5 <> 1 THEN epoch(o_orderdate)::BIGINT + o_orderkey % 100 END AS finished_s,
         o_orderkey % 50 AS received, o_orderkey % 20 AS created FROM orders)"""
