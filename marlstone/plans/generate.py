"""Deterministic reviews for load tests, from a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import EPOCH

#: What the generated reviews are about.
TOPICS = (
    "They came on time and kept us posted.", "The price matched the quote to the cent.", "Our ceiling no longer leaks after the storm.", "Scheduling a visit took two minutes.",
    "The crew cleaned up before they left.", "I was told clearly what would happen next.", "The waiting room was calm and bright.", "They found the fault others had missed.",
    "Parking next door made it easy.", "The follow-up call was a kind touch.", "The warranty papers came the same day.", "My mother felt at ease with them.",
)


def topic(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TOPICS]), (i % 12 + 1).cast("int"))


def reviews(spark: SparkSession, count: int, project_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Review i: two topics by i, ratings 3 to 5, a third from yelp, one an hour, north or south by turns."""
    i = F.col("id")
    return spark.range(0, count, 1, partitions).select(
        "id", F.lit(project_id).cast("bigint").alias("project_id"), F.lit("live").alias("environment"), F.when(i % 3 == 0, "yelp").otherwise("google").alias("source"), F.concat(F.lit("load/"), i).alias("external_id"),
        (3 + F.floor(i / 12) % 3).cast("int").alias("rating"), F.concat_ws(" ", topic(i), topic(i * 7 + 3)).alias("text"), (EPOCH + i * 3600).alias("occurred_s"), F.create_map(F.lit("location"), F.when(i % 2 == 0, "north").otherwise("south")).alias("metadata"),
    )


def chunks(generated: DataFrame) -> DataFrame:
    """Two excerpts each: the whole text and its first sentence."""
    first = F.concat(F.split_part(F.col("text"), F.lit("."), F.lit(1)), F.lit("."))
    both = F.array(F.struct(F.lit("full").alias("kind"), F.col("text").alias("text")), F.struct(F.lit("sentence").alias("kind"), first.alias("text")))
    return generated.select(F.col("id").alias("review_id"), F.posexplode(both).alias("n", "c")).select((F.col("review_id") * 2 + F.col("n")).alias("id"), "review_id", "c.kind", "c.text", F.lit(0).alias("start_offset"))


DEMO_LIVE, DEMO_TEST = 80, 10


def demo(spark: SparkSession, anchor_s: int) -> tuple[DataFrame, DataFrame]:
    """Reviews of a demonstration project, dated back from an anchor, and their whole texts as excerpts with hashed vectors.

    80 live ones and 10 for tests; every eighth has no rating and, of these, every other one a sentiment of its own.
    """
    from ..functions.vector import hashed_embedding

    i = F.col("id")
    rows = spark.range(DEMO_LIVE + DEMO_TEST).select(
        "id", F.when(i < DEMO_LIVE, "live").otherwise("test").alias("environment"), F.when(i % 4 == 0, "yelp").otherwise("google").alias("source"), F.concat(F.lit("demo/"), i).alias("external_id"),
        F.when(i % 8 != 7, 1 + (i * 3) % 5).cast("int").alias("rating"), F.when(i % 16 == 7, "positive").alias("sentiment"), F.concat_ws(" ", topic(i), topic(i * 5 + 2)).alias("text"),
        (F.lit(anchor_s) - i * 86_400).alias("occurred_s"), F.concat(F.lit("place "), i % 3).alias("location"),
    )
    parts = rows.select(i.alias("review_id"), F.lit("full").alias("kind"), "text", F.lit(0).alias("start_offset"), hashed_embedding(64)("text").alias("embedding"))
    return rows, parts


def replay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A saved evaluation run (JSON lines of queries with their rows in rank order) as observed rows and queries."""
    schema = "id string, q string, kind string, tags array<string>, expect array<string>, acceptable array<string>, rows array<struct<key:string,similarity:double,lexical:boolean,rerank:double>>"
    saved = spark.read.schema(schema).json(path)
    none = F.array().cast("array<string>")
    queries = saved.select(F.col("id").alias("query_id"), "kind", F.array_contains(F.coalesce("tags", none), "cross-language").alias("cross_language"), F.coalesce("expect", none).alias("expect"), F.coalesce("acceptable", none).alias("acceptable"))
    return saved.select(F.col("id").alias("query_id"), F.posexplode("rows").alias("rank", "r")).select("query_id", "rank", "r.*"), queries
