"""The queue of index messages as a stream of JSON files, indexed batch by batch; at least once, so each step can be repeated."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as C
from .. import schema
from ..functions import ship
from ..operators import dml, jobs
from ..sources import tables

ship(__name__)


def messages(spark: SparkSession, path: str, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema.MESSAGE).option("maxFilesPerTrigger", files).json(path)


#: Partitions of the excerpt table, by a hash of the review.
PARTS = 64


def part_of(review: Column) -> Column:
    return F.pmod(F.xxhash64(review.cast("string")), F.lit(PARTS)).cast("int")


def index_stream(queue: DataFrame, reviews, chunks_path: str, failed_path: str, checkpoint: str, dimensions: int = C.EMBEDDING_DIMENSIONS):
    """Start indexing: `reviews` gives the table as it is; excerpts of a batch replace what their reviews had.

    Only the partitions of the reviews named are read and replaced, and only excerpts that changed are embedded.  Reviews that
    have become hidden or empty lose their excerpts.  Messages of no known type are put aside in `failed_path`, the second
    sink.  What a broken-off replacement has left is put in order before the next batch; a table that can't be read ends the
    stream.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = F.col("type") == "review.index"
        batch.filter(~F.coalesce(known, F.lit(False))).withColumn("epoch", F.lit(epoch)).write.mode("append").json(failed_path)
        named = batch.filter(known).select(F.col("reviewId").alias("review_id")).distinct()
        tables.recover(spark, chunks_path)
        # At most PARTS numbers.
        parts = [r[0] for r in named.select(part_of(F.col("review_id")).alias("p")).distinct().collect()]
        there = [p for p in parts if tables.exists(spark, f"{chunks_path}/part={p}")]
        old = spark.read.option("basePath", chunks_path).parquet(*[f"{chunks_path}/part={p}" for p in there]) if there else None
        fresh, _ = jobs.index_step(reviews(), named, dimensions, old)
        fresh = fresh.withColumn("part", part_of(F.col("review_id")))
        rows = fresh if old is None else dml.replace_children(old, fresh, parents=named)
        if parts:
            tables.swap_parts(rows, chunks_path, "part", parts)

    return queue.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_stream(events: DataFrame) -> DataFrame:
    """Running totals by project and month, for update mode."""
    return events.groupBy("project_id", F.trunc("ts", "MM").alias("month")).agg(F.count(F.lit(1)).alias("queries"), F.sum("cache_hit").alias("cache_hits"))


def limited_stream(events: DataFrame, key: str, limit: int, period: float = C.RATE_PERIOD_SECONDS) -> DataFrame:
    """key, event_id, allowed by a sliding window kept as state for each key.

    The state of a key ends when the watermark has passed its last event by a period."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        allowed, window = jobs.limit_fold(rows["t"].tolist(), limit, period, list(state.get[0]) if state.exists else [])
        state.update((window,))
        state.setTimeoutTimestamp(max(int((rows["t"].iloc[-1] + period) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], "event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    timed = events.withWatermark("ts", f"{int(period)} seconds").select(key, "event_id", "ts", (F.unix_micros("ts") / 1e6).alias("t"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} bigint, event_id bigint, allowed boolean", "window array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def poll(page: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is newer than each location's cursor, and the cursors moved to the newest update seen."""
    fresh = page.join(cursors, "location", "left").filter(F.col("cursor_ms").isNull() | (F.col("update_ms") > F.col("cursor_ms"))).drop("cursor_ms")
    moved = cursors.unionByName(page.select("location", F.col("update_ms").alias("cursor_ms"))).groupBy("location").agg(F.max("cursor_ms").alias("cursor_ms"))
    return fresh, moved
