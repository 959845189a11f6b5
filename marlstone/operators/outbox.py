"""The queue's sink: messages in batches, quota and refunds, and a ledger that makes a repeated micro-batch send nothing twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..sources.snapshots import SnapshotTable
from ..storage import written
from .search import counted_rank

#: Messages in one call to the queue.
SEND_BATCH = 100


def planned(rows: DataFrame, order: list[Column | str], most: int | None = None) -> DataFrame:
    """`rows` with their number n in the order; a sweep takes `most`, any other number is dealt by ranges."""
    if most is None:
        return counted_rank(rows.withColumn("query_id", F.lit(0)), "n", *order).drop("query_id")
    return rows.orderBy(*order).limit(most).withColumn("n", F.row_number().over(Window.orderBy(*order)))


def with_quota(plan: DataFrame, room: int) -> DataFrame:
    """Each message's batch and verdict under a quota of `room` messages: whole batches go while there is room, and once one is
    refused it and all after it are put off.

    An attempt is counted before a batch is sent; the refused batch gets its own back, and those after it never had theirs counted,
    so what is put off stands as it was (`index_attempts`).
    """
    total = plan.agg(F.count(F.lit(1)).alias("total"))  # one row
    told = plan.join(F.broadcast(total)).withColumn("batch", F.floor((F.col("n") - 1) / SEND_BATCH))
    sent = F.least((F.col("batch") + 1) * SEND_BATCH, "total") <= room
    attempts = F.when(sent, F.col("index_attempts") + 1).otherwise(F.col("index_attempts"))
    return told.withColumns({"sent": sent, "index_attempts": attempts}).drop("total")


def sweep_and_send(stuck: DataFrame, room: int, most: int = 1000) -> DataFrame:
    """Stuck reviews, oldest first, with what the sweep does to each: sent with one attempt more, or put off as it was."""
    waiting = stuck.filter(F.col("index_attempts") < C.MAX_INDEX_ATTEMPTS)
    return with_quota(planned(waiting, ["updated_s", "id"], most), room)


class Outbox:
    """Messages that were sent, by micro-batch, in a table whose versions carry the number of the last one."""

    def __init__(self, table: SnapshotTable, quota: int):
        self.table, self.quota = table, quota

    def send(self, messages: DataFrame, epoch: int) -> dict[str, int]:
        """Send a micro-batch, once: rows, the quota used, and the batch's number are one commit.  Returns what became of it."""
        record = self.table.record()
        if record.get("epoch", -1) >= epoch:
            return {"sent": 0, "deferred": 0, "repeated": 1}
        used = record.get("used", 0)
        told = with_quota(planned(messages, ["updated_s", "id"]), self.quota - used).drop("n", "batch").withColumn("epoch", F.lit(epoch))
        told = written(told, "outbox")  # what is counted is what is committed
        n = told.agg(F.count_if("sent").alias("sent"), F.count_if(~F.col("sent")).alias("deferred")).first()
        self.table.commit(told, keep="all", record={"epoch": epoch, "used": used + n.sent}, base=self.table.version())
        return {"sent": n.sent, "deferred": n.deferred, "repeated": 0}

    def sent(self) -> DataFrame | None:
        rows = self.table.read()
        return rows.filter("sent") if rows is not None else None

    def deferred(self) -> DataFrame | None:
        """Messages whose last verdict was to wait: to be offered again with a later micro-batch."""
        rows = self.table.read()
        if rows is None:
            return None
        return rows.groupBy("id").agg(F.max_by(F.struct("sent", "index_attempts", "updated_s"), "epoch").alias("last")).filter("NOT last.sent").select("id", "last.index_attempts", "last.updated_s")


def outbox_stream(messages: DataFrame, outbox: Outbox, checkpoint: str):
    """Send a stream of messages (id, index_attempts, updated_s); what was put off before is offered again first."""

    def handle(batch: DataFrame, epoch: int) -> None:
        waiting = outbox.deferred()
        offered = batch.select("id", "index_attempts", "updated_s")
        if waiting is not None:
            offered = offered.unionByName(waiting.join(offered, "id", "left_anti"))
        outbox.send(offered, epoch)

    return messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
