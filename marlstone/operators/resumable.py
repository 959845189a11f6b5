"""An import that pauses and resumes: rows are committed batch by batch, each together with the counts so far.

A batch's rows, how far the upload has been read, and the totals are one version of one table, so after a stop at any point
the next run goes on after the last batch that counts, and totals are exact.  Stored rows are a log; `current` is what it says now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshots import SnapshotTable
from ..storage import written

#: Rows of the upload in one commit.
BATCH_ROWS = 500
COUNTS = ("received", "created", "updated", "skipped", "failed")


class ResumableImport:
    """Imports rows (row: 1, 2, ... in the upload; key; the columns of `values`) into a table that it owns.

    `valid` says which rows can be taken.  Of rows of one batch with the same key the last one counts and the others are
    skipped; a row that says what is stored already is skipped too.
    """

    def __init__(self, table: SnapshotTable, key: str, values: list[str], valid: Column):
        self.table, self.key, self.values, self.valid = table, key, values, valid

    def progress(self) -> dict:
        """Totals, the last row read (processed), and the status: new, running, paused or succeeded."""
        return {"processed": 0, "status": "new", **dict.fromkeys(COUNTS, 0)} | self.table.record()

    def current(self) -> DataFrame | None:
        """The latest row of each key."""
        rows = self.table.read()
        if rows is None:
            return None
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*self.values), "row").alias("v")).select(self.key, "v.*")

    def judged(self, batch: DataFrame) -> DataFrame:
        """A batch's rows with what becomes of each (`outcome`)."""
        stored = self.current()
        good = F.coalesce(self.valid, F.lit(False)) & F.col(self.key).isNotNull()
        rows = batch.withColumn("good", good)
        last = F.max("row").over(Window.partitionBy(self.key, "good"))  # of a batch, so bounded
        rows = rows.withColumn("last", last == F.col("row"))
        if stored is None:
            there, same = F.lit(False), F.lit(False)
        else:
            rows = rows.join(stored.select(self.key, F.struct(*self.values).alias("stored")), self.key, "left")
            there = F.col("stored").isNotNull()
            same = F.struct(*self.values).eqNullSafe(F.col("stored"))
        outcome = F.when(~F.col("good"), "failed").when(~F.col("last"), "skipped").when(~there, "created").when(same, "skipped").otherwise("updated")
        return rows.withColumn("outcome", outcome).select("row", self.key, *self.values, "outcome")

    def run(self, rows: DataFrame, batch_rows: int = BATCH_ROWS, batches: int | None = None) -> dict:
        """Go on with the upload `rows`; pause after so many batches, if a budget is given.  Returns the progress."""
        told, done = self.progress(), 0
        while told["status"] != "succeeded":
            if batches is not None and done == batches:
                told = {**told, "status": "paused"}
                self.table.commit(None, keep="all", record=told)
                break
            start = told["processed"]
            batch = rows.filter((F.col("row") > start) & (F.col("row") <= start + batch_rows))
            judged = written(self.judged(batch), "import-batch")
            n = judged.agg(F.count(F.lit(1)).alias("received"), *(F.count_if(F.col("outcome") == c).alias(c) for c in COUNTS[1:])).first()
            if n.received == 0:
                told = {**told, "status": "succeeded"}
                self.table.commit(None, keep="all", record=told)
                break
            told = {"processed": start + batch_rows, "status": "running", **{c: told[c] + n[c] for c in COUNTS}}
            self.table.commit(judged.filter("outcome IN ('created', 'updated')").drop("outcome"), keep="all", record=told)
            done += 1
        return told
