"""Artifacts of imports (uploads, plans, errors, details) as objects under a folder, with a table that says which there are.

Objects are written, and deleted, by the tasks that have their rows; which objects there are is read from the table, so no
listing of a folder ever meets in one place.  The table changes after its objects when they are written, and before nothing is lost
when they are deleted: an object that a broken-off deletion has removed already is passed over the next time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ship
from ..storage import uri_of, written
from .snapshots import SnapshotTable

ship(__name__)

#: Folders by a hash of the key, so that a deletion rewrites the rows it touches and not all.
PARTS = 16


class ArtifactStore:
    """Objects at `path`/objects, named by keys such as project/artifact/errors.csv."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = SnapshotTable(spark, f"{self.path}/index", ("part",))

    def put(self, objects: DataFrame) -> dict[str, int]:
        """Write objects (key, content binary); one with the same key is replaced.  Returns counts."""
        import pyarrow as pa

        uri = uri_of(self.spark, f"{self.path}/objects")

        def write(batches):
            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(uri)
            for batch in batches:
                for key, content in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                    where = f"{base}/{key}"
                    system.create_dir(where.rpartition("/")[0], recursive=True)
                    with system.open_output_stream(where, compression=None) as out:
                        out.write(content or b"")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c or b"") for c in batch.column(1).to_pylist()], pa.int64())], ["key", "bytes"])

        new = written(objects.select("key", "content").mapInArrow(write, "key string, bytes bigint"), "objects")
        n = new.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        if n.objects:
            parted = self._parted(new)
            touched = [r.part for r in parted.select("part").distinct().collect()]  # PARTS at most
            kept = self._rows_of(touched)
            rows = parted if kept is None else kept.join(parted, "key", "left_anti").select("key", "bytes", "part").unionByName(parted)
            self.table.commit(rows, keep="others")
        return n.asDict()

    def _parted(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))

    def _rows_of(self, parts: list[int]) -> DataFrame | None:
        rows = self.table.read()
        return rows.filter(F.col("part").isin(parts)) if rows is not None else None

    def listed(self, prefix: str = "") -> DataFrame:
        """key, bytes of the objects under a prefix."""
        rows = self.table.read()
        if rows is None:
            return self.spark.createDataFrame([], "key string, bytes bigint")
        return rows.filter(F.startswith("key", F.lit(prefix))).select("key", "bytes")

    def delete(self, prefix: str) -> dict[str, int]:
        """Delete the objects under a prefix, each by the task that has its row; what is gone already is no error.  Returns counts."""
        import pyarrow as pa

        uri = uri_of(self.spark, f"{self.path}/objects")

        def remove(batches):
            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(uri)
            for batch in batches:
                there = [system.get_file_info(f"{base}/{k}").type == fs.FileType.File for k in batch.column(0).to_pylist()]
                for key, found in zip(batch.column(0).to_pylist(), there, strict=True):
                    if found:
                        system.delete_file(f"{base}/{key}")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(there)], ["key", "bytes", "there"])

        going = self.listed(prefix)
        gone = written(going.repartition("key").mapInArrow(remove, "key string, bytes bigint, there boolean"), "deleted")
        n = gone.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(~F.col("there")).alias("missing")).first()
        if n.objects:
            touched = [r.part for r in self._parted(gone).select("part").distinct().collect()]
            kept = self._rows_of(touched).filter(~F.startswith("key", F.lit(prefix)))
            self.table.commit(kept, keep="others", replaced=[(p,) for p in touched])
        return n.asDict()

    def read(self, prefix: str = "") -> DataFrame:
        """key, content of the objects under a prefix, each read by the task that has its row."""
        import pyarrow as pa

        uri = uri_of(self.spark, f"{self.path}/objects")

        def load(batches):
            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(uri)
            for batch in batches:
                for key in batch.column(0).to_pylist():
                    with system.open_input_stream(f"{base}/{key}") as stream:
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([stream.read()], pa.binary())], ["key", "content"])

        return self.listed(prefix).select("key").repartition("key").mapInArrow(load, "key string, content binary")
