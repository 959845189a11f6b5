"""Shared plumbing of the training-data operators: storage for cut lineage, shipping of Python code, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space in the word rule `[^\x20\x09-\x0D]+`.
SPACE = " \t\n\x0b\x0c\r"


def ship(module_name: str) -> None:
    """Let Python functions of a module travel with the job, so executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def process_store(name: str) -> dict:
    """A dict that lives as long as the Python worker process, whichever task uses it."""
    holder = sys.modules.setdefault("_marlstone_process_store", types.ModuleType("_marlstone_process_store"))
    return holder.__dict__.setdefault("tables", {}).setdefault(name, {})


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where all is on one machine one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Folders made by this driver that are still there.
_folders: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends if not before."""
    path = f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex[:12]}"
    if not _folders:
        atexit.register(_remove_all, spark)
    _folders.append(path)
    return path


def folders() -> list[str]:
    return [*_folders]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of `new_folder` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _folders.remove(path)


def _remove_all(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):
        remove(spark, folders())


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def batches_of(columns: list[str], table: pa.RecordBatch):
    """Python lists of some columns of an Arrow batch."""
    return [table.column(table.schema.get_field_index(c)).to_pylist() for c in columns]
