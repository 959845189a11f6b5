"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where all is on one machine and nothing is named, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def files_of(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a function from strings to its paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_sweep, spark)
    _made.append(path)
    return path


def _sweep(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):
        for path in _made:
            fs, at = files_of(spark, path)
            fs.delete(at(path), True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table of the shared folder: computed once, whoever reads it, and not lost with an executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What pyarrow calls the stores that Hadoop knows by other names.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def uri_of(spark: SparkSession, path: str) -> str:
    """A path as tasks can open it with pyarrow: without a scheme it is where Spark's default file system has it."""
    from pyarrow import fs

    files, at = files_of(spark, path)
    scheme, rest = files.makeQualified(at(path)).toString().split(":", 1)
    uri = f"{SCHEMES.get(scheme, scheme)}:{rest if rest.startswith('//') else '//' + rest}"
    try:
        fs.FileSystem.from_uri(uri)
    except Exception as e:
        raise ValueError(f"pyarrow has no file system for {path}") from e
    return uri
