"""Stored tables as Parquet: reading by tenant, and replacing a table by its new rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, project_id, environment: str) -> DataFrame:
    """A tenant's rows; with the table partitioned by project and environment only its folders are read."""
    return spark.read.parquet(path).where((F.col("project_id") == project_id) & (F.col("environment") == environment))


def store(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("project_id", "environment").mode("overwrite").parquet(path)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a function from strings to its paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at(path))


def _take_place(spark: SparkSession, beside: str, path: str, old: str) -> None:
    fs, at = _files(spark, path)
    if fs.exists(at(path)):
        fs.mkdirs(at(old).getParent())
        if not fs.rename(at(path), at(old)):
            raise OSError(f"{path} could not be moved away")
    if not fs.rename(at(beside), at(path)):
        raise OSError(f"{beside} could not take the place of {path}")


#: What a replacement is of, as the names of what it puts beside the table say: all of it, or some of its partitions.
WHOLE, SOME = "whole", "parts"


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo replacements that were broken off; call it before a table is read or changed.

    What is missing at its place is taken from the new rows, which were complete before anything was moved, or else from the
    old.  A table replaced as a whole that stands at its place is done, whatever the old one had.
    """
    fs, at = _files(spark, path)
    name = at(path).getName()
    beside = [s.getPath() for s in fs.globStatus(at(at(path).getParent(), f"{name}.*-*-*")) or []]
    new, old = ({tuple(p.getName().split("-")[-2:]): p for p in beside if p.getName().startswith(f"{name}.{kind}-")} for kind in ("new", "old"))
    for tag in {*new, *old}:
        moved = old.get(tag)
        if moved is not None and tag[0] == SOME:
            for part in [s.getPath().getName() for s in fs.listStatus(moved) if "=" in s.getPath().getName()]:
                if not fs.exists(at(path, part)):
                    ready = at(new[tag], part) if tag in new else None
                    fs.rename(ready if ready is not None and fs.exists(ready) else at(moved, part), at(path, part))
        elif moved is not None and not fs.exists(at(path)):
            fs.rename(new[tag] if tag in new else moved, at(path))
        for p in (new.get(tag), moved):
            if p is not None and fs.exists(p):
                fs.delete(p, True)


def parted_by(spark: SparkSession, path: str) -> list[str]:
    """The columns that a stored table's folders are parted by."""
    fs, at = _files(spark, path)
    columns, folder = [], at(path)
    while fs.exists(folder):
        below = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and "=" in s.getPath().getName()]
        if not below:
            break
        columns.append(below[0].getName().split("=", 1)[0])
        folder = below[0]
    return columns


def swap(rows: DataFrame, path: str) -> None:
    """Replace the table at `path` by rows that may be computed from it: write beside it, parted as it is, then rename.

    If it breaks off between the renames, `recover` puts the new rows in place."""
    spark, tag = rows.sparkSession, f"{WHOLE}-{uuid.uuid4().hex[:8]}"
    beside, old = f"{path}.new-{tag}", f"{path}.old-{tag}"
    columns = [c for c in parted_by(spark, path) if c in rows.columns]
    (rows.write.partitionBy(*columns) if columns else rows.write).parquet(beside)
    _take_place(spark, beside, path, old)
    fs, at = _files(spark, path)
    fs.delete(at(old), True)


def swap_parts(rows: DataFrame, path: str, column: str, values: list) -> None:
    """Replace the partitions `column` = one of `values` by what `rows` has for them, nothing perhaps; others are not touched."""
    spark, tag = rows.sparkSession, f"{SOME}-{uuid.uuid4().hex[:8]}"
    beside, old = f"{path}.new-{tag}", f"{path}.old-{tag}"
    rows.write.partitionBy(column).parquet(beside)
    fs, at = _files(spark, path)
    fs.mkdirs(at(path))
    for value in values:
        part = f"{column}={value}"
        if fs.exists(at(beside, part)):
            _take_place(spark, f"{beside}/{part}", f"{path}/{part}", f"{old}/{part}")
        elif fs.exists(at(path, part)):
            fs.mkdirs(at(old))
            fs.rename(at(path, part), at(old, part))
    fs.delete(at(beside), True)
    fs.delete(at(old), True)


def healthy(spark: SparkSession) -> bool:
    """Whether a query gets an answer."""
    return spark.range(1).count() == 1
