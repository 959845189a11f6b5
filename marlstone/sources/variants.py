"""Nested JSON as a table of cells, level by level in the JVM: VARIANT tells what each value is, its object's text in which order.

Lines of JSON are split like any text, so no file is one task.  A cell is a record's dotted name and its value as a
string: arrays as JSON, null as nothing; an empty object has no cells.  Records that are no JSON object have none either and
are listed by `broken`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written

def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """row, json: the lines of files, numbered so that numbers differ and keep the order of lines."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("row"), F.ltrim(F.col("value"), F.lit("﻿")).alias("json"))


def broken(records: DataFrame, text: str = "json") -> DataFrame:
    """Records that are no JSON object."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return records.filter(~F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False)))


def _scalar(value: Column, kind: Column) -> Column:
    """A value as users write it: 1.0 as 1, 1.50 as 1.5."""
    plain = F.coalesce(value.try_cast("string"), F.lit(""))
    number = F.startswith(kind, F.lit("DECIMAL")) | kind.isin("DOUBLE", "FLOAT")
    shorter = F.when(F.contains(plain, F.lit(".")) & ~F.contains(plain, F.lit("E")), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when(kind == "VOID", "").when(F.startswith(kind, F.lit("ARRAY")), F.to_json(value)).when(number, shorter).otherwise(plain)


def _one_level(objects: DataFrame) -> DataFrame:
    """row, place, name, kind, value, json: what stands in each object (row, place, name, json), with its place in the order."""
    spark = objects.sparkSession
    told = objects.withColumns({"v": F.try_parse_json("json"), "keys": F.json_object_keys("json"), "texts": F.from_json("json", "map<string,string>")})
    told = told.filter(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    each = told.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    name = F.when(F.col("name") == "", F.col("key")).otherwise(F.concat("name", F.lit("."), F.col("key")))
    each = each.select("row", F.concat("place", F.array(F.array_position("keys", F.col("key")).cast("int"))).alias("place"), name.alias("name"), F.schema_of_variant("value").alias("kind"), "value", F.element_at("texts", F.col("key")).alias("json"))
    return each


def cells(records: DataFrame, row: str = "row", text: str = "json") -> DataFrame:
    """row, name, value, place of records (row, a text each): the leaves of their objects; place is where each stands in its record."""
    # Dealt out, since parsing costs more than moving and a file may be one task.
    objects = records.repartition(row).select(F.col(row).alias("row"), F.array().cast("array<int>").alias("place"), F.lit("").alias("name"), F.col(text).alias("json"))
    out = None
    while True:
        each, nested = _one_level(objects), F.startswith("kind", F.lit("OBJECT"))
        # Written, so that each level is parsed once, whoever reads its leaves and the objects within.
        level = written(each.select("row", "name", F.when(~nested, _scalar(F.col("value"), F.col("kind"))).alias("value"), "place", nested.alias("nested"), F.when(nested, F.col("json")).alias("json")), "cells")
        leaves = level.filter("NOT nested").select("row", "name", "value", "place")
        out = leaves if out is None else out.unionByName(leaves)
        objects = level.filter("nested").select("row", "place", "name", "json")
        if objects.isEmpty():
            return out


def headers(table: DataFrame) -> DataFrame:
    """name, first: the names in the order in which they first appear (by row, then place)."""
    return table.groupBy("name").agg(F.min(F.struct("row", "place")).alias("first"))


def rows_of(table: DataFrame) -> DataFrame:
    """row, cells: a map from name to value for each record."""
    return table.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("cells"))
