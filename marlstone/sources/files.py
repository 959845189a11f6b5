"""Uploaded files: CSV with sniffed delimiters, JSON tables, and export archives."""

from __future__ import annotations

import codecs
import io
import json
import re
import zipfile
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import ship, slices

ship(__name__)

DELIMITERS = (",", ";", "\t", "|")


class ShapeError(ValueError):
    """A file that is not what it should be."""


def detect_delimiter(header: str) -> str:
    """The delimiter most frequent outside quotes; of equals the first listed."""
    bare = re.sub(r'"[^"]*"', "", header)
    return max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d)))


def field_pattern(delimiter: str) -> re.Pattern:
    """One field with what ends it: in quotes (doubled ones stand for one) with anything up to the delimiter behind, or bare."""
    d = re.escape(delimiter)
    return re.compile(rf'(?:"(?P<quoted>(?:[^"]|"")*)(?:"(?P<behind>[^{d}\r\n]*)|\Z)|(?P<bare>[^{d}\r\n]*))(?P<end>{d}|\r\n|\r|\n|\Z)')


class Records:
    """Records of a CSV text that arrives in parts, however it is cut: RFC 4180 with bare CR, doubled quotes, quotes inside a
    field kept, an open quote at the end closed, and blank records left out.

    What has arrived is matched field by field; a record is given out when something stands behind its line end, and what is
    left waits for the next part.
    """

    def __init__(self, delimiter: str = ","):
        self.pattern, self.waiting, self.at_start = field_pattern(delimiter), "", True

    def write(self, text: str) -> Iterator[list[str]]:
        if text and self.at_start:
            text, self.at_start = text.removeprefix("\ufeff"), False
        self.waiting += text
        yield from self._records(last=False)

    def end(self) -> Iterator[list[str]]:
        yield from self._records(last=True)

    def _records(self, last: bool) -> Iterator[list[str]]:
        text, row, quoted, begin = self.waiting, [], False, 0
        for m in self.pattern.finditer(text):
            open_end = m.end() == len(text)
            if open_end and not last:
                break  # the field, or the line end, may go on
            if m["quoted"] is not None:
                quoted = True
                row.append(m["quoted"].replace('""', '"') + (m["behind"] or ""))
            else:
                row.append(m["bare"])
            if m["end"] == "" or m["end"] in "\r\n":
                begin = m.end()
                if quoted or len(row) > 1 or row[0].strip():
                    yield row
                row, quoted = [], False
                if m["end"] == "":
                    break
        self.waiting = text[begin:]


def parse_csv(text: str) -> tuple[list[str], list[list[str]]]:
    """Trimmed headers and rows of a whole text."""
    first = text.lstrip("\ufeff").splitlines()[0] if text.strip() else ""
    records = Records(detect_delimiter(first))
    rows = [*records.write(text), *records.end()]
    return [h.strip() for h in rows[0]] if rows else [], rows[1:]


#: Bytes of a file that are parsed at once, and records that are given out together.
PART = 1 << 20


def csv_parts(content: bytes) -> Iterator[tuple[list[str], list[list[str]]]]:
    """Headers and rows of a file as `parse_csv` gives them, in parts: the text and its rows are never there as a whole."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    texts = (decoder.decode(content[at : at + PART], at + PART >= len(content)) for at in range(0, len(content), PART))
    # The delimiter is told from the first line, however long.
    head = ""
    for text in texts:
        head += text
        if len(head.lstrip("\ufeff").splitlines()) > 1:
            break
    first = next(iter(head.lstrip("\ufeff").splitlines()), "") if head.strip() else ""
    records, headers = Records(detect_delimiter(first)), None
    for found in chain([records.write(head)], (records.write(t) for t in texts), [records.end()]):
        rows = list(found)
        if headers is None and rows:
            headers, rows = [h.strip() for h in rows[0]], rows[1:]
        if rows:
            yield headers, rows


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, row (from 1), and cells of large CSV files in RFC 4180 form, read line by line in parallel.

    A line goes on in the next one while the quotes up to its end are odd.  Quotes and records are counted in each part that
    Spark reads; the counts of the parts, a row for each, say what stands before them.  A record is put together from its lines, and
    no task has more than the lines of its part and of records that reach into it.
    """
    head = spark.read.text(path).limit(1).first()
    delimiter = detect_delimiter((head[0] if head else "").lstrip("\ufeff"))
    w = Window.partitionBy("path", "part").orderBy("at")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    lines = lines.withColumn("part", F.shiftright("at", 33)).withColumn("q", F.length("line") - F.length(F.replace("line", F.lit('"'))))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("path", "part").agg(F.sum("q").alias("n")).select("path", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("quotes_before"))
    lines = lines.join(parts, ["path", "part"]).withColumn("upto", F.col("quotes_before") + F.sum("q").over(w) - F.col("q"))
    lines = lines.withColumn("begins", (F.col("upto") % 2 == 0).cast("int")).withColumn("own", F.sum("begins").over(w))
    starts = lines.groupBy("path", "part").agg(F.sum("begins").alias("n")).select("path", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("records_before"))
    numbered = lines.join(starts, ["path", "part"]).withColumn("record", F.col("records_before") + F.col("own"))
    whole = numbered.groupBy("path", "record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                cells = [next(iter([*(r := Records(delimiter)).write(t), *r.end()]), None) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells, pa.list_(pa.string()))], ["path", "record", "cells"])

    # Blank records take no number, and the first that is left is the header.
    filled = whole.filter(F.trim("text") != "").mapInArrow(run, "path string, record bigint, cells array<string>")
    blank = whole.filter(F.trim("text") == "").groupBy("path").agg(F.sort_array(F.collect_list("record")).alias("gaps"))
    row = F.col("record") - F.coalesce(F.size(F.filter("gaps", lambda g: g < F.col("record"))), F.lit(0)) - 1
    return filled.join(blank, "path", "left").select("path", row.alias("row"), "cells").filter("row > 0")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Row number and cells of a well-formed CSV file, read in parallel by Spark; all columns are strings."""
    head = spark.read.text(path, wholetext=False).limit(1).first()
    return spark.read.csv(path, header=True, sep=detect_delimiter((head[0] if head else "").lstrip("﻿")), quote='"', escape='"', multiLine=True, inferSchema=False, ignoreLeadingWhiteSpace=False)


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, row, headers and cells of CSV files in any shape that `Records` copes with; a file is read by one task."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                done = 0
                for headers, rows in csv_parts(content.as_py()):
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n, pa.string()), pa.array(range(done + 1, done + n + 1), pa.int64()), pa.array([headers] * n, pa.list_(pa.string())), pa.array(rows, pa.list_(pa.string()))], ["path", "row", "headers", "cells"])
                    done += n

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row bigint, headers array<string>, cells array<string>")


def flatten(value, prefix: str = "") -> dict[str, str]:
    """A nested object as dotted names and strings: arrays as JSON, null as nothing."""
    if value is None:
        return {prefix: ""} if prefix else {}
    if isinstance(value, list):
        return {prefix: json.dumps(value, ensure_ascii=False, separators=(",", ":"))}
    if isinstance(value, dict):
        out: dict[str, str] = {}
        for k, v in value.items():
            out |= flatten(v, f"{prefix}.{k}" if prefix else k)
        return out
    text = {True: "true", False: "false"}.get(value) if isinstance(value, bool) else str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    return {prefix: text}


def records_of(value) -> list[dict]:
    """The records of a JSON document: an array of objects, an object's one array, or the array under a usual name."""
    found = value if isinstance(value, list) else None
    if isinstance(value, dict):
        arrays = [v for v in value.values() if isinstance(v, list)]
        found = arrays[0] if len(arrays) == 1 else next((value[k] for k in C.COLLECTION_KEYS if isinstance(value.get(k), list)), None)
    if found is None:
        raise ShapeError("an array of objects is expected, or an object with one")
    if not all(isinstance(r, dict) for r in found):
        raise ShapeError("every item must be an object")
    return found


def parse_json_table(text: str) -> tuple[list[str], list[list[str]]]:
    """Headers in the order in which they first appear, and rows."""
    try:
        value = json.loads(text.removeprefix("﻿"))
    except ValueError as e:
        raise ShapeError("the file is not valid JSON") from e
    rows = [flatten(r) for r in records_of(value)]
    headers = list(dict.fromkeys(k for r in rows for k in r))
    return headers, [[r.get(h, "") for h in headers] for r in rows]


def json_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, row, headers and cells of JSON files."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                headers, rows = parse_json_table(content.decode("utf-8"))
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(1, n + 1), pa.int64()), pa.array([headers] * n, pa.list_(pa.string())), pa.array(rows, pa.list_(pa.string()))], ["path", "row", "headers", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row bigint, headers array<string>, cells array<string>")


def error_report(errors: DataFrame, path: str) -> None:
    """row and reason, quoted, with CRLF line ends."""
    errors.select("row", "reason").coalesce(1).sortWithinPartitions("row").write.mode("overwrite").csv(path, header=True, quoteAll=True, lineSep="\r\n", escape='"')


# ---- export archives ------------------------------------------------------------------------------------------

#: Which entries of an export are reviews, listing data, or reviews written by the owner.
REVIEW_PAGES = r"(?:^|/)Google Business Profile/account-([^/]+)/location-([^/]+)/reviews(?:-[^/]+)?\.json$"
LISTING_DATA = r"(?:^|/)Google Business Profile/account-([^/]+)/location-([^/]+)/additionalData\.json$"
OWN_REVIEWS = r"(?i)(?:^|/)Maps \(your places\)/Reviews\.json$"


def entry_kind(path):
    """What an entry of an export is, by its path; null for what is of no interest."""
    return F.when(F.rlike(path, F.lit(REVIEW_PAGES)), "reviews").when(F.rlike(path, F.lit(LISTING_DATA)), "location-data").when(F.rlike(path, F.lit(OWN_REVIEWS)), "maps-reviews")


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """path and text of the entries of interest, from zip archives or loose files."""
    wanted = re.compile("|".join(p.removeprefix("(?i)") for p in (REVIEW_PAGES, LISTING_DATA, OWN_REVIEWS)), re.I)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = []
                if content[:4] == b"PK\x03\x04":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        found = [(i.filename, z.read(i).decode("utf-8", "replace")) for i in z.infolist() if wanted.search(i.filename)]
                elif wanted.search(name):
                    found = [(name, content.decode("utf-8", "replace"))]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], ["path", "text"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.url_decode("path").alias("path"), "content").mapInArrow(run, "path string, text string")
