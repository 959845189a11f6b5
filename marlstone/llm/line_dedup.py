"""Line deduplication by content-defined chunks of lines.

Each line is hashed, and at every line a hash is taken of the window of its own and the line before's hash (MD5 of both: a
rolling hash with a window of two, in SQL functions).  A chunk begins where
that hash is lower than at the line before and at the line after.  That depends on four lines only, so lines put in or
taken out shift the boundaries next to them and no others; and two such places are never next to each other, so all
chunks have two lines or more, save perhaps a text's first.

A multi-line chunk that occurs more than once, in whatever documents, stays where it occurs first (least doc_id, then
place) and is removed elsewhere.  Hashes only nominate: chunks whose hash repeats are fetched and grouped by their bytes,
map-side combined, and the first of each group of equal bytes stays.

What is shuffled by chunk are hashes, then the bytes of repeated chunks, combined first, so a chunk that stands in a
third of all documents leaves each task once.  What goes back to the documents is keyed by document.

Cases: a null text stays null; empty texts and lines of white space alone are left alone, as are single lines; repeated
rows (same doc_id and text) are one document and lose the same chunks; a null doc_id sorts last; an empty table gives an
empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Begins a chunk in a joined text, in which the escape character itself has been followed by `e`.
ESCAPE = "\x01"
MARK = ESCAPE + "b"


def split_chunks(text: Column, lines: str, hashes: str, rolling: str) -> list[tuple[str, Column]]:
    """The columns to add, one after the other, to get the array of chunks; joined by newlines they are the text."""
    escaped = F.when(F.contains(text, F.lit(ESCAPE)), F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e"))).otherwise(text)
    roll = F.transform(F.col(hashes), lambda h, i: F.md5(F.concat(F.coalesce(F.get(F.col(hashes), i - 1), F.lit("")), h)))

    def begins(i: Column) -> Column:
        here = F.get(F.col(rolling), i)
        return (i > 0) & (here < F.get(F.col(rolling), i - 1)) & F.coalesce(here < F.get(F.col(rolling), i + 1), F.lit(False))

    marked = F.array_join(F.transform(F.col(lines), lambda line, i: F.when(begins(i), F.concat(F.lit(MARK), line)).otherwise(line)), "\n")
    chunks = F.split(F.replace(marked, F.lit("\n" + MARK), F.lit(MARK)), MARK)
    return [(lines, F.split(escaped, "\n")), (hashes, F.transform(F.col(lines), lambda x: F.md5(x))), (rolling, roll), ("_chunks", chunks)]


def with_chunks(frame: DataFrame, text: str) -> DataFrame:
    for name, column in split_chunks(F.col(text), "_lines", "_hashes", "_rolling"):
        frame = frame.withColumn(name, column)
    return frame.drop("_lines", "_hashes", "_rolling")


def _unescaped(chunk: Column) -> Column:
    return F.when(F.contains(chunk, F.lit(ESCAPE)), F.replace(chunk, F.lit(ESCAPE + "e"), F.lit(ESCAPE))).otherwise(chunk)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of `docs` with `_row` (their columns), `_text` (what is left of the text), `_removed_chunks`, `_removed_lines`."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"), F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_row"))
    texts = rows.select("_id", "_hash", "_text")

    # Hashes of all multi-line chunks, and of these the ones that occur more than once.  The outer form of explode keeps
    # Catalyst from inferring a filter on the array, which it would push down by repeating the whole chain per element.
    chunks = with_chunks(texts.filter(F.contains("_text", F.lit("\n"))), "_text").select("_id", "_hash", F.posexplode_outer("_chunks").alias("_place", "_chunk"))
    several = F.contains("_chunk", F.lit("\n")) & F.rlike("_chunk", F.lit(r"[^ \x09-\x0D]"))
    refs = materialise(chunks.filter(several).select("_id", "_hash", "_place", F.xxhash64("_chunk").alias("_of")), "line-chunks")
    # Written, so that both sides of the join are shuffled as they are and Spark can split a hash that very many share.
    repeated = materialise(refs.groupBy("_of").count().filter("count > 1").select("_of"), "repeated-chunks")
    nominated = materialise(refs.join(repeated.hint("merge"), "_of", "left_semi"), "nominated-chunks")

    # Their bytes, from the documents that hold them (repeated rows give the same places twice, which changes no minimum);
    # the first of each group of equal bytes stays.
    places = nominated.groupBy("_id", "_hash").agg(F.collect_set("_place").alias("_places"))
    fetched = with_chunks(_by_row(texts, places, "inner"), "_text").select("_id", "_hash", F.explode_outer("_places").alias("_place"), "_chunks")
    fetched = fetched.select("_id", "_hash", "_place", F.get("_chunks", F.col("_place")).alias("_chunk"))
    first = fetched.groupBy("_chunk").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_place", "_hash")).alias("f")).select("f._id", "f._hash", "f._place")
    gone = _by_row(nominated.select("_id", "_hash", "_place").distinct(), materialise(first, "first-chunks"), "left_anti", "_place")

    lost = gone.groupBy("_id", "_hash").agg(F.collect_set("_place").alias("_gone"))
    out = with_chunks(_by_row(rows, lost, "left"), "_text")
    kept = F.filter(F.col("_chunks"), lambda c, i: ~F.array_contains("_gone", i))
    left = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(_unescaped(F.array_join(kept, "\n")))
    count = lambda t: F.size(F.split(t, "\n"))
    out = out.select("_row", left.alias("_left"), "_text", F.coalesce(F.size("_gone"), F.lit(0)).alias("_removed_chunks"), F.size("_chunks").alias("_n"))
    lines = F.when(F.coalesce("_removed_chunks", F.lit(0)) == 0, 0).when(F.col("_removed_chunks") == F.col("_n"), count(F.col("_text"))).otherwise(count(F.col("_text")) - count(F.col("_left")))
    return out.select("_row", F.col("_left").alias("_text"), F.greatest("_removed_chunks", F.lit(0)).alias("_removed_chunks"), lines.alias("_removed_lines"))


def _by_row(left: DataFrame, right: DataFrame, how: str, *more: str) -> DataFrame:
    """Join on the row (_id, which may be null, and _hash) and further columns; the columns of `left`, then the rest."""
    keys = ["_id", "_hash", *more]
    other = right.select(*[F.col(k).alias(f"r{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"r{k}"))
    # Merged at any size, so that what is shuffled grows evenly with the input.
    return left.join(other.hint("merge"), on, how).drop(*[f"r{k}" for k in keys])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the text column reduced to what stays; the same columns in the same order."""
    out = line_dedup(docs, id_col, text_col)
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


def op4_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that stays, and how many chunks and lines were removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select(F.col("_row.doc_id").alias("doc_id"), F.col("_text").alias("text"), F.col("_removed_chunks").alias("removed_chunks"), F.col("_removed_lines").alias("removed_lines"))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT *, md5(coalesce(lag(md5(line)) OVER w, '') || md5(line)) AS roll FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), marked AS (
  SELECT *, coalesce(roll < lag(roll) OVER w AND roll < lead(roll) OVER w, false) AS begins FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, sum(begins::int) OVER (PARTITION BY doc_id ORDER BY i) AS place FROM marked
), chunks AS (
  SELECT doc_id, place, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM numbered GROUP BY doc_id, place
), judged AS (
  SELECT *, n > 1 AND regexp_matches(chunk, '[^ \\x09-\\x0D]') AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, place) > 1 AS gone FROM chunks
), told AS (
  SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text,
         count_if(gone)::int AS removed_chunks, coalesce(sum(n) FILTER (WHERE gone), 0)::int AS removed_lines
  FROM judged GROUP BY doc_id
)
SELECT doc_id, t.text, coalesce(t.removed_chunks, 0) AS removed_chunks, coalesce(t.removed_lines, 0) AS removed_lines FROM documents LEFT JOIN told t USING (doc_id)
"""
