"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one row for each text ever seen: its SHA-256, the doc_id
that stays and how many rows carried the text.  A new batch is summed up by digest first (map-side combined, so a group
of copies of any size leaves each task as one row), reduced by a sort-merge anti-join with the index, and appended.
The verdict of each row then comes from a join on the digest.  Groups that hold more than 1/HOT_GROUPS of the batch's rows,
of which there can't be more than HOT_GROUPS, are joined by broadcast instead, so their rows don't pile up in one task.

A new index gets as many buckets as its first rows need (`buckets_for`).  Each append adds a file to every bucket, so
after some of them `compact` writes the index anew with one sorted file a bucket, and with more buckets if it has grown.

`deduplicate` takes a whole table through an index in batches, largest doc_ids first, so that of equal texts the largest
doc_id stays whichever batch it is in.

Cases: a null text counts as empty; texts are equal when their bytes are; of equal texts the largest doc_id stays; rows
that repeat a doc_id and its text are one document given twice, of which the first is kept; a null doc_id is smaller
than any other; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_folder, text_or_empty

#: A group with more than this share of a batch is joined by broadcast; so there are at most as many.
HOT_GROUPS = 1000
#: Rows of the index that a bucket should hold, some 60 bytes each.
BUCKET_ROWS = 4_000_000
LEAST_BUCKETS = 16
INDEX_COLUMNS = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch BIGINT"


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


class DigestIndex:
    """A digest index at `path`; open it again by the same path and bucket count."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE TABLE {self.table} ({INDEX_COLUMNS}) USING PARQUET CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        # One writer for each bucket, so each bucket of a batch is one sorted file.
        fresh.repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def compact(self, path: str, buckets: int | None = None) -> DigestIndex:
        """The same rows as a new index at another path, one sorted file a bucket; the old one stays as it is."""
        out = DigestIndex(self.spark, path, buckets or max(self.buckets, buckets_for(self.rows().count())))
        out.append(self.rows())
        return out

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest and copies: how many rows have both in common."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest")).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))


def add_batch(given: DataFrame, index: DigestIndex, batch: int) -> None:
    """Append the digests of a batch (doc_id, digest, copies) that the index hasn't got."""
    groups = given.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    known = index.rows().select("digest")
    fresh = groups.hint("merge").join(known.hint("merge"), "digest", "left_anti")
    index.append(fresh.select("digest", "keep_id", "group_size", F.lit(batch).cast("bigint").alias("batch")))


def dedup_batch(docs: DataFrame, index: DigestIndex, batch: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a batch against the index and itself, append what is new, and return a row for each row of the batch.

    doc_id, keep_id, group_size (of the rows of the batch in which the text was first seen), kept, text_sha256.
    """
    given = materialise(digests(docs, id_col, text_col), "digests")
    add_batch(given, index, batch)
    return verdicts(given, index.rows(), F.col("batch") == batch)


def hot_digests(given: DataFrame) -> DataFrame:
    """The digests that more than 1/HOT_GROUPS of these rows (and 1000 at least) have: HOT_GROUPS of them at most."""
    groups = materialise(given.groupBy("digest").agg(F.sum("copies").alias("n")), "digest-groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return groups.filter(F.col("n") > max(1000, total // HOT_GROUPS)).select("digest")


def verdicts(given: DataFrame, index: DataFrame, first_seen_here) -> DataFrame:
    """A row for each row behind `given` by what the index says; `first_seen_here` tells whose texts may stay."""
    known = index.select("digest", "keep_id", "group_size", first_seen_here.alias("here"))
    hot = known.join(F.broadcast(hot_digests(given)), "digest", "left_semi").select(F.col("digest").alias("h_digest"), F.struct("keep_id", "group_size", "here").alias("hot"))
    tagged = given.join(F.broadcast(hot), F.col("digest") == F.col("h_digest"), "left").drop("h_digest")
    rest = tagged.filter("hot IS NULL").drop("hot").join(known, "digest")
    found = rest.select("doc_id", "digest", "copies", "keep_id", "group_size", "here").unionByName(tagged.filter("hot IS NOT NULL").select("doc_id", "digest", "copies", "hot.*"))
    stays = F.col("here") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", stays.alias("stays"), F.lower(F.hex("digest")).alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All of `docs` through one new index in batches of falling doc_id; the columns of `dedup_batch`, with group_size over all.

    The index's name is dropped again; its files go with the driver.
    """
    spark = docs.sparkSession
    given = materialise(digests(docs, id_col, text_col), "digests")
    index = DigestIndex(spark, new_folder(spark, "digest-index"), buckets_for(given.count()))
    cuts = given.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)]).alias("c")).first().c if batches > 1 else []
    upto = None
    for k, cut in enumerate([*reversed(cuts or []), None]):
        own = F.lit(True) if upto is None else F.coalesce(F.col("doc_id") <= upto, F.lit(True))
        if cut is not None:
            own, upto = own & (F.col("doc_id") > cut), cut
        add_batch(given.filter(own), index, k)
    # How many rows of all batches carry each text; the index counts those of its first batch.
    sizes = given.groupBy("digest").agg(F.sum("copies").alias("group_size"))
    whole = materialise(index.rows().select("digest", "keep_id").hint("merge").join(sizes.hint("merge"), "digest"), "digest-verdicts")
    index.close()
    return verdicts(given, whole, F.lit(True))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches against one index, the second one's known texts removed by the anti-join."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
