"""A training-data pipeline over `documents`: five stages, each written as Parquet and read by the next.

Rejects by quality rules, removes repeated chunks of lines, keeps one document of each group of near copies, masks
personal data, and packs what is left into sequences.  All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import line_dedup, packing, pii, quality, simhash
from marlstone.llm.common import folders, materialise, remove
from marlstone.llm.tokens import vocabulary_path


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def _rows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id and text_hash are among `wanted`; a null doc_id matches a null one.

    Columns are named through their tables, so whatever else `docs` has can't clash."""
    wanted = wanted.select("doc_id", "text_hash")
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (F.xxhash64(docs["text"]) == wanted["text_hash"]), "left_semi")


def _fresh(docs: DataFrame, name: str) -> str:
    """A name like `name` that no column of `docs` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: What makes texts near copies: the Jaccard similarity of their sets of five-word shingles.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the rules with risk-controlled cutoffs.

    A null or empty text fails the base rule; of rows that repeat a doc_id each is judged by its own text, and repeated rows
    all stay or all go; an empty table gives an empty one; further columns, whatever their names, are kept."""
    told = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _rows_of(docs, told.filter("kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the multi-line chunks that an earlier one has.

    Null texts stay null; of equal chunks the one with the least doc_id and place stays, a null doc_id last; an empty table gives an
    empty one; further columns are kept."""
    return _with_length(line_dedup.deduplicated(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id; of rows that repeat that doc_id, one."""
    found = simhash.near_duplicates(docs, SHINGLE_WORDS, similarity=SIMILARITY).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    told = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.count(F.lit(1)).alias("n"))
    told = materialise(told.select("r.doc_id", "r.text_hash", "n"), "representatives")
    kept = _rows_of(docs, told)
    if told.filter("n > 1").isEmpty():
        return kept
    # Columns that can be compared suffice: the rows agree in doc_id and text.
    name = _fresh(kept, "hash")
    return kept.withColumn(name, F.xxhash64("text")).dropDuplicates(["doc_id", name]).drop(name)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind.

    Null texts stay null, repeated rows stay, an empty table gives an empty one, further columns are kept."""
    return _with_length(pii.mask_pii(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.

    A null text is packed as an empty one, which has its end id; repeated rows are packed each; an empty table gives an
    empty one; further columns are left behind."""
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: XXH64 fingerprints, disguises and tokenizers have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`.  What a stage has written for itself, and its input, go when its result is written;
    results are written with zstandard, which takes less disk, and less memory for pages of long texts, than Snappy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        own = set(folders())
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{k}", "zstd")
            done = folders()[-1]
            remove(spark, [f for f in folders() if f != done and (f not in own or f"/stage-{k - 1}-" in f)])
    return docs
