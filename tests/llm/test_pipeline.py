"""The pipeline against a brute-force version of all its stages."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import pii
from marlstone.llm.tokens import vocabulary_path

from .test_dedup import slow_similar
from .test_native_ops import slow_counts, slow_line_dedup
from .test_tokens import check_packing


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = "\n".join(words(9) for _ in range(12))
    rows = [(0, None), (1, ""), (2, "too short"), (3, "a b c d e f g h " * 20), (4, words(5000))]
    for d in range(10, 40):
        text = "\n".join(words(12) for _ in range(4)) + f"\nwrite to user{d}@mail.example.org or user{d} (at) mail (dot) org\n" + (passage + "\n" + words(10) if d % 3 == 0 else words(8))
        rows.append((d, text))
        if d % 5 == 0:
            rows.append((d + 100, text))
            rows.append((d + 200, text.replace("write", "wrote")))
    where = str(tmp_path_factory.mktemp("tables"))
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(10, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows


def test_run_is_the_brute_force_pipeline(spark, given):
    where, rows = given
    kept = []
    for d, t in rows:
        n, *_, repeated = slow_counts(t)
        if not (n < 20 or 100 * repeated > 30 * n):
            kept.append((d, t))
    lines = [(d, t) for d, t, _ in slow_line_dedup(kept)]
    first = {d for d, c in slow_similar(lines, 5, 0.8) if d == c}
    masked = [(d, pii.masked(t)) for d, t in lines if d in first]
    got = corpus_pipeline.run(spark, where).collect()
    assert len(kept) < len(rows) and len(first) < len(kept) and any("[EMAIL]" in t for _, t in masked) and all("@" not in t for _, t in masked)
    assert {d for d, _ in masked} == {r.doc_id for r in got}
    check_packing(Tokenizer.from_file(vocabulary_path()), masked, got)


def test_stages_keep_the_columns_and_handle_odd_rows(spark, given):
    where, _ = given
    docs = spark.read.parquet(f"{where}/documents.parquet")
    long = " ".join(map(str, range(30)))
    odd = spark.createDataFrame([(None, long, None, None, None), (None, long + " x", "xx", None, 1), (7, long, "en", "s", 3), (7, long, "en", "s", 3), (7, None, None, "s", None), (8, "", "en", "s", 0)], docs.schema)
    for frame, count in ((docs, None), (odd, 6), (odd.filter("false"), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, where)
            assert out.columns == docs.columns, name
            n = out.count()
            assert count is None or (n == count if "PII" in name or "line" in name else n <= count)
            if count == 6 and "near" in name:
                assert n == 2  # the one text with its variant (26 of 27 shingles in common), and the empty ones
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "PII", "best-fit packing"]


def test_stages_with_columns_of_any_name(spark, given):
    """Columns that the stages could use inside stay as they are."""
    where, _ = given
    docs = spark.read.parquet(f"{where}/documents.parquet")
    names = ["_id", "_hash", "hash", "text_hash", "node", "d", "t", "n", "root", "key", "kept", "_place", "part", "line"]
    wide = docs.limit(12).union(docs.limit(2)).select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, where)
        if name != "best-fit packing":
            assert out.columns == wide.columns, name
            assert all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in out.collect()), name
        else:
            assert out.count() > 0
