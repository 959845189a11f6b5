"""Each registered query as it stands, over a whole small table, against SQL or a brute-force version."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from marlstone.llm.registry import ORACLES, QUERIES
from marlstone.llm.tokens import vocabulary_path

from .test_alignment import COLUMNS as alignment_columns
from .test_alignment import Slow
from .test_dedup import slow_components
from .test_native_ops import slow_counts
from .test_prefix_trie import COLUMNS as trie_columns
from .test_prefix_trie import slow_trie
from .test_spans import slow_pii, slow_secrets
from .test_tokens import check_packing, crc

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The given documents, and rows that are null, empty, repeated, disguised or hard on tokenizers."""
    where = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(None, "no id"), (9001, None), (9002, ""), (9003, "D.İ. <|ENDOFTEXT|> a"), (9004, "john [at] example [dot] com"), (9005, "pwd is kJxLmQvZtRnWpYsDqHgBfTcR token=abcdef0123"), (9005, "same id"), (9006, "one two"), (9006, "one two"), (9007, "x " * 6000), (9008, "l1\nl2\nl3\n" * 300)]
    more = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in odd], docs.schema)
    docs.union(more).write.parquet(f"{where}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{where}/labels.parquet")
    return where, [tuple(r) for r in docs.union(more).select("doc_id", "text").collect()]


def rows_of(spark, tables, name, *columns):
    out = QUERIES[name](spark, tables[0])
    return out.select(*columns).collect() if columns else out.collect()


@pytest.mark.parametrize("name, slow, kinds", [("op1_pii_deobfuscation", slow_pii, ("email", "ip", "card", "phone")), ("op3_secret_novelty", slow_secrets, ("assign", "access", "hex"))])
def test_spans(spark, tables, name, slow, kinds):
    got = rows_of(spark, tables, name, "doc_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans")
    want = []
    for d, t in tables[1]:
        base = slow(t or "")
        want.append((d, *(sum(k == s[0] for s in base) for k in kinds), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(want, key=str)
    found = {r.doc_id: r.spans for r in got}
    assert "email:" in found[9004] if "pii" in name else any("novel:" in r.spans for r in got)
    once = {d: t for d, t in tables[1] if sum(d == x for x, _ in tables[1]) == 1}
    for r in got:  # base spans stay among all spans
        assert {f"{k}:{a}:{b}" for k, a, b in slow(once.get(r.doc_id) or "")} <= set(r.spans.split(","))


def test_sharding(spark, tables):
    got = rows_of(spark, tables, "op2_bounded_ring_sharding")
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for d, t in tables[1]), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got), key=str) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))


def test_quality(spark, tables):
    got = rows_of(spark, tables, "op5_risk_controlled_quality", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = []
    for d, t in tables[1]:
        n, *rest, repeated = slow_counts(t)
        want.append((d, n, *rest, repeated, n < 20 or 100 * repeated > 30 * n))
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(want, key=str)
    assert not any(r.base_failed and r.kept for r in got)


def test_segmentations(spark, tables):
    texts = {}
    for d, t in tables[1]:
        texts.setdefault(d, set()).add(zlib.crc32((t or "").encode()))
    got = rows_of(spark, tables, "op6_gumbel_segmentations")
    assert {r.doc_id for r in got} == set(texts) and all(r.decoded_crc32 in texts[r.doc_id] for r in got)
    assert all(0 <= r.inclusion <= 1 and math.isfinite(r.log_inclusion) and r.log_inclusion <= 0 and r.log_prob <= 0 for r in got)
    assert all(r.inclusion == pytest.approx(math.exp(r.log_inclusion)) for r in got)


def test_exact_copies(spark, tables):
    rows = tables[1]
    got = rows_of(spark, tables, "op7_exact_dedup", "doc_id", "group_size", "keep_id", "kept", "text_sha256")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = con.sql(f"SELECT doc_id, group_size, keep_id, kept, text_sha256 FROM ({ORACLES['op7_exact_dedup']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_fingerprints(spark, tables):
    got = rows_of(spark, tables, "op8_simhash_near_dedup", "doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got), key=str) == sorted(slow_components(tables[1]), key=str)


def test_packing(spark, tables):
    got = rows_of(spark, tables, "op9_best_fit_packing")
    bins = check_packing(Tokenizer.from_file(vocabulary_path()), tables[1], got)
    assert bins <= -(-sum(r.length for r in got) // 4096) + 2


def test_token_files(spark, tables):
    model = Tokenizer.from_file(vocabulary_path())
    got = sorted(rows_of(spark, tables, "op10_token_files", "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda r: r.start)
    want = []
    for d, t in tables[1]:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, len(ids), crc(np.array(ids))))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(d for d, _ in tables[1] if d is not None)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()


def test_lexicon(spark, tables):
    model = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    got = rows_of(spark, tables, "op12_lexicon_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for d, t in tables[1]:
        ids = model.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_alignment(spark, tables):
    got = rows_of(spark, tables, "op11_cross_tokenizer_alignment", "doc_id", *alignment_columns)
    assert sorted(map(tuple, got), key=str) == sorted(Slow().rows(tables[1]), key=str)


def test_prefix_trie(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_prefix_trie"](spark, DATA).select(*trie_columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow_trie(rows), key=str)
