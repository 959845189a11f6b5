import hashlib
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import exact_dedup, simhash, similar
from marlstone.llm.components import components
from marlstone.llm.exact_dedup import DigestIndex, dedup_batch

SCHEMA = "doc_id bigint, text string, kept int, group_size string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, 7, "clash") for d, t in rows], SCHEMA)


def test_exact_dedup_cases(spark, tmp_path):
    rows = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "long " * 50_000), (6, "b"), (6, "b"), (None, "a"), (None, "z"), (7, "B")]
    index = DigestIndex(spark, str(tmp_path / "index"), 4)
    got = sorted(map(tuple, dedup_batch(docs(spark, rows), index).collect()), key=str)
    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", []).append(d)
    want, given = [], set()
    for d, t in rows:
        ids = [x for x in texts[t or ""] if x is not None]
        keep = max(ids, default=None)
        first = (d, t) not in given
        given.add((d, t))
        want.append((d, keep, len(texts[t or ""]), d == keep and first, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_dedup_appends_and_drops_what_is_known(spark, tmp_path):
    path = str(tmp_path / "index")
    index = DigestIndex(spark, path, 4)
    dedup_batch(docs(spark, [(10, "a"), (11, "b")]), index, 0).collect()
    index.close()
    again = DigestIndex(spark, path, 4)  # by its path, as another session would
    got = {r.doc_id: r for r in dedup_batch(docs(spark, [(20, "b"), (21, "c")]), again, 1).collect()}
    assert not got[20].kept and got[20].keep_id == 11 and got[21].kept
    assert again.rows().count() == 3
    plan = again.rows().join(again.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_exact_dedup_of_nothing(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4)
    assert dedup_batch(docs(spark, []), index).collect() == []


def test_hot_groups_go_by_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 4)
    index = DigestIndex(spark, str(tmp_path / "index"), 4)
    got = dedup_batch(docs(spark, [(i, "same" if i % 2 else f"t{i}") for i in range(100)]), index).collect()
    assert len(got) == 100 and sum(r.kept for r in got) == 51 and {r.group_size for r in got if r.doc_id % 2} == {50}


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_a_whole_table_in_batches_is_the_sql(spark, tmp_path, batches):
    rows = [(d, f"t{d % 37}" if d % 3 else "same") for d in range(300)] + [(None, "same"), (None, "alone"), (5, "t5"), (5, "t5"), (7, None), (8, ""), (9, "long " * 9000)]
    frame = docs(spark, rows)
    tables = {t.name for t in spark.catalog.listTables()}
    got = sorted(map(tuple, exact_dedup.deduplicate(frame, batches).select("doc_id", "group_size", "keep_id", "kept", "text_sha256").collect()), key=str)
    assert {t.name for t in spark.catalog.listTables()} == tables
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert got == sorted(con.sql(f"SELECT doc_id, group_size, keep_id, kept, text_sha256 FROM ({exact_dedup.OP7_SQL})").fetchall(), key=str)


def test_hot_groups_are_those_of_the_batch(spark, tmp_path):
    """An old index of many large groups gives no broadcast; a text seen once before that fills the batch does."""
    index = DigestIndex(spark, str(tmp_path / "index"), 4)
    old = spark.range(3000).select(F.unhex(F.sha2(F.concat(F.lit("old"), "id"), 256)).alias("digest"), F.col("id").alias("keep_id"), F.lit(1002).cast("bigint").alias("group_size"), F.lit(0).cast("bigint").alias("batch"))
    index.append(old.union(spark.createDataFrame([(bytearray(hashlib.sha256(b"now hot").digest()), 1, 1, 0)], old.schema)))
    few = exact_dedup.digests(docs(spark, [(i, f"old{i}") for i in range(10)]))
    assert exact_dedup.hot_digests(few).count() == 0
    many = docs(spark, [(10_000 + i, "now hot") for i in range(1500)] + [(20_000, "new")])
    assert exact_dedup.hot_digests(exact_dedup.digests(many)).count() == 1
    got = dedup_batch(many, index, 1).collect()
    assert len(got) == 1501 and [r.doc_id for r in got if r.kept] == [20_000] and {r.keep_id for r in got} == {1, 20_000}


def test_a_compacted_index_is_read_in_order(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4)
    for k in range(3):
        dedup_batch(docs(spark, [(10 * k + i, f"{k} {i}") for i in range(10)]), index, k).collect()
    whole = index.compact(str(tmp_path / "compact"))
    assert sorted(map(str, whole.rows().collect())) == sorted(map(str, index.rows().collect())) and whole.buckets == exact_dedup.LEAST_BUCKETS
    names = {f.rpartition("_")[2].split(".")[0] for f in whole.rows().inputFiles()}
    assert len(names) == len(whole.rows().inputFiles())
    assert exact_dedup.buckets_for(10**9) == 250


def slow_fingerprint(text, size=3):
    words = bytes(text, "utf-8").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = [slow_fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_position_sets_cover():
    sets = [set(s) for s in simhash.position_sets()]
    assert len(sets) == 14 and all(any(s <= set(five) for s in sets) for five in combinations(range(8), 5))


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one two"), (5, "ONE TWO"), (6, "É é"), (None, "solo null"), (None, "one two"), (7, "x " * 20_000)]
    for d in range(10, 60):
        base = rng.choice(words, 120).tolist()
        rows.append((d, " ".join(base)))
        for k in range(3):
            base[int(rng.integers(120))] = "edit"
            rows.append((d * 100 + k, " ".join(base)))
    rows += [(4, "one two"), (999, "one\x1ctwo three")]
    got = sorted(map(tuple, simhash.near_duplicates(docs(spark, rows)).drop("root", "text_hash").collect()), key=str)
    want = sorted(slow_components(rows), key=str)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 30  # some were linked


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_long_posting_lists_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 5), replace=False)) for _ in range(300)}
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 50)}
    fps = sorted(fps)
    frame = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, np.int64)}))
    for limit in (4096, 8):
        got = {r.node: r.root for r in components(simhash.links(frame, long_list=limit)).collect()}
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in combinations(fps, 2):
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
        groups, want = {}, {}
        for f in fps:
            want.setdefault(find(f), set()).add(f)
        for f in fps:
            groups.setdefault(got.get(f, f), set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 1000 + i) for i in range(50)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({got[i] for i in range(100, 161)}) == 1 and len({got[7], *(got[1000 + i] for i in range(50))}) == 1 and len(set(got.values())) == 2 and 5 not in got
    assert F is not None


def slow_similar(rows, size, similarity):
    """(doc_id, least doc_id of its group) by the Jaccard similarity of all pairs."""
    sets = []
    for _, t in rows:
        words = bytes(t or "", "utf-8").lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if find(i) != find(j) and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, least.get(find(i))) for i, (d, _) in enumerate(rows)]


def near_rows(seed, texts=25, copies=6):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE TWO"), (None, "solo null"), (None, "one two"), (7, "x " * 20_000), (4, "one")]
    passage = rng.choice(words, 60).tolist()
    for d in range(10, 10 + texts):
        base = rng.choice(words, int(rng.integers(40, 300))).tolist() + passage * int(rng.integers(0, 2))
        rows.append((d, " ".join(base)))
        for k in range(copies):  # each a step further away, so that chains grow beyond what their ends share
            base[int(rng.integers(len(base)))] = f"edit{rng.integers(1000)}"
            rows.append((d * 100 + k, " ".join(base)))
    return rows


def test_similar_texts_against_all_pairs(spark):
    rows = near_rows(6)
    got = simhash.near_duplicates(docs(spark, rows), 5, similarity=0.8).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(slow_similar(rows, 5, 0.8), key=str)
    assert simhash.near_duplicates(docs(spark, []), 5, similarity=0.8).collect() == []


def test_recall_where_lists_of_keys_are_dealt_into_parts(spark, monkeypatch):
    rows = near_rows(8, texts=6, copies=40)
    monkeypatch.setattr(similar.nominated, "__defaults__", (16,))
    got = {(r.doc_id): r.root for r in simhash.near_duplicates(docs(spark, rows), 5, similarity=0.8).collect()}
    sets = {d: {tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} for d, t in rows if d is not None and d >= 10}
    alike = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(alike) > 500 and sum(got[a] == got[b] for a, b in alike) >= 0.9 * len(alike)


def test_the_forest_spans_what_is_near():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    fps[20:] = fps[:20] ^ np.uint64(5)
    links = similar.nearest_forest(fps, 8)
    assert sorted((min(a, b), max(a, b)) for a, b in links) == [(i, i + 20) for i in range(20)]


@pytest.mark.parametrize("seed, long_list", [(1, 4096), (2, 4096), (3, 4)])
def test_no_link_is_lost_in_groups_at_the_threshold(spark, monkeypatch, seed, long_list):
    """Sixty groups of eight copies with 2 to 6 of 300 words changed: many pairs are just above or below 0.8."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for k in range(8):
            words = list(base)
            for at in rng.choice(300, int(rng.integers(2, 7)), replace=False):
                words[at] = f"e{rng.integers(10**6)}"
            rows.append((g * 10 + k, " ".join(words)))
    monkeypatch.setattr(similar.nominated, "__defaults__", (long_list,))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows), 5, similarity=0.8).collect()}
    assert got == dict(slow_similar(rows, 5, 0.8))


def test_likeliest_partners_are_of_other_components_and_parts():
    sketches = np.zeros((5, 48), np.uint8)
    sketches[3, :10] = 1
    sketches[4] = 9
    roots, sides = np.array([0, 0, 1, 2, 3]), np.array([0, 0, 0, 1, 1])
    assert similar.likeliest(sketches, roots, sides, False, 9) == ([(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)], False)
    assert similar.likeliest(sketches, roots, sides, True, 9) == ([(0, 3), (1, 3), (2, 3)], False)
    pairs, more = similar.likeliest(sketches, roots, sides, False, 1)
    assert more and len([p for p in pairs if 2 in p]) >= 1 and not {(0, 1), (0, 4), (1, 4)} & set(pairs)
    alone = np.array([0, 0, 0, 0, 1])
    assert similar.likeliest(np.zeros((5, 48), np.uint8), alone, sides, False, 2)[0] in ([(0, 4), (1, 4)], [(0, 4), (2, 4)], [(0, 4), (3, 4)], [(1, 4), (2, 4)], [(1, 4), (3, 4)], [(2, 4), (3, 4)])


def test_a_list_gives_fewer_links_than_it_has_texts():
    """Of 80 texts whose pairs are nearly all alike, and 80 of which none are: no pair is left out, and pairs don't come out."""
    rng = np.random.default_rng(3)
    one, other = (np.sort(rng.integers(0, 1 << 62, 100).astype(np.uint64)) for _ in range(2))
    sets = [np.sort(np.concatenate([one[k % 5 :], rng.integers(0, 1 << 62, 3).astype(np.uint64)])) for k in range(80)]
    sets += [np.sort(np.concatenate([other[:60], rng.integers(0, 1 << 62, 40).astype(np.uint64)])) for _ in range(80)]
    sketches = np.repeat(np.array([[1] * 48, [2] * 48], np.uint8), 80, axis=0)
    keys, roots, sides = np.full((160, 12), 7), np.arange(160), np.arange(160) % 2
    for crossing in (False, True):
        links = similar.joined_within(7, keys, sketches, roots, sides, crossing, sets, 0.8)
        assert len(links) == 79 and all(i < 80 and j < 80 for i, j in links)
        assert not crossing or all(sides[i] != sides[j] for i, j in links)
