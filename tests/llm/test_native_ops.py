"""Sharding, line deduplication and quality rules against brute force."""

import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import line_dedup, quality, sharding
from marlstone.llm.common import materialise

# ---- sharding


def docs(spark, rows):
    return spark.createDataFrame([(d, t, 7, "clash") for d, t in rows], "doc_id bigint, text string, slot int, shard string")


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 1000])
def test_counts_are_at_most_one_apart_and_slots_gapless(spark, n):
    rows = [(i if i % 7 else 5, None if i % 5 == 0 else "é" * (i % 9)) for i in range(n)]
    got = sharding.assign_shards(docs(spark, rows)).collect()
    sizes = [0] * 16
    for r in got:
        sizes[r.shard] += 1
    assert len(got) == n and max(sizes) - min(sizes) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_rows_stay_on_the_ring_until_their_shard_is_full(spark):
    rows = [(i, "x") for i in range(3000)]
    owners = sharding.ring(16)
    loads = {}
    for d, _ in rows:
        place = xxhash.xxh64_intdigest(d.to_bytes(8, "little"), 42) >> (64 - sharding.RING_BITS)
        loads.setdefault(owners[place], []).append(d)
    got = sharding.assign_shards(docs(spark, rows), headroom=0.25).collect()
    room = -int(-1.25 * 3000 // 16)
    kept = {s: sum(r.shard == s and r.home_shard == s for r in got) for s in range(16)}
    for r in got:
        assert r.doc_id in loads[r.home_shard]
    for s in range(16):
        assert kept[s] == min(room, len(loads[s])) and sum(r.shard == s for r in got) <= room
    exact = sharding.assign_shards(docs(spark, rows)).collect()
    assert sum(r.shard != r.home_shard for r in exact) < 1200  # far from a new deal of all rows


@pytest.mark.parametrize("shards", [16, 64, 256])
def test_the_ring_is_even_whatever_the_number_of_shards(shards):
    owners = sharding.ring(shards)
    share = [0] * shards
    for s in owners:
        share[s] += 1
    mean = len(owners) / shards
    assert min(share) > 0.5 * mean and max(share) < 1.7 * mean
    half = shards // 2
    assert abs(sum(share[:half]) - sum(share[half:])) < 0.1 * len(owners)


def test_one_more_shard_takes_rows_and_moves_few_others(spark):
    frame = docs(spark, [(i, "x") for i in range(4000)])
    before, after = ({r.doc_id: (r.shard, r.home_shard) for r in sharding.assign_shards(frame, n, headroom=0.25).collect()} for n in (16, 17))
    assert all(after[d][1] in (before[d][1], 16) for d in before)  # by the ring alone rows go to the new shard only
    moved = [d for d in before if after[d][0] != before[d][0]]
    assert len(moved) < 4000 * 0.2 and sum(after[d][0] == 16 for d in moved) > 100


def test_overflow_continues_clockwise():
    assert sharding.flows([5, 1, 0], [0, 1, 2], [2, 2, 2]) == [[(0, 2), (1, 1), (2, 2)], [(1, 1)], []]
    with pytest.raises(ValueError):
        sharding.flows([5], [0], [4])


def test_one_key_of_a_third_of_all_rows(spark):
    rows = [(1, "same")] * 400 + [(i, "x") for i in range(800)]
    got = sharding.assign_shards(docs(spark, rows)).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(16)]
    assert len(got) == 1200 and max(sizes) - min(sizes) <= 1 and len({(r.shard, r.slot) for r in got}) == 1200


# ---- line deduplication


def chunks_of(text):
    lines = text.split("\n")
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    hashes = [md5(x) for x in lines]
    roll = [md5((hashes[i - 1] if i else "") + h) for i, h in enumerate(hashes)]
    out = [[lines[0]]]
    for i in range(1, len(lines)):
        if i + 1 < len(lines) and roll[i] < roll[i - 1] and roll[i] < roll[i + 1]:
            out.append([])
        out[-1].append(lines[i])
    return ["\n".join(c) for c in out]


def slow_line_dedup(rows):
    ids = sorted({(d is None, d or 0, t) for d, t in rows if t is not None})
    seen, left = {}, {}
    for null, d, t in ids:
        kept, gone = [], 0
        for k, c in enumerate(chunks_of(t)):
            multi = "\n" in c and re.search(r"[^ \t-\r]", c)
            if multi and seen.setdefault(c, (null, d, t, k)) != (null, d, t, k):
                gone += 1
            else:
                kept.append(c)
        left[None if null else d, t] = ("\n".join(kept) if gone else t, gone)
    return [(d, *(left[d, t] if t is not None else (None, 0))) for d, t in rows]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    pool = [[f"line {p} {i} {rng.random()}" for i in range(rng.randint(2, 14))] for p in range(12)]
    rows = [(0, None), (1, ""), (2, "\n\n\n"), (3, "one line"), (4, "one line"), (None, "\n".join(pool[0])), (5, "a\x01b\nx\x01e\n" + "\n".join(pool[1])), (6, "\n".join(["same"] * 50)), (7, "\n".join(["same"] * 50)), (8, "ends\n"), (9, "\n".join(f"w{i}" for i in range(3000)))]
    for d in range(20, 60):
        lines = [f"own {d} {i}" for i in range(rng.randint(0, 6))]
        for _ in range(rng.randint(1, 3)):
            lines += rng.choice(pool) + [f"own {d} {rng.random()}"]
        rows.append((d, "\n".join(lines)))
    rows += [rows[-1], (200, rows[-2][1]), (201, rows[9][1] + "\nmore"), (59, "another text\nfor the same id\nok")]
    frame = spark.createDataFrame([(d, t, "en", "clash") for d, t in rows], "doc_id bigint, text string, _text string, _row string")
    got = line_dedup.line_dedup(frame).select(F.col("_row.doc_id"), "_text", "_removed_chunks", "_removed_lines").collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(slow_line_dedup(rows), key=str)
    assert sum(r[2] for r in got) > 40
    same = line_dedup.deduplicated(frame)
    assert same.columns == frame.columns and same.count() == len(rows)


def test_chunks_resist_shifts():
    rng = random.Random(3)
    lines = [f"{rng.random()}" for _ in range(400)]
    a, b = chunks_of("\n".join(lines)), chunks_of("\n".join(["new", *lines[:200], "x", "y", *lines[200:]]))
    assert len(set(a) - set(b)) <= 4 and min(c.count("\n") for c in a[1:]) >= 1


def test_line_dedup_of_nothing(spark):
    assert line_dedup.deduplicated(docs(spark, [])).collect() == []


# ---- quality rules


def slow_counts(t):
    words = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    found = {}
    for i in range(len(words) - 7):
        found.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for v in found.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 100, "é#ü *$% a<b>\n\nline\nline\r\n line\x0b" * 3, "w\xa0x y\x1cz", " ".join(map(str, range(30_000))), "q w e r t y u i o p\n" * 500, "😀 😀"]


def test_counts(spark):
    frame = spark.createDataFrame([(i, t, "en", 5) for i, t in enumerate(TEXTS)] + [(None, "a b", None, 6), (3, "one", "en", 5)], "doc_id bigint, text string, lang string, n_words int")
    got = {r.doc_id: r for r in quality.counts(frame).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_counts(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert got[None].stratum == "other"


def binomial_tail(n, p, k):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_critical_count_is_the_exact_binomial_bound(spark):
    ns = [0, 1, 50, 299, 300, 473, 474, 1000, 2500]
    got = {r.n: r.k for r in spark.createDataFrame([(n,) for n in ns], "n bigint").select("n", quality.critical_count(F.col("n"), 0.01, F.lit(0.05)).alias("k")).collect()}
    for n in ns:
        want = -1
        while want + 1 <= n * 0.01 and binomial_tail(n, 0.01, want + 1) <= 0.05:
            want += 1
        assert got[n] == want, n
    huge = spark.range(1).select(quality.critical_count(F.lit(1_000_000), 0.01, F.lit(0.001)).alias("k")).first().k
    assert 10_000 - 330 < huge < 10_000 - 290  # 3.09 deviations of 99.5


def test_cutoffs_hold_the_bound_and_drop_junk(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for d in range(3000):
        bad = d % 10 == 0
        rows.append((d, " ".join(word() + "$$$" * bad for _ in range(30)), "en" if d < 2900 else "de"))
        if d % 2 == 0:
            labels.append((d, 0 if bad else 1, 0))
    labels += [(None, 1, 0), (1, None, 0), (10, 0, 0)]
    told = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(told) == 3000
    for r in told:
        bad, en = r.doc_id % 10 == 0, r.doc_id < 2900
        assert r.kept == (not (bad and en)), r  # too few labels in the other language to prove a rule


def test_the_tail_of_very_many_labels_needs_few_terms(spark):
    for n, low, high in ((1_000_000_000, 10_000_000 - 3.0912 * 3147.0, 10_000_000 - 3.0892 * 3145.0), (100_000, 1000 - 3.2 * 31.5, 1000 - 3.0 * 31.5)):
        k = spark.range(1).select(quality.critical_count(F.lit(n), 0.01, F.lit(0.001)).alias("k")).first().k
        assert low - 1 <= k <= high + 1, (n, k)
    n, p = 30_000, 0.01
    got = spark.range(1).select(quality.critical_count(F.lit(n), p, F.lit(0.002)).alias("k")).first().k
    log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
    tail = [sum(math.exp(log(j)) for j in range(k + 1)) for k in (got, got + 1)]
    assert tail[0] <= 0.002 < tail[1]


def slow_cutoffs(units):
    """(good, steps of each rule) of one stratum to the cutoff of each rule, by trying them all."""
    out, error = {}, quality.DELTA / (len(quality.RULES) * 5)
    good, bad = [s for g, s in units if g], [s for g, s in units if not g]
    for r in quality.RULES:
        most = max((k for k in range(int(len(good) * 0.01) + 1) if binomial_tail(len(good), 0.01, k) <= error), default=-1)
        tried = [(c, sum(s[r] >= c for s in good), sum(s[r] >= c for s in bad)) for c in range(1, quality.GRID + 1)]
        gain = [(b / max(1, len(bad)) - quality.FALSE_COST * g / max(1, len(good)), c) for c, g, b in tried if g <= most]
        gain = [x for x in gain if x[0] > 0]
        if gain:
            out[r] = max(gain)[1]
    return out


def test_cutoffs_against_brute_force(spark):
    rng = random.Random(17)
    rows, labels, units = [], [], []
    for d in range(2600):
        bad = rng.random() < 0.2
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        for k in range(40):
            if rng.random() < (0.3 if bad else 0.004):
                words[k] = rng.choice(["!!!!", "$$$", "same", words[0]])
        rows.append((d, " ".join(words), "fr"))
        labels.append((d, int(not bad), 0))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    counted = materialise(quality.counts(frame), "counted")
    for r in counted.filter("NOT base_failed").select("doc_id", *[quality.steps(x).alias(x) for x in quality.RULES]).collect():
        units.append((labels[r.doc_id][1] == 1, r.asDict()))
    want = slow_cutoffs(units)
    held = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert {r.rule: r.cutoff for r in quality.cutoffs(counted, held).collect()} == want and want


def test_repeated_rows_and_equal_texts_are_no_further_evidence(spark):
    text = lambda d: " ".join(f"w{d}x{k}" for k in range(30)) + (" !!!!" * 9 if d % 6 == 0 else "")
    rows = [(d, text(d), "en") for d in range(60)] * 100 + [(1000 + d, text(7), "en") for d in range(2000)]
    labels = [(d, int(d % 6 != 0), 0) for d in range(60)] + [(1000 + d, 1, 0) for d in range(2000)]
    counted = materialise(quality.counts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")), "counted")
    held = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert quality.holdout(counted, held).groupBy("good").count().orderBy("good").collect() == [(False, 10), (True, 50)]
    assert quality.cutoffs(counted, held).collect() == []


def test_without_labels_only_the_base_rule_holds(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    told = quality.judge(spark.createDataFrame([(1, "a $$$", "en"), (2, " ".join(map(str, range(40))), "en")], "doc_id bigint, text string, lang string"), none).collect()
    assert sorted((r.doc_id, r.kept) for r in told) == [(1, False), (2, True)]
    assert quality.judge(spark.createDataFrame([], "doc_id bigint, text string, lang string"), none).collect() == []
