import hashlib
import random
import zlib

import pytest

from marlstone.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def slow_trie(rows):
    """Every rebuilt conversation as a tuple of turns, and every prefix as a key."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns, key=lambda t: (t[0], t[1], t[2][:256]))] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = (*own.get(c - c % 100, [])[:h], *turns[h:])
    members, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    children, leaves, saved = {}, {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = leaves.get(key, 0) + (key not in children)
        saved[key] = saved.get(key, 0) + (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
        if key:
            up = key[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[key]
            saved[up] = saved.get(up, 0) + saved[key]
    for key, of in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(key, [])))).encode()).hexdigest()
        yield min(of), len(key), min(members[key[:-1]]) if key else None, len(of), children.get(key, 0), leaves[key], saved[key], digest


def check(spark, rows):
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow_trie(rows), key=str)


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(600), n), 0, 100, 5_000_000_017]:
        rows += [(c, t, rng.choice("ua"), rng.choice(["", "hi", "hé", "a b c"])) for t in range(rng.randint(1, 8))]
    return rows


def test_random_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 1)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 3)
    check(spark, random_rows(1, 300))


def test_odd_rows(spark):
    rows = [(0, 0, "u", "a"), (0, None, None, "b"), (0, 2, "u", None), (1, None, None, None), (1, 1, "u", ""), (2, 3, "u", "same"), (2, 3, "u", "same"), (2, 3, "a", "same"), (None, 1, "u", "nobody"), (7, 7, "u", "x" * 5000), (7, 7, "u", "x" * 4999 + "y")]
    rows += [(c, t, "u", "copy") for c in range(200, 240) for t in range(3)]
    check(spark, [*rows, *((c, t, "u", "absent base") for c in range(305, 330) for t in range(4))])
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extra_columns_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 5)
    rows = [(300, t, "u", f"t{t % 7}") for t in range(700)] + [(301, t, "u", f"t{t % 7}") for t in range(400)]
    more = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", part int, hash string")
    got = prefix_trie.prefix_trie(more).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow_trie(rows), key=str)


def test_colliding_fingerprints_are_found_and_mended(spark, monkeypatch):
    """With a first base under which all sums are the same, groups are not sound, and the next base is taken."""
    rows = random_rows(3, 60)
    turns = prefix_trie.turn_references(prefix_trie.numbered(spark.createDataFrame(rows, SCHEMA)))
    blind = prefix_trie.group_prefixes(prefix_trie.rebuilt_prefixes(prefix_trie.with_prefixes(turns.withColumn("hash", prefix_trie.F.lit(0).cast("bigint")), (2, 3)), (2, 3)))
    assert not prefix_trie.unsound(blind).isEmpty()
    real = prefix_trie.unsound
    calls = []
    monkeypatch.setattr(prefix_trie, "unsound", lambda g: calls.append(1) or (real(blind) if len(calls) == 1 else real(g)))
    check(spark, rows)
    assert len(calls) == 2


@pytest.mark.parametrize("base, prime", [(7, 2147483647), (1103515245, 2147483629)])
def test_power(spark, base, prime):
    exponents = [0, 1, 5, 63, 1000, 2**33 + 5]
    got = spark.createDataFrame([(e,) for e in exponents], "e bigint").select("e", prefix_trie.power(prefix_trie.F.col("e"), base, prime).alias("p")).collect()
    assert {r.e: r.p for r in got} == {e: pow(base, e, prime) for e in exponents}
