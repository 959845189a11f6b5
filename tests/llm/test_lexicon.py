import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from marlstone.llm import lexicon
from marlstone.llm.tokens import vocabulary_path

VOCABULARY = vocabulary_path("byte_bpe_50k.json")
ALPHABET = ["a", "b", "'s", "'", "  ", " ", "\n", "\t", "é", "日本", "١", "²", "😀", "<|endoftext|>", "\x1c", "\xa0", "　", "x1", "...", "the", " and", "\r\n", "ΣΣ", "​", "aaa", "ing", "\x00", "ﬁ", "́", "ẞ", "🫨"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(3000)] + ["", " ", "a" * 3000, "ab" * 800 + " x", "<|endoftext|>" * 3, "word " * 3000]


def compiled(words, library):
    entries = [(w.encode(), tuple(library.encode(w, add_special_tokens=False).ids)) for w in sorted(words, key=str.encode)]
    return entries, lexicon.compile_lexicon(entries)


def all_ids(encoder, texts):
    return [part.tolist() for _, ids, many in encoder.encode(texts) for part in np.split(ids, np.cumsum(many)[:-1])]


def test_ids_are_those_of_the_library(library, texts):
    bare = lexicon.LexiconEncoder(VOCABULARY)
    words = {w for t in texts[:1500] if bare.plain(t) for w in bare.find(t) if len(w.encode()) <= lexicon.WORD_BYTES}
    _, flat = compiled(words, library)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for encoder in (bare, lexicon.LexiconEncoder(VOCABULARY, flat)):
        assert all_ids(encoder, texts) == want


def test_long_texts_are_cut_where_words_end(library, monkeypatch):
    monkeypatch.setattr(lexicon, "SLICE", 50)
    rng = random.Random(8)
    texts = ["".join(rng.choices([a for a in ALPHABET if a not in ("\x1c", "🫨")], k=400)) for _ in range(40)]
    assert all_ids(lexicon.LexiconEncoder(VOCABULARY), texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_lexicon_has_its_words_and_no_others(library):
    rng = random.Random(9)
    words = {"".join(rng.choices("abing", k=rng.randint(1, 7))) for _ in range(900)}
    entries, flat = compiled(words, library)
    book = lexicon.Lexicon(flat)
    asked = [*sorted(words), *("".join(rng.choices("abingx", k=rng.randint(1, 9))) for _ in range(900)), "", "a" * 100]
    data = np.frombuffer("".join(asked).encode(), np.uint8)
    lengths = np.array([len(a) for a in asked])
    there, ids, counts = book.look_up(data, np.cumsum(lengths) - lengths, lengths)
    assert there.tolist() == [a in words for a in asked]
    known = {w.decode(): list(i) for w, i in entries}
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [known.get(a, []) for a in asked]


def test_lexicon_is_minimal(library):
    """No two states accept the same rests with the same ids."""
    entries, flat = compiled({a + b for a in ("sing", "br", "k", "wr") for b in ("ing", "ings", "inger", "ingers")}, library)
    root, states, arcs = (int(x) for x in flat[:3])
    book = lexicon.Lexicon(flat)
    below = {}

    def rests(state):
        if state not in below:
            out = {(b"", tuple(book.pool[book.end[state] :][: book.end_n[state]].tolist()))} if book.end[state] >= 0 else set()
            for i in np.flatnonzero(book.key // 256 == state):
                first = tuple(book.pool[book.out[i] :][: book.out_n[i]].tolist())
                out |= {(bytes([book.key[i] % 256]) + w, first + ids) for w, ids in rests(int(book.to[i]))}
            below[state] = frozenset(out)
        return below[state]

    assert rests(root) == {(w, ids) for w, ids in entries}
    assert len(below) == states == len(set(below.values()))
    assert arcs < sum(len(w) for w, _ in entries) // 2
    assert lexicon.Lexicon(lexicon.compile_lexicon([])).look_up(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))[0].tolist() == [False]


def test_encode_and_decode_tables(spark, library, texts):
    rows = [(i, t, "clash", 1.5) for i, t in enumerate(texts[-300:])] + [(None, None, None, None), (3, "twice", "x", 0.0), (3, "twice", "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string, x double").withColumnRenamed("x", "a.b")
    book = lexicon.build_lexicon(docs, VOCABULARY, words=50)
    got = lexicon.decode(lexicon.encode(docs, VOCABULARY, book), VOCABULARY).collect()
    at_once = lexicon.encode(docs, VOCABULARY, book, back=True).drop("text").collect()
    assert sorted(str((r.doc_id, r.ids, r.decoded)) for r in at_once) == sorted(str((r.doc_id, r.ids, r.decoded)) for r in got)
    want = sorted((str(d), library.encode(t or "", add_special_tokens=False).ids, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False), str(x)) for d, t, _, x in rows)
    assert sorted((str(r.doc_id), r.ids, r.decoded, str(r["a.b"])) for r in got) == want
    empty = docs.limit(0)
    assert lexicon.encode(empty, VOCABULARY, lexicon.build_lexicon(empty, VOCABULARY)).count() == 0


def test_ids_that_are_no_text(spark, library):
    odd = [[0, 50256, 5], [127, 128, 200], [], None, [255, 94, 121, 50256]]
    got = lexicon.decode(spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "n int, ids array<int>"), VOCABULARY).orderBy("n").collect()
    assert [r.decoded for r in got] == [library.decode(x or [], skip_special_tokens=False) for x in odd]
