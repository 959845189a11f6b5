"""Sampled segmentations against all segmentations of short texts."""

import math
import zlib

import numpy as np
import pytest
import sentencepiece

from marlstone.llm import pieces
from marlstone.llm.tokens import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")
TEXTS = ["Hello world", "a", "x\ny  z", "日本🎉 zz", "  lead", "tail  ", "anna banana", "\n\n", " ", "é́ñ", "a\tb", "ſtraße №5"]


@pytest.fixture(scope="module")
def model():
    return pieces.Model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def all_paths(library, text):
    """Every segmentation with its probability, by listing them."""
    s = pieces.META + text.replace(" ", pieces.META)
    known = {library.id_to_piece(i): i for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    log = lambda i: -math.log(2 + min(-library.get_score(i), library.get_piece_size()))

    def walk(at):
        if at == len(s):
            yield (), 0.0
            return
        if s[at] not in known:
            ids = tuple(library.piece_to_id(f"<0x{b:02X}>") for b in s[at].encode())
            for rest, p in walk(at + 1):
                yield ids + rest, p
        for end in range(at + 1, min(len(s), at + 16) + 1):
            i = known.get(s[at:end])
            if i is not None:
                for rest, p in walk(end):
                    yield (i, *rest), log(i) + p

    found = list(walk(0))
    total = math.log(sum(math.exp(p) for _, p in found))
    return {ids: p - total for ids, p in found}


@pytest.mark.parametrize("text", TEXTS)
def test_samples_are_distinct_paths_with_their_probabilities(model, library, text):
    paths = all_paths(library, text)
    for seed in range(5):
        got = pieces.sample_batch(model, pieces.row_keys([1], seed), [text], 6)[0]
        assert len(got) == min(6, len(paths)) and len({tuple(x[0].tolist()) for x in got}) == len(got)
        noisy = [x[2] for x in got]
        assert noisy == sorted(noisy, reverse=True)
        for ids, logp, _, _ in got:
            assert paths[tuple(ids.tolist())] == pytest.approx(logp, abs=1e-6)
            assert pieces.decode(model, ids.tolist()) == text == library.decode(ids.tolist())


def test_texts_with_few_paths_emit_them_all(model, library):
    for text in ("a", "日本🎉 zz", "\n\n"):
        paths = all_paths(library, text)
        got = pieces.sample_batch(model, pieces.row_keys([3], 0), [text], len(paths) + 3)[0]
        assert {tuple(x[0].tolist()) for x in got} == set(paths)


def test_samples_follow_gumbel_top_k(model, library):
    """The first and the first two samples come as often as sampling without replacement says."""
    text, n = "x anna", 4000
    paths = all_paths(library, text)
    got = pieces.sample_batch(model, pieces.row_keys(list(range(n)), 9), [text] * n, 2)
    first, pairs = {}, {}
    for g in got:
        a, b = tuple(g[0][0].tolist()), tuple(g[1][0].tolist())
        first[a] = first.get(a, 0) + 1
        pairs[a, b] = pairs.get((a, b), 0) + 1
    for a, p in paths.items():
        p = math.exp(p)
        assert abs(first.get(a, 0) - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 3
        for b, q in paths.items():
            if a != b:
                both = p * math.exp(q) / (1 - p)
                assert abs(pairs.get((a, b), 0) - n * both) < 5 * math.sqrt(n * both) + 3


def test_inclusion_scores_weigh_the_samples(model, library):
    """Each sample over its inclusion score estimates the sum of all probabilities, 1, without bias."""
    n = 3000
    got = pieces.sample_batch(model, pieces.row_keys(list(range(n)), 4), ["Hello anna"] * n, 3)
    total = [sum(math.exp(lp) / -math.expm1(-math.exp(lp - rest)) for _, lp, _, rest in g) for g in got]
    assert np.mean(total) == pytest.approx(1.0, abs=5 * np.std(total) / math.sqrt(n))


def test_a_row_does_not_depend_on_its_batch(model):
    texts = [*TEXTS, "ab" * 60, "one two three four " * 30]
    together = pieces.sample_batch(model, pieces.row_keys(list(range(len(texts))), 0), texts, 3)
    for d, text in enumerate(texts):
        alone = pieces.sample_batch(model, pieces.row_keys([d], 0), [text], 3)[0]
        assert [(x[0].tolist(), round(x[1], 6)) for x in alone] == [(x[0].tolist(), round(x[1], 6)) for x in together[d]]


def test_long_units_and_texts(model, library):
    for text in ("ab" * 3000, "🎉" * 2000, "word " * 20_000, " " * 3000):
        got = pieces.sample_batch(model, pieces.row_keys([1], 0), [text], 2)[0]
        assert len({x[0].tobytes() for x in got}) == len(got) == (1 if text[0] == "🎉" else 2) and all(pieces.decode(model, x[0].tolist()) == text for x in got)


def test_segmentations_however_rare_are_emitted(model, library):
    """Thousands of samples of one text: all segmentations, down to chances that single precision and differences to 1 lose."""
    text = "the of"
    paths = all_paths(library, text)
    assert min(paths.values()) < math.log(1e-9) and len(paths) < 200
    got = pieces.sample_batch(model, pieces.row_keys([5], 1), [text], len(paths) + 5)[0]
    assert {tuple(x[0].tolist()) for x in got} == set(paths) and len(got) == len(paths)


def test_what_is_left_is_the_sum_of_the_other_paths(model, library):
    unit = pieces.META + "anna"
    lattices = pieces.Lattices(model, [unit, "\n"])
    paths = sorted(all_paths(library, "anna").items(), key=lambda x: -x[1])
    own = [lattices.lengths(np.array(ids)) for ids, _ in paths]
    for k in range(len(paths) + 1):
        assert lattices.rest(0, own[:k]) == pytest.approx(sum(math.exp(p) for _, p in paths[k:]), rel=1e-9, abs=0 if k == len(paths) else 1e-300)
    assert lattices.single.tolist() == [False, True]


def test_one_key_gives_the_draws_of_many():
    keys = np.array([1, 2**63 + 5, 77], np.uint64)
    assert pieces.uniform(keys, 3, 1 << 21).tolist() == [pieces.uniform_of(int(k), 3, 1 << 21) for k in keys]


def test_documents_encode_and_decode_as_the_library_does(spark, library):
    rows = [(1, None), (2, ""), (3, "a text of\nsome words"), (None, "no id"), (4, "日本🎉  zz " * 2000)]
    frame = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id bigint, text string, ids string")
    encoded = pieces.encode_documents(frame, PATH)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == sorted(((d, library.encode(t or "")) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.text) for r in pieces.decode_documents(encoded, PATH).collect()), key=str) == sorted(((d, library.decode(library.encode(t or ""))) for d, t in rows), key=str)
    assert pieces.encode_documents(frame.filter("false"), PATH).collect() == []


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "a text of\nsome words"), (None, "no id"), (3, "a text of\nsome words")]
    frame = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id bigint, text string, sample string")
    got = pieces.sample_segmentations(frame, PATH).collect()
    assert sorted((str(r.doc_id), r.sample) for r in got) == sorted([("1", 0), ("2", 0), *[("3", s) for s in (0, 0, 1, 1)], ("None", 0), ("None", 1)])
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and 0 < r.inclusion <= 1 and r.n_pieces == len(r.ids)
        assert r.decoded_crc32 in {zlib.crc32((t or "").encode()) for d, t in rows if d == r.doc_id}
    assert pieces.sample_segmentations(frame.filter("false"), PATH).collect() == []
