import io
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from marlstone.llm import packing, token_files
from marlstone.llm.common import new_folder
from marlstone.llm.tokens import WordTokenizer, vocabulary_path

TEXTS = ["", None, "Hello, World! it's 1234", "a\tb\x1cc d", "H̱ello ΣΣς İI K", "<|endoftext|> hi<|startoftext|>x", "x" * 9000, "É É ünder " * 3000, "  ", "日本語 テキスト", "word. word, (word) word?!"]
SCHEMA = "doc_id bigint, text string, start string, piece double"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 1.0) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(vocabulary_path())


def ids_of(model, text):
    return model.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts(model):
    own = WordTokenizer(vocabulary_path(), generation=3)
    for _ in range(2):  # from the cache as well
        for text, packed in zip(TEXTS, own.encode([t or "" for t in TEXTS]), strict=True):
            assert np.frombuffer(packed, own.dtype).tolist() == ids_of(model, text), text


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, model):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (50, "twice"), (50, "twice"), (50, "other")]
    folder = new_folder(spark, "files")
    manifest = spark.createDataFrame(token_files.write_token_files(docs(spark, rows), folder, vocabulary_path()).collect(), "file string, part bigint, docs bigint, ids bigint, bytes bigint")
    got = sorted(map(tuple, token_files.read_token_files(manifest, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    want = sorted((str(d), len(ids_of(model, t)) + 1, crc([*ids_of(model, t), 2])) for d, t in rows)
    assert sorted((str(d), n, c) for d, _, n, c in got) == want
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    system, base = token_files.file_system(token_files._plain_uri(folder))
    for r in manifest.collect():
        with system.open_input_file(f"{base}/{r.file}") as stream:
            reader = token_files.FrameReader(stream)
            for d in {int(x) for x in reader.doc_id} - {0, 50}:
                text = dict(rows)[d]
                assert reader.read(d).tolist() == [*ids_of(model, text), 2]


def test_token_files_of_nothing(spark):
    folder = new_folder(spark, "files")
    manifest = token_files.write_token_files(docs(spark, []), folder, vocabulary_path())
    assert token_files.read_token_files(manifest, folder).collect() == []


def test_only_the_wanted_frame_is_read_and_damage_is_seen():
    out = io.BytesIO()
    writer = token_files.FrameWriter(out, "<u2", frame_bytes=64)
    texts = {i: np.arange(i, i + 40, dtype="<u2") for i in range(10)}
    for d, ids in texts.items():
        writer.add(d, ids.tobytes())
    writer.close()
    raw = bytearray(out.getvalue())
    reader = token_files.FrameReader(io.BytesIO(raw))
    assert len(reader.table) == 11 and all(reader.read(d).tolist() == ids.tolist() for d, ids in texts.items())
    raw[reader.at[3] + 6] ^= 255
    hurt = token_files.FrameReader(io.BytesIO(raw))
    assert hurt.read(9).tolist() == texts[9].tolist()
    with pytest.raises(Exception):  # noqa: B017
        hurt.read(3)
    import zstandard  # independent frames: any reader of the format gets the plain bytes

    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read(80)
    assert plain == texts[0].tobytes()


def check_packing(model, rows, got, capacity=4096):
    pieces = {}
    for d, t in rows:
        ids = [*ids_of(model, t), 1]
        for p in range(0, len(ids), capacity):
            own = ids[p : p + capacity]
            key = (d, p // capacity, p, len(own), crc(own))
            pieces[key] = pieces.get(key, 0) + 1
    seen, bins = {}, {}
    for r in got:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        seen[key] = seen.get(key, 0) + 1
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == pieces
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, model):
    rng = np.random.default_rng(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (5, "same"), (5, "same")] + [(100 + i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 5000, 120))]
    got = packing.pack_documents(docs(spark, rows), vocabulary_path()).collect()
    bins = check_packing(model, rows, got)
    assert bins <= -(-sum(r.length for r in got) // 4096) + 2
    whole = packing.sequences(packing.pack_documents(docs(spark, rows), vocabulary_path(), with_ids=True)).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in got) and max(len(r.ids) for r in whole) <= 4096


def test_groups_leave_no_room_behind(spark):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 60, 3000).tolist()
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "uid bigint, length bigint")
    got = packing.pack_lengths(frame, capacity=100, group=200).collect()
    assert sorted(r.uid for r in got) == list(range(3000))
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + sizes[r.uid]
    assert max(fill.values()) <= 100 and len(fill) <= sum(sizes) / 100 * 1.01 + 1


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 50, 200).tolist()
    a = packing.best_fit(range(200), sizes, 100)
    b = packing.best_fit(rng.permutation(200), sizes, 100)
    for _ in range(20):
        c = packing.crossover(a, b, sizes, 100, rng)
        assert sorted(i for x in c for i in x) == list(range(200)) and max(sum(sizes[i] for i in x) for x in c) <= 100


def test_an_epoch_improves_on_best_fit():
    """Pieces too large to fill sequences by best-fit: islands must find packings with fewer."""
    saved = 0
    for seed in range(3):
        sizes = sorted(np.random.default_rng(seed).integers(1100, 2000, 800).tolist())
        first = packing.best_fit(np.argsort(-np.array(sizes), kind="stable"), sizes, 4096)
        best = packing.evolve(sizes, 4096, seed, [])
        assert sorted(i for x in best for i in x) == list(range(800))
        saved += len(first) - len(best)
    assert saved >= 7


def test_packing_of_nothing(spark):
    assert packing.pack_documents(docs(spark, []), vocabulary_path()).collect() == []


def test_token_files_lie_where_spark_means(spark, tmp_path):
    """A path without a scheme is the default file system's; a store that can't be opened is refused."""
    assert token_files.shared_uri(spark, str(tmp_path)) == f"file://{tmp_path}"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://elsewhere")
    conf.set("fs.viewfs.mounttable.elsewhere.link./x", f"file://{tmp_path}")
    try:
        with pytest.raises(ValueError, match="viewfs"):
            token_files.write_token_files(docs(spark, [(1, "a")]), "/x", vocabulary_path())
    finally:
        conf.set("fs.defaultFS", old)
