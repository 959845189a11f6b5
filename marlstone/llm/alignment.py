"""Alignment of the tokens of two tokenizers over the same bytes, and how often ids are linked in all documents.

A byte-level BPE (A) reads a space and the text, a sentence-piece BPE (B) the text, to which it adds the space.  Ends of A's
tokens go into a dictionary from end to index; B's ends found in it are the common ends, which slice both lists into
groups.  Within a group each stretch between neighbouring ends lies in one token of either side: these are its links.

No token of either side goes over a space that follows something else than white space, so texts are cut there into units
and the different units of a slice are aligned once, all together; a text is put together from its units' groups and
links.  Spark sums the links of all documents and scores each document by these counts.  The table of counts is broadcast
only up to BROADCAST_PAIRS pairs; beyond, it is joined by sorting.

Cases: a text that is null, empty, or whose joined tokens are not its bytes has no tokens (zeros, and an empty digest) and
no part in the counts.  Repeated rows and copies count each by itself.  A text is never split, so memory grows with the
longest one (some 40 bytes a character).  An empty table gives an empty one; further columns are left behind.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, process_store, ship, text_or_empty
from .lexicon import LexiconEncoder, find_keys, ranges, slots_of, token_bytes
from .tokens import vocabulary_path

ship(__name__)

#: Characters of texts that are aligned at once, unless one text is longer.
SLICE = 6 << 20
#: The table of counts is sent to every executor up to this many pairs, some 100 MB.
BROADCAST_PAIRS = 2_000_000
#: White space in RE2, and all that some library takes for it: a space after it may belong to the same token.
BLANK = r"\s\x0b\x1c-\x1f\x{85}\x{180e}\p{Z}"


class PairAligner:
    """Tokens of both sides for texts, and how they lie to each other."""

    def __init__(self, vocabulary: str, model: str):
        import sentencepiece

        self.a = LexiconEncoder(vocabulary)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.sizes = self.a.size, len(pieces)
        self.bytes_a = pa.array([token_bytes(self.a.whole.id_to_token(i) or "") for i in range(self.a.size)], pa.large_binary())
        of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_b = pa.array(of_b, pa.large_binary())
        self.lengths = [pc.binary_length(x).to_numpy() for x in (self.bytes_a, self.bytes_b)]
        self.space = self.b.piece_to_id("▁")
        #: Whether B's pieces have spaces only before all else, so that a space after something else begins a piece.
        self.cut = not any(" " in p.replace("▁", " ").lstrip(" ") for p in pieces)
        # What stands for a token in the list of groups: its id and what follows, another of its side, B's side, or a group.
        self.codes = pa.array([f"{i}{end}" for n, ends in zip(self.sizes, (",|", ",;"), strict=True) for end in ends for i in range(n)], pa.large_binary())

    @classmethod
    def of_process(cls, vocabulary: str, model: str) -> PairAligner:
        kept = process_store("aligners")
        if (vocabulary, model) not in kept:
            kept[vocabulary, model] = cls(vocabulary, model)
        return kept[vocabulary, model]

    def units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different units of some texts without the space before them, the units in order (indices), how many each text has."""
        whole = pa.array(texts, pa.string())
        marks = itertools.chain("\x1f", map(chr, range(0xE000, 0xF900)))
        mark = next((m for m in marks if not pc.any(pc.match_substring(whole, m)).as_py()), None) if self.cut else None
        if mark is None:
            units = whole.dictionary_encode()
            return units.dictionary.to_pylist(), units.indices.to_numpy(), np.ones(len(texts), np.int64)
        odd = pc.match_substring_regex(whole, f"[{BLANK}] |^ ")
        marked = pc.replace_substring(whole, " ", mark)
        if pc.any(odd).as_py():
            marked = pc.replace_with_mask(marked, odd, pc.replace_substring_regex(whole.filter(odd), f"([^{BLANK}]) ", f"\\1{mark}"))
        lists = pc.split_pattern(marked, mark)
        units = lists.flatten().dictionary_encode()
        return units.dictionary.to_pylist(), units.indices.to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)

    def ids(self, units: list[str]):
        """Ids of both sides for all units, and how many each has."""
        a, many_a = self._ids_a([" " + u for u in units])
        lists = self.b.encode(units, out_type=int, num_threads=1)
        lists = [x or ([] if u else [self.space]) for x, u in zip(lists, units, strict=True)]
        many_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(many_b.sum()))
        return a, many_a, b, many_b

    def _ids_a(self, units: list[str]):
        """A's ids; special tokens are ordinary text here."""
        hard = [] if self.a.plain("\n".join(units)) else [i for i, u in enumerate(units) if not self.a.plain(u)]
        easy = list(units)
        for i in hard:
            easy[i] = ""
        ids, many = self.a.encode_plain(easy)
        if hard:
            parts = np.split(ids, np.cumsum(many)[:-1])
            for i in hard:
                parts[i] = np.array(self.plain_library.encode(units[i], add_special_tokens=False).ids, np.int64)
            ids, many = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, many

    @property
    def plain_library(self):
        if not hasattr(self, "_library"):
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.a.whole.to_str())
            self._library.encode_special_tokens = True
        return self._library

    def sound(self, units: list[str], ids: np.ndarray, many: np.ndarray, tokens: pa.Array, lengths: np.ndarray) -> np.ndarray:
        """Of which units the joined tokens are a space and the unit."""
        want = [b" " + u.encode() for u in units]
        size = np.fromiter(map(len, want), np.int64, len(want))
        owner = np.repeat(np.arange(len(units)), many)
        got = np.bincount(owner, weights=lengths[ids], minlength=len(units)).astype(np.int64)
        there = np.frombuffer(tokens.take(pa.array(ids)).buffers()[2] or b"", np.uint8)
        here = np.frombuffer(b"".join(want), np.uint8)
        same = size == got
        if same.all() and np.array_equal(here, there[: len(here)]):
            return same
        few = np.flatnonzero(same)
        differ = here[ranges((np.cumsum(size) - size)[few], size[few])] != there[ranges((np.cumsum(got) - got)[few], got[few])]
        same[few[np.bincount(np.repeat(np.arange(len(few)), size[few]), weights=differ, minlength=len(few)) > 0]] = False
        return same

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """For each text: n_a, n_b, n_groups, n_links, digest of its groups, and its links as pairs of ids with how often each is there."""
        texts = [t or "" for t in texts]
        units, unit, in_text = self.units(texts)
        a, many_a, b, many_b = self.ids(units)
        good = self.sound(units, a, many_a, self.bytes_a, self.lengths[0]) & self.sound(units, b, many_b, self.bytes_b, self.lengths[1])
        text = np.repeat(np.arange(len(texts)), in_text)
        fine = np.bincount(text, weights=~good[unit], minlength=len(texts)) == 0
        fine &= np.fromiter(map(bool, texts), bool, len(texts))
        # Units that are not sound go, with all texts that have one.
        a, b = a[np.repeat(good, many_a)], b[np.repeat(good, many_b)]
        many_a, many_b = many_a * good, many_b * good
        unit, text = unit[fine[text]], text[fine[text]]

        # Ends over all units one after the other; the dictionary from end to index, and B's ends that are in it.
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        index = find_keys(ends_a, slots_of(ends_a), ends_b)
        common_b = np.flatnonzero(index >= 0)
        common_a = index[common_b].astype(np.int64)
        in_a, in_b = np.diff(common_a, prepend=-1), np.diff(common_b, prepend=-1)

        # Groups as codes: A's ids, then B's, each with what follows it.
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[common_a], last_b[common_b] = True, True
        size_a, size_b = self.sizes
        code_a, code_b = a + size_a * last_a, b + 2 * size_a + size_b * last_b
        first = np.cumsum(in_a + in_b) - in_a - in_b
        codes = np.empty(len(a) + len(b), np.int32)
        codes[ranges(first, in_a)] = code_a
        codes[ranges(first + in_a, in_b)] = code_b

        # Links: of each stretch between neighbouring ends, the tokens that it lies in.
        stretch = np.union1d(ends_a, ends_b)
        link = a[np.searchsorted(ends_a, stretch)] * size_b + b[np.searchsorted(ends_b, stretch)]

        def by_unit(ends, own):
            """How many of `own` lie in each unit, whose last byte A's last token has."""
            last = np.append(0, ends_a)[np.cumsum(many_a)]
            return np.diff(np.append(0, np.searchsorted(own, last, "right")))

        groups, links = by_unit(ends_a, ends_a[common_a]), by_unit(ends_a, stretch)

        def total(of_unit):
            return np.bincount(text, weights=of_unit[unit], minlength=len(texts)).astype(np.int64)

        out = {"n_a": total(many_a), "n_b": total(many_b), "n_groups": total(groups), "n_links": total(links)}
        tokens = many_a + many_b
        ids = codes[ranges((np.cumsum(tokens) - tokens)[unit], tokens[unit])]
        at = np.append(0, np.cumsum(out["n_a"] + out["n_b"]))
        written = self.codes.take(pa.array(ids))
        place = np.frombuffer(written.buffers()[1], np.int64, len(written) + 1)[at].tolist()
        raw = memoryview(written.buffers()[2] or b"")
        out["groups_sha256"] = [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in itertools.pairwise(place)]

        # Each text's links, every pair once.
        pairs, number = np.unique(link, return_inverse=True)
        many = links[unit]
        key = np.repeat(text, many) * max(1, len(pairs)) + number[ranges((np.cumsum(links) - links)[unit], many)]
        key, times = np.unique(key, return_counts=True)
        owner = key // max(1, len(pairs))
        out["links"] = pairs[key - owner * max(1, len(pairs))] if len(pairs) else key
        out["times"] = times
        out["in_text"] = np.bincount(owner, minlength=len(texts))
        out["groups"] = ids, at
        return out

    def slices(self, texts: list[str]):
        """Slices of a list (from, to): up to SLICE characters, or one text."""
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t or "") > SLICE:
                yield start, i
                start, size = i, 0
            size += len(t or "")
        if start < len(texts):
            yield start, len(texts)

    def groups_of(self, text: str) -> list[tuple[list[int], list[int]]]:
        """The groups of one text, as ids of both sides."""
        codes = self.align([text])["groups"][0].tolist()
        written = b"".join(self.codes.take(pa.array(codes, pa.int32())).to_pylist()).decode()
        return [tuple([int(i) for i in side.split(",")] for side in g.split("|")) for g in written[:-1].split(";")] if written else []


SUMS = ["n_a", "n_b", "n_groups", "n_links"]


def align_documents(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and links: pairs of ids (a * size of B + b) with how often each
    is linked in the text.  `with_groups` adds groups: for each the ids of both sides."""
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<struct<pair:bigint,times:bigint>>" + ", groups array<struct<a:array<int>,b:array<int>>>" * with_groups
    names = ["doc_id", *SUMS, "groups_sha256", "links", *["groups"] * with_groups]

    def of_batch(batches):
        aligner = PairAligner.of_process(vocabulary, model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in aligner.slices(texts):
                got = aligner.align(texts[start:end])
                links = pa.StructArray.from_arrays([pa.array(got["links"], pa.int64()), pa.array(got["times"], pa.int64())], ["pair", "times"])
                columns = [batch.column(0).slice(start, end - start), *(pa.array(got[n], pa.int64()) for n in SUMS), pa.array(got["groups_sha256"], pa.string())]
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(got["in_text"])), pa.int32()), links))
                if with_groups:
                    columns.append(pa.array([[{"a": a, "b": b} for a, b in aligner.groups_of(t or "")] for t in texts[start:end]], pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("bigint").alias("d"), text_or_empty(text_col).alias("t")).mapInArrow(of_batch, schema)


def count_links(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, n (how many links of all documents hold it), best (1 where no pair with the same id of B has more, else 0)."""
    counts = aligned.select(F.inline("links")).groupBy("pair").agg(F.sum("times").alias("n"))
    counts = materialise(counts.withColumn("b", F.col("pair") % size_b), "link-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B at most
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """`aligned` (whose `row` tells its rows apart) with n_best and count_sum instead of its links."""
    small = counts.count() <= broadcast_pairs
    links = aligned.select("row", F.inline("links")).join(F.broadcast(counts) if small else counts.hint("merge"), "pair")
    sums = links.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    scored = aligned.drop("links").join(sums, "row", "left")
    return scored.drop("row").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte-level BPE against sentence pieces."""
    import sentencepiece

    docs, model = spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("piece_bpe_32k.model")
    aligned = align_documents(docs, vocabulary_path("byte_bpe_50k.json"), model).withColumn("row", F.monotonically_increasing_id())
    aligned = materialise(aligned, "aligned", "zstd")
    size_b = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    scored = score_links(aligned, count_links(aligned, size_b))
    return scored.select("doc_id", *SUMS, "n_best", "count_sum", "groups_sha256")
