"""Byte-level BPE by a lexicon: frequent words and their ids in a minimal acyclic transducer, all other words merged exactly.

The words of all documents are counted by Spark; the `words` most frequent ones (a bound of the lexicon alone, which no id
depends on) are compiled on the driver into an automaton that shares prefixes and suffixes, with ids on its arcs as near
to the start as they can be.  Its arrays lie in one file that Spark sends to every executor, where all Python workers map
the same pages.  The words of a slice of texts are looked up together, one byte of all of them at a time; words that the
automaton lacks are merged by rank, again all together.

Cases: null counts as empty; an empty text has no ids; a text that is longer than a slice is cut where a word ends anyhow;
texts with special tokens, or characters whose class has changed between versions of Unicode, and words over LONG_WORD
bytes go through the tokenizers library whole.  Repeated rows stay; an empty table gives an empty one; the other columns
stay as they are, those called like an output (ids, decoded) excepted, which are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, new_folder, process_store, ship, text_or_empty
from .tokens import vocabulary_path

ship(__name__)

#: How many words the lexicon has, and bytes of the longest one.
LEXICON_WORDS, WORD_BYTES = 1 << 16, 64
#: Longer words are merged by the library, whose queue suits them better.
LONG_WORD = 1024
#: Characters that are split into words at once, and distinct words that a task counts before it hands them on.
SLICE, HELD_WORDS = 2 << 20, 1 << 18
#: Ids that are decoded at once, unless one row has more.
DECODED = 1 << 20
#: What stands for a space between units, and before a text's first unit; both are characters that no plain text has.
CUT, FIRST = "\x1f", "\x1e"
#: White space in RE2, and all that libraries take for it.
BLANK = r"\s\x0b\x{85}\p{Z}"
#: Fixed value: the pattern by which byte-level vocabularies split text before their merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.iinfo(np.int64).max


@functools.cache
def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones for themselves, others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(token: str) -> bytes:
    """What a byte-level token stands for; a token with other characters stands for its own."""
    table = byte_characters()
    return bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()


def settled(char: str) -> bool:
    """Whether a character is of one kind in all versions of Unicode since 3.2, and white space for all libraries or none."""
    then, now = unicodedata.ucd_3_2_0.category(char), unicodedata.category(char)
    return then != "Cn" and then[0] == now[0] and not "\x1c" <= char <= "\x1f" and char != "\x85"


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each length, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


# ---- a table of numbers ---------------------------------------------------------------------------------------


def _first_slot(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def slots_of(keys: np.ndarray) -> np.ndarray:
    """Which of some distinct keys lies in each slot of an open table (-1: none); a key moves on until one is free."""
    slots = np.full(8 << max(1, len(keys)).bit_length(), -1, np.int32)
    left, at = np.arange(len(keys)), _first_slot(keys, len(slots))
    while len(left):
        free = slots[at] < 0
        slots[at[free]] = left[free]
        lost = slots[at] != left
        left, at = left[lost], (at[lost] + 1) % len(slots)
    return slots


def find_keys(keys: np.ndarray, slots: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is among `keys`, -1 for those that are not there."""
    at = _first_slot(wanted, len(slots))
    found = slots[at]
    left = np.flatnonzero(found >= 0)
    left = left[keys[found[left]] != wanted[left]]
    while len(left):  # in others' slots
        at[left] = (at[left] + 1) % len(slots)
        found[left] = slots[at[left]]
        left = left[found[left] >= 0]
        left = left[keys[found[left]] != wanted[left]]
    return found


# ---- the automaton --------------------------------------------------------------------------------------------


def compile_lexicon(entries: list[tuple[bytes, tuple[int, ...]]]) -> np.ndarray:
    """The minimal transducer of words in ascending order of bytes, as one array of int32.

    Built word by word: what the next word has no part in is frozen, and a frozen state that equals an earlier one, with
    what it leads to and puts out, is that one.  Ids move towards the start as far as all words of a state agree.
    """
    registered: dict[tuple, int] = {}
    frozen: list[tuple] = []

    def freeze(state) -> int:
        key = (state[0], tuple(sorted((label, to, out) for label, (to, out) in state[1].items())))
        if key not in registered:
            registered[key] = len(frozen)
            frozen.append(key)
        return registered[key]

    # A state: what a word that ends here still puts out (None: none ends here), and its arcs.
    path: list[list] = [[None, {}]]
    last = b""
    for word, ids in [*entries, (b"", None)]:
        common = len(os.path.commonprefix([last, word]))
        for i in range(len(last), common, -1):
            arcs = path[i - 1][1]
            arcs[last[i - 1]] = (freeze(path[i]), arcs[last[i - 1]][1])
        if ids is None:
            break
        del path[common + 1 :]
        path += [[None, {}] for _ in word[common:]]
        for i in range(common, len(word)):
            path[i][1][word[i]] = (-1, ())
        path[len(word)][0] = ()
        left = tuple(ids)
        for i in range(common):
            to, out = path[i][1][word[i]]
            shared = os.path.commonprefix([out, left])
            if rest := out[len(shared) :]:
                below = path[i + 1]
                below[1] = {label: (t, rest + o) for label, (t, o) in below[1].items()}
                if below[0] is not None:
                    below[0] = rest + below[0]
                path[i][1][word[i]] = (to, shared)
            left = left[len(shared) :]
        if common < len(word):
            path[common][1][word[common]] = (-1, left)
        last = word
    root = freeze(path[0])

    pool: list[int] = []
    at: dict[tuple, int] = {}

    def place(out: tuple) -> tuple[int, int]:
        if out not in at:
            at[out] = len(pool)
            pool.extend(out)
        return at[out], len(out)

    arcs = [(state, label, to, *place(out)) for state, (_, own) in enumerate(frozen) for label, to, out in own]
    ends = [(-1, 0) if final is None else place(final) for final, _ in frozen]
    table = np.array(arcs, np.int32).reshape(-1, 5).T
    keys = table[0] * 256 + table[1]
    slots = slots_of(keys)
    parts = [np.array([root, len(frozen), len(arcs), len(pool), len(slots)]), slots, keys, table[2], table[3], table[4], *np.array(ends, np.int32).reshape(-1, 2).T, np.array(pool)]
    return np.concatenate([p.ravel().astype(np.int32) for p in parts])


class Lexicon:
    """Looks words up in the arrays of `compile_lexicon`, all of them at once."""

    def __init__(self, flat: np.ndarray):
        self.root, states, arcs, pool, slots = map(int, flat[:5])
        cuts = np.cumsum([5, slots, arcs, arcs, arcs, arcs, states, states, pool])
        self.slots, self.key, self.to, self.out, self.out_n, self.end, self.end_n, self.pool = (flat[a:b] for a, b in itertools.pairwise(cuts))
        self.words_end = self.end >= 0

    def look_up(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Which words are there, their ids one after the other, and how many each has (0 for those not there)."""
        n = len(starts)
        state = np.full(n, self.root if len(self.key) else -1, np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        alive = np.flatnonzero((lengths > 0) & (lengths <= WORD_BYTES) & (state >= 0))
        state[lengths > WORD_BYTES] = -1
        for k in itertools.count():
            alive = alive[lengths[alive] > k]
            if not len(alive):
                break
            key = state[alive] * 256 + data[starts[alive] + k]
            arc = find_keys(self.key, self.slots, key)
            found = arc >= 0
            state[alive[~found]] = -1
            alive, arc = alive[found], arc[found]
            state[alive] = self.to[arc]
            steps.append((alive, arc))
        there = state >= 0
        there[there] = self.words_end[state[there]]
        where = np.flatnonzero(there)
        steps = [(w[there[w]], a[there[w]]) for w, a in steps]
        word = np.concatenate([*(w for w, _ in steps), where])
        begin = np.concatenate([*(self.out[a] for _, a in steps), self.end[state[where]]])
        many = np.concatenate([*(self.out_n[a] for _, a in steps), self.end_n[state[where]]])
        order = np.argsort(word, kind="stable")  # by word, and within it by step
        order = order[many[order] > 0]
        counts = np.bincount(word[order], weights=many[order], minlength=n).astype(np.int64)
        return there, self.pool[ranges(begin[order].astype(np.int64), many[order].astype(np.int64))], counts


# ---- encoding and decoding of slices --------------------------------------------------------------------------


class LexiconEncoder:
    """Ids of texts, the same as encode(text, add_special_tokens=False).ids without truncation."""

    def __init__(self, vocabulary: str, lexicon: np.ndarray | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            told = json.load(f)
        model, split = told["model"], told["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or told["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or odd:
            raise ValueError("not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.whole = Tokenizer.from_file(vocabulary)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.size = self.whole.get_vocab_size()
        self.find = regex.compile(WORDS).findall
        self.known: set[str] = set()
        self.break_at = regex.compile(r"\p{L}(?!\p{L})|\S(?=\s)")
        chars = {b: c for c, b in byte_characters().items()}
        self.byte_ids = np.array([ids[chars[b]] for b in range(256)])
        made = np.full(self.size, -1)
        merges = np.empty((len(model["merges"]), 3), np.int64)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, both = ids[a], ids[b], ids[a + b]
            if rank <= max(made[left], made[right]):
                raise ValueError("a merge that comes before its parts")
            if made[both] < 0:
                made[both] = rank
            merges[rank] = left * self.size + right, rank, both
        self.pair, self.rank, self.both = (np.ascontiguousarray(c) for c in merges.T)
        self.slots = slots_of(self.pair)
        self.lexicon = None if lexicon is None else Lexicon(lexicon)

    @functools.cached_property
    def of_words(self):
        """The library without its own way to tell words."""
        from tokenizers import Tokenizer, pre_tokenizers

        model = Tokenizer.from_str(self.whole.to_str())
        model.encode_special_tokens = True
        model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return model

    @classmethod
    def of_process(cls, vocabulary: str, file: str | None = None) -> LexiconEncoder:
        """The encoder of this worker process; the lexicon is mapped into memory, not read."""
        kept = process_store("lexicons")
        if (vocabulary, file) not in kept:
            kept.clear()
            kept[vocabulary, file] = cls(vocabulary, file and np.memmap(SparkFiles.get(file), np.int32, "r"))
        return kept[vocabulary, file]

    def plain(self, text: str) -> bool:
        """Whether the words of a text can be told here as the library tells them."""
        if any(s in text for s in self.special):
            return False
        new = set(text) - self.known
        if not all(map(settled, new)):
            return False
        self.known |= new
        return True

    def pieces(self, text: str):
        """A long text in slices that end where a word ends."""
        at = 0
        while len(text) - at > SLICE:
            end = self.break_at.search(text, at + SLICE)
            if end is None:
                break
            yield text[at : end.start() + 1]
            at = end.start() + 1
        yield text[at:]

    def merge(self, data: np.ndarray, lengths: np.ndarray):
        """Ids of words given by their bytes, one after the other, and how many each has.

        A round merges in each word all places of its pair of least rank, from the left.  A merge of rank r only makes
        pairs of higher rank, so that is what merging one place at a time gives.
        """
        n = len(lengths)
        symbol, word = self.byte_ids[data], np.repeat(np.arange(n), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            pair = symbol[:-1] * self.size + symbol[1:]
            at = find_keys(self.pair, self.slots, pair)
            rank = np.where((at >= 0) & (word[:-1] == word[1:]), self.rank[at], NEVER)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(np.append(rank, NEVER), first)
            size = np.diff(np.append(first, len(word)))
            rest = np.repeat(least < NEVER, size)
            done.append((word[~rest], symbol[~rest]))
            take = np.append((rank < NEVER) & (rank == np.repeat(least, size)[:-1]), False)
            # Where places overlap (aaa), every second one from the left.
            place = np.arange(len(take))
            begin = np.maximum.accumulate(np.where(take & ~np.append(False, take[:-1]), place, 0))
            take &= (place - begin) % 2 == 0
            chosen = np.flatnonzero(take)
            symbol[chosen] = self.both[at[chosen]]
            rest[chosen + 1] = False
            symbol, word = symbol[rest], word[rest]
        word, symbol = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
        return symbol[np.argsort(word, kind="stable")], np.bincount(word, minlength=n)

    def distinct(self, words: pa.Array):
        """Ids of distinct words, one after the other, and how many each has."""
        starts = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
        lengths, starts = np.diff(starts), starts[:-1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        if self.lexicon is None:
            there, ids, counts = np.zeros(len(words), bool), np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        else:
            there, ids, counts = self.lexicon.look_up(data, starts, lengths)
        parts, owners = [ids], [np.repeat(np.arange(len(words)), counts)]
        if len(rest := np.flatnonzero(~there & (lengths <= LONG_WORD))):
            merged, many = self.merge(data[ranges(starts[rest], lengths[rest])], lengths[rest])
            parts.append(merged)
            owners.append(np.repeat(rest, many))
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            parts.append(np.array(self.of_words.encode(words[i].as_py(), add_special_tokens=False).ids, np.int64))
            owners.append(np.full(len(parts[-1]), i))
        owner = np.concatenate(owners)
        return np.concatenate(parts)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def words_of(self, texts: list[str]):
        """The distinct words of plain texts, those of each distinct unit (indices, and how many), and the units (indices).

        A space after anything but white space begins a word, so texts are cut there into units, and only the distinct
        ones are searched for words.
        """
        whole = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(whole, f"[{BLANK}] ")
        marked = pc.replace_substring(whole, " ", CUT)
        if pc.any(odd).as_py():
            marked = pc.replace_with_mask(marked, odd, pc.replace_substring_regex(whole.filter(odd), f"([^{BLANK}]) ", f"\\1{CUT}"))
        lists = pc.split_pattern(pc.binary_join_element_wise(FIRST, marked, ""), CUT)
        units = lists.flatten().dictionary_encode()
        single = pc.match_substring_regex(units.dictionary, r"^\p{L}+$")  # a word as it is
        words, many = [], []
        for u in units.dictionary.filter(pc.invert(single)).to_pylist():
            words += (found := self.find(u[1:] if u[:1] == FIRST else " " + u))
            many.append(len(found))
        words = pa.concat_arrays([pc.binary_join_element_wise(" ", units.dictionary.filter(single), ""), pa.array(words, pa.string())]).dictionary_encode()
        single = single.to_numpy(zero_copy_only=False)
        in_unit = np.ones(len(single), np.int64)
        in_unit[~single] = many
        owner = np.append(np.flatnonzero(single), np.repeat(np.flatnonzero(~single), many))
        return words.dictionary, words.indices.to_numpy()[np.argsort(owner, kind="stable")], in_unit, units.indices.to_numpy(), lists.value_lengths().to_numpy()

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        words, word, in_unit, unit, in_text = self.words_of(texts)
        ids, many = self.distinct(words)
        ids = ids[ranges((np.cumsum(many) - many)[word], many[word])]  # now of the distinct units
        ends = np.append(0, np.cumsum(many[word]))[np.append(0, np.cumsum(in_unit))]
        starts, lengths = ends[:-1][unit], np.diff(ends)[unit]
        per_text = np.diff(np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(in_text))])
        return ids[ranges(starts, lengths)], per_text

    def encode(self, texts: list[str]):
        """(how many texts, their ids one after the other, how many each has), again and again until all are done."""
        group: list[str] = []
        size = 0
        for t in texts:
            long = len(t) > SLICE
            if group and (long or size + len(t) > SLICE):
                yield self._encode_group(group)
                group, size = [], 0
            if not long:
                group.append(t)
                size += len(t)
            elif self.plain(t):
                ids = np.concatenate([self.encode_plain([p])[0] for p in self.pieces(t)])
                yield 1, ids, np.array([len(ids)])
            else:
                yield self._encode_group([t])
        if group:
            yield self._encode_group(group)

    def _encode_group(self, texts: list[str]):
        odd = [i for i, t in enumerate(texts) if not self.plain(t)]
        if not odd:
            return len(texts), *self.encode_plain(texts)
        whole = {i: np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.int64) for i in odd}
        ids, many = self.encode_plain(["" if i in whole else t for i, t in enumerate(texts)])
        parts = np.split(ids, np.cumsum(many)[:-1])
        parts = [whole.get(i, p) for i, p in enumerate(parts)]
        return len(texts), np.concatenate(parts), np.array([len(p) for p in parts])


# ---- jobs -----------------------------------------------------------------------------------------------------


def count_words(docs: DataFrame, vocabulary: str, text_col: str = "text", longest: int = WORD_BYTES) -> DataFrame:
    """word, n: how often each word of at most `longest` bytes is in all texts."""

    def count(batches):
        encoder, held = LexiconEncoder.of_process(vocabulary), None
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if encoder.plain(t)]
            for piece in itertools.chain.from_iterable(map(encoder.pieces, texts)) if any(len(t) > SLICE for t in texts) else [None]:
                words, word, in_unit, unit, _ = encoder.words_of(texts if piece is None else [piece])
                times = np.repeat(np.bincount(unit, minlength=len(in_unit)), in_unit)
                n = np.bincount(word, weights=times, minlength=len(words)).astype(np.int64)
                table = pa.table({"word": words, "n": n})
                held = table if held is None else pa.concat_tables([held, table]).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                if len(held) > HELD_WORDS:
                    yield from held.to_batches(1 << 16)
                    held = None
        if held is not None:
            yield from held.to_batches(1 << 16)

    words = docs.select(text_or_empty(text_col).alias("t")).mapInArrow(count, "word string, n bigint")
    return words.filter(F.octet_length("word") <= longest).groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, words: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compile the most frequent words; returns the name under which every executor has the file."""
    spark = docs.sparkSession
    counts = materialise(count_words(docs, vocabulary, text_col), "word-counts", "zstd")
    # The least count that so many words reach; a row for each count, and then only the words chosen, come together.
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("above", F.sum("words").over(Window.orderBy(F.desc("n"))))
    least = levels.filter(F.col("above") <= words).agg(F.min("n")).first()[0]
    top = counts.filter(F.col("n") >= least) if least is not None else counts.limit(0)
    chosen = sorted(r.word.encode() for r in top.select("word").collect())  # at most `words` of WORD_BYTES each
    encoder = LexiconEncoder(vocabulary)
    data, lengths = np.frombuffer(b"".join(chosen), np.uint8), np.array([len(w) for w in chosen], np.int64)
    ids, many = encoder.merge(data, lengths)
    split = np.split(ids, np.cumsum(many)[:-1]) if chosen else []
    flat = compile_lexicon([(w, tuple(i.tolist())) for w, i in zip(chosen, split, strict=True)]).astype("<i4").tobytes()
    name = f"lexicon-{hashlib.sha256(flat).hexdigest()[:16]}.bin"
    # Written to the shared folder by Spark's file system, so any driver path will do; executors fetch it once each.
    path = f"{new_folder(spark, 'lexicon')}/{name}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    for i in range(0, len(flat), 1 << 20):
        out.write(bytearray(flat[i : i + (1 << 20)]))
    out.close()
    if name not in {f.rsplit("/", 1)[-1] for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)
    return name


def _wider(frame: DataFrame, used: str, added: dict[str, T.DataType], rows_of) -> DataFrame:
    """`frame` and more columns, which `rows_of` makes from the column `used` of each batch: (rows, arrays) until all are done."""
    rest = [c for c in frame.columns if c.lower() not in added]
    kept = frame.select(*("`{}`".format(c.replace("`", "``")) for c in rest), F.col(used))
    schema = T.StructType([*kept.schema.fields[:-1], *(T.StructField(n, t) for n, t in added.items())])
    names = [*rest, *added]

    def widen(batches):
        for batch in batches:
            at = 0
            for n, arrays in rows_of(batch.column(batch.num_columns - 1)):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, n) for i in range(len(rest))), *arrays], names)
                at += n

    return kept.toDF(*(f"c{i}" for i in range(len(rest) + 1))).mapInArrow(widen, schema)  # names with dots don't pass


def texts_of(column: pa.Array, vocabulary: str):
    """(rows, their texts) until all lists of ids are done."""
    kept = process_store("token-bytes")
    if vocabulary not in kept:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(vocabulary)
        kept[vocabulary] = pa.array([token_bytes(model.id_to_token(i) or "") for i in range(model.get_vocab_size())], pa.large_binary())
    column = column.fill_null([])
    offsets = column.offsets.to_numpy()
    steps = np.flatnonzero(np.diff((offsets - offsets[0]) // DECODED)) + 1
    for a, b in itertools.pairwise(sorted({0, *steps.tolist(), len(column)})):
        starts = offsets[a : b + 1]
        tokens = kept[vocabulary].take(column.values.slice(starts[0], starts[-1] - starts[0]))
        ends = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1)[starts - starts[0]]
        raw = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(np.ascontiguousarray(ends)), tokens.buffers()[2]])
        try:
            yield b - a, raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            yield b - a, pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


IDS, DECODED_TEXT = {"ids": T.ArrayType(T.IntegerType())}, {"decoded": T.StringType()}


def encode(docs: DataFrame, vocabulary: str, lexicon: str | None = None, text_col: str = "text", back: bool = False) -> DataFrame:
    """`docs` with ids (array<int>) of each text; `lexicon` is what `build_lexicon` has returned.  `back` adds what `decode` would, in the same pass."""

    def rows_of(column):
        for n, ids, many in LexiconEncoder.of_process(vocabulary, lexicon).encode([t or "" for t in column.to_pylist()]):
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.array(ids, pa.int32()))
            if not back:
                yield n, [lists]
                continue
            at = 0
            for k, texts in texts_of(lists, vocabulary):
                yield k, [lists.slice(at, k), texts]
                at += k

    return _wider(docs, text_col, IDS | (DECODED_TEXT if back else {}), rows_of)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with decoded: the text of its ids, special tokens included; bytes that are no UTF-8 become U+FFFD. Null ids give an empty text."""

    def rows_of(column):
        for n, texts in texts_of(column, vocabulary):
            yield n, [texts]

    return _wider(encoded, ids_col, DECODED_TEXT, rows_of)


def op12_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by a lexicon of their own frequent words, and decoded again."""
    docs, vocabulary = spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("byte_bpe_50k.json")
    back = encode(docs.select("doc_id", "text"), vocabulary, build_lexicon(docs, vocabulary), back=True)
    return back.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
