"""Tokenisation by a public vocabulary file, word by word with a bounded cache.

Where a vocabulary's pre-tokenizer never joins text across white space, the ids of a text are the ids of its words one
after the other.  Then the words of a whole batch are numbered by Arrow, each distinct one is encoded once by the
tokenizers library and kept in a two-generation cache of the worker process, whose size does not depend on the data, and
the ids are gathered as arrays.  Any other vocabulary encodes whole texts by the library.

Cases: an empty text has no ids; a text of any length is one array; words that hold a special token, a combining mark or
any character whose lower case or class could depend on Unicode tables go through the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import process_store, ship

ship(__name__)

#: Combining marks: composition may depend on the case of the letter before them, so such words are not lower-cased here.
COMBINING = "[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]"
#: Fixed value: the pattern by which the word vocabulary splits text before its merges.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters alone are split here: their classes are settled, and no lower case of theirs is longer than one.
SETTLED = re.compile("[!-~\u00a1-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e]+")
#: Bytes of text that are encoded at once, unless one text is longer.
SLICE_BYTES = 8 << 20


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of whole texts as little-endian arrays; the same ids as encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, generation: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.generation = generation
        self.by_word = self._splits_at_spaces()
        if self.by_word:
            import regex

            suffix = self.model.model.end_of_word_suffix
            self.ends = np.zeros(self.model.get_vocab_size(), bool)
            for token, i in self.model.get_vocab(with_added_tokens=False).items():
                self.ends[i] = token.endswith(suffix)
            self.parts = regex.compile(PARTS)
            self.combining = re.compile(COMBINING)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of_process(cls, path: str) -> WordTokenizer:
        store = process_store("tokenizers")
        if path not in store:
            store[path] = cls(path)
        return store[path]

    def _splits_at_spaces(self) -> bool:
        """Whether the file lowers its text, drops white space and marks the end of each part: what words rest on."""
        said = json.loads(self.model.to_str())
        steps = lambda x, key: x.get(key, [x]) if x else []
        split = next(iter(steps(said["pre_tokenizer"], "pretokenizers")), {})
        norms = [n["type"] for n in steps(said["normalizer"], "normalizers")]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].startswith("<|") for t in said["added_tokens"])
        return plain and norms == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": PARTS} and split["behavior"] == "Removed" and bool(said["model"].get("end_of_word_suffix"))

    def _missing(self, words: list[str]) -> list[bytes]:
        """Ids of words that no cache has, by way of their parts."""
        young, old, split, new = self.young, self.old, [], {}
        for w in words:
            if w.isalpha() or "<|" in w or not SETTLED.fullmatch(w):
                split.append((w,))
                new[w] = None
            else:
                split.append(own := self.parts.findall(w))
                for p in own:
                    new[p] = young.get(p) or old.get(p)
        wanted = [p for p, ids in new.items() if ids is None]
        for p, ids in zip(wanted, self._encode_parts(wanted), strict=True):
            new[p] = ids
            if len(p) < 32:
                young[p] = ids
        return [new[own[0]] if len(own) == 1 else b"".join(map(new.__getitem__, own)) for own in split]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """As `_encode_words`; a part ends with the token that says so, and if that doesn't add up, offsets decide."""
        if not parts:
            return []
        ids = np.array(self.model.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(parts) or ends[-1] != len(ids):
            return self._encode_words(parts)
        raw, ends = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, from one text that holds them all: a token belongs to the word in which it starts."""
        starts = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        found = self.model.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, self.dtype).tobytes()
        at = np.array([a for a, _ in found.offsets], np.int64)
        ends = np.searchsorted(at, [*starts[1:], 1 << 62]) * self.dtype.itemsize
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _lowered(self, texts: pa.Array) -> pa.Array:
        """ASCII letters in lower case (the model lowers the rest), but for words in which case still decides something."""
        low = pc.ascii_lower(texts)
        odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, COMBINING))
        if pc.any(odd).as_py():
            keep = lambda w: "<|" in w or self.combining.search(w)
            own = [" ".join(w if keep(w) else w.encode().lower().decode() for w in re.split(r"[\x20\x09-\x0d]+", t)) for t in texts.filter(odd).to_pylist()]
            low = pc.replace_with_mask(low, odd, pa.array(own, texts.type))
        return low

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(self._lowered(texts))
        coded = split.flatten().dictionary_encode()
        words, young, old = coded.dictionary.to_pylist(), self.young, self.old
        found = [young.get(w) for w in words]
        missing = []
        for k, ids in enumerate(found):
            if ids is None:
                ids = old.get(words[k])
                if ids is None:
                    missing.append(k)
                else:
                    found[k] = young[words[k]] = ids
        for k in range(0, len(missing), 1000):
            part = missing[k : k + 1000]
            for i, ids in zip(part, self._missing([words[i] for i in part]), strict=True):
                found[i] = young[words[i]] = ids
        if len(young) > self.generation:
            self.old, self.young = young, {"": b""}
        # Where each distinct word's ids lie, then the ids of the words in the order of the texts.
        width = self.dtype.itemsize
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // width
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        table = np.frombuffer(b"".join(found), self.dtype)
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        at = np.arange(ends[-1], dtype=kind)
        at += np.repeat((first[codes] - ends[:-1]).astype(kind), each)
        return table[at], ends[split.offsets.to_numpy() - split.offsets[0].as_py()]

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, self.dtype) for e in self.model.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.empty(0, self.dtype), *ids]), np.cumsum([0, *map(len, ids)])

    def encode_array(self, texts: pa.Array):
        """Slice by slice of an Arrow array of strings: the first text's number, the ids, and where each text begins in them."""
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
            yield (at, *(self._slice if self.by_word else self._whole)(texts.slice(at, end - at)))
            at = end

    def encode_ended(self, texts: pa.Array, end_id: int):
        """As `encode_array`, with the end id after each text."""
        for at, ids, starts in self.encode_array(texts):
            starts = starts + np.arange(len(starts))
            whole = np.full(starts[-1], end_id, self.dtype)
            own = np.ones(len(whole), bool)
            own[starts[1:] - 1] = False
            whole[own] = ids
            yield at, whole, starts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as `dtype`."""
        out = []
        for _, ids, starts in self.encode_array(pa.array(texts, pa.string())):
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip((starts[:-1] * self.dtype.itemsize).tolist(), (starts[1:] * self.dtype.itemsize).tolist(), strict=True)]
        return out
