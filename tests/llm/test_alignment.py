import hashlib
import itertools
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from marlstone.llm import alignment
from marlstone.llm.lexicon import token_bytes
from marlstone.llm.tokens import vocabulary_path

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
ALPHABET = ["a", "b", "'s", "'", "  ", " ", "\n", "\t", "é", "日本", "١", "😀", "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", "\x1c", "\x1f", "\xa0", "　", "x1", "...", "the", " and", "\r\n", "\r ", ";\r", "\x00", "ﬁ", "", ""]


class Slow:
    """Whole texts by the libraries, a dictionary for each, and every pair of a group compared."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.size_b = self.b.get_piece_size()

    def align(self, text):
        """Ids of both sides, groups, links; or None where there are no tokens."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        of_a = [token_bytes(self.a.id_to_token(i)) for i in a]
        of_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            return None
        ends_a, ends_b = ([0, *itertools.accumulate(map(len, x))] for x in (of_a, of_b))
        groups, links, i0, j0 = [], Counter(), 0, 0
        for end in sorted(set(ends_a[1:]) & set(ends_b[1:])):
            i1, j1 = ends_a.index(end), ends_b.index(end)
            groups.append((a[i0:i1], b[j0:j1]))
            for i, j in itertools.product(range(i0, i1), range(j0, j1)):
                if max(ends_a[i], ends_b[j]) < min(ends_a[i + 1], ends_b[j + 1]):
                    links[a[i] * self.size_b + b[j]] += 1
            i0, j0 = i1, j1
        return a, b, groups, links

    def rows(self, docs):
        """What the query returns for (doc_id, text) rows."""
        told = [(d, self.align(t)) for d, t in docs]
        counts = sum((x[3] for _, x in told if x), Counter())
        most = Counter()
        for p, n in counts.items():
            most[p % self.size_b] = max(n, most[p % self.size_b])
        for d, x in told:
            if x is None:
                yield d, 0, 0, 0, 0, 0, 0, ""
                continue
            a, b, groups, links = x
            written = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
            best = sum(n for p, n in links.items() if counts[p] == most[p % self.size_b])
            yield d, len(a), len(b), len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(written.encode()).hexdigest()


COLUMNS = [*alignment.SUMS, "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def slow():
    return Slow()


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("together", [1, 40])
def test_slices_of_any_size(slow, together):
    texts, aligner = [*random_texts(1, 1200), "a" * 2000, " ", "a ", "  a", "a  "], alignment.PairAligner.of_process(A, B)
    for at in range(0, len(texts), together):
        part = texts[at : at + together]
        got = aligner.align(part)
        links = iter(zip(got["links"].tolist(), got["times"].tolist(), strict=True))
        for k, t in enumerate(part):
            want = slow.align(t)
            assert dict(itertools.islice(links, int(got["in_text"][k]))) == (dict(want[3]) if want else {}), t
            assert tuple(int(got[c][k]) for c in alignment.SUMS) == ((len(want[0]), len(want[1]), len(want[2]), sum(want[3].values())) if want else (0, 0, 0, 0)), t
            if together == 1:
                assert aligner.groups_of(t) == (want[2] if want else [])


@pytest.mark.parametrize("broadcast_pairs", [0, alignment.BROADCAST_PAIRS])
def test_scores_of_tables(spark, slow, broadcast_pairs):
    rows = [*enumerate(random_texts(2, 300)), (None, "no id the"), (7, None), (8, ""), (3, "twice and twice"), (3, "twice and twice"), (900, "the and " * 2000)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, n_a int, links string")
    aligned = alignment.materialise(alignment.align_documents(docs, A, B, with_groups=True).withColumn("row", alignment.F.monotonically_increasing_id()), "aligned")
    got = alignment.score_links(aligned, alignment.count_links(aligned, slow.size_b), broadcast_pairs)
    assert sorted(map(tuple, got.select("doc_id", *COLUMNS).collect()), key=str) == sorted(slow.rows(rows), key=str)
    some = aligned.filter("doc_id = 900").first()
    assert [(g.a, g.b) for g in some.groups] == slow.align("the and " * 2000)[2]
    assert alignment.align_documents(docs.limit(0), A, B).count() == 0
