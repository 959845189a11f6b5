"""What the findings of the fourth round asked for."""

import random

import numpy as np
from pyspark.sql import functions as F

from marlstone.functions import indexing, nearness
from marlstone.functions import text as T
from marlstone.functions import vector as V
from marlstone.operators import jobs, postings, search
from marlstone.plans import queries, views

DATA = "/root/testdata/sf0.001"

ODD = ["Dr. ", "e.g. ", " ", "\n", "A. ", "well-known", "it's", "'go.'", "!'abc", "?", ". ", "ΑΣ.", "Β", "İstanbul", "_", "snake_case", "the", "was. ", "x-", "-y", "1.5", "café", "́", "…", "The roof leaked. "]


def odd_texts(n):
    r = random.Random(5)
    return ["".join(r.choice(ODD) for _ in range(r.randint(1, 30))) for _ in range(n)] + ["He was. It is. To be.", "'", "one", "a" * 300 + ". " + "b c. " * 200]


def test_index_step_takes_sentences_apart_once_and_gives_what_excerpts_have(spark):
    texts = odd_texts(400)
    rows = spark.createDataFrame([(i, t, None, False) for i, t in enumerate(texts)], "id bigint, text string, rating int, hidden boolean").coalesce(1)
    parts, _ = jobs.index_step(rows, rows.select(F.col("id").alias("review_id")), 16)
    # A table in one file is not one task.
    assert "hashpartitioning(id" in parts._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.review_id, r.kind, r.start_offset, r.text, r.embedding, [(w.key, w.value) for w in r.words]) for r in parts.withColumn("words", F.map_entries("lexemes")).collect())
    want = []
    for i, t in enumerate(texts):
        for kind, e, offset in T.excerpts(t) if t.strip() else []:
            vector = V.hashed_vector(e, 16) if V.TOKEN.search(e.lower()) else None
            want.append((i, kind, offset, e, vector, list(T.vector_of(e).items())))
    want.sort(key=lambda w: w[:4])
    assert [(*g[:4], g[5]) for g in got] == [(*w[:4], w[5]) for w in want]
    for g, w in zip(got, want, strict=True):
        assert (g[4] is None and w[4] is None) or np.array_equal(np.float32(g[4]), np.float32(w[4]))
    # Each different run is told once, however many excerpts it is in.
    runs = indexing.Runs()
    parts, units, _ = indexing.parts_of("The roof leaked. They came. It was fixed. All good.")
    assert len(parts) == 7 and len(units) == 4 and runs["roof"] == runs["roof"] == 0


def wholly(reviews, chunks, asked, both):
    """The same from ranks over all pairs as rows."""
    best = search.best_of_reviews(search.hybrid_ranks(reviews, chunks, asked, below_floor=both))
    above, below = best.filter("NOT below_floor"), best.filter("below_floor")
    out = search._limited(above).select(*search.RESULT)
    if both:
        out = out.unionByName(search._limited(below.join(above.select("query_id", "review_id"), ["query_id", "review_id"], "left_anti")).select(*search.RESULT))
    return sorted(map(str, out.collect()))


def test_searches_meet_pairs_in_blocks_and_never_as_rows(spark, monkeypatch):
    rng = random.Random(11)
    reviews = spark.createDataFrame([(i, i % 2, "live", 1 + i % 5, None, i % 31 == 0, "st"[i % 2], rng.choice([None, i % 4])) for i in range(150)], "id bigint, project_id bigint, environment string, rating bigint, sentiment string, hidden boolean, source string, occurred_s bigint")
    # Equal vectors, none of any length, and some of another number of dimensions, which no query meets; several excerpts a review.
    vector = lambda i: [1.0, 0.3, -0.2] if i % 3 == 0 else [0.0] * 3 if i % 13 == 0 else [1.0] if i % 17 == 0 else [rng.gauss(0, 1) for _ in range(3)]
    made = [(i, rng.randrange(150), rng.choice(["full", "window", "sentence"]), i % 5, None if i % 19 == 0 else vector(i), {w: [1, 4] for w in ("roof", "leak") if rng.random() < 0.4}) for i in range(500)]
    chunks = spark.createDataFrame(made, "id bigint, review_id bigint, kind string, start_offset int, embedding array<double>, lexemes map<string,array<int>>")
    texts = ["roof", None, "-roof", "leak or roof"]
    asked = [search.Query(10 * p + k, p, "live", 2 + 3 * k, 1 + k, 0.9 if k % 2 else 0.2, vector=[1.0, 0.2 * k, -0.1 * p], text=t, sources=["s"] * (k == 3)) for p in (0, 1) for k, t in enumerate(texts)]
    bare = [search.Query(**{**q.__dict__, "text": None}) for q in asked]
    cases = [(search.debug, asked, True), (search.hybrid, asked, False), (search.debug, bare, True), (search.hybrid, bare, False)]
    want = [wholly(reviews, chunks, qs, both) for _, qs, both in cases]
    monkeypatch.setattr(nearness, "PAIRS", 60)
    monkeypatch.setattr(nearness, "TILE", (2, 3))
    monkeypatch.setattr(search, "_scored", None)
    assert [sorted(map(str, find(reviews, chunks, qs).collect())) for find, qs, _ in cases] == want and all(want)


def test_hybrid_batch_asks_for_words_that_documents_have(spark, monkeypatch):
    """Its words were stop words, so two of four forms asked for nothing; and word ranks left out what has no vector yet."""
    seen = {}
    keep = search.hybrid
    monkeypatch.setattr(search, "hybrid", lambda r, c, qs, **more: seen.update(more, queries=qs) or keep(r, c, qs, **more))
    found = queries.QUERIES["search_hybrid_batch"](spark, DATA).collect()
    forms = sorted({q.text for q in seen["queries"]})
    parsed = postings.parse([postings.Asked(k, 0, "live", f) for k, f in enumerate(forms)])
    assert parsed and all(len(p.lexemes) == 2 for p in parsed) and any(r.lexical for r in found)
    chunks, docs = views.chunks(spark, DATA), {r.doc_id: r.text for r in views.table(spark, DATA, "documents").collect()}
    wanted = {x for p in parsed for x in p.lexemes}
    want = {(lex, r.id, tuple(at)) for r in chunks.collect() for lex, at in T.vector_of(docs[r.review_id] or "").items() if lex in wanted}
    assert {(r.lexeme, r.id, tuple(r.positions)) for r in seen["postings"].collect()} == want
    assert {r.id for r in chunks.filter("embedding IS NULL").collect()} & {i for _, i, _ in want}
