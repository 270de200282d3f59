"""Bottom-k fingerprints against exact sets, and the edited-text query against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pricewell.llm import fingerprints as fp

random.seed(1)
VOCABULARY = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


def sets(text, n=5):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_estimates(spark):
    base = prose(1500)
    pairs = [(base, base), (base, base[: len(base) // 2] + prose(700)), (base, prose(900)), ("one two", "one two"), ("one two", "one"), ("", ""), ("", "a"), (None, None)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fp.sketch(F.col("a")).alias("x"), fp.sketch(F.col("b")).alias("y"))
    got = rows.select("a", "b", fp.resemblance(F.col("x"), F.col("y")).alias("j"), fp.containment(F.col("x"), F.col("y")).alias("c"),
                      fp.distinct_shingles(F.col("x")).alias("n")).collect()
    for r in got:
        a, b = sets(r.a or ""), sets(r.b or "")
        j = len(a & b) / len(a | b) if a | b else 1.0
        c = len(a & b) / len(a) if a else 1.0
        assert abs(r.j - j) < 5 * fp.standard_error(0.5) and abs(r.c - c) < 0.3 and abs(r.n - len(a)) <= 0.35 * len(a)
        if len(a) < fp.K and len(b) < fp.K and len(a | b) < fp.K:
            assert r.j == pytest.approx(j) and r.n == len(a)


def test_merge_is_sketch_of_union(spark):
    parts = [prose(300) for _ in range(6)]
    rows = spark.createDataFrame([(i % 2, t) for i, t in enumerate(parts)] + [(7, "")], "k int, text string").select("k", fp.sketch(F.col("text")).alias("s"))
    merged = {r.k: r.s for r in fp.merged_sketch(rows, ["k"], "s").collect()}
    for k in (0, 1):
        own = [sorted(h for h in r.h) for r in spark.createDataFrame([(t,) for t in parts[k::2]], "text string").select(fp.shingle_hashes(F.col("text")).alias("h")).collect()]
        assert merged[k] == sorted({h for x in own for h in x})[: fp.K]
    assert merged[7] == []


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_edits(docs_of, buckets):
    texts = [None, "", "a", "ab cd", prose(40), prose(41), "é" * 7, prose(3000), "same text here", "same text here"]
    ids = list(range(10, 10 + len(texts)))
    got = {r.doc_id: r for r in fp.fingerprint_edits(docs_of(texts, ids, ["'x' AS next", "1 AS bucket"]), buckets=buckets).collect()}
    order = sorted(zip(ids, [t or "" for t in texts], strict=True), reverse=True)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        keep = len(t) // 3
        edited = t[: len(t) - keep] + after[:keep]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if edited == t:
            assert got[i].near_edited == 1.0 and got[i].fingerprint == got[i].edited_fingerprint
    assert got[18].fingerprint == got[19].fingerprint and got[19].near_next == 1.0


def test_ties_nulls_and_empty(docs_of):
    got = fp.fingerprint_edits(docs_of(["b b", "a a", "c c", None], [5, 5, None, None])).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == [(-1, 0), (-1, 3), (5, 3), (5, 3)]
    assert fp.fingerprint_edits(docs_of([], [])).count() == 0
    assert fp.fingerprint_edits(docs_of(["alone is its own next"])).first().near_next == 1.0
