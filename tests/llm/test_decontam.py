"""Seeds and alignment against plain loops, and planted copies, edited copies and chance."""

import random

import numpy as np

from pricewell.llm import decontam

random.seed(6)
VOCABULARY = ["".join(random.choice("aeioustrndlm") for _ in range(random.randrange(2, 8))) for _ in range(4000)]
COMMON = VOCABULARY[:30]


def prose(n):
    return [random.choice(COMMON if random.random() < 0.4 else VOCABULARY) for _ in range(n)]


def edited(words, rate):
    out = []
    for w in words:
        r = random.random()
        out += [random.choice(VOCABULARY)] if r < rate * 0.6 else [] if r < rate * 0.8 else [w, random.choice(VOCABULARY)] if r < rate else [w]
    return out


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (decontam.MATCH if x == y else decontam.MISS), h[i - 1, j] + decontam.GAP, h[i, j - 1] + decontam.GAP)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 15)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint64)
        score, x, y = decontam.align(a, b)
        assert score == smith_waterman(a.tolist(), b.tolist())
        if score:
            assert smith_waterman(a.tolist(), b[x:y].tolist()) == score


def test_planted(spark, docs_of):
    items = [prose(random.randrange(15, 60)) for _ in range(60)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, ""), (92, "two words"), (0, " ".join(items[0]))], "item_id long, text string")
    texts, want = [], {}
    for k in range(240):
        body = prose(200)
        if k % 2:
            item, p = k % 60, random.randrange(200)
            body[p:p] = edited(items[item], [0, 0.1, 0.2, 0.3][k // 60])
            want[k] = item
        texts.append(" ".join(body).capitalize() + ".\n")
    # One item leaked into many documents keeps its seeds; empty, null and repetitive texts give nothing.
    texts += [" ".join(prose(30) + items[7]) for _ in range(150)] + [None, "", "the " * 5000, COMMON[0] * 20_000]
    for k in range(240, 390):
        want[k] = 7
    docs = docs_of(texts, extra=["1 AS item_id", "'z' AS score"])
    got = decontam.contaminated(docs, bench).collect()
    hit = {(r.doc_id, r.item_id) for r in got}
    assert {d for d, _ in hit} <= set(want)
    assert len(hit & set(want.items())) >= 0.97 * len(want)
    for r in got[:50]:
        words = " ".join(texts[r.doc_id][r.start : r.end].lower().split())
        assert r.score < 1 or words.strip(".") == " ".join(items[r.item_id])
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in hit}


def test_blocks(spark, docs_of, monkeypatch):
    items = [prose(20) for _ in range(9)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    docs = docs_of([" ".join(prose(10) + w) for w in items])
    whole = sorted(decontam.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 45)
    assert sorted(decontam.contaminated(docs, bench).collect()) == whole and decontam.decontaminate(docs, bench).count() == 0
    assert decontam.contaminated(docs_of([]), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 9
