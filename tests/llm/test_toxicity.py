"""Gradients of the network, and accuracy on rows that were not learned from."""

import random
from zlib import crc32

import numpy as np
import pytest

from pricewell.llm import toxicity

SYLLABLES = "er th on an in re st ea ti or nd ha to".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Net(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    known, gram, first = np.array([1, 0, 3, 5]), np.array([1, 2, 3, 9, 2, 7, 7]), np.array([0, 2, 3, 5])
    at, size = rng.integers(0, 4, (3, 6)), np.array([6, 2, 4])
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([2.0, 1.0, 1.0])

    def loss():
        p = toxicity._sigmoid(net.score(net.gates(net.inputs(known, gram, first)), at, size))
        return -(weight * np.log(np.where(label > 0, p, 1 - p))).sum() / 3

    seen = {}
    net.adam = seen.update
    net.learn(known, gram, first, at, size, label, weight)
    for name in net.p:
        spot = (known[2], 3) if name == "word" else (2, 4) if name == "gram" else tuple(0 for _ in net.p[name].shape)
        keep = net.p[name][spot]
        net.p[name][spot] = keep + 1e-3
        up = loss()
        net.p[name][spot] = keep - 1e-3
        down = loss()
        net.p[name][spot] = keep
        assert seen[name][spot] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-5), name


def test_windows_cover_every_word():
    for n in (0, 1, 39, 40, 41, 72, 73, 500):
        start, size, at = toxicity.windows(np.array([0, 0, n]))
        seen = np.zeros(n, int)
        for a, k in zip(start, size, strict=True):
            seen[a : a + k] += 1
        assert at.tolist() == [0, 0, len(start)] and (seen > 0).all() and (size <= toxicity.LENGTH).all()


def test_score_is_the_same_in_any_batch():
    rng = np.random.default_rng(1)
    net = toxicity.Net(0)
    gates = net.gates(rng.standard_normal((30, 2 * toxicity.WIDTH)).astype(np.float32))
    at, size = rng.integers(0, 30, (9, toxicity.LENGTH)), rng.integers(1, toxicity.LENGTH, 9)
    whole = net.score(gates, at, size)
    assert np.allclose(whole, np.concatenate([net.score(gates, at[k : k + 1], size[k : k + 1]) for k in range(9)]), atol=1e-5)


def test_held_out(spark):
    rng = random.Random(5)
    bad = ["gurk", "fleth", "zonk"]
    rows, marks = [], []
    for i in range(700):
        w = [word(rng) for _ in range(rng.randrange(5, 300))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(bad) + rng.choice(["", "!!", "er"]))
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    long = " ".join(word(rng) for _ in range(20_000))
    odd = [(1000, None), (1001, ""), (1002, "12 !"), (1003, long), (None, "gurk zonk " + rows[1][1]), rows[3], (1004, "gurk fleth! ZONK")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 AS toxic", "'x' AS score")
    labels = spark.createDataFrame([(i, 1, t) for i, t in marks] + [(5, 1, None), (None, 1, 1), (7000, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(by[i].predicted, t) for i, t in marks if by[i].held_out]
    assert len(held) > 120 and sum(p == t for p, t in held) >= 0.95 * len(held)
    assert [by[i].score for i in (1000, 1001)] == [0.0, 0.0] and by[None].predicted == by[1004].predicted == 1


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.judge(docs, labels).first().score == 0.0
    assert toxicity.judge(docs.limit(0), labels.limit(0)).count() == 0
