"""Pseudo-likelihood against plain loops, gradients, and that training tells prose from noise."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pricewell.llm import lm

WORDS = "the of and to in a is was for on with as his that at by from it an he".split()


def prose(rng, n):
    out, at = [], 0
    for _ in range(n):
        at = (at * 7 + rng.choice((1, 3))) % 20
        out.append(WORDS[at])
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    return [prose(rng, rng.randrange(5, 200)) for _ in range(300)]


def test_scores_are_sums_of_log_probabilities(spark, corpus):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus[:40])], "doc_id long, text string")
    v = lm.vocabulary(docs)
    counts = {}
    for t in corpus[:40]:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    assert v.known == len(counts) and v.counts[: v.known].tolist() == [1 + n for n in sorted(counts.values(), reverse=True)]
    p = lm.start_weights(v)
    got = {r.doc_id: r for r in lm.score(docs, v, p).collect()}
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for i in (0, 7, 39):
        (_, words, first), = lm._word_runs(pa.array([corpus[i]]))
        ids = v.ids(words).tolist()
        total = 0.0
        for k, own in enumerate(ids):
            around = [ids[k + s] if 0 <= k + s < len(ids) else v.pad for s in (-2, -1, 1, 2)]
            h = np.tanh(np.concatenate([p["emb"][a] for a in around]).astype(float) @ p["w1"] + p["b1"])
            c = own // lm.CLASS
            total += np.log(soft(h @ p["wc"] + p["bc"])[c] * soft(h @ p["ww"][c] + p["bw"][c])[own % lm.CLASS])
        assert got[i].n_tokens == len(ids) and got[i].pll == pytest.approx(total, rel=1e-3)


def test_gradients(corpus):
    v = lm.Vocabulary(np.arange(10, dtype=np.uint64) * 999, np.full(10, 5), 100)
    rng = np.random.default_rng(0)
    ids, around = rng.integers(0, 400, 6), rng.integers(0, v.size + 1, (6, 4))
    for name, at in (("w1", (3, 2)), ("wc", (1, 4)), ("bc", (2,)), ("ww", (int(ids[0]) // lm.CLASS, 5, 7)), ("bw", (int(ids[0]) // lm.CLASS, 3)), ("emb", (int(around[0, 1]), 2))):
        p = {k: w.astype(np.float64) for k, w in lm.start_weights(v).items()}
        t = lm.Trainer(p)
        seen = {}
        t._move = lambda n, a, g: seen.setdefault(n, []).append((a, g))  # noqa: B023
        t.step(ids, around)
        full = np.zeros_like(p[name])
        for a, g in seen[name]:
            full[a] += g
        up = {k: w.copy() for k, w in p.items()}
        up[name][at] += 1e-5
        slope = -(lm.log_probabilities(up, ids, around).sum() - lm.log_probabilities(p, ids, around).sum()) / 1e-5
        assert full[at] == pytest.approx(slope, rel=1e-3, abs=1e-6), name


def test_every_place_is_trained(corpus):
    v = lm.Vocabulary(np.arange(10, dtype=np.uint64) * 999, np.full(10, 5), 100)
    ids = np.random.default_rng(1).integers(0, v.size, 2 * lm.WIDE + 77)
    around = lm.contexts(ids, np.array([0, len(ids)]), v.pad)
    t = lm.Trainer(lm.start_weights(v))
    seen = []
    t.step = lambda own, near: seen.append((own, near))
    t.learn(ids, around)
    assert np.array_equal(np.concatenate([a for a, _ in seen]), ids) and np.array_equal(np.concatenate([b for _, b in seen]), around)


def test_training_tells_prose_from_noise(spark, corpus):
    rng = random.Random(9)
    noise = [" ".join(rng.sample(t.split(), len(t.split()))) for t in corpus[:60]]
    rows = [(i, t) for i, t in enumerate(corpus)] + [(None, corpus[0]), (5, corpus[5]), (900, None), (901, ""), (902, "- !!"), (903, "the " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pll")
    v = lm.vocabulary(docs)
    weights = lm.train(docs, v)
    got = lm.score(docs, v, weights).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].n_tokens, by[i].pll, by[i].mean_logp) == (0, 0.0, None) for i in (900, 901, 902)) and by[903].n_tokens == 30_000
    before = lm.score(docs, v, lm.start_weights(v)).toPandas()
    after = lm.score(docs, v, weights).toPandas()
    assert after.pll.sum() > before.pll.sum() + 0.3 * after.n_tokens.sum()
    shuffled = lm.score(spark.createDataFrame([(i, t) for i, t in enumerate(noise)], "doc_id long, text string"), v, weights).collect()
    assert sum(r.pll < by[r.doc_id].pll for r in shuffled) >= 55


def test_rare_words_have_their_own_counts(spark, corpus):
    names = [f"w{k}" for k in range(6000)]
    hashes = next(iter(lm._word_runs(pa.array([" ".join(names)]))))[1]
    by_entry = {}
    for name, h in zip(names, hashes.tolist(), strict=True):
        by_entry.setdefault(h % lm.TAIL, []).append(name)
    rare, noise = next(x for x in by_entry.values() if len(x) > 1)[:2]
    texts = [*corpus[:20], *[f"the {rare} of"] * 9, f"the {noise} of", "", "the of", None, f"{rare} {noise} {rare}"]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = lm.count_words(docs)
    v = lm.vocabulary_of(counts, known=20)
    assert v.rest.sum() == 13 and (v.rest > 0).sum() == 1
    p = lm.start_weights(v)
    plain = {r.doc_id: r for r in lm.score(docs, v, p).collect()}
    got = {r.doc_id: r for r in lm.score(docs, v, p, counts).collect()}
    assert len(got) == len(plain) == len(texts)
    n = {rare: 11, noise: 2}
    for i, t in enumerate(texts):
        a, b = plain[i or None], got[i or None]
        gap = sum(np.log(n[w] / 14) for w in (t or "").split() if w in n)
        assert b.n_tokens == a.n_tokens and b.pll == pytest.approx(a.pll + gap) and (b.mean_logp is None) == (not b.n_tokens)
    assert plain[20].pll == pytest.approx(plain[29].pll) and got[20].pll > got[29].pll + 1


def test_empty(spark):
    assert lm.pseudo_likelihood(spark.createDataFrame([], "doc_id long, text string")).count() == 0
