"""Links, components and set sizes against brute force; hot groups; odd-sketch estimates."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pricewell.llm import neardup

random.seed(8)
VOCABULARY = ["".join(random.choice("aeioustrnd") for _ in range(random.randrange(2, 7))) for _ in range(2500)]


def prose(n):
    return [random.choice(VOCABULARY) for _ in range(n)]


def edit(words, k):
    out = list(words)
    for _ in range(k):
        out[random.randrange(len(out))] = random.choice(VOCABULARY)
    return out


def brute(rows, n):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets, root = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(docs_of, texts, n=4):
    order = random.sample(range(len(texts)), len(texts))
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(texts, order, ["1 AS rep", "'x' AS digest"]), n).collect()}
    want = brute(list(zip(order, texts, strict=True)), n)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    return want


def test_small_groups(docs_of):
    texts = [None, "", " \t\n", "a b c", "A  b\nC", "a b", "É b c d", "é b c d", "x " * 3000]
    for _ in range(60):
        base = prose(random.randrange(20, 150))
        texts += [" ".join(edit(base, k)) for k in random.sample(range(8), 3)] + [" ".join(base).upper() + "\n"]
    check(docs_of, texts)


def test_hot_groups(docs_of):
    base, passage = prose(140), prose(120)
    texts = [" ".join(edit(base, random.randrange(0, 12))) for _ in range(220)]
    # Chains away from the base, documents that share one long passage, and exact copies.
    last = base
    for _ in range(40):
        last = edit(last, 2)
        texts.append(" ".join(last))
    texts += [" ".join(prose(random.randrange(10, 60)) + passage + prose(random.randrange(60))) for _ in range(120)] + [" ".join(base)] * 50
    want = check(docs_of, texts)
    assert len({c for _, c in want.values()}) < 300


def test_estimates():
    rng = np.random.default_rng(1)
    for j in (0.8, 0.9, 0.97):
        gap = []
        for _ in range(60):
            n = 800
            common = int(2 * n * j / (1 + j))
            u = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
            a, b = np.unique(u[:n]), np.unique(u[n - common :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            odd = neardup.odd_sketches(np.concatenate([neardup.min_hashes(x, np.array([0])) for x in (a, b)]))
            gap.append(neardup.estimate(odd[:1], odd[1:])[0] - true)
            parity = neardup.set_parities([a, b])
            assert np.unpackbits((parity[0] ^ parity[1]).view(np.uint8)).sum() <= len(np.setxor1d(a, b))
        assert abs(np.mean(gap)) < 0.02 and np.std(gap) < 0.05 and min(gap) > -neardup.SLACK


def test_ids(docs_of):
    docs = docs_of(["a b c d e f", "a b c d e f", "q r s t u v", "q r s t u v", None, "a b c d e f"], [7, None, 3, 3, None, 9])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 4).collect()), key=str)
    assert got == sorted([(7, 7, True), (9, 7, False), (3, 3, True), (3, 3, True), (None, None, False), (None, None, False)], key=str)
    one = neardup.keep_one(docs, 4)
    assert one.columns == docs.columns and sorted(str(r.doc_id) for r in one.collect()) == ["3", "7", "None", "None"]
    assert neardup.near_duplicates(docs_of([]), 4).count() == 0 and neardup.keep_one(docs_of([])).count() == 0
