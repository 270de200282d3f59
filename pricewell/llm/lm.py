"""Language-model scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

A token is a run of ASCII letters, digits and other characters beyond ASCII (A-Z lower-cased); the ``KNOWN`` most frequent words of the corpus have entries of their own in the network, all others share ``TAIL``
hashed entries, where each has the share that its own count has of its entry's.  The two tokens before and the two after a place pass an embedding and a hidden layer; the masked token's probability is that of its class
times that inside its class.  A text's score is the sum of the log-probabilities of all its tokens, each given the others around it.

Word counts cover all documents; they give the vocabulary and the starting biases, and the whole table, which has a row for each distinct word and so grows with
the corpus, stays in Spark and is joined to the words outside the network's own.  The weights start from a bounded sample of documents; then every task goes on
training on every place of all of its documents, and Spark averages the tasks' weights, weighted by their places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .textarrays import SIGNS, mix, runs, span_hashes, text_bytes, word_spans

# TAIL is a power of two, so that signed and unsigned hashes leave the same rest.
KNOWN, TAIL, CLASS = 4096, 1024, 80
WIDTH, HIDDEN, SIDE = 16, 32, 2
#: Documents of the sample the weights start from, those of the least hash, and passes over it.
SAMPLE, PASSES = 400, 2
#: Places of a training step: on the sample, and in the pass over all documents.
BATCH, WIDE = 512, 8192
RATE = 0.08
STRETCH = 8192
# Words whose counts a task holds before it hands them on.
HELD = 1_000_000


class Vocabulary:
    """Entries by corpus frequency; classes are stretches of ``CLASS`` entries; ``rest``: the count of all other words, as a total or for each shared entry."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rest: int | np.ndarray):
        order = np.argsort(hashes)
        self.sorted, self.entry = hashes[order], order
        self.known = len(hashes)
        self.size = -(-(self.known + TAIL) // CLASS) * CLASS
        self.counts = np.ones(self.size)
        self.counts[: self.known] += counts
        self.rest = np.full(TAIL, rest / TAIL) if np.ndim(rest) == 0 else rest
        self.counts[self.known : self.known + TAIL] += self.rest
        self.pad = self.size

    def ids(self, words: np.ndarray) -> np.ndarray:
        tail = self.known + (words % np.uint64(TAIL)).astype(np.int64)
        if not self.known:
            return tail
        at = np.minimum(np.searchsorted(self.sorted, words), self.known - 1)
        return np.where(self.sorted[at] == words, self.entry[at], tail)


def start_weights(v: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    put = lambda *s: (rng.standard_normal(s) * s[-2] ** -0.5 if len(s) < 3 else rng.standard_normal(s) * 0.1).astype(np.float32)
    classes = v.size // CLASS
    by_class = v.counts.reshape(classes, CLASS)
    return {
        "emb": (rng.standard_normal((v.size + 1, WIDTH)) * 0.3).astype(np.float32), "w1": put(2 * SIDE * WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32),
        "wc": put(HIDDEN, classes), "bc": np.log(by_class.sum(1) / v.counts.sum()).astype(np.float32),
        "ww": put(classes, HIDDEN, CLASS), "bw": np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32),
    }


def _log_softmax(x):
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def _softmax(x):
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def contexts(ids: np.ndarray, first: np.ndarray, pad: int) -> np.ndarray:
    """(words, 2 SIDE) tokens before and after each word of the rows; ``pad`` beyond a row's edge."""
    wide = np.full(len(ids) + SIDE * len(first), pad)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(ids)) + SIDE * (row + 1)
    wide[at] = ids
    return np.stack([wide[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def log_probabilities(p: dict, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of each token given the tokens around it."""
    out = np.empty(len(ids))
    for k in range(0, len(ids), STRETCH):
        own = ids[k : k + STRETCH]
        h = np.tanh(p["emb"][around[k : k + STRETCH]].reshape(len(own), -1) @ p["w1"] + p["b1"])
        cls, inside = own // CLASS, own % CLASS
        got = _log_softmax(h @ p["wc"] + p["bc"])[np.arange(len(own)), cls]
        order = np.argsort(cls, kind="stable")
        begin = np.flatnonzero(np.append(True, np.diff(cls[order]) > 0))
        for a, z in zip(begin, np.append(begin[1:], len(own)), strict=True):
            r, c = order[a:z], cls[order[a]]
            got[r] += _log_softmax(h[r] @ p["ww"][c] + p["bw"][c])[np.arange(len(r)), inside[r]]
        out[k : k + STRETCH] = got
    return out


class Trainer:
    """Adagrad on batches of places."""

    def __init__(self, weights: dict):
        self.p = {k: w.copy() for k, w in weights.items()}
        self.g = {k: np.full_like(w, 0.1) for k, w in weights.items()}
        self.places = 0

    def _move(self, name, at, grad):
        self.g[name][at] += grad * grad
        self.p[name][at] -= RATE * grad / np.sqrt(self.g[name][at])

    def step(self, ids: np.ndarray, around: np.ndarray) -> None:
        p, n = self.p, len(ids)
        # In the order of their classes, the places of a class are a slice.
        order = np.argsort((ids // CLASS).astype(np.int32), kind="stable")
        ids, around = ids[order], around[order]
        x = p["emb"][around].reshape(n, -1)
        h = np.tanh(x @ p["w1"] + p["b1"])
        cls, inside = ids // CLASS, ids % CLASS
        d = _softmax(h @ p["wc"] + p["bc"])
        d[np.arange(n), cls] -= 1
        dh = d @ p["wc"].T
        grad = {"wc": h.T @ d, "bc": d.sum(0)}
        begin = np.flatnonzero(np.append(True, np.diff(cls) > 0))
        moves = []
        for a, z in zip(begin, np.append(begin[1:], n), strict=True):
            r, c = slice(a, z), cls[a]
            e = _softmax(h[r] @ p["ww"][c] + p["bw"][c])
            e[np.arange(z - a), inside[r]] -= 1
            dh[r] += e @ p["ww"][c].T
            moves.append((c, h[r].T @ e, e.sum(0)))
        du = dh * (1 - h * h)
        grad |= {"w1": x.T @ du, "b1": du.sum(0)}
        dx = (du @ p["w1"].T).reshape(-1, WIDTH)
        flat = around.ravel()
        order = np.argsort(flat, kind="stable")
        begin = np.flatnonzero(np.append(True, np.diff(flat[order]) > 0))
        for c, gw, gb in moves:
            self._move("ww", c, gw)
            self._move("bw", c, gb)
        for k, g in grad.items():
            self._move(k, slice(None), g)
        self._move("emb", flat[order][begin], np.add.reduceat(dx[order], begin, axis=0))
        self.places += n

    def learn(self, ids: np.ndarray, around: np.ndarray) -> None:
        for k in range(0, len(ids), WIDE):
            self.step(ids[k : k + WIDE], around[k : k + WIDE])


def _word_runs(column):
    buf, off = text_bytes(column)
    for i, j in runs(off):
        part, at = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, first = word_spans(part, at, SIGNS)
        yield i, span_hashes(part, starts, ends), first


def _merge(parts):
    words = np.concatenate([w for w, _ in parts])
    at, where = np.unique(words, return_inverse=True)
    return at, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _count_words(batches):
    parts, held = [], 0
    emit = lambda w, n: pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["word", "n"])
    for batch in batches:
        for _, words, _ in _word_runs(batch.column("text")):
            own, n = np.unique(words, return_counts=True)
            parts.append((own, n))
            held += len(own)
            if held > HELD:
                parts = [_merge(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield emit(*parts[0])
                    parts, held = [], 0
    if parts:
        yield emit(*_merge(parts))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of all documents, by hash."""
    return docs.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """The ``known`` most frequent words of ``counts``, ties by hash, and what the other words of each shared entry count."""
    top = counts.orderBy(F.desc("n"), "word").limit(known).collect()
    n = np.array([r.n for r in top], np.int64)
    words = np.array([r.word for r in top], np.int64).view(np.uint64)
    rest = np.zeros(TAIL)
    for r in counts.groupBy(F.pmod("word", F.lit(TAIL)).alias("entry")).agg(F.sum("n").alias("n")).collect():
        rest[r.entry] = r.n
    rest -= np.bincount((words % np.uint64(TAIL)).astype(np.int64), weights=n, minlength=TAIL)
    return Vocabulary(words, n, rest)


def vocabulary(docs: DataFrame, known: int = KNOWN) -> Vocabulary:
    """The ``known`` most frequent words; ties go by hash."""
    return vocabulary_of(cut_lineage(count_words(docs)), known)


def train(docs: DataFrame, v: Vocabulary, sample: int = SAMPLE, passes: int = PASSES) -> dict[str, np.ndarray]:
    """Weights: first from the sample, then averaged over tasks that each train on all of their documents."""
    rows = docs.where("text IS NOT NULL AND doc_id IS NOT NULL")
    ids = [r.doc_id for r in rows.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample).collect()]
    texts = [r.text for r in sorted(rows.where(F.col("doc_id").isin(ids)).select("doc_id", "text").collect())] if ids else []
    weights = start_weights(v)
    first = Trainer(weights)
    for _ in range(passes):
        for _, words, at in _word_runs(pa.array(texts, pa.string())):
            own = v.ids(words)
            around = contexts(own, at, v.pad)
            for k in range(0, len(own), BATCH):
                first.step(own[k : k + BATCH], around[k : k + BATCH])
    weights = first.p
    names, shapes = list(weights), {k: w.shape for k, w in weights.items()}

    def go_on(batches):
        own = Trainer(weights)
        own.g = {k: g.copy() for k, g in first.g.items()}
        for batch in batches:
            for _, words, at in _word_runs(batch.column("text")):
                token = v.ids(words)
                own.learn(token, contexts(token, at, v.pad))
        if own.places:
            flat = np.concatenate([own.p[k].ravel() for k in names]).astype(np.float64) * own.places
            cut = 1024
            parts = [flat[k : k + cut] for k in range(0, len(flat), cut)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(parts, pa.list_(pa.float64())), pa.array([own.places] * len(parts), pa.int64())], ["part", "w", "n"])

    got = docs.select("text").mapInArrow(go_on, "part long, w array<double>, n long")
    each = got.select("part", "n", F.posexplode("w").alias("at", "w")).groupBy("part", "at").agg((F.sum("w") / F.sum("n")).alias("w"))
    mean = each.toArrow()
    if not mean.num_rows:
        return weights
    flat = np.empty(sum(w.size for w in weights.values()))
    flat[mean["part"].to_numpy() * 1024 + mean["at"].to_numpy()] = mean["w"].to_numpy()
    out, at = {}, 0
    for k in names:
        size = int(np.prod(shapes[k]))
        out[k] = flat[at : at + size].reshape(shapes[k]).astype(np.float32)
        at += size
    return out


def _lists(row: np.ndarray, words: np.ndarray, rows: int) -> pa.Array:
    """Distinct words of each row with their counts; a row without words has one of count 0, by its place, so that such rows do not meet under one key."""
    bare = np.flatnonzero(np.bincount(row, minlength=rows) == 0)
    row, words, real = np.concatenate([row, bare]), np.concatenate([words, mix(bare)]), np.arange(len(row) + len(bare)) < len(row)
    order = np.lexsort((words, row))
    row, words, real = row[order], words[order], real[order]
    begin = np.flatnonzero(np.append(True, (np.diff(row) > 0) | (words[1:] != words[:-1])))
    n = np.diff(np.append(begin, len(row))) * real[begin]
    pairs = pa.StructArray.from_arrays([pa.array(words[begin].view(np.int64)), pa.array(n)], ["word", "k"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[begin], np.arange(rows + 1)), pa.int32()), pairs)


def score(docs: DataFrame, v: Vocabulary, weights: dict[str, np.ndarray], counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, pll (sum of log-probabilities), mean_logp of each text; null and wordless texts have 0 tokens, pll 0 and a null mean.

    With ``counts``, the table of ``count_words``, a word that shares its entry has the entry's probability times its count over the entry's count plus one,
    where the one is left for words never seen; without it, words are scored by their entries alone.
    """
    with_counts, share = counts is not None, -np.log1p(v.rest)

    def run(batches):
        for batch in batches:
            for i, words, first in _word_runs(batch.column("text")):
                own = v.ids(words)
                each = log_probabilities(weights, own, contexts(own, first, v.pad))
                n = np.diff(first)
                shared = np.flatnonzero(own >= v.known)
                if with_counts:
                    each[shared] += share[own[shared] - v.known]
                logs = np.concatenate([[0.0], np.cumsum(each)])
                pll = logs[first[1:]] - logs[first[:-1]]
                cols = [batch.column("doc_id").slice(i, len(n)), pa.array(n), pa.array(pll)]
                if with_counts:
                    cols.append(_lists(np.repeat(np.arange(len(n)), n)[shared], words[shared], len(n)))
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "pll", *(["tail"] if with_counts else [])]
    got = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, pll double" + ", tail array<struct<word: long, k: long>>" * with_counts)
    if with_counts:
        # One flow from the texts to the sums: a row's number is made once and stays with it.
        each = got.withColumn("_row", F.monotonically_increasing_id()).select("_row", "doc_id", "n_tokens", "pll", F.inline("tail"))
        part = F.when(F.col("k") > 0, F.col("k") * F.log(F.coalesce("n", F.lit(1)).cast("double"))).otherwise(0.0)
        got = each.join(counts, "word", "left").groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), (F.first("pll") + F.sum(part)).alias("pll"))
    return got.select("doc_id", "n_tokens", "pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_logp"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` (doc_id, text; other columns are ignored) and score each of its rows; repeated rows are each scored, an empty table gives none."""
    counts = cut_lineage(count_words(docs))
    v = vocabulary_of(counts)
    return score(docs, v, train(docs, v), counts)
