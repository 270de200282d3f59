"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, over overlapping windows of words.

A word enters as its own vector, if the training sample knows it, beside the mean vector of its byte 3-grams and 5-grams.  Two gated recurrences read a window
from both sides, attention pools their states, a logistic unit scores the window.  A text's score is a logistic function of all its windows' scores (the two
highest, their sum, mean and number), fitted on a quarter of the sample that the network has not seen.  Labels are of whole texts: in training a text of
label 1 stands for its most suspicious window (first by word log-odds, then by the network), one of label 0 for its worst and a random window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed
from .langid import held_out
from .textarrays import SIGNS, runs, span_hashes, text_bytes, word_spans

LENGTH, STRIDE = 40, 20
#: Bounds of the training sample: texts of either label, those of the least hash, and words with a vector of their own.
SAMPLE, WORDS = 1500, 20_000
GRAM_BITS, WIDTH, HIDDEN, ATTENTION = 14, 12, 8, 8
EPOCHS, BATCH, RATE, DROP = 8, 64, 0.01, 0.2
THRESHOLD = 0.3
STRETCH = 2048

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters."""
    out = _FOLD[buf].astype(np.uint8)
    accent = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
    out[accent] += 32
    return out


def word_grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte 3-grams and 5-grams of each word, its edges included, and the first of each word."""
    size = ends - starts
    wide = np.zeros(int(size.sum()) + 4 * len(size), np.uint64)
    first = np.cumsum(size + 4) - (size + 4)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    wide[np.repeat(first + 1, size) + inside] = buf[np.repeat(starts, size) + inside]
    at = np.repeat(first, size) + inside
    code = (wide[at] << np.uint64(16)) | (wide[at + 1] << np.uint64(8)) | wide[at + 2]
    long = (code << np.uint64(16)) | (wide[at + 3] << np.uint64(8)) | wide[at + 4] | np.uint64(1 << 40)
    both = np.stack([code, long], axis=1).ravel() * np.uint64(0x9E3779B97F4A7C15)
    return (both >> np.uint64(64 - GRAM_BITS)).astype(np.int64), 2 * (np.cumsum(size) - size)


def scatter(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of ``values`` by place."""
    out = np.zeros((rows, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
        out[at[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def windows(first: np.ndarray, length: int = LENGTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size (words) of the windows that cover each row's words, and each row's first window."""
    count = np.diff(first)
    many = np.where(count > length, -(-(count - length) // stride) + 1, (count > 0).astype(count.dtype))
    at = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(count)), many)
    step = (np.arange(at[-1]) - at[:-1][row]) * stride
    return first[:-1][row] + step, np.minimum(count[row] - step, length), at


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """Parameters and both passes of the network."""

    def __init__(self, words: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        put = lambda *shape, scale=None: (rng.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)
        h, d = HIDDEN, 2 * WIDTH
        self.p = {"word": put(words + 1, WIDTH, scale=0.3), "gram": put(1 << GRAM_BITS, WIDTH, scale=0.5), "Wa": put(2 * h, ATTENTION), "ba": put(ATTENTION, scale=0.01),
                  "va": put(ATTENTION), "wo": put(2 * h), "bo": np.zeros(1, np.float32)}
        for s in "fb":
            self.p |= {f"Wx{s}": put(d, 3 * h), f"bx{s}": np.zeros(3 * h, np.float32), f"U{s}": put(h, 2 * h), f"V{s}": put(h, h)}
        self.first = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0

    def inputs(self, known: np.ndarray, gram: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(words, 2 WIDTH) input vectors of distinct words."""
        count = np.diff(np.append(first, len(gram)))[:, None]
        return np.concatenate([self.p["word"][known], np.add.reduceat(self.p["gram"][gram], first, axis=0) / count], axis=1)

    def states(self, gx: np.ndarray, at: np.ndarray, size: np.ndarray, side: str, keep=None) -> np.ndarray:
        """(windows, LENGTH, HIDDEN) states of one recurrence; ``gx``: gate inputs of the distinct words, ``at``: words of the windows."""
        p, h, n = self.p, HIDDEN, len(at)
        out = np.zeros((n, at.shape[1], h), np.float32)
        state = np.zeros((n, h), np.float32)
        for t in range(at.shape[1]) if side == "f" else range(at.shape[1] - 1, -1, -1):
            live = (t < size)[:, None]
            g = gx[at[:, t]]
            zr = _sigmoid(g[:, : 2 * h] + state @ p[f"U{side}"])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(g[:, 2 * h :] + (r * state) @ p[f"V{side}"])
            if keep is not None:
                keep.append((t, live, state, z, r, new))
            state = np.where(live, new + z * (state - new), state)
            out[:, t] = state
        return out

    def pool(self, both: np.ndarray, size: np.ndarray):
        p = self.p
        u = np.tanh(both @ p["Wa"] + p["ba"])
        s = np.where(np.arange(both.shape[1]) < size[:, None], u @ p["va"], -np.inf)
        a = np.exp(s - s.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        c = np.einsum("nt,nth->nh", a, both)
        return u, a, c, c @ p["wo"] + p["bo"][0]

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p[f"Wx{s}"] + self.p[f"bx{s}"] for s in "fb"]

    def score(self, gates: list[np.ndarray], at: np.ndarray, size: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.states(g, at, size, s) for g, s in zip(gates, "fb", strict=True)], axis=2)
        return self.pool(both, size)[3]

    def score_all(self, gates: list[np.ndarray], place: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logits of windows, a stretch of them at a time."""
        cuts = [slice(k, k + STRETCH) for k in range(0, len(start), STRETCH)]
        return np.concatenate([self.score(gates, _matrix(place, start[c], size[c]), size[c]) for c in cuts]) if cuts else np.zeros(0, np.float32)

    def learn(self, known, gram, first, at, size, label, weight) -> float:
        """One step on a batch of windows over its distinct words."""
        p, h = self.p, HIDDEN
        x = self.inputs(known, gram, first)
        kept = {"f": [], "b": []}
        both = np.concatenate([self.states(g, at, size, s, kept[s]) for g, s in zip(self.gates(x), "fb", strict=True)], axis=2)
        u, a, c, logit = self.pool(both, size)
        prob = _sigmoid(logit)
        d = (weight * (prob - label) / len(label)).astype(np.float32)
        grad = {"wo": c.T @ d, "bo": np.array([d.sum()], np.float32)}
        dc = d[:, None] * p["wo"]
        da = np.einsum("nth,nh->nt", both, dc)
        ds = a * (da - (a * da).sum(1, keepdims=True))
        du = ds[:, :, None] * p["va"] * (1 - u * u)
        dh = a[:, :, None] * dc[:, None, :] + du @ p["Wa"].T
        grad |= {"va": np.einsum("nta,nt->a", u, ds), "Wa": np.einsum("nth,nta->ha", both, du), "ba": du.sum((0, 1))}
        dx = np.zeros_like(x)
        for s, part in (("f", dh[:, :, :h]), ("b", dh[:, :, h:])):
            U, V = p[f"U{s}"], p[f"V{s}"]
            gU, gV, parts = np.zeros_like(U), np.zeros_like(V), []
            back = np.zeros((len(at), h), np.float32)
            for t, live, state, z, r, new in reversed(kept[s]):
                back = back + part[:, t]
                on = back * live
                dn = on * (1 - z) * (1 - new * new)
                dz = on * (state - new) * z * (1 - z)
                drh = dn @ V.T
                dr = drh * state * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                gU += state.T @ dzr
                gV += (r * state).T @ dn
                parts.append((at[:, t], np.concatenate([dzr, dn], axis=1)))
                back = back * ~live + on * z + drh * r + dzr @ U.T
            dg = scatter(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts]), len(x))
            grad |= {f"U{s}": gU, f"V{s}": gV, f"Wx{s}": x.T @ dg, f"bx{s}": dg.sum(0)}
            dx += dg @ p[f"Wx{s}"].T
        count = np.diff(np.append(first, len(gram)))
        grad["word"] = scatter(known, dx[:, :WIDTH], len(p["word"]))
        grad["gram"] = scatter(gram, np.repeat(dx[:, WIDTH:] / count[:, None], count, axis=0), len(p["gram"]))
        self.adam(grad)
        return float(-(weight * np.log(np.maximum(np.where(label > 0, prob, 1 - prob), 1e-7))).mean())

    def adam(self, grad: dict) -> None:
        self.steps += 1
        for k, g in grad.items():
            m, v = self.first[k], self.second[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.p[k] -= RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def _words(column):
    """One run of rows at a time: (first row, distinct word hashes, their trigrams, words as places in them, each row's first word)."""
    buf, off = text_bytes(column)
    for i, j in runs(off):
        part, at = fold(buf[off[i] : off[j]]), off[i : j + 1] - off[i]
        starts, ends, first = word_spans(part, at, SIGNS)
        hashes, once, place = np.unique(span_hashes(part, starts, ends), return_index=True, return_inverse=True)
        grams = word_grams(part, starts[once], ends[once])
        # A word repeated on the spot is read once.
        fresh = np.append(True, np.diff(place) != 0)[: len(place)]
        fresh[first[:-1][first[:-1] < len(place)]] = True
        total = np.concatenate([[0], np.cumsum(fresh)])
        yield i, hashes, grams, place[fresh], total[first]


def _look_up(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """1 + place of each hash in the sorted vocabulary, 0 if it is unknown."""
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def _matrix(place: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(windows, LENGTH) words of the windows; places past the end repeat a word and are masked."""
    if not len(place):
        return np.zeros((0, LENGTH), np.int64)
    return place[np.minimum(start[:, None] + np.arange(LENGTH), len(place) - 1)]


def features(logit: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, 6) what a text's score depends on, from the logits of its windows (``at``: first window of each row, every row has one)."""
    count = np.diff(np.append(at, len(logit)))
    prob = _sigmoid(logit)
    top = np.maximum.reduceat(logit, at)
    row = np.repeat(np.arange(len(at)), count)
    best = np.flatnonzero(logit == top[row])
    rest = logit.copy()
    rest[best[np.append(True, np.diff(row[best]) > 0)]] = -12
    total = np.add.reduceat(prob, at)
    second = np.maximum(np.maximum.reduceat(rest, at), -12)
    return np.stack([np.ones(len(at)), np.clip(top, -12, 12), second, np.log(total + 0.01), total / count, np.log(count)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gap = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gap)
    return w


def train(texts: list[str], labels: np.ndarray, seed: int = 7):
    """(vocabulary, network, text coefficients, rate of label 1); the network is None unless both labels occur."""
    labels = np.asarray(labels, np.float32)
    rate = float(labels.mean()) if len(labels) else 0.0
    none = (np.zeros(0, np.uint64), None, None, rate)
    if not 0 < rate < 1:
        return none
    parts = list(_words(pa.array(texts, pa.string())))
    hashes, once = np.unique(np.concatenate([x[1] for x in parts]), return_index=True)
    size = np.concatenate([np.diff(np.append(first, len(gram))) for _, _, (gram, first), _, _ in parts])
    gram = np.concatenate([x[2][0] for x in parts])
    begin = np.cumsum(size) - size
    word_at = [gram[begin[k] : begin[k] + size[k]] for k in once]
    flat_at, flat_first = np.concatenate(word_at), np.cumsum([0, *map(len, word_at)])[:-1]
    place = np.concatenate([np.searchsorted(hashes, own)[there] for _, own, _, there, _ in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[4]) for x in parts]))])
    start, n, at = windows(first)
    full = np.flatnonzero(np.diff(at))
    fit_rows = full[full % 4 > 0]
    if len(set(labels[fit_rows])) < 2:
        return none

    # Texts that hold a word, by label: the vocabulary and the log-odds that choose the first windows.
    df = np.zeros((2, len(hashes)))
    for r in fit_rows:
        df[int(labels[r]), np.unique(place[first[r] : first[r + 1]])] += 1
    often = np.argsort(-df.sum(0), kind="stable")[:WORDS]
    vocabulary = np.sort(hashes[often[df.sum(0)[often] > 1]])
    known = _look_up(vocabulary, hashes)
    odds = np.log((df[1] + 0.5) / (labels[fit_rows].sum() + 1)) - np.log((df[0] + 0.5) / ((1 - labels[fit_rows]).sum() + 1))
    odds = np.where(df[1] > 1, np.maximum(odds - 1, 0), 0)[place]
    total = np.concatenate([[0], np.cumsum(odds)])
    guess = total[start + n] - total[start]

    net, rng = Net(len(vocabulary), seed), np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        if epoch >= 2:
            guess = net.score_all(net.gates(net.inputs(known, flat_at, flat_first)), place, start, n)
        worst = {r: at[r] + int(np.argmax(guess[at[r] : at[r + 1]])) for r in fit_rows}
        yes, no = [worst[r] for r in fit_rows if labels[r] > 0], [r for r in fit_rows if labels[r] == 0]
        picks = [(w, 1.0) for w in yes] + [(int(rng.integers(at[r], at[r + 1])), 0.0) for r in no] + [(worst[r], 0.0) for r in no if epoch >= 1]
        weight = min(10.0, (len(picks) - len(yes)) / len(yes))
        order = rng.permutation(len(picks))
        for k in range(0, len(order), BATCH):
            w, label = np.array([picks[o] for o in order[k : k + BATCH]]).T
            w = w.astype(np.int64)
            words, cell = np.unique(_matrix(place, start[w], n[w]), return_inverse=True)
            own = [word_at[x] for x in words]
            hidden = np.where(rng.random(len(words)) < DROP, 0, known[words])
            net.learn(hidden, np.concatenate(own), np.cumsum([0, *map(len, own)])[:-1], cell.reshape(len(w), LENGTH), n[w], label.astype(np.float32),
                      np.where(label > 0, weight, 1).astype(np.float32))
    logit = net.score_all(net.gates(net.inputs(known, flat_at, flat_first)), place, start, n)
    x = features(logit, at[:-1][full])
    fresh = full % 4 == 0
    fresh = fresh if len(set(labels[full[fresh]])) > 1 else np.ones(len(full), bool)
    return vocabulary, net, logistic(x[fresh], labels[full[fresh]]), rate


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE):
    """Train on the labelled texts where ``learn`` holds: of either label at most ``sample``, those of the least hash of their id."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learn).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    marked = [(r.doc_id, r.toxic) for r in least_hashed(marked, "toxic", "doc_id", sample).collect()]
    toxic = dict(sorted(marked))
    rows = docs.where(F.col("doc_id").isin(list(toxic)) & F.col("text").isNotNull()).select("doc_id", "text").collect()
    rows = sorted((r.doc_id, r.text) for r in rows)
    return train([t for _, t in rows], np.array([toxic[i] for i, _ in rows], np.float32))


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of each text; null texts and texts without a word score 0, and the rate of label 1 stands for an untrained network."""
    vocabulary, net, final, rate = model
    weights = net.p if net else None

    def run(batches):
        own = Net(0)
        if weights:
            own.p = weights
        for batch in batches:
            for i, hashes, (gram, begin), place, first in _words(batch.column("text")):
                n = len(first) - 1
                score = np.zeros(n)
                start, size, at = windows(first)
                full = np.flatnonzero(np.diff(at))
                if weights and len(start):
                    logit = own.score_all(own.gates(own.inputs(_look_up(vocabulary, hashes), gram, begin)), place, start, size)
                    score[full] = _sigmoid(features(logit, at[:-1][full]) @ final)
                elif len(start):
                    score[full] = rate
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def judge(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, toxic) of the rows that are not held out.

    Rows without a label or of other labels are not learned from; repeated rows are each scored; empty tables give an empty result.
    """
    model = fit(docs, labels, ~held_out(F.col("doc_id"), mod, rest))
    got = predict(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
