"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores the pairs.

Words are runs of letters and digits, A-Z lower-cased, compared by hash.  A first pass counts in how many documents each n-gram of the benchmark occurs; of each
item the rarest three quarters become seeds (a rank inside the item, so an item that leaked into many documents keeps its seeds).  A second pass finds
the seeds in every text; seeds of one item on near diagonals open a region, and the item is aligned locally with the region's words.  The benchmark is
the query set: it is taken in blocks of bounded size, each joined map-side with all documents, so neither pass shuffles a text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import SIGNS, runs, shingles, span_hashes, text_bytes, word_spans

SEED = 3
RARE = 0.75
#: Words of items that one block holds; about 40 bytes each travel with the tasks.
BLOCK_WORDS = 500_000
MATCH, MISS, GAP = 1.0, -0.5, -0.5
#: A passage counts if its score is this share of the item's words, and at least LEAST (or the whole of a shorter item).
SHARE, LEAST = 0.4, 6.0
_FILTER_BITS = 22


def words_of(text: str) -> np.ndarray:
    buf, off = text_bytes(pa.array([text], pa.string()))
    starts, ends, _ = word_spans(buf, off, SIGNS)
    return span_hashes(buf, starts, ends)


def grams_of(words: np.ndarray) -> np.ndarray:
    return shingles(words, np.array([0, len(words)]), SEED)[0]


def align(item: np.ndarray, region: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: (score, first and past-the-last word of the region)."""

    def best(a, b):
        step = -GAP * np.arange(len(b))
        row, top, end = np.zeros(len(b) + 1), 0.0, (0, 0)
        for i, word in enumerate(a):
            new = np.maximum(np.maximum(row[:-1] + np.where(b == word, MATCH, MISS), row[1:] + GAP), 0)
            new = np.maximum.accumulate(new + step) - step
            row = np.concatenate([[0.0], new])
            at = int(new.argmax()) if len(new) else 0
            if len(new) and new[at] > top:
                top, end = float(new[at]), (i + 1, at + 1)
        return top, end

    score, (i, j) = best(item, region)
    if not score:
        return 0.0, 0, 0
    _, (_, back) = best(item[:i][::-1], region[:j][::-1])
    return score, j - back, j


class Seeds:
    """Sorted n-grams of a block of items with the (item, place) pairs that hold them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], grams: list[np.ndarray], keep=None):
        rows = [(g, k, q) for k, own in enumerate(grams) for q, g in enumerate(own.tolist()) if keep is None or g in keep[k]]
        rows.sort()
        self.items = items
        table = np.array(rows, np.uint64).reshape(-1, 3)
        self.gram, first = np.unique(table[:, 0], return_index=True)
        self.first = np.append(first, len(table)).astype(np.int64)
        self.item, self.place = table[:, 1].astype(np.int64), table[:, 2].astype(np.int64)
        self.mask = np.zeros(1 << _FILTER_BITS, bool)
        self.mask[self._slot(self.gram)] = True

    @staticmethod
    def _slot(gram):
        return (gram >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, places in ``gram``) of those grams that are seeds."""
        at = np.flatnonzero(self.mask[self._slot(grams)])
        if not len(at) or not len(self.gram):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.gram, grams[at]), len(self.gram) - 1)
        ok = self.gram[k] == grams[at]
        return at[ok], k[ok]


def _scan(column, seeds: Seeds):
    """One run of rows at a time, if it holds seeds: (first row, bytes, starts, ends, words, each row's first word, row and word of the hits, their seeds)."""
    buf, off = text_bytes(column)
    for i, j in runs(off):
        part, at = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, first = word_spans(part, at, SIGNS)
        words = span_hashes(part, starts, ends)
        grams, rows = shingles(words, first, SEED)
        hit, seed = seeds.find(grams)
        if len(hit):
            row = np.searchsorted(rows, hit, "right") - 1
            yield i, part, at, starts, ends, words, first, row, first[row] + hit - rows[row], seed


def _counter(seeds: Seeds):
    def run(batches):
        total = np.zeros(len(seeds.gram), np.int64)
        for batch in batches:
            for *_, row, _, seed in _scan(batch.column("text"), seeds):
                total += np.bincount(np.unique(row * len(total) + seed) % len(total), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    return run


def passages(row: np.ndarray, word: np.ndarray, seed: np.ndarray, seeds: Seeds, first: np.ndarray, words: np.ndarray):
    """(row, item, score, first word, past-the-last word) of the passages of one run that reach the threshold."""
    count = seeds.first[seed + 1] - seeds.first[seed]
    entry = np.repeat(seeds.first[seed], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    row, item = np.repeat(row, count), seeds.item[entry]
    diagonal = np.repeat(word, count) - seeds.place[entry]
    order = np.lexsort((diagonal, item, row))
    row, item, diagonal = row[order], item[order], diagonal[order]
    size = np.array([len(w) for _, w in seeds.items])[item]
    new = np.append(True, (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) > size[1:]))
    begin = np.flatnonzero(new)
    for a, z in zip(begin, np.append(begin[1:], len(row)), strict=True):
        own = seeds.items[item[a]][1]
        slack = len(own) // 4 + 2
        lo, hi = max(first[row[a]], diagonal[a] - slack), min(first[row[a] + 1], diagonal[z - 1] + len(own) + slack)
        score, x, y = align(own, words[lo:hi])
        if score >= max(SHARE * len(own), min(len(own), LEAST)):
            yield row[a], item[a], score / len(own), lo + x, lo + y


def _matches(batch, seeds: Seeds):
    """(row, item id, score, start, end in code points) of the passages of a batch."""
    for i, part, at, starts, ends, words, first, row, word, seed in _scan(batch.column("text"), seeds):
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        for r, k, score, x, y in passages(row, word, seed, seeds, first, words):
            yield i + r, seeds.items[k][0], score, chars[starts[x]] - chars[at[r]], chars[ends[y - 1]] - chars[at[r]]


def _reporter(seeds: Seeds):
    def run(batches):
        for batch in batches:
            found = list(zip(*_matches(batch, seeds), strict=True))
            if found:
                ids = batch.column("doc_id").take(pa.array(found[0]))
                rest = [pa.array(list(c), t) for c, t in zip(found[1:], (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "item_id", "score", "start", "end"])

    return run


def _sieve(seeds: Seeds):
    def run(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[m[0] for m in _matches(batch, seeds)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _blocks(benchmark: DataFrame):
    """Blocks of items (id, words), read from Spark row by row."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        words = words_of(r.text) if r.text else np.zeros(0, np.uint64)
        if len(words) < SEED or r.item_id is None:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.item_id, words))
        size += len(words)
    if block:
        yield block


def block_seeds(docs: DataFrame, items: list[tuple[int, np.ndarray]]) -> Seeds:
    """The seeds of one block: of each item the rarest n-grams by the number of documents that hold them."""
    grams = [grams_of(w) for _, w in items]
    every = Seeds(items, grams)
    counts = docs.select("text").mapInArrow(_counter(every), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(every.gram), np.int64)
    for r in counts:
        df[r.k] = r.n
    keep = []
    for own in grams:
        ranked = sorted(set(own.tolist()), key=lambda g: (df[np.searchsorted(every.gram, np.uint64(g))], g))
        keep.append(set(ranked[: int(np.ceil(RARE * len(ranked)))]))
    return Seeds(items, grams, keep)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, start, end (code points): every passage of ``docs`` (doc_id, text) that copies an item of ``benchmark`` (item_id, text).

    ``score`` is the alignment's score by word of the item, 1 for a full copy.  Null and empty texts match nothing, nor do items of fewer than three words or
    a null id (nothing tells them from chance); repeated rows are each reported; empty tables give an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, item_id long, score double, start long, end long"
    docs = docs.select("doc_id", "text")
    found = [docs.mapInArrow(_reporter(block_seeds(docs, items)), out) for items in _blocks(benchmark)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], out)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of ``benchmark``, whole and with all their columns."""
    clean = docs
    for items in _blocks(benchmark):
        clean = clean.mapInArrow(_sieve(block_seeds(docs, items)), docs.schema)
    return clean
