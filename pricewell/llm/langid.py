"""Language of a text by multilingual mixture inference.

A text is a mixture of languages.  Each word's likelihood in each language comes from hashed byte trigrams; expectation-maximisation estimates the languages'
proportions over all words of the text, and the set of languages is chosen by penalised likelihood: from all languages the least is dropped again and
again, and the set of the highest log-likelihood less ``PENALTY * log(words)`` for each language wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least_hashed
from .textarrays import runs, text_bytes

BUCKETS = 1 << 16
#: Bound of the training sample: texts of each language, those of the least hash.
SAMPLE = 3000
SMOOTH = 0.5
PENALTY = 3.0
FULL_STEPS, DROP_STEPS = 8, 4
UND = "und"

# Classes of bytes: 0 for anything that is no letter, A-Z as a-z, every byte of other characters as itself.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram that ends at or just after each letter, first trigram of each word, first word of each row."""
    # A gap between rows keeps words apart.
    rows = len(off) - 1
    wide = np.zeros(len(buf) + rows + 2, np.int64)
    at = np.arange(len(buf)) + np.repeat(np.arange(rows), np.diff(off)) + 1
    wide[at] = _CLASS[buf]
    ink = wide > 0
    tri = (wide[:-2] * 155 + wide[1:-1]) * 155 + wide[2:]
    # tri[i] has its middle at i + 1: one trigram for each letter, with its neighbours.
    middle = np.flatnonzero(ink[1:-1])
    bucket = ((tri[middle].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    start = ~ink[middle]
    row_at = np.searchsorted(middle, off + np.arange(rows + 1))
    word = np.flatnonzero(start)
    return bucket, word, np.searchsorted(word, row_at)


def _count(batches):
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        buf, off = text_bytes(batch.column("text"))
        seen = {}
        for i, j in runs(off):
            bucket, word, first = trigrams(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            ends = np.append(word, len(bucket))[first]
            for r in range(j - i):
                got = np.bincount(bucket[ends[r] : ends[r + 1]], minlength=BUCKETS)
                seen[langs[i + r]] = seen.get(langs[i + r], 0) + got
        for lang, got in seen.items():
            at = np.flatnonzero(got)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(got[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by bucket and language) from the rows of ``docs`` (doc_id, text, lang) where ``learn`` holds.

    At most ``sample`` texts of each language count, those of the least hash of their id; the counts are summed by Spark, and what reaches the driver is bounded
    by languages times buckets.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = [r.doc_id for r in least_hashed(rows.select("doc_id", "lang"), "lang", "doc_id", sample).select("doc_id").distinct().collect()]
    counts = rows.where(F.col("doc_id").isin(ids)).select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long")
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in got})
    table = np.full((BUCKETS, max(1, len(langs))), SMOOTH)
    for r in got:
        table[r.bucket, langs.index(r.lang)] += r.n
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def _mix(like: np.ndarray, first: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over the words of each row (``first``: non-empty stretches): (shares, log-likelihood of the words, without their scale)."""
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(like))))
    count = np.bincount(row, minlength=len(first))[:, None]
    for _ in range(steps):
        part = like * share[row]
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, first, axis=0) / count
    total = np.log(np.maximum((like * share[row]).sum(1), 1e-37))
    return share, np.add.reduceat(total, first)


def mixtures(buf, off, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: shares of the chosen languages (rows x languages), words, log-likelihood per trigram, trigrams."""
    bucket, word, first = trigrams(buf, off)
    rows, langs = len(off) - 1, table.shape[1]
    shares, words = np.zeros((rows, langs)), np.diff(first)
    grams = np.diff(np.append(word, len(bucket))[first])
    fit_ = np.zeros(rows)
    full = np.flatnonzero(words)
    if not len(full):
        return shares, words, fit_, grams
    log = np.add.reduceat(table[bucket], word, axis=0)
    top = log.max(1, keepdims=True)
    like = np.exp(np.maximum(log - top, -60))
    begin = first[:-1][full]
    scale = np.add.reduceat(top[:, 0].astype(np.float64), begin)
    alive = np.ones((len(full), langs), bool)
    share, score = _mix(like, begin, np.full((len(full), langs), 1 / langs, np.float32), FULL_STEPS)
    cost = PENALTY * np.log(words[full] + 1)
    best, best_share, best_like = score - cost * langs, share, score
    for left in range(langs - 1, 0, -1):
        least = np.where(alive, share, np.inf).argmin(1)
        alive[np.arange(len(full)), least] = False
        share = np.where(alive, np.maximum(share, 1e-6), 0)
        share, score = _mix(like, begin, (share / share.sum(1, keepdims=True)).astype(np.float32), DROP_STEPS if left > 1 else 0)
        better = score - cost * left > best
        best = np.where(better, score - cost * left, best)
        best_share, best_like = np.where(better[:, None], share, best_share), np.where(better, score, best_like)
    shares[full] = best_share
    fit_[full] = (best_like + scale) / np.maximum(grams[full], 1)
    return shares, words, fit_, grams


def _has_letter(text) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """``docs`` with _lang_pred, _score, _n_langs, _fit of each text; every column and row stays.

    ``_score`` is the smoothed share of the predicted language; null texts and texts without a letter, and all texts if nothing was learned, give ``und`` and 0.
    """
    names = [*docs.columns, "_lang_pred", "_score", "_n_langs", "_fit"]

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            buf, off = text_bytes(column)
            for i, j in runs(off):
                part, at, n = buf[off[i] : off[j]], off[i : j + 1] - off[i], j - i
                shares, words, fit_, grams = mixtures(part, at, table)
                top = shares.argmax(1) if len(langs) else np.zeros(n, int)
                score = (words * shares[np.arange(n), top] + SMOOTH) / (words + SMOOTH * len(langs)) if len(langs) else np.zeros(n)
                plain = _ascii_letters(part, at)
                known = [bool(langs) and bool(plain[r] or _has_letter(column[i + r].as_py())) for r in range(n)]
                pred = [langs[top[r]] if known[r] else UND for r in range(n)]
                own = [pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array((shares > 0).sum(1)), pa.array(fit_)]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, n) for c in batch.columns), *own], names)

    found = T.StructType(list(docs.schema.fields))
    for name, kind in zip(names[-4:], (T.StringType(), T.DoubleType(), T.LongType(), T.DoubleType()), strict=True):
        found = found.add(name, kind)
    return docs.mapInArrow(run, found)


def _ascii_letters(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row holds an ASCII letter."""
    total = np.concatenate([[0], np.cumsum((_CLASS[buf] > 0) & (buf < 128))])
    return total[off[1:]] > total[off[:-1]]


def identify(docs: DataFrame, mod: int = 5, rest: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_langs, fit of each row of ``docs`` (doc_id, text, lang), learned from the rows that are not held out.

    Null texts are ``und``; repeated rows are each predicted; rows of a null lang are not learned from; an empty table gives an empty result.
    """
    langs, table = fit(docs, ~held_out(F.col("doc_id"), mod, rest), sample)
    got = predict(docs.select("doc_id", "text"), langs, table)
    names = {c: c[1:] for c in ("_lang_pred", "_score", "_n_langs", "_fit")}
    return got.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), *[F.col(a).alias(b) for a, b in names.items()])
