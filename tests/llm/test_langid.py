"""Mixtures against plain EM, and accuracy on rows that were not learned from."""

import random

import numpy as np
import pyarrow as pa

from pricewell.llm import langid
from pricewell.llm.textarrays import text_bytes

PARTS = {"en": "the of and ing tion er th re".split(), "de": "ch sch ung ein der ge heit ü".split(), "fr": "eau que é ou les eux ai è".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_trigrams():
    texts = ["ab c", "", None, "É9é", "  ", "a"]
    bucket, word, first = langid.trigrams(*text_bytes(pa.array(texts, pa.string())))
    assert np.diff(first).tolist() == [2, 0, 0, 2, 0, 1]
    one = langid.trigrams(*text_bytes(pa.array(["c"])))[0]
    # A row's edge ends its words just as a space does.
    assert bucket[2] == one[0] and len(bucket) == 8


def test_mixture_is_em():
    rng = np.random.default_rng(2)
    like, first = rng.random((50, 3)).astype(np.float32), np.array([0, 20])
    share, score = langid._mix(like, first, np.full((2, 3), 1 / 3, np.float32), 5)
    for r, part in enumerate((like[:20], like[20:])):
        pi = np.full(3, 1 / 3)
        for _ in range(5):
            post = part * pi
            pi = (post / post.sum(1, keepdims=True)).mean(0)
        assert np.allclose(share[r], pi, atol=1e-5) and np.isclose(score[r], np.log(part @ pi).sum(), rtol=1e-5)


def test_accuracy_and_cases(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randrange(3, 120)), lang) for i, lang in enumerate(rng.choice(list(PARTS)) for _ in range(600))]
    mixed = [(1000 + i, prose(rng, "en", 100) + "\n" + prose(rng, "de", 60), None) for i in range(20)]
    odd = [(2000, None, "en"), (2001, "", None), (2002, "12 345 --- !!", "fr"), (2003, "日本語", None), (None, prose(rng, "fr", 50), "fr"), (2004, prose(rng, "de", 30_000), "de"), rows[0]]
    docs = spark.createDataFrame(rows + mixed + odd, "doc_id long, text string, lang string").selectExpr("*", "'q' AS source", "1 AS score", "2 AS _fit2")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + len(mixed) + len(odd)
    by = {r.doc_id: r for r in got}
    from zlib import crc32

    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(by[i].lang_pred, lang) for i, _, lang in rows if by[i].held_out]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [by[i].lang_pred for i in (2000, 2001, 2002)] == ["und"] * 3 and by[2003].lang_pred != "und" and by[None].lang_pred == "fr" and by[2004].lang_pred == "de"
    assert sum(by[1000 + i].n_langs == 2 and by[1000 + i].lang_pred == "en" and 0.4 < by[1000 + i].score < 0.8 for i in range(20)) >= 18
    assert all(0 <= r.score <= 1 for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs).first().lang_pred == "und" and langid.identify(docs.limit(0)).count() == 0
