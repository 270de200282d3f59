"""Each stage of the pipeline against a brute-force version on a small fixture, and the whole run."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from pricewell.llm import pii
from pricewell.llm.queries import PIECE_MODEL
from tests.llm.test_neardup import brute

random.seed(12)
PARTS = {"en": "the of and ing tion er th re".split(), "fr": "eau que é ou les eux ai è".split()}


def prose(lang, n):
    return ["".join(random.choice(PARTS[lang]) for _ in range(random.randrange(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    items = [" ".join(prose("en", 25)) for _ in range(8)]
    texts = [(lang, prose(lang, random.randrange(30, 90))) for lang in ["en", "fr"] * 40]
    rows = [(lang, " ".join(w)) for lang, w in texts]
    rows += [(lang, " ".join([*w[:-1], "x"])) for lang, w in texts[:10]] + rows[10:14] * 2
    rows += [("en", f"{' '.join(prose('en', 20))} {item} {' '.join(prose('en', 10))}") for item in items]
    rows += [("en", " ".join(prose("en", 30)) + " +1 (212) 555-1234 and a.b@c.de"), ("en", None), (None, ""), ("fr", "12 34 !!"), (None, " ".join(prose("fr", 40)))]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, [t for _, t in rows], items


def test_stages(spark, home):
    path, texts, items = home
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language", "near_duplicates", "decontamination", "personal_data", "sentencepiece"]

    told = stage["language"](spark, docs, path).cache()
    have = {i: t for i, t in enumerate(texts) if t and any(map(str.isalpha, t))}
    assert told.columns == docs.columns and {r.doc_id: r.text for r in told.collect()} == have

    one = stage["near_duplicates"](spark, told, path).cache()
    have = {i: t for i, t in have.items() if brute(list(have.items()), 5)[i][1] == i}
    assert one.columns == docs.columns and {r.doc_id: r.text for r in one.collect()} == have

    clean = stage["decontamination"](spark, one, path).cache()
    have = {i: t for i, t in have.items() if not any(x in t for x in items)}
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in clean.collect()} == have

    safe = stage["personal_data"](spark, clean, path).cache()
    have = {i: pii.masked(t, pii.base_spans(t)) for i, t in have.items()}
    assert safe.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in safe.collect()} == {i: (t, len(t)) for i, t in have.items()}
    assert sum("[EMAIL]" in t and "[PHONE]" in t for t in have.values()) == 1

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))
    want = {i: library.encode(t, add_eos=True) for i, t in have.items()}
    got = stage["sentencepiece"](spark, safe, path).collect()
    assert {r.doc_id: r.ids for r in got} == want
    assert all(r.decoded_sha256 == hashlib.sha256(have[r.doc_id].encode()).hexdigest() for r in got)

    whole = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id: r.ids for r in whole} == want


def test_language_rejects_by_the_model(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(prose(lang, 60)), lang) for i, lang in enumerate(["en", "fr"] * 300)]
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(40)) for _ in range(20)]
    rows += [(1000 + i, t, None) for i, t in enumerate([*noise, "12 34 x !! 99", "12 34 !!", None, " ".join(prose("en", 40))])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == {*range(600), 1023}


def test_language_without_labels(spark):
    rows = [(1, "the of and"), (2, "12 34 !!"), (3, "\u00e9"), (4, ""), (5, None), (None, "of")]
    for lang, doc_id in (("NULL", "doc_id"), ("'en'", "CAST(NULL AS long)")):
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"{doc_id} AS doc_id", "text", f"CAST({lang} AS string) AS lang")
        assert sorted(r.text for r in corpus_pipeline.language(spark, docs, "").collect()) == ["of", "the of and", "\u00e9"]


def test_empty(spark, home, tmp_path):
    path, _, _ = home
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
