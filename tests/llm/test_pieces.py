"""The merge rounds against the library, id by id."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from pricewell.llm import pieces
from pricewell.llm.queries import PIECE_MODEL

PATH = public_tokenizers.path(PIECE_MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "  a  b ", "a\nb\t c\r\n", "ﬁ é ａ", "▁x▁▁y", "</s> <0x0A> <unk>", "\u0000a", "日本𐍈", "a" * 41, " " * 70, "x" + " " * 33 + "y", "abc" * 3000, " " * 3000, "\n" * 300,
         "tion" * 500 + " mentions", "l'été où ça", "١٢٣ 0123456789" * 20]


def library(text):
    ids = LIBRARY.encode(text, add_eos=True)
    return len(ids), " ".join(map(str, ids)), LIBRARY.decode(ids)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PATH)


def test_exact(model):
    random.seed(4)
    alphabet = "ab cdet \n\t▁  éñßü日本𐍈</s>0129\u0000ﬁáAAaaaannnn."
    texts = TEXTS + ["".join(random.choice(alphabet) for _ in range(random.randrange(80))) for _ in range(3000)]
    for text, got in zip(texts, pieces.encode_batch(model, texts), strict=True):
        assert got == library(text), repr(text[:80])


def test_heap_and_rounds_agree(model):
    random.seed(5)
    units = ["▁" + "".join(random.choice("etaoinshrdlucm") for _ in range(random.randrange(1, 30))) for _ in range(500)]
    for unit, got in zip(units, model.merge(units), strict=True):
        assert got == model.one_by_one([model.symbol[c] for c in unit])


def test_cache_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 50)
    texts = [f"word{i} and{i} more{i} text{i}" for i in range(400)]
    assert [x[1] for x in pieces.encode_batch(model, texts)] == [library(t)[1] for t in texts]


def test_documents(docs_of):
    texts = [*TEXTS, None, TEXTS[3]]
    docs = docs_of(texts, extra=["'x' AS ids", "1 AS n_tokens"])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in pieces.digest_documents(docs, PATH, with_ids=True).collect()}
    whole = {r.doc_id: r for r in pieces.encode_documents(docs, PATH).collect()}
    assert len(got) == len(texts) and pieces.digest_documents(docs_of([]), PATH).count() == 0
    for i, t in enumerate(texts):
        n, ids, back = library(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (n, sha(ids), sha(back))
        assert got[i].ids == whole[i].ids == [int(x) for x in ids.split()] and whole[i].decoded == back
