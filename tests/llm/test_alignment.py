"""Alignment of two tokenisers against plain counting with the libraries, the bitmaps, and the quick encoder against the library."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from pricewell.llm import alignment as A
from pricewell.llm.queries import BYTE_MODEL, PIECE_MODEL

PATHS = public_tokenizers.path(BYTE_MODEL), public_tokenizers.path(PIECE_MODEL)


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def alphabet():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {}, 0
    for b in range(256):
        if b in printable:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


def brute(texts, libraries):
    a, b = libraries
    back = alphabet()

    def ends(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    docs, count = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append(None)
            continue
        end_a, end_b = ends(bytes_a), ends(bytes_b)
        links = [(ids_a[i], ids_b[j]) for i, x in enumerate(end_a) for j, y in [(j, y) for j, y in enumerate(end_b) if y == x]]
        count.update(links)
        groups, i, j = [], 0, 0
        for e in sorted(set(end_a) & set(end_b)):
            p, q = end_a.index(e) + 1, end_b.index(e) + 1
            groups.append(",".join(map(str, ids_a[i:p])) + "|" + ",".join(map(str, ids_b[j:q])))
            i, j = p, q
        docs.append((len(ids_a), len(ids_b), links, ";".join(groups), len(groups)))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for i, d in enumerate(docs):
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups, n = d
            out.append((i, n_a, n_b, n, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest()))
    return out


TEXTS = ["Hello world", "", None, " ", "  two  spaces ", "a▁b", "<s> </s> <|endoftext|> <unk> <0x41>", "naïve café ÀÉ", "日本語 テスト", "👍🏽 ok", "\x00\x01", "line\nline\r\n\ttab",
         "it's we'll I'M 123 4567 x86", "a b  c \u0085d \u001ce", "٣٤ ก ſ ǅ ΐ", "aaaaaaaa" * 40, "of of of of the the", "﻿bom", "é combining", "!!!??? ... ---"]


def test_brute(spark, libraries):
    rng = random.Random(3)
    parts = [t for t in TEXTS if t] + ["of", "the", "tion", "ing"]
    texts = [*TEXTS, *[rng.choice(["", " ", "\n"]).join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(120)], *["the same text"] * 40]
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, chunk int").repartition(3)
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for size in (500, 8 << 20):
        got = A.align_documents(docs, *PATHS, chunk_bytes=size).select(cols).collect()
        assert sorted(map(tuple, got)) == brute(texts, libraries)


def test_quick_encoder_is_the_library(libraries):
    """Every character that is left to the quick encoder, beside letters, digits, spaces and itself."""
    tool = A.ByteTokens(PATHS[0])
    chars = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x20AC] if A._PLAIN.fullmatch(chr(c))]
    assert len(chars) > 600
    for c in chars:
        for text in (f" a{c}b{c}{c} {c}1{c} {c}{c}  {c}'s{c}", f"{c}", f"{c} {c}\n{c}.{c}"):
            assert tool.quick.encode_ordinary(text) == libraries[0].encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_long_units(libraries):
    tool = A.ByteTokens(PATHS[0])
    for text in ("a" * 30_000, " " * 30_000, "ab!" * 5000):
        assert tool.ids(text).tolist() == libraries[0].encode(text, add_special_tokens=False).ids


def test_bitmaps():
    rng = np.random.default_rng(1)
    for docs, n in ((9, 40), (3000, 30_000), (65536, 200_000)):
        pair = rng.choice([3, 3, 3, 70_000, 1_500_000_000], n)
        doc = rng.integers(0, docs, n)
        want = Counter(zip(pair.tolist(), doc.tolist(), strict=True))
        keys, planes = A._index(pair.astype(np.int64) << 16 | doc, docs)
        got = Counter()
        for p, x in zip(keys.tolist(), planes, strict=True):
            for k, plane in enumerate(A.unpack(x)):
                got.update({(p, d): 1 << k for d in A.positions(*plane).tolist()})
            assert A.popcounts(x) == (len({d for q, d in want if q == p}), sum(m for (q, _), m in want.items() if q == p))
        assert got == want


def test_counts(spark):
    docs = spark.createDataFrame([(1, "of the of the"), (2, "of the"), (3, None)], "doc_id long, text string")
    import tempfile

    _, index = A.build_index(docs, *PATHS, tempfile.mkdtemp(prefix="spark-") + "/x")
    assert sorted((r.n_docs, r.n_links, r.best) for r in A.pair_counts(index).collect()) == [(2, 3, True), (2, 3, True)]


def test_empty(spark):
    assert A.align_documents(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []
