"""Alignment of two tokenisations of the same texts by inverted pair bitmaps.

One pass cuts the texts into chunks of documents.  In a chunk every pair of ids that end together (a link) has compressed bitmaps of documents: plane k holds
the documents in which the pair has bit k of its number of links set.  The planes of a pair OR-ed give its documents; their population counts, times the
powers of two, give its links.  Bitmaps of different chunks never share a document, so merging them adds their population counts, which combines on the map
side.  The counts then go back along the postings: every bitmap gets the count of its pair and deals it out to its documents.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir
from .pieces import SPACE
from .textarrays import text_bytes

# A chunk is closed at this many bytes of text or documents (positions in a bitmap have 16 bits); it holds one document at least.
CHUNK_BYTES = 8 << 20
CHUNK_DOCS = 1 << 16
# Texts are aligned together up to this many characters.
RUN = 1 << 19
_SHIFT = 32
# Characters on which all pattern engines agree what a letter, a digit and white space are; other texts take the slower library.
_PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-ɏ‐-‧‰-⁞€]*")
# The quick encoder takes the square of the length of one unit.
_LONG = re.compile(r"\S{4000}|\s{4000}")
# Split pattern of the byte-level vocabulary (a fixed value of its format).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """The byte-level vocabulary (A): ids of a text and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken
        import tokenizers

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        special = {t["content"] for t in given.get("added_tokens", ())}
        alphabet = _byte_alphabet()
        ids = {t: i for t, i in given["model"]["vocab"].items() if t not in special}
        self.token = [b""] * (1 + max(given["model"]["vocab"].values()))
        for t, i in ids.items():
            self.token[i] = bytes(alphabet[c] for c in t)
        self.slow = tokenizers.Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        # In such a vocabulary an id is the rank of its merge; the quick encoder needs no more.
        self.quick = tiktoken.Encoding(f"bytes-{uuid.uuid4().hex}", pat_str=_SPLIT, mergeable_ranks={self.token[i]: i for i in sorted(ids.values())}, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and not _LONG.search(text):
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)


class PieceTokens:
    """The piece model (B): ids of a text and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.token = [b"" if self.library.is_control(i) or self.library.is_unknown(i) else bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(SPACE, " ").encode()
                      for i, p in enumerate(pieces)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Side:
    """Bytes of the ids of one side, as one flat array."""

    def __init__(self, token: list[bytes]):
        self.token = token
        self.size = np.array([len(t) for t in token], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(token), np.uint8)

    def text(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, joined."""
        size = self.size[ids]
        return self.flat[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Aligned:
    """Aligned texts of a run: ids of both sides of all, the places where both end, and the number of each of these of every text."""

    def __init__(self, a, b, cut_a, cut_b, n_a, n_b, n_cuts):
        self.a, self.b, self.cut_a, self.cut_b, self.n_a, self.n_b, self.n_cuts = a, b, cut_a, cut_b, n_a, n_b, n_cuts


class Aligner:
    """Both tokenisers with their tables of tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.tokens_a, self.tokens_b = ByteTokens(path_a), PieceTokens(path_b)
        self.a, self.b = Side(self.tokens_a.token), Side(self.tokens_b.token)
        ids_a, ids_b = list(map(str, range(len(self.a.size)))), list(map(str, range(len(self.b.size))))
        # Written forms: an id before another of its side, and the last of its side in a group.
        self.names = [f"{i}," for i in ids_a] + [f"{i}|" for i in ids_a] + [f"{i}," for i in ids_b] + [f"{i};" for i in ids_b]

    def align(self, texts: list[str]) -> Aligned:
        """Tokens of each text; an empty text, and one that a side does not give back, has none."""
        nothing = np.zeros(0, np.int64)
        at = [i for i, t in enumerate(texts) if t]
        ids_a, ids_b = [nothing] * len(texts), [nothing] * len(texts)
        for i, b in zip(at, self.tokens_b.ids([texts[i] for i in at]), strict=True):
            a, b = self.tokens_a.ids(" " + texts[i]), np.array(b, np.int64)
            want = np.frombuffer((" " + texts[i]).encode(), np.uint8)
            if all(side.size[x].sum() == len(want) and np.array_equal(side.text(x), want) for side, x in ((self.a, a), (self.b, b))):
                ids_a[i], ids_b[i] = a, b
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = np.concatenate([nothing, *ids_a]), np.concatenate([nothing, *ids_b])
        # Both sides of a text have the same bytes, so that the offsets run on over all texts.
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        if not len(a):
            return Aligned(a, b, nothing, nothing, n_a, n_b, np.zeros(len(texts), np.int64))
        place = np.searchsorted(end_b, end_a)
        cut_a = np.flatnonzero(end_b[place] == end_a)
        return Aligned(a, b, cut_a, place[cut_a], n_a, n_b, np.diff(np.searchsorted(cut_a, np.concatenate([[0], np.cumsum(n_a)]))))

    def written(self, x: Aligned) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        last_a, last_b = np.zeros(len(x.a), bool), np.zeros(len(x.b), bool)
        last_a[x.cut_a] = last_b[x.cut_b] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        out = np.empty(len(x.a) + len(x.b), np.int64)
        # Before an id come those of its side and, of the other, those of earlier groups (A) or of groups up to its own (B).
        out[np.arange(len(x.a)) + np.concatenate([[0], x.cut_b + 1])[group_a]] = x.a + last_a * len(self.a.size)
        out[np.arange(len(x.b)) + x.cut_a[group_b] + 1] = 2 * len(self.a.size) + x.b + last_b * len(self.b.size)
        names = list(map(self.names.__getitem__, out.tolist()))
        ends = np.cumsum(x.n_a + x.n_b).tolist()
        return ["".join(names[i:j])[:-1] for i, j in zip([0, *ends], ends, strict=False)]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


# A plane is a kind, a size in bytes and its content: ascending positions of two bytes, or one bit a document where that is shorter.
LIST, BITS = 0, 1
_HEAD = struct.Struct("<BI")


def pack(planes: list[np.ndarray], docs: int) -> bytes:
    """Bitmap planes of one pair from the ascending positions of each plane."""
    out = []
    for at in planes:
        if 2 * len(at) <= (docs + 7) // 8:
            kind, body = LIST, at.astype("<u2").tobytes()
        else:
            flags = np.zeros(docs, np.uint8)
            flags[at] = 1
            kind, body = BITS, np.packbits(flags, bitorder="little").tobytes()
        out.append(_HEAD.pack(kind, len(body)) + body)
    return b"".join(out)


def unpack(planes: bytes) -> list[tuple[int, np.ndarray]]:
    """(kind, content) of each plane."""
    out, i = [], 0
    while i < len(planes):
        kind, size = _HEAD.unpack_from(planes, i)
        i += _HEAD.size
        out.append((kind, np.frombuffer(planes, "<u2" if kind == LIST else np.uint8, size // (2 if kind == LIST else 1), i)))
        i += size
    return out


def positions(kind: int, content: np.ndarray) -> np.ndarray:
    return content.astype(np.int64) if kind == LIST else np.flatnonzero(np.unpackbits(content, bitorder="little"))


def popcounts(planes: bytes) -> tuple[int, int]:
    """(documents, links) of a pair in a chunk: the planes OR-ed, and each plane times its power of two."""
    found = unpack(planes)
    count = [len(c) if kind == LIST else int(np.bitwise_count(c).sum()) for kind, c in found]
    links = sum(n << k for k, n in enumerate(count))
    if len(found) == 1:
        return count[0], links
    return len(np.unique(np.concatenate([positions(*p) for p in found]))), links


def _index(links: np.ndarray, docs: int) -> tuple[np.ndarray, list[bytes]]:
    """Pairs of a chunk and their planes, from ``pair << 16 | document`` of every link."""
    links = np.sort(links)
    first = np.flatnonzero(np.append(True, links[1:] != links[:-1]))
    times = np.diff(np.append(first, len(links)))
    pair, doc = links[first] >> 16, (links[first] & 0xFFFF).astype("<u2")
    begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    end = np.append(begin[1:], len(pair))
    most = np.maximum.reduceat(times, begin)
    flat = doc.tobytes()
    short = (most == 1) & (2 * (end - begin) <= (docs + 7) // 8)
    out = []
    for s, e, m, easy in zip(begin.tolist(), end.tolist(), most.tolist(), short.tolist(), strict=True):
        if easy:
            out.append(_HEAD.pack(LIST, 2 * (e - s)) + flat[2 * s : 2 * e])
        else:
            out.append(pack([doc[s:e][(times[s:e] >> k & 1) == 1] for k in range(m.bit_length())], docs))
    return pair[begin], out


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ROW = f"kind string, chunk long, place int, {_DOC}, pair long, docs long, links long, planes binary"


def build_index(texts: DataFrame, path_a: str, path_b: str, folder: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Tokenise and align every text once.  Two tables in ``folder``: documents (chunk, place, counts and digest of groups) and the inverted index
    (chunk, pair, docs, links, planes)."""

    def run(batches):
        tool = aligner(path_a, path_b)
        base, number = TaskContext.get().partitionId() << 24, 0
        found_links, rows, size = [], [], 0

        def flush():
            nonlocal found_links, rows, size, number
            n, chunk = len(rows), base + number
            doc = list(zip(*rows, strict=True))
            none = lambda k, kind: pa.nulls(k, kind)
            long, text, raw = pa.int64(), pa.string(), pa.binary()
            names = [c.split(" ")[0] for c in _ROW.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(["document"] * n), pa.array([chunk] * n, long), pa.array(range(n), pa.int32()), *[pa.array(doc[i], long) for i in range(5)], pa.array(doc[5], text),
                                              none(n, long), none(n, long), none(n, long), none(n, raw)], names)
            every = np.concatenate(found_links)
            if len(every):
                pair, planes = _index(every, n)
                pair = pair // len(tool.b.size) << _SHIFT | pair % len(tool.b.size)
                for i in range(0, len(pair), 20_000):
                    part = planes[i : i + 20_000]
                    k = len(part)
                    docs, links = zip(*map(popcounts, part), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(["pair"] * k), pa.array([chunk] * k, long), none(k, pa.int32()), *[none(k, long)] * 5, none(k, text), pa.array(pair[i : i + k]),
                                                      pa.array(docs, long), pa.array(links, long), pa.array(part, raw)], names)
            found_links, rows, size, number = [], [], 0, number + 1

        for batch in batches:
            ids, given = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            i = 0
            while i < len(ids):
                j, held = i, 0
                while j < len(ids) and held < RUN and j - i + len(rows) < CHUNK_DOCS:
                    held += len(given[j] or "")
                    j += 1
                found = tool.align([t or "" for t in given[i:j]])
                place = np.repeat(np.arange(len(rows), len(rows) + j - i), found.n_cuts)
                found_links.append(found.a[found.cut_a] * len(tool.b.size) + found.b[found.cut_b] << 16 | place)
                for doc_id, n_a, n_b, n, groups in zip(ids[i:j], found.n_a.tolist(), found.n_b.tolist(), found.n_cuts.tolist(), tool.written(found), strict=True):
                    rows.append((doc_id, n_a, n_b, n, n, hashlib.sha256(groups.encode()).hexdigest() if n_a else ""))
                size, i = size + held, j
                if size >= chunk_bytes or len(rows) == CHUNK_DOCS:
                    yield from flush()
        if rows:
            yield from flush()

    texts.select("doc_id", "text").mapInArrow(run, _ROW).write.parquet(f"{folder}/index")
    every = texts.sparkSession.read.schema(_ROW).parquet(f"{folder}/index")
    return every.where("kind = 'document'").drop("kind", "pair", "docs", "links", "planes"), every.where("kind = 'pair'").select("chunk", "pair", "docs", "links", "planes")


def pair_counts(index: DataFrame) -> DataFrame:
    """a, b, n_docs, n_links, best of every pair: documents and links that hold it, and whether no pair of the same B id has more links."""
    pairs = index.groupBy("pair").agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links"))
    pairs = pairs.withColumns({"a": F.shiftright("pair", _SHIFT), "b": F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))})
    most = pairs.groupBy("b").agg(F.max("n_links").alias("most"))
    # One row for each id of the B vocabulary at most.
    return pairs.join(F.broadcast(most), "b").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def _postings(planes: pa.Array):
    """(row, position, weight) of the documents in the bitmaps of many rows: at once for single lists, which most are, and plane by plane for the rest."""
    raw, off = text_bytes(planes)
    size = np.diff(off)
    body = raw[off[:-1, None] + np.arange(1, 5)].astype(np.int64) @ (1 << 8 * np.arange(4))
    single = (raw[off[:-1]] == LIST) & (body + _HEAD.size == size)
    rows = np.flatnonzero(single)
    count = body[rows] // 2
    at = np.repeat(off[:-1][rows] + _HEAD.size - 2 * (np.cumsum(count) - count), count) + 2 * np.arange(count.sum())
    yield np.repeat(rows, count), raw[at].astype(np.int64) | raw[at + 1].astype(np.int64) << 8, 1
    for r in np.flatnonzero(~single).tolist():
        for k, plane in enumerate(unpack(planes[r].as_py())):
            at = positions(*plane)
            yield np.full(len(at), r), at, 1 << k


def _deal_out(scored: DataFrame) -> DataFrame:
    """chunk, place, n_best, count_sum of the documents in the bitmaps of scored pairs; rows come sorted by chunk."""

    def run(batches):
        chunk, sums = None, None
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

        def flush():
            at = np.flatnonzero(sums[2])
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([chunk] * len(at), at, sums[0, at], sums[1, at]), kinds, strict=True)], ["chunk", "place", "n_best", "count_sum"])

        for batch in batches:
            planes, of, links, best = batch.column("planes"), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "n_links", "best"))
            for i, j in zip(cut := np.flatnonzero(np.append(True, of[1:] != of[:-1])), np.append(cut[1:], len(of)), strict=True):
                if of[i] != chunk:
                    if chunk is not None:
                        yield flush()
                    chunk, sums = int(of[i]), np.zeros((3, CHUNK_DOCS), np.int64)
                for rows, at, weight in _postings(planes.slice(i, j - i)):
                    np.add.at(sums[0], at, best[i:j][rows] * weight)
                    np.add.at(sums[1], at, links[i:j][rows] * weight)
                    sums[2, at] = 1
        if chunk is not None:
            yield flush()

    return scored.mapInArrow(run, "chunk long, place int, n_best long, count_sum long")


def align_documents(texts: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    A text that is null, empty or not given back by the tokens of a side has no tokens: zeros and an empty digest.  Repeated rows each count and each come
    back; other columns are ignored; an empty table gives an empty one.
    """
    spark = texts.sparkSession
    folder = f"{shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    docs, index = build_index(texts, path_a, path_b, folder, chunk_bytes)
    scored = index.select("chunk", "pair", "planes").join(pair_counts(index).select("pair", "n_links", "best"), "pair").select("chunk", "planes", "n_links", "best")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = _deal_out(scored.repartition(parts, "chunk").sortWithinPartitions("chunk"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return docs.join(sums, ["chunk", "place"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
