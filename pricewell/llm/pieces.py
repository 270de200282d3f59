"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the model can reach across: before each run of spaces and around each line end.  The distinct units of a batch are encoded
together: their symbols lie in one flat array, each round takes the least pair rank of every unit (a segmented minimum), merges all of its occurrences from
the left at once and compacts the array, until no unit has a pair left.  Units are kept from batch to batch, in a cache of fixed size.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
# Units a worker keeps, about 300 bytes each; beyond, it starts anew.
CACHE = 500_000
UNIT = re.compile(r"\n| +[^ \n]*|[^ \n]+")
NONE = np.iinfo(np.int32).max


def _fields(data: bytes):
    """(number, value) of the fields of a protobuf message."""

    def varint(i):
        value = shift = 0
        while True:
            c = data[i]
            value |= (c & 127) << shift
            i, shift = i + 1, shift + 7
            if c < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        elif tag & 7 == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class Pieces:
    """Tables of a byte-pair model: pieces, pair ranks and the byte pieces that stand for unknown characters."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.text: list[str] = []
        score, kind, norm = [], [], {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.text.append(piece[1].decode())
                score.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kind.append(piece.get(3, NORMAL))
            elif number == 3:
                norm = dict(_fields(value))
        if norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or USER in kind or UNUSED in kind:
            raise ValueError("only models without normalisation and user-defined pieces, with a leading space, are supported")
        self.kind = kind
        self.end = next(i for i, t in enumerate(self.text) if kind[i] == CONTROL and t == "</s>")
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if kind[i] == BYTE}
        self.symbol = {t: i for i, t in enumerate(self.text) if kind[i] == NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", t) for t in self.symbol):
            raise ValueError("a piece reaches across a cut")
        for t in list(self.symbol):
            for c in t:
                self.symbol.setdefault(c, len(self.text) + len(self.symbol))
        order = {s: r for r, s in enumerate(sorted({score[i] for i, k in enumerate(kind) if k == NORMAL}, reverse=True))}
        pairs, careful = {}, set()
        rank = {t: order[score[i]] for t, i in self.symbol.items() if i < len(self.text)}
        for t, r in rank.items():
            for k in range(1, len(t)):
                a, b = t[:k], t[k:]
                if a in self.symbol and b in self.symbol:
                    pairs[self.symbol[a], self.symbol[b]] = (r, self.symbol[t])
                    careful.update(rank[x] for x in (a, b) if rank.get(x, -1) >= r)
        # Merging one occurrence of such a piece may open a pair that comes before its next occurrence: these go one at a time.
        self.pairs, self.careful = pairs, np.zeros(len(order) + 1, bool)
        self.careful[list(careful)] = True
        self.width = max(self.symbol.values()) + 2
        key = np.array([a * self.width + b for a, b in pairs], np.int64)
        by = np.argsort(key)
        self.key, self.rank, self.made = key[by], *np.array(list(pairs.values()), np.int32)[by].T
        # Symbol of each code point; those of no piece are negative.
        self.start = -1 - np.arange(0x110000)
        for t, i in self.symbol.items():
            if len(t) == 1:
                self.start[ord(t)] = i
        self.name = list(map(str, range(len(kind))))
        # Ids from here on are ordinary pieces.
        self.plain = 1 + max(i for i, k in enumerate(kind) if k != NORMAL)
        self.extra = {i: t for t, i in self.symbol.items() if i >= len(self.text)}
        self.fresh()

    def fresh(self) -> None:
        self.code: dict[str, int] = {}
        self.ids: list[str] = []
        self.back: list[str] = []

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without) and place in the table of pairs of symbols; unknown symbols are negative."""
        want = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.width + right)
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], NONE), at

    def one_by_one(self, symbols: list[int]) -> list[int]:
        """Merge single pairs, least rank then leftmost first, with a heap."""
        n = len(symbols)
        after, before, heap = [*range(1, n), -1], list(range(-1, n - 1)), []

        def add(i):
            if i >= 0 and after[i] >= 0 and (p := self.pairs.get((symbols[i], symbols[after[i]]))):
                heapq.heappush(heap, (p[0], i, symbols[i], symbols[after[i]], p[1]))

        for i in range(n - 1):
            add(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if symbols[i] is not None else -1
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j], after[i] = made, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            add(before[i])
            add(i)
        return [s for s in symbols if s is not None]

    def merge(self, units: list[str]) -> list[list[int]]:
        """Final symbols of each unit."""
        sym = self.start[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        count = np.array([len(u) for u in units], np.int64)
        name, done = np.arange(len(units)), [[] for _ in units]
        while len(name):
            first = np.concatenate([[0], np.cumsum(count)])
            rank, at = self.pair(sym, np.append(sym[1:], -1))
            rank[first[1:] - 1] = NONE
            least = np.minimum.reduceat(rank, first[:-1])
            word = np.repeat(np.arange(len(name)), count)
            hit = np.flatnonzero((rank == least[word]) & (rank != NONE))
            # One occurrence is always safe; several of a careful pair are left to the heap.
            risky = (np.bincount(word[hit], minlength=len(name)) > 1) & self.careful[np.minimum(least, len(self.careful) - 1)]
            ready = (least == NONE) | risky
            hit = hit[~ready[word[hit]]]
            if ready.any():
                own, at_end = sym[ready[word]].tolist(), np.cumsum(count[ready])
                for w, a, z in zip(name[ready].tolist(), (at_end - count[ready]).tolist(), at_end.tolist(), strict=True):
                    done[w] = own[a:z]
                for w in name[risky].tolist():
                    done[w] = self.one_by_one(done[w])
            if len(hit):
                # Overlapping occurrences (aaa) follow each other: of such a run every second one is merged.
                start = np.append(True, np.diff(hit) != 1)
                run = np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.made[at[hit]]
            keep = ~ready[word]
            keep[hit + 1] = False
            count = np.bincount(word[keep], minlength=len(name))[~ready]
            sym, name = sym[keep], name[~ready]
        return done

    def learn(self, units: list[str]) -> None:
        """Encode new units, one stretch of symbols at a time, and keep their ids and decoded texts."""
        stretch, size = [], 0
        for u in [*units, None]:
            if stretch and (u is None or size + len(u) > 200_000):
                for unit, symbols in zip(stretch, self.merge([s.replace(" ", SPACE) for s in stretch]), strict=True):
                    ids = self.to_ids(symbols)
                    self.code[unit] = len(self.ids)
                    self.ids.append(" ".join([self.name[k] for k in ids]))
                    self.back.append(self.decode(ids, lead=False))
                stretch, size = [], 0
            if u is not None:
                stretch.append(u)
                size += len(u)

    def to_ids(self, symbols: list[int]) -> list[int]:
        if min(symbols) >= 0 and max(symbols) < len(self.text):
            return symbols
        out = []
        for s in symbols:
            if 0 <= s < len(self.text):
                out.append(s)
            else:
                c = chr(-1 - s) if s < 0 else self.extra[s]
                out += [self.byte[b] for b in c.encode()]
        return out

    def decode(self, ids: list[int], lead: bool = True) -> str:
        """Text of ids: control pieces are silent, runs of byte pieces are UTF-8; ``lead`` drops the space set before the text."""
        if ids and min(ids) >= self.plain:
            text = "".join([self.text[k] for k in ids]).replace(SPACE, " ")
            return text[1:] if lead and text[:1] == " " else text
        out = []
        raw = bytearray()
        for i in [*ids, self.end]:
            if self.kind[i] == BYTE:
                raw.append(int(self.text[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if self.kind[i] != CONTROL:
                out.append(self.text[i])
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if lead and text[:1] == " " else text

    def joined(self, codes: list[int]) -> tuple[int, str, str]:
        """(number of ids, ids joined by spaces, decoded text) of the units of a text; the end id is the last."""
        ids, back = self.ids, self.back
        row, text = " ".join([ids[c] for c in codes]), "".join([back[c] for c in codes])
        return row.count(" ") + 2, f"{row} {self.end}", text[1:] if text[:1] == " " else text


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


# Texts whose new units are learned together.
BATCH = 200


def encode_batch(pieces: Pieces, texts: list) -> list[tuple[int, str, str]]:
    """(number of ids, ids joined by spaces, decoded text) of each text."""
    out = []
    for i in range(0, len(texts), BATCH):
        units = [UNIT.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts[i : i + BATCH]]
        codes = [list(map(pieces.code.get, u)) for u in units]
        late = [k for k, c in enumerate(codes) if None in c]
        new = dict.fromkeys(u for k in late for u, c in zip(units[k], codes[k], strict=True) if c is None)
        if len(pieces.code) + len(new) > CACHE:
            pieces.fresh()
            late, new = range(len(units)), dict.fromkeys(u for own in units for u in own)
        pieces.learn(list(new))
        for k in late:
            codes[k] = list(map(pieces.code.get, units[k]))
        out += [pieces.joined(c) if c else (1, str(pieces.end), "") for c in codes]
    return out


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, ids (array), decoded of each row; null texts are empty, an empty text has the end id alone.  Other columns are ignored."""

    def run(batches):
        pieces = model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                got = encode_batch(pieces, part.column("text").to_pylist())
                ids = [np.array(x[1].split(" "), np.int32) for x in got]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([x[2] for x in got], pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, on request with ids; the digests are taken where the ids are made.

    Null texts are empty; repeated rows are each encoded; other columns are ignored.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]

    def run(batches):
        pieces = model(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                got = encode_batch(pieces, part.column("text").to_pylist())
                cols = [part.column("doc_id"), pa.array([x[0] for x in got], pa.int64()), pa.array([sha(x[1]) for x in got]), pa.array([sha(x[2]) for x in got])]
                if with_ids:
                    cols.append(pa.array([np.array(x[1].split(" "), np.int32) for x in got], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
