"""Personal data: base patterns and a skip-chain conditional random field.

Four patterns give base spans, which always stay.  The field adds spans: its tokens are the white-space words that hold a digit or ``@`` (any other word is outside
every entity), its labels the kinds and "outside".  Neighbours within a few words share chain potentials, and tokens of one document that are equal or similar
(same letters and digits, or same digits with one of them ending in the other) share skip potentials.  Loopy sum-product message passing gives the marginals; a
token with a twin whose best kind passes ``SURE`` becomes a span.  Weights are learned from the base spans of a sample, with the own pattern's evidence hidden
from half of the tokens, and from the same texts with later mentions that no base pattern sees (a number without its plus, the end of a card number, the name
of a mail address), so that context and twins have to explain them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
OUTSIDE = len(KINDS)
LABELS = OUTSIDE + 1
#: Documents of the training sample, those of the least hash among those with a token.
SAMPLE = 2000
SURE = 0.9
NEAR_WORDS = 3
# Letters and digits that a token needs to have twins.
LONG = 5
FEATURES = 1 << 10
ROUNDS = 12
EPOCHS = 6
# Rows that are turned into Python texts at a time.
ROWS = 500

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
_MARK = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each ``@`` outwards in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1) if begin == at else last
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns in code points, by kind, then start."""
    found = [(0, a, z) for a, z in emails(text)] if "@" in text else []
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-12:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def join_spans(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in sorted(spans))


_EDGE = "\"'()[]{}<>,;:!?*#$%&|=.`~-"


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the words that hold a digit or ``@``, without signs at their edges."""
    out = []
    if not _MARK.search(text):
        return out
    for m in _WORD.finditer(text):
        word = m[0]
        if not _MARK.search(word):
            continue
        left = len(word) - len(word.lstrip(_EDGE))
        core = word.strip(_EDGE)
        if core:
            out.append((m.start() + left, m.start() + left + len(core)))
    return out


def labels_of(spans, at: list[tuple[int, int]]) -> np.ndarray:
    """Label of each token: the first kind whose span covers its middle, else outside."""
    out = np.full(len(at), OUTSIDE)
    for k, a, z in sorted(spans, reverse=True):
        for i, (b, e) in enumerate(at):
            if b < z and e > a:
                out[i] = k
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little") % FEATURES


_KNOWN: dict[str, int] = {}


def _bucket(name: str) -> int:
    if name not in _KNOWN:
        if len(_KNOWN) > 100_000:
            _KNOWN.clear()
        _KNOWN[name] = _hash(name)
    return _KNOWN[name]


def shape(word: str) -> str:
    """The word with runs of digits, letters and other characters as one sign each."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "0", word)))[:12]


def evidence(text: str, at: list[tuple[int, int]], spans) -> list[tuple[list[int], list[int]]]:
    """Feature buckets of each token: (those that tell of its own pattern, those of its form and context)."""
    base = labels_of(spans, at)
    out = []
    for i, (a, z) in enumerate(at):
        word = text[a:z]
        digits = sum(map(str.isdigit, word))
        before = text[max(0, a - 24) : a].split(" ")
        own = [_bucket(f"base={base[i]}")]
        form = [_bucket("bias"), _bucket(f"shape={shape(word)}"), _bucket(f"digits={min(digits, 20)}"), _bucket(f"at={'@' in word}"), _bucket(f"dots={min(word.count('.'), 4)}"),
                _bucket(f"before={before[-1][-8:] if before[-1] else (before[-2][-8:] if len(before) > 1 else '')}"), _bucket(f"plus={text[max(0, a - 1):a] == '+' or word[:1] == '+'}")]
        out.append((own, form))
    return out


def links(text: str, at: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j, kind) of the field: 0 for chain neighbours, 1 for equal and 2 for similar tokens; equal tokens form a chain, each linked to its next twin."""
    edges = []
    for i in range(len(at) - 1):
        if len(text[at[i][1] : at[i + 1][0]].split()) < NEAR_WORDS and at[i + 1][0] - at[i][1] < 60:
            edges.append((i, i + 1, 0))
    last, ends = {}, {}
    for i, (a, z) in enumerate(at):
        word = text[a:z].lower()
        key = re.sub(r"[\W_]", "", word)
        digits = re.sub(r"\D", "", word)
        if len(key) < LONG:
            continue
        if key in last:
            edges.append((last[key], i, 1))
        elif len(digits) >= 7 and digits[-7:] in ends and ends[digits[-7:]][1] != key:
            edges.append((ends[digits[-7:]][0], i, 2))
        elif "@" in word and (user := word.split("@")[0]) in ends:
            edges.append((ends[user][0], i, 2))
        last[key] = i
        if len(digits) >= 7:
            ends[digits[-7:]] = (i, key)
        if "@" in word:
            ends[word.split("@")[0]] = (i, key)
        else:
            ends.setdefault(word, (i, key))
    if not edges:
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    e = np.array(edges)
    return e[:, :2], e[:, 2]


_GROUP = re.compile(r"[0-9().+-]*[0-9][0-9().+-]*")


def later(text: str, base) -> list[tuple[tuple[int, int], tuple[int, int, int]]]:
    """(span, base span) of the mentions that no single token shows: number groups whose joined digits end a base card or phone number (after a trunk zero, if
    any), and words that are the name of a base e-mail.  A token of 7 digits stands alone, as in ``links``."""
    names, ends = {}, {}
    for s in base:
        word = text[s[1] : s[2]]
        if s[0] == 0 and not _MARK.search(user := word.split("@")[0].lower()) and len(re.sub(r"[\W_]", "", user)) >= LONG:
            names.setdefault(user, s)
        digits = re.sub(r"\D", "", word) if s[0] > 1 else ""
        for n in range(7, len(digits) + 1):
            ends.setdefault(digits[-n:], s)
    out, run = [], []
    if not names and not ends:
        return out
    covered, k = sorted((a, z) for _, a, z in base), 0

    def close():
        i = 0
        while i < len(run):
            digits, found = "", 0
            for j in range(i, len(run)):
                own = re.sub(r"\D", "", text[run[j][0] : run[j][1]])
                digits += own
                if j > i and len(own) >= 7 or len(digits) > 20:
                    break
                got = ends.get(digits) or ends.get(digits.lstrip("0"))
                if got and (j > i or " " in text[got[1] : got[2]]):
                    found, to = j + 1, got
                if len(own) >= 7:
                    break
            if found:
                out.append(((run[i][0], run[found - 1][1]), to))
            i = max(found, i + 1)
        run.clear()

    for m in _WORD.finditer(text):
        left = len(m[0]) - len(m[0].lstrip(_EDGE))
        core = m[0].strip(_EDGE)
        a, z = m.start() + left, m.start() + left + len(core)
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        inside = k < len(covered) and covered[k][0] < m.end()
        number = bool(core) and not inside and bool(_GROUP.fullmatch(core))
        if run and not (number and m.start() - run[-1][2] == 1):
            close()
        if number:
            run.append((a, z, m.end()))
        elif core and not inside and core.lower() in names:
            out.append(((a, z), names[core.lower()]))
    close()
    return out


def graph(text: str, base) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Nodes and edges of the field: the tokens and their links, then the nodes of ``later``, each linked to a node of its whole base span."""
    at = tokens(text)
    ends, kind = links(text, at)
    more, edges, known = [], [], {}
    for span, whole in later(text, base):
        if whole not in known:
            known[whole] = len(at) + len(more)
            more.append(whole[1:])
        edges.append((known[whole], len(at) + len(more)))
        more.append(span)
    if not more:
        return at, ends, kind
    return at + more, np.concatenate([ends, np.array(edges)]), np.concatenate([kind, np.full(len(edges), 2)])


def _normal(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def propagate(node: np.ndarray, ends: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Loopy sum-product in logs: (log-marginals of nodes, log-marginals of edges); ``pair``: (edges, labels of i, labels of j)."""
    if not len(ends):
        return _normal(node), np.zeros((0, LABELS, LABELS))
    i, j = ends.T
    # Messages to the j end come first, then those to the i end.
    to, source = np.concatenate([j, i]), np.concatenate([i, j])
    table = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
    message = np.zeros((len(to), LABELS))
    for _ in range(rounds):
        total = node.copy()
        np.add.at(total, to, message)
        out = (total[source] - message[back])[:, :, None] + table
        top = out.max(1)
        new = _normal(top + np.log(np.exp(out - top[:, None, :]).sum(1)))
        message = 0.5 * message + 0.5 * new
    total = node.copy()
    np.add.at(total, to, message)
    n = len(i)
    both = (total[i] - message[n:])[:, :, None] + (total[j] - message[:n])[:, None, :] + pair
    flat = both.reshape(n, -1)
    return _normal(total), _normal(flat).reshape(both.shape)


class Field:
    """Weights: of features by label, and of label pairs by kind of edge."""

    def __init__(self):
        self.node = np.zeros((FEATURES, LABELS))
        self.pair = np.zeros((3, LABELS, LABELS))

    def scores(self, seen: list[list[int]]) -> np.ndarray:
        return np.array([self.node[f].sum(0) for f in seen])


def mention(text: str, span: tuple[int, int, int]) -> str | None:
    """A later mention of an entity that no base pattern sees."""
    word = text[span[1] : span[2]]
    if span[0] == 0:
        user = word.split("@")[0]
        return user if len(re.sub(r"[\W_]", "", user)) >= LONG else None
    if span[0] == 2:
        return re.sub(r"\D", "", word)[-8:]
    return word.split(" ", 1)[-1].lstrip("+") if span[0] == 3 else None


def examples(text: str, rng) -> list[tuple[str, list]]:
    """(text, gold spans): the text itself and, if it has mentions to add, with them among words of its own."""
    base = base_spans(text)
    out, more, gold = [(text, base)], text, list(base)
    words = text.split()
    for span in base:
        again = mention(text, span)
        if again:
            more += " " + " ".join(words[int(k)] for k in rng.integers(0, len(words), 5) if not _MARK.search(words[int(k)])) + " "
            gold.append((span[0], len(more), len(more) + len(again)))
            more += again
    return out + [(more, gold)] * (len(gold) > len(base))


def train(texts: list[str], seed: int = 3) -> Field:
    """Stochastic gradient ascent on the likelihood under the loopy marginals."""
    field, rng = Field(), np.random.default_rng(seed)
    docs = []
    for text in texts:
        for own, gold in examples(text, rng) if tokens(text) else []:
            seen = base_spans(own)
            at, ends, kind = graph(own, seen)
            docs.append((evidence(own, at, seen), ends, kind, labels_of(gold, at)))
    for epoch in range(EPOCHS):
        rate = 0.2 / (1 + epoch)
        for d in rng.permutation(len(docs)):
            seen, ends, kind, gold = docs[d]
            # The own evidence of a half of the tokens is hidden: the rest must carry the label.
            use = [own + form if rng.random() < 0.5 else form for own, form in seen]
            logs, both = propagate(field.scores(use), ends, field.pair[kind])
            gap = -np.exp(logs)
            gap[np.arange(len(gold)), gold] += 1
            for f, g in zip(use, gap, strict=True):
                field.node[f] += rate * g
            if len(ends):
                flat = -np.exp(both)
                flat[np.arange(len(ends)), gold[ends[:, 0]], gold[ends[:, 1]]] += 1
                for k in range(3):
                    if (kind == k).any():
                        field.pair[k] += rate * 0.5 * flat[kind == k].mean(0)
            field.node *= 1 - 1e-4 * rate
    return field


def all_spans(text: str, field: Field, sure: float = SURE) -> tuple[list, list]:
    """(base spans, spans with the field's): a token that no base span touches joins if its marginal of a kind passes ``sure`` and it has a twin, direct or
    by way of others, of that kind among the base spans."""
    base = base_spans(text)
    if not base:
        # Without one known entity there is no twin to agree with.
        return base, base
    at, ends, kind = graph(text, base)
    if not at:
        return base, base
    seen = evidence(text, at, base)
    logs, _ = propagate(field.scores([own + form for own, form in seen]), ends, field.pair[kind])
    known = labels_of(base, at)
    best = logs[:, :OUTSIDE].argmax(1)
    group = list(range(len(at)))
    for i, j in ends[kind > 0].tolist():
        # Edges run forward, then to the nodes of ``later``, so an earlier root is final.
        group[j] = group[i]
    kinds = {(group[i], int(known[i])) for i in range(len(at))}
    added = [(int(best[i]), *at[i]) for i in range(len(at)) if known[i] == OUTSIDE and (group[i], int(best[i])) in kinds and np.exp(logs[i, best[i]]) >= sure]
    # A node of ``later`` may have the span of a token.
    return base, base + list(dict.fromkeys(added))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Learn from at most ``sample`` texts that hold a token, those of the least hash of their text."""
    rows = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", F.xxhash64("text").alias("h")).orderBy("h", "doc_id").limit(sample).collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    texts = docs.where(F.col("doc_id").isin(ids)).select("doc_id", "text").collect() if ids else []
    return train([t for _, t in sorted((r.doc_id, r.text) for r in texts if r.text)])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id with counts by kind, base_sha256 and spans of each text.

    Null texts are empty and have no span; repeated rows are each searched; other columns are ignored.
    """
    sha = lambda spans: hashlib.sha256(join_spans(spans).encode()).hexdigest()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                got = []
                for text in part.column("text").to_pylist():
                    base, spans = all_spans(text, field) if text else ([], [])
                    got.append((*(sum(s[0] == k for s in spans) for k in range(len(KINDS))), sha(base), join_spans(spans)))
                cols = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(list(c), pa.int64()) for c in cols[:4]), pa.array(list(cols[4])), pa.array(list(cols[5]))],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; null texts stay null, all other columns and rows stay."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                clean = [masked(t, all_spans(t, field)[1]) if t else t for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(clean, pa.string()), *part.columns[at + 1 :]], part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def masked(text: str | None, spans) -> str | None:
    """The text with each span, merged where they overlap, replaced by its first kind in brackets."""
    if not text or not spans:
        return text
    out, last = [], 0
    for k, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, z)
    return "".join(out) + text[last:]
