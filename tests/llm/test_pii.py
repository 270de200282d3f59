"""Base patterns against plain regular expressions, message passing against enumeration, twins on planted texts."""

import itertools
import random
import re
import time

import numpy as np

from pricewell.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(x):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(x)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(x):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        out += [(2, m.start(), m.end())] if 16 <= len(d) <= 19 and total % 10 == 0 else []
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(x) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    random.seed(0)
    for alphabet in ("ab@.-_ 1", "a1.@", "12.", "0123456789 -+().", "+1 9(", "@a.b_ é٣", "04 -"):
        for _ in range(3000):
            x = "".join(random.choice(alphabet) for _ in range(random.randrange(50)))
            assert sorted(brute(x)) == sorted(pii.base_spans(x)), x
    assert pii.base_spans("4532015112830366 x") == [(2, 0, 16)]


def test_linear_time():
    t = time.time()
    for x in ("a" * 200_000, "1" * 200_000, "+1" + " " * 200_000, "1." * 100_000, "@" * 200_000, "a@" * 100_000, "1 " * 100_000):
        pii.all_spans(x, pii.Field())
    assert time.time() - t < 20


def test_propagation_on_trees():
    rng = np.random.default_rng(1)
    node, ends = rng.standard_normal((4, pii.LABELS)), np.array([[0, 1], [1, 2], [1, 3]])
    pair = rng.standard_normal((3, pii.LABELS, pii.LABELS))
    total = np.zeros((4, pii.LABELS))
    for x in itertools.product(range(pii.LABELS), repeat=4):
        w = np.exp(sum(node[i, x[i]] for i in range(4)) + sum(pair[e, x[i], x[j]] for e, (i, j) in enumerate(ends)))
        for i in range(4):
            total[i, x[i]] += w
    got, both = pii.propagate(node, ends, pair, rounds=60)
    assert np.allclose(np.exp(got), total / total.sum(1, keepdims=True), atol=1e-6) and np.allclose(np.exp(both).sum((1, 2)), 1)


def planted(n):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioustrnd") for _ in range(5))
    out = []
    for i in range(n):
        w = [word() for _ in range(30)]
        w[5] = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        w[12] = str(rng.randrange(10**7, 10**8)) if i % 2 else word()
        w[20] = f"{word()}.{rng.randrange(10, 99)}@mail{rng.randrange(9)}.example.com"
        out.append(" ".join(w))
    return out


def test_twins():
    field = pii.train(planted(300))
    text = "call +1 (212) 555-1234 soon, erea onth the again at 212 555-1234 or 77345678 and 77345678 later"
    base, spans = pii.all_spans(text, field)
    assert [text[a:z] for _, a, z in base] == ["+1 (212) 555-1234"]
    assert [(pii.KINDS[k], text[a:z]) for k, a, z in spans[len(base) :]] == [("phone", "555-1234")]
    assert pii.masked(text, spans).count("[PHONE]") == 2


def test_twins_of_groups_and_names():
    rng, cards = random.Random(4), []
    while len(cards) < 150:
        d = str(rng.randrange(4 * 10**15, 5 * 10**15))
        if pii.luhn(d):
            cards.append(f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}")
    field = pii.train(planted(300) + [f"erea onth the {c} again reha onth the with erea" for c in cards] + [re.sub(r"\.[0-9]+@", ".erea@", t) for t in planted(150)])
    for text, want in (
        ("pay 4532 0151 1283 0366 soon, erea onth the again with 12830366 ok", ["12830366"]),
        ("pay 4532 0151 1283 0366 soon, erea onth the again with 1283 0366 ok", ["1283 0366"]),
        ("call +49 30 1234 5678 soon, erea onth the again at 030 1234 5678 or 8765 4321", ["030 1234 5678"]),
        ("mail john.doe@x.com soon, erea onth the again John.Doe or john", ["John.Doe"]),
    ):
        base, spans = pii.all_spans(text, field)
        assert len(base) == 1 and [text[a:z] for _, a, z in spans[1:]] == want, text
        assert {k for k, *_ in spans} == {base[0][0]}


def test_documents(docs_of):
    texts = [None, "", "plain words only", "mail a.b@c.de, mail a.b@c.de", "ip 10.0.0.1 é 300.1.1.1", "x " * 5000 + "4532015112830366"]
    docs = docs_of(texts + texts[3:4], extra=["'x' AS spans", "2 AS n_email"])
    field = pii.fit(docs)
    got = {r.doc_id: r for r in pii.find(docs, field).collect()}
    for i, t in enumerate(texts):
        want = pii.join_spans(brute(t or ""))
        assert got[i].spans == want and got[i].base_sha256 == __import__("hashlib").sha256(want.encode()).hexdigest()
    assert (got[3].n_email, got[4].n_ip, got[5].n_card, got[6].spans) == (2, 1, 1, got[3].spans)
    clean = {r.doc_id: r for r in pii.redact(docs, field).collect()}
    assert clean[0].text is None and clean[2].text == texts[2] and clean[3].text == "mail [EMAIL], mail [EMAIL]" and clean[3].spans == "x"
    empty = docs_of([])
    assert pii.find(empty, pii.fit(empty)).count() == 0
