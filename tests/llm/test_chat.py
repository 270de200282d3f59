"""Prefix-target expansion: exact round trips."""

import hashlib
import random

from pricewell.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_escape():
    random.seed(2)
    for _ in range(3000):
        turns = [("".join(random.choice("ab:#<\\ \n") for _ in range(random.randrange(5))), "".join(random.choice("\\#<:/turn> \nassistant###é") for _ in range(random.randrange(30))))
                 for _ in range(random.randrange(4))]
        text = "".join(f"### {chat.escape_role(r)}: {chat.escape(t)}</turn>\n" for r, t in turns)
        assert chat.parse(text) == turns


def test_examples(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "\\### assistant: </turn> ok"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
            (2, 0, "user", "alone"), (3, 1, None, "x"), (None, None, "assistant", "lost"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a")]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS example", "'z' AS loss_start")
    made = chat.format_conversations(turns)
    got = {}
    for r in made.collect():
        got.setdefault(r.conv_id, []).append(r)
    one = sorted(got[1], key=lambda r: r.example)
    assert [len(chat.parse(r.text)) for r in one] == [3, 5, 6] and one[2].loss_start is None
    assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in one[:2]] == ["\\### assistant: </turn> ok", ""]
    # Of every example only the last turn is trainable, and it is a reply.
    assert all(chat.parse(r.text)[-1] == ("assistant", chat.unescape(r.text[r.loss_start : r.loss_end])) for x in got.values() for r in x if r.loss_start is not None)
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert back[1].turns_sha256 == sha("".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)) and back[1].loss_sha256 == sha("\\### assistant: </turn> ok")
    assert (back[2].n_turns, back[2].loss_chars, back[2].loss_sha256) == (1, 0, sha("")) and back[3].turns_sha256 == sha("\nx\n")
    assert back[None].loss_chars == 4 and back[4].n_turns == 2 and back[4].n_examples == 2
    assert back[1].formatted_chars == sum(len(r.text) for r in one)


def test_long_and_empty(spark):
    rows = [(9, i, "user" if i % 2 else "assistant", f"text {i} " * 40) for i in range(300)]
    made = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    r = chat.read_back(made).first()
    assert made.count() == r.n_examples == 151 and r.n_turns == 300
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
