"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all turns before it as context.

A turn reads ``### role: text</turn>`` and a line end.  Inside roles and texts a backslash goes before each backslash, ``#`` and ``<`` (in roles also before
``:``), so that no text can hold a mark and the escape can be undone.  Only the reply of an example is trainable: ``loss_start`` and ``loss_end`` are the code
points of its text.  Turns after the last reply would be lost; they close the conversation as one more example without a trainable part.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
REPLY = "assistant"
# Examples of a batch that leaves a task hold about this many code points.
OUT_CHARS = 4_000_000
TURN = re.compile(r"### ((?:[^\\:#<]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"[\\#<]", r"\\\g<0>", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\#<:]", r"\\\g<0>", role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; an error if it is not one."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _expand(batches):
    """Sorted turns to examples; a conversation's turns may lie in several batches, and only its formatted text is held."""
    rows, chars = [], 0
    conv, prefix, length, examples, trained = object(), [], 0, 0, True

    def flush():
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "example", "text", "loss_start", "loss_end"])

    for batch in batches:
        for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
            if conv != c:
                if not trained:
                    rows.append((conv, examples, "".join(prefix), None, None))
                    chars += length
                conv, prefix, length, examples, trained = c, [], 0, 0, True
            body = escape(text or "")
            turn = f"{OPEN}{escape_role(role or '')}{SEP}{body}{CLOSE}"
            prefix.append(turn)
            length += len(turn)
            trained = role == REPLY
            if trained:
                prefix = ["".join(prefix)]
                end = length - len(CLOSE)
                rows.append((conv, examples, prefix[0], end - len(body), end))
                chars += length
                examples += 1
                if chars > OUT_CHARS:
                    yield flush()
                    rows, chars = [], 0
    if not trained:
        rows.append((conv, examples, "".join(prefix), None, None))
    if rows:
        yield flush()


def format_conversations(turns: DataFrame) -> DataFrame:
    """Examples (conv_id, example, text, loss_start, loss_end) of ``turns`` (conv_id, turn, role, text; other columns are ignored).

    Turns go by ``turn``, then role and text, so repeated rows are repeated turns; null texts and roles are empty, a null turn comes first, null conv_ids are one
    conversation.  The examples of a conversation follow each other within a partition, in order; an empty table gives none.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_expand, "conv_id long, example long, text string, loss_start long, loss_end long")


def _read(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    rows = []
    conv, last, loss, loss_chars, chars, examples = object(), None, hashlib.sha256(), 0, 0, 0

    def close():
        turns = parse(last)
        digest = hashlib.sha256()
        for role, text in turns:
            digest.update(f"{role}\n{text}\n".encode())
        rows.append((conv, len(turns), digest.hexdigest(), loss_chars, loss.hexdigest(), chars, examples))

    for batch in batches:
        for c, text, a, z in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "text", "loss_start", "loss_end")), strict=True):
            if conv != c:
                if last is not None:
                    close()
                conv, loss, loss_chars, chars, examples = c, hashlib.sha256(), 0, 0, 0
            last = text
            chars += len(text)
            examples += 1
            if a is not None:
                reply = unescape(text[a:z])
                loss.update(reply.encode())
                loss_chars += len(reply)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows = []
    if last is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples as ``format_conversations`` leaves them: the turns of the last one and all text under the loss spans."""
    return examples.mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
    )
