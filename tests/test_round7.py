"""A user's windows share one value, a text is answered once, columns of names alone are built once."""

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as E
from pricewell.functions import attributes as A
from pricewell.functions.text import phrase_pattern
from pricewell.operators import catalog as C, phrases as PH, resolve as R
from pricewell.plans import bindings as X
from pricewell.streaming import dialog as D


class Value:
    held, updates = None, 0

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held, self.updates = value, self.updates + 1

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.value, self.timers = Value(), set()

    def getValueState(self, *args):
        return self.value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def __init__(self, seconds):
        self.seconds = seconds

    def getCurrentWatermarkInMs(self):
        return self.seconds * 1000


def test_windows_of_a_user():
    """Old texts leave the value, a null text is a text, a duplicate refreshes nothing, one timer stands behind all that is held."""
    windows, handle = D.UserWindows(100, 1000), Handle()
    windows.init(handle)

    def take(clock, rows):
        frame = pd.DataFrame(rows, columns=["message_id", "s", "text_key", "reply", "outcome"])
        frame = frame.assign(ts=pd.to_datetime(frame["s"], unit="s"), reply_key=frame["reply"])
        out = pd.concat(windows.handleInputRows((7,), iter([frame]), Clock(clock)))
        return {r.message_id: r.outcome for r in out.itertuples()}

    assert take(0, [(2, 1010, "a", "A", None), (1, 1000, "a", "A", None), (3, 1020, "b", None, None), (4, 1030, None, "A", None), (5, 1031, "c", "C", "duplicate_text")]) == {
        1: None, 2: "duplicate_user", 3: None, 4: "duplicate_reply", 5: "duplicate_text"}
    assert handle.value.updates == 1 and handle.timers == {2000001}
    assert take(1050, [(6, 1100, "a", "B", None), (7, 1125, None, "A", None)]) == {6: None, 7: "duplicate_user"}
    assert take(1200, [(8, 1210, "b", None, None)]) == {8: None}
    assert dict(zip(*handle.value.held[:2], strict=True)) == {"b": 1210 * D.MICROS} and handle.value.held[2:4] == (1100 * D.MICROS, "B")
    assert handle.timers == {2100001}


def test_a_text_is_answered_once(spark, monkeypatch):
    catalog = X.text_catalog(spark, "/root/testdata/sf0.001").filter("variant_id < 24")
    variants = C.build_variants(catalog).withColumns({"price": F.col("variant_id") * 10 + 5000, "region": F.lit(None).cast("string")}).localCheckpoint()
    index = C.build_alias_index(catalog).localCheckpoint()
    title = catalog.filter("variant_id = 13").first().title
    texts = [f"куплю {title}", None, "привет"]
    batch = spark.createDataFrame([(i, i, 1, texts[i % 3]) for i in range(30)], "message_id long, user_id long, chat_id long, text string").withColumn("ts", F.timestamp_seconds("message_id"))
    seen = []
    lines = D.normalize_queries
    monkeypatch.setattr(D, "normalize_queries", lambda q, *a, **k: seen.append(q.count()) or lines(q, *a, **k))
    got = D.answer_messages(batch, variants, index).collect()
    assert seen == [2] and len(got) == 30
    kinds = {(texts.index(r.text), r.msg_class, r.reply is None) for r in got}
    assert kinds == {(0, "product", False), (1, "spam", True), (2, "spam", True)}


def test_columns_are_built_once(spark):
    assert R._phrase_columns("_l0", "second") is R._phrase_columns("_l0", "second")
    steps = [A._attribute_steps(t, None, None, None, None, False, None) for t in ("a", "a", "b")]
    assert steps[0] is steps[1] and steps[0] is not steps[2]
    rows = spark.createDataFrame([("Galaxy S25 128GB Black", "iPhone 17 256GB White")], "a string, b string")
    for t, want in (("a", "Black"), ("b", "White"), ("a", "Black")):
        assert A.with_attributes(rows, t).first().color == want


def test_copies_of_a_message_are_classified_once(spark):
    """The patterns stand behind the grouping of the texts, in the stored part of the plan."""
    plan = E.queries()["classify_messages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper() and "Join" in plan


def test_phrases_by_plain_looks_and_by_pattern(spark):
    """The pattern decides, whatever the looks before it say; it runs only where they leave a pair open."""
    phrases = ["one two", "a.b c", "-x y", "one  two three", "zwei drei", "ärger im", "e"]
    texts = ["one two", "xone two", "one twos, one-two!", "ONE._- two", "a b c", "a.b_c", "a.b c1 a.b  c", "q -x y", "q-x.y", "x y", "one\ttwo\n three", "Zwei", "zwei dreißig", "Ärger im", "bärger imx ärger  im.",
             "one two1 one two", "e", "ée e", None, "eé", "drei zwei"]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    p = spark.createDataFrame(list(enumerate(phrases)), "phrase_id int, phrase string")
    got = {tuple(r) for r in PH.phrase_hits(t, p, "k").collect()}
    every = t.crossJoin(p.withColumn("_p", phrase_pattern(F.col("phrase")))).filter("lower(text) rlike _p").select("k", "phrase_id")
    want = {tuple(r) for r in every.collect()}
    assert got == want and len(want) > 12
    plan = PH.phrase_hits(t, p, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan
