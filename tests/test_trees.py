"""Trees of any depth and dictionary phrases against plain loops."""

import json
import random
import re

from pricewell.operators import catalog as C, phrases as PH, trees as T


def test_marks_and_choice(spark):
    rng = random.Random(2)
    paths = [[rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(120)] + [["x"], ["ab", "c"], ["a", "b c"]]
    marks = [(rng.choice(paths)[: rng.randrange(1, 12)], float(i)) for i in range(25)] * 2
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "id int, path array<string>")
    given = spark.createDataFrame([("|".join(p), v) for p, v in marks], "path_key string, value double")
    got = {r.id: r.nearest for r in T.nearest_mark(df, given, []).collect()}
    for i, p in enumerate(paths):
        above = [(len(m), v) for m, v in marks if p[: len(m)] == m]
        assert got[i] == (max(above)[1] if above else None)
    spec = spark.createDataFrame([(m,) for m, _ in marks], "spec_path array<string>")
    kept = {r.id for r in T.chosen_rows(df, spec, []).collect()}
    assert kept == {i for i, p in enumerate(paths) if any(p[: len(m)] == m or m[: len(p)] == p for m, _ in marks)}
    assert T.chosen_rows(df, spec.limit(0), []).count() == len(paths)


def test_subtree(spark):
    rows = [(["a", "b", "c"], 3), (["a", "b"], None), (["a"], 1), (["d"] * 9, 5)]
    got = {(r.key, r.n_leaves, r.n_valued, r.least) for r in T.subtree_totals(spark.createDataFrame(rows, "path array<string>, v int"), "v").collect()}
    assert {("a", 3, 2, 1), ("a|b", 2, 1, 3), ("a|b|c", 1, 1, 3), ("|".join("d" * 9), 1, 1, 5)} <= got and len(got) == 12


def test_flatten(spark):
    tree = {"b": {"a": ["x", {"y": 1}], "s": "leaf"}, "n": None, "e": {}, "z": {"z": {"z": {"z": {"z": {"z": "deep"}}}}}, "t": "{not json"}
    rows = spark.createDataFrame([(1, json.dumps(tree)), (2, None), (3, '"one"')], "id int, tree string")
    got = sorted((r.id, "|".join(r.path), tuple(r.positions), r.leaf) for r in T.flatten_tree(rows).collect() if r.leaf is not None)
    assert got == sorted([(1, "b|a", (0, 0, 0), "x"), (1, "b|a|y", (0, 0, 1, 0), "1"), (1, "b|s", (0, 1), "leaf"), (1, "z|z|z|z|z|z", (3, 0, 0, 0, 0, 0), "deep"), (1, "t", (4,), "{not json"), (3, "", (), '"one"')])


def test_phrases(spark):
    rng = random.Random(4)
    words = ["pro", "max", "air", "Яндекс", "станция", "wi-fi", "a", "5g", "é", "c++", "я", "."]
    phrases = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(60)] + ["", None, "  pro  max ", "()"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "-", "_", ". ", "", "  "]) for _ in range(rng.randrange(0, 14))) for _ in range(80)] + [None, "", "PRO MAX", "()"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    p = spark.createDataFrame(list(enumerate(phrases)), "phrase_id int, phrase string")
    got = {(r.id, r.phrase_id) for r in PH.phrase_hits(t, p, "id").collect()}
    want = set()
    for j, q in enumerate(phrases):
        if (q or "").strip():
            pattern = re.compile("(?<![a-z0-9])" + r"[\s._-]+".join(map(re.escape, re.split(" +", q.strip().lower()))) + "(?![a-z0-9])", re.ASCII)
            want |= {(i, j) for i, x in enumerate(texts) if x is not None and pattern.search(x.lower())}
    assert got == want
    plan = PH.phrase_hits(t, p, "id")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "rlike" not in plan.partition("BroadcastNestedLoopJoin")[2].split("\n")[0]


def test_edit_chains(spark):
    """Long chains, names given again and to themselves, deletions."""
    rng = random.Random(8)
    log = [("c", i, "delete" if rng.random() < 0.1 else "rename", rng.choice("abcdefg"), rng.choice("abcdefg")) for i in range(60)] + [("d", i, "rename", f"n{i}", f"n{i + 1}") for i in range(40)]
    edits = spark.createDataFrame(log, "cat string, seq long, action string, name string, new_name string")
    names = [("c", n) for n in "abcdefgz"] + [("d", "n0"), ("d", "n39")]
    got = {(r.cat, r.name): (r.final, r.n_edits) for r in C.replay_edits(spark.createDataFrame(names, "cat string, name string"), edits, ["cat"]).collect()}
    for cat, name in names:
        now, n = name, 0
        for c, _, action, old, new in log:
            if c == cat and now == old:
                now, n = (new if action == "rename" else None), n + 1
        assert got[cat, name] == (now, n)
