"""The range join against brute force over rules and urls."""

import random

import pytest

from pricewell.llm import urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, signs: s[: min([s.find(c) for c in signs if c in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def judge(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


RULES = [*urls.DEFAULT_RULES, ("block", "a.b.c", "/"), ("allow", "b.c", "/x"), ("block", "b.c", "/x/y"), ("allow", "b.c", "/x/y/z"), ("block", "b.c", ""), ("allow", "c", "/xx")]


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_brute_force(spark, buckets):
    random.seed(buckets)
    labels = ["a", "b", "c", "com", "example", "net", "www", "de", "x-1"]
    paths = ["", "/", "/en/", "/en", "/fr/x", "/es/", "/x", "/x/y", "/x/y/z/1", "/xx/y", "/é", "//"]
    made = [f"{random.choice(['http', 'HTTPS', ''])}://{'.'.join(random.choice(labels) for _ in range(random.randrange(4)))}{random.choice(paths)}{random.choice(['', '?q=/en/', '#en', '?://b.c/x'])}"
            for _ in range(400)]
    made += [None, "", "no scheme", "http:/a.b", "http://WWW.Example.COM/en/1", "http://b.c", "http://b.c.", "http://b.c:80/x"] + ["http://www.example.com/en/same"] * 300
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(made)] + [(None, "http://b.c/x"), (3, made[3])], "page_id long, url string").selectExpr("*", "1 AS host", "'z' AS stack")
    got = urls.judge_urls(pages, spark.createDataFrame(RULES + [RULES[0], ("block", None, "/")], urls.RULE_SCHEMA), buckets=buckets).collect()
    assert len(got) == len(made) + 2
    want = {i: judge(u, RULES) for i, u in enumerate(made)} | {None: judge("http://b.c/x", RULES)}
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id], r


def test_empty(spark):
    rules = spark.createDataFrame(urls.DEFAULT_RULES, urls.RULE_SCHEMA)
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    page = spark.createDataFrame([(1, "http://x.com/a")], "page_id long, url string")
    assert urls.judge_urls(page, rules.limit(0), default="block").first().verdict == "block"


def test_native(spark):
    page = spark.createDataFrame([(1, "http://x.com/a")], "page_id long, url string")
    plan = urls.judge_urls(page, spark.createDataFrame(urls.DEFAULT_RULES, urls.RULE_SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
