"""URL filter: a sort-merge range join between canonical url keys and nested rules.

A host is reversed label by label and each label ends with a dot (``com.example.www.``), so that "this host and its subdomains" is the interval of keys
with one prefix; path prefixes are intervals of paths in the same way.  Urls and rules are sorted together, and a running ``last`` carries the stack of the
rules that are open at the latest rule start; the entries that do not cover the url are popped.  Hosts are swept first, then the paths under each open host.
Ranges of the key are cut from the urls, a hot key is dealt over several of them, and each range starts with the stack the ranges before it left open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bucket_cuts, bucket_of, cut_lineage

# Given rules: (verdict, host, path).
DEFAULT_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
RULE_SCHEMA = "verdict string, host string, path string"


def url_parts(url):
    """(host, path): both empty for null or without ``://``; A-Z of the host in lower case."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit("."))


def _sweep(urls: DataFrame, rules: DataFrame, group: list[str], key: str, buckets: int) -> DataFrame:
    """``urls`` with ``open``: entries of the stack whose key is a prefix of the url's.

    ``urls`` has ``uid`` and the columns of ``group`` and ``key``; ``rules`` has the same and ``stack``: the rules, outermost first, that are open once
    this one has started, itself included.
    """
    order = F.concat_ws("\x01", *group, key) if group else F.col(key)
    urls, rules = urls.withColumn("_at", order), rules.withColumn("_at", order)
    cuts = bucket_cuts(urls, "_at", F.xxhash64("uid"), buckets)
    place = lambda df, spread: df.withColumn("_bucket", bucket_of(F.col("_at"), cuts, "string", spread))
    urls = place(urls, F.xxhash64("uid"))
    rules = place(rules, F.lit(0))
    events = urls.withColumn("_turn", F.lit(1)).unionByName(rules.withColumn("_turn", F.lit(0)), allowMissingColumns=True)
    run = Window.partitionBy("_bucket").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("_open", F.last("stack", ignorenulls=True).over(run)).where("_turn = 1")
    # The stack a range starts with: the last one of the nearest earlier range that has rules.  One row for each range.
    ends = rules.groupBy("_bucket").agg(F.max_by("stack", "_at").alias("_end"))
    ends = urls.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_bucket")).join(ends, "_bucket", "left")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_bucket", F.last("_end", ignorenulls=True).over(before).alias("_end"))
    swept = swept.join(ends, "_bucket", "left").withColumn("_open", F.coalesce("_open", "_end"))
    popped = F.filter(F.col("_open"), lambda r: F.startswith(F.col(key), r["key"]))
    if group:
        popped = F.filter(popped, lambda r: F.array(*[r[g] for g in group]) == F.array(*group))
    return swept.withColumn("open", popped).drop("_at", "_turn", "_bucket", "_open", "_end", "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", buckets: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages`` (page_id, url; other columns are ignored).

    ``rules``: verdict, host, path.  A rule fits its host and all subdomains if the url's path starts with the rule's path.  The longest rule (host and
    path together, then the longer host, then the lesser verdict) wins; without one, ``default`` holds and ``rule`` is null.  Rules with a null field fit
    nothing, repeated rules count once; rule hosts hold no control characters.  Repeated pages are judged each, null urls and ids are kept.
    """
    spark = pages.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    urls = urls.withColumns({"uid": F.struct("page_id", "url"), "hkey": host_key(F.col("host"))}).drop("url")
    rules = rules.dropna().select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").distinct().withColumn("hkey", host_key(F.col("host")))

    # Open hosts at the start of each rule host: those of its label prefixes that carry rules, found by an equality join.
    hosts = rules.select("hkey").distinct()
    labels = F.split(F.expr("substr(hkey, 1, length(hkey) - 1)"), "\\.", -1)
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))))
    stacks = hosts.select(F.col("hkey").alias("of"), prefix.alias("hkey")).join(hosts, "hkey")
    stacks = stacks.groupBy("of").agg(F.sort_array(F.collect_list(F.struct(F.col("hkey").alias("key")))).alias("stack"))
    swept = cut_lineage(_sweep(urls, stacks.select(F.col("of").alias("hkey"), "stack"), [], "hkey", buckets))

    # Under each open host: the paths.  A page stays in as many rows as it has open hosts, which its labels bound.
    probes = swept.where(F.size("open") > 0).select("uid", "path", F.explode("open.key").alias("rhost"))
    best = rules.groupBy(F.col("hkey").alias("rhost"), "path").agg(F.min(F.struct("verdict", "host")).alias("r"))
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), 1, n)))
    near = best.select("rhost", F.col("path").alias("of"), starts.alias("path")).join(best, ["rhost", "path"])
    near = near.groupBy("rhost", "of").agg(F.sort_array(F.collect_list(F.struct(F.col("path").alias("key"), "rhost", "r"))).alias("stack"))
    found = _sweep(probes, near.select("rhost", F.col("of").alias("path"), "stack"), ["rhost"], "path", buckets)
    fits = found.select("uid", F.explode("open").alias("o")).groupBy("uid").agg(F.max_by(
        F.struct(F.concat("o.r.host", "o.key").alias("rule"), F.col("o.r.verdict").alias("verdict")),
        F.struct(F.length(F.concat("o.r.host", "o.key")), F.length("o.r.host"), F.when(F.col("o.r.verdict") == "allow", 1).otherwise(0)),
    ).alias("best"))
    # A page without an open host has nothing to look up.
    out = swept.select("uid", "host", "path").join(fits, "uid", "left")
    return out.select("uid.page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
