"""Queries over plain offers: best price, winners, roll-ups, prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money as M
from ..functions.text import fmt_price
from ..operators import catalog as C, match as J, pricing as P, publish as B, rollup as A
from ..session import cut_lineage
from . import bindings as X
from .registry import query

BEST_SQL = f"""
offer AS (SELECT l_partkey AS variant_id, {X.CHANNEL} AS channel, {X.UNIT_PRICE} AS price FROM lineitem),
mn AS (SELECT variant_id, min(price) AS min_price, count(*) AS n_offers, count(DISTINCT channel) AS n_channels FROM offer GROUP BY 1),
win AS (SELECT DISTINCT o.variant_id, o.channel FROM offer o JOIN mn ON o.variant_id = mn.variant_id AND o.price - mn.min_price <= 0.0001),
best AS (SELECT mn.*, w.best_channels FROM mn JOIN (SELECT variant_id, string_agg(channel, ',' ORDER BY channel) AS best_channels FROM win GROUP BY 1) w USING (variant_id))
"""


# The checks state the bands themselves, so that a wrong band in the package shows.
def margin_sql(c: str) -> str:
    return (f"(CASE WHEN {c} <= 5000 THEN 0.30::DOUBLE WHEN {c} <= 10000 THEN 0.20::DOUBLE WHEN {c} <= 30000 THEN 0.15::DOUBLE WHEN {c} <= 40000 THEN 0.10::DOUBLE "
            f"WHEN {c} <= 50000 THEN 0.05::DOUBLE WHEN {c} <= 60000 THEN 0.08::DOUBLE WHEN {c} <= 70000 THEN 0.06::DOUBLE WHEN {c} <= 90000 THEN 0.05::DOUBLE ELSE 0.04::DOUBLE END)")


def wholesale_sql(c: str) -> str:
    return f"({c} + CASE WHEN {c} < 20000 THEN 300 WHEN {c} < 150000 THEN 500 WHEN {c} < 250000 THEN 1000 ELSE 2000 END)"


def retail_sql(c: str) -> str:
    return (f"({c} + CASE WHEN {c} <= 10000 THEN 1500 WHEN {c} <= 25000 THEN 2000 WHEN {c} <= 70000 THEN 3000 WHEN {c} <= 100000 THEN 4000 "
            f"WHEN {c} <= 200000 THEN 5000 ELSE 20000 END)")


def best(spark, d):
    return J.best_price(X.offers(spark, d), ["variant_id"])


@query("best_offer_per_variant", f"""WITH {BEST_SQL}
SELECT p_partkey AS variant_id, p_type AS cat, p_brand AS brand, p_name AS model, min_price, n_offers, n_channels, best_channels,
 CAST(ceil(round_even(min_price, 0) * (1.0::DOUBLE + {margin_sql('round_even(min_price, 0)')})) AS BIGINT) AS price_retail
FROM part LEFT JOIN best ON p_partkey = variant_id""")
def best_offer_per_variant(spark, d):
    cat = X.catalog(spark, d).select("variant_id", "cat", "brand", "model")
    joined = cat.join(best(spark, d), "variant_id", "left")
    return P.price_variants(joined).select(
        *cat.columns, "min_price", "n_offers", "n_channels", F.array_join("best_channels", ",").alias("best_channels"), "price_retail"
    )


@query("offer_dedupe", f"""SELECT l_partkey AS variant_id, {X.CHANNEL} AS channel, {X.UNIT_PRICE} AS price, l_returnflag AS raw, max(l_shipdate) AS seq
FROM lineitem GROUP BY ALL""")
def offer_dedupe(spark, d):
    return J.dedupe_offers(X.offers(spark, d), ["variant_id"]).select("variant_id", "channel", "price", "raw", "seq")


@query("winning_channels", f"WITH {BEST_SQL} SELECT win.variant_id, channel, min_price FROM win JOIN mn ON win.variant_id = mn.variant_id")
def winning_channels(spark, d):
    return best(spark, d).select("variant_id", F.explode("best_channels").alias("channel"), "min_price")


@query("channel_wins", f"WITH {BEST_SQL} SELECT channel, count(*) AS wins FROM win GROUP BY 1")
def channel_wins(spark, d):
    return J.channel_wins(best(spark, d))


@query("source_channels", f"""SELECT l_partkey AS variant_id, count(DISTINCT l_suppkey) AS n_channels, min({X.CHANNEL}) AS first_channel, count(DISTINCT {X.LINE}) AS n_raw, min({X.LINE}) AS first_raw FROM lineitem GROUP BY 1""")
def source_channels(spark, d):
    o = X.offer_lines(spark, d).select(F.col("true_variant").alias("variant_id"), "channel", F.col("text").alias("raw"))
    pairs = J.collect_sources(o, ["variant_id"])
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    return pairs.groupBy("variant_id").agg(F.count(of("channel", "value")).alias("n_channels"), F.min(of("channel", "value")).alias("first_channel"),
                                           F.count(of("raw", "value")).alias("n_raw"), F.min(of("raw", "value")).alias("first_raw"))


@query("unmatched_offers", """SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber % 5 = 0 THEN -1 - l_partkey ELSE l_partkey END AS variant_id FROM lineitem
WHERE CASE WHEN l_linenumber % 5 = 0 THEN -1 - l_partkey ELSE l_partkey END NOT IN (SELECT p_partkey FROM part)""")
def unmatched_offers(spark, d):
    o = X.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", "CASE WHEN l_linenumber % 5 = 0 THEN -1 - l_partkey ELSE l_partkey END AS variant_id")
    return J.unmatched_offers(o, X.catalog(spark, d), ["variant_id"])


# ------------------------------------------------------------------- roll-up
REG = "CASE variant_id % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'jp' END"


def _items(spark, d):
    """Matches per variant; parts that share type, brand and name share a title."""
    j = X.catalog(spark, d).join(best(spark, d), "variant_id")
    return j.selectExpr(
        "cat", "brand", "brand AS series", "brand AS model", "model AS title", "floor(min_price) AS min_price",
        "best_channels", f"array_compact(array({REG})) AS region_min", "variant_id AS seq",
    )


ITEM_SQL = f"""{BEST_SQL},
item AS (SELECT p_type AS cat, p_brand AS brand, p_name AS title, CAST(floor(min_price) AS BIGINT) AS min_price, best_channels, {REG} AS reg, variant_id AS seq
 FROM part JOIN best ON p_partkey = variant_id)"""


def index_sql(src: str, out: str) -> str:
    return f"""{out}_low AS (SELECT cat, brand, title, min(min_price) AS min_price FROM {src} GROUP BY ALL),
{out}_at AS (SELECT i.* FROM {src} i JOIN {out}_low l USING (cat, brand, title, min_price)),
{out}_reg AS (SELECT cat, brand, title, string_agg(reg, ',' ORDER BY s) AS region_min FROM (SELECT cat, brand, title, reg, min(seq) AS s FROM {out}_at WHERE reg IS NOT NULL GROUP BY ALL) GROUP BY ALL),
{out} AS (SELECT a.cat, a.brand, a.title, any_value(a.min_price) AS min_price, arg_min(a.best_channels, a.seq) AS best_channels, coalesce(any_value(r.region_min), '') AS region_min
 FROM {out}_at a LEFT JOIN {out}_reg r USING (cat, brand, title) GROUP BY ALL)"""


def _flat(df, *cols):
    return df.select(*cols, F.col("title_key").alias("title"), F.col("min_price").cast("bigint").alias("min_price"),
                     F.array_join("best_channels", ",").alias("best_channels"), F.array_join("region_min", ",").alias("region_min"))


@query("price_catalog_rollup", f"WITH {ITEM_SQL}, {index_sql('item', 'idx')} SELECT cat, brand, title, min_price, best_channels, region_min FROM idx")
def price_catalog_rollup(spark, d):
    return _flat(A.winner_index(_items(spark, d)), "cat", "brand")


@query("tenant_merge", f"""WITH {ITEM_SQL},
base AS (SELECT * REPLACE (seq * 2 AS seq) FROM item), own AS (SELECT * REPLACE (seq * 2 + 1000000000000 AS seq) FROM item WHERE seq % 3 = 0),
both_ AS (SELECT * FROM base UNION ALL SELECT * FROM own), {index_sql('both_', 'idx')} SELECT cat, brand, title, min_price, best_channels, region_min FROM idx""")
def tenant_merge(spark, d):
    items = _items(spark, d)
    return _flat(A.merge_tenant(items, items.filter("seq % 3 = 0")), "cat", "brand")


@query("tenant_view", """SELECT n_nationkey AS tenant_id, CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey IN (SELECT c_nationkey FROM customer) THEN 'own' ELSE 'base' END AS source,
 CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey IN (SELECT c_nationkey FROM customer) THEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) ELSE (SELECT count(*) FROM supplier) END AS n_rows FROM nation""")
def tenant_view(spark, d):
    base = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.lit("base").alias("source"))
    own = X.table(spark, d, "customer").select(F.col("c_nationkey").alias("tenant_id"), F.col("c_custkey").alias("row_id"), F.lit("own").alias("source"))
    tenants = X.table(spark, d, "nation").selectExpr("n_nationkey AS tenant_id", "CASE WHEN n_nationkey % 3 = 0 THEN 'default' ELSE 'custom' END AS mode")
    sources = A.tenant_sources(own, tenants)
    counts = own.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("_own"))
    total = base.agg(F.count(F.lit(1)).alias("_base"))
    return sources.join(counts, "tenant_id", "left").crossJoin(F.broadcast(total)).select(
        "tenant_id", "source", F.when(F.col("source") == "own", F.col("_own")).otherwise(F.col("_base")).alias("n_rows"))


LK_TITLE = "CASE variant_id % 3 WHEN 0 THEN concat('M', CAST(variant_id AS VARCHAR(20)), ' 8/256gb') WHEN 1 THEN concat('M', CAST(variant_id AS VARCHAR(20)), ' 256gb') ELSE concat('M', CAST(variant_id - variant_id % 6 AS VARCHAR(20)), ' 12/512 GB') END"
LK_VARIANT = "CASE variant_id % 4 WHEN 0 THEN concat('m', CAST(variant_id AS VARCHAR(20)), '  256GB') WHEN 1 THEN concat('M', CAST(variant_id AS VARCHAR(20)), ' 8/256gb') WHEN 2 THEN concat('m', CAST(variant_id AS VARCHAR(20)), ' 12/256GB') ELSE concat('m', CAST(variant_id - variant_id % 6 AS VARCHAR(20)), ' 512 gb') END"
_KEY = "regexp_replace(lower(trim({0})), ' {{2,}}', ' ', 'g')"
_STRIP = r"regexp_replace({0}, '\b\d{{1,2}}\s*/\s*(\d{{2,4}}\s*(?:gb|tb))\b', '\1', 'g')"


@query("two_step_lookup", f"""WITH {BEST_SQL},
src AS (SELECT p_type AS cat, {_KEY.format(LK_TITLE)} AS k, floor(min_price) AS min_price FROM best JOIN part ON p_partkey = variant_id),
idx AS (SELECT cat, k, min(min_price) AS min_price FROM src GROUP BY ALL),
st AS (SELECT cat, {_STRIP.format('k')} AS k2, count(*) AS n, min(min_price) AS min_price FROM idx WHERE {_STRIP.format('k')} <> k GROUP BY ALL),
full_ AS (SELECT cat, k, min_price FROM idx UNION ALL SELECT cat, k2, min_price FROM st WHERE n = 1 AND (cat, k2) NOT IN (SELECT (cat, k) FROM idx)),
v AS (SELECT p_partkey AS variant_id, p_type AS cat, {_KEY.format(LK_VARIANT.replace('variant_id', 'p_partkey'))} AS k FROM part)
SELECT variant_id, v.cat, CAST(coalesce(a.min_price, b.min_price) AS BIGINT) AS min_price FROM v LEFT JOIN full_ a ON a.cat = v.cat AND a.k = v.k
LEFT JOIN full_ b ON b.cat = v.cat AND b.k = {_STRIP.format('v.k')}""")
def two_step_lookup(spark, d):
    c = X.catalog(spark, d)
    items = c.join(best(spark, d), "variant_id").selectExpr(
        "cat", f"{LK_TITLE} AS title", "floor(min_price) AS min_price", "best_channels", "array('us') AS region_min", "variant_id AS seq")
    from ..functions.text import title_key
    # the index is a stored stage: the lookup reads it three times
    index = cut_lineage(A.winner_index(items.withColumn("title_key", title_key("title")), ["cat", "title_key"]))
    out = A.price_lookup(c.selectExpr("variant_id", "cat", f"{LK_VARIANT} AS title"), index, ["cat"])
    return out.select("variant_id", "cat", F.col("min_price").cast("bigint").alias("min_price"))


LOW_PRICED = "SELECT p_type AS cat, p_brand AS brand, p_name AS model, CASE WHEN min_price < 2000 THEN min_price END AS min_price FROM part LEFT JOIN best ON p_partkey = variant_id"


def _priced(spark, d):
    c = X.catalog(spark, d).join(best(spark, d), "variant_id", "left")
    return c.withColumn("min_price", F.when(F.col("min_price") < 2000, F.col("min_price")))


@query("coverage_rollup", f"""WITH {BEST_SQL}, c AS ({LOW_PRICED})
SELECT cat, brand, model, count(*) AS n_variants, count(min_price) AS n_priced, CAST(grouping(cat, brand, model) AS INT) AS level FROM c GROUP BY ROLLUP (cat, brand, model)""")
def coverage_rollup(spark, d):
    return A.coverage_rollup(_priced(spark, d), ["cat", "brand", "model"], F.col("min_price").isNotNull())


@query("subtree_priced", f"""WITH {BEST_SQL}, c AS ({LOW_PRICED})
SELECT cat, brand, count(min_price) > 0 AS has_price FROM c GROUP BY ROLLUP (cat, brand)""")
def subtree_priced(spark, d):
    return A.subtree_priced(_priced(spark, d), ["cat", "brand"]).select("cat", "brand", "has_price")


@query("catalog_counts", "SELECT count(DISTINCT (p_type, p_brand, p_name)) AS n_models, count(*) AS n_variants FROM part")
def catalog_counts(spark, d):
    c = X.catalog(spark, d).withColumn("series", F.col("brand"))
    return A.catalog_counts(c)


ATTRS = {"cat": "p_type", "brand": "p_brand", "model": "nullif(p_name, 'old rod')", "size": "CAST(p_size AS VARCHAR)"}
UNPIVOT = " UNION ALL ".join(f"SELECT '{a}' AS attr, {e} AS value FROM part" for a, e in ATTRS.items())


def _attrs(spark, d):
    return X.catalog(spark, d).withColumn("model", F.nullif("model", F.lit("old rod")))


@query("attribute_coverage", f"SELECT attr, count(value) AS n_filled, count(DISTINCT value) AS n_distinct, (SELECT count(*) FROM part) AS n_rows FROM ({UNPIVOT}) GROUP BY 1")
def attribute_coverage(spark, d):
    return A.attribute_coverage(_attrs(spark, d), list(ATTRS))


@query("top_values", f"""WITH v AS (SELECT attr, value, count(*) AS n FROM ({UNPIVOT}) WHERE value IS NOT NULL GROUP BY ALL)
SELECT attr, value, n, CAST(row_number() OVER (PARTITION BY attr ORDER BY n DESC, value) AS INT) AS rn FROM v QUALIFY rn <= 10""")
def top_values(spark, d):
    return A.top_values(_attrs(spark, d), list(ATTRS), 10)


# -------------------------------------------------------------------- prices
@query("margin_bands", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(l_extendedprice, 0) AS BIGINT) AS price_min, CAST(round_even(l_extendedprice, 0) AS BIGINT) + 500 AS price_opt,
 CAST(ceil(round_even(l_extendedprice, 0) * (1.0::DOUBLE + {margin_sql('round_even(l_extendedprice, 0)')})) AS BIGINT) AS price_retail FROM lineitem""")
def margin_bands(spark, d):
    df = X.table(spark, d, "lineitem").withColumn("min_price", F.col("l_extendedprice"))
    return P.price_variants(df).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_min", "price_opt", "price_retail")


@query("channel_markup", f"""SELECT o_orderkey, CAST(round_even({wholesale_sql('o_totalprice')}, 0) AS BIGINT) AS opt_price, CAST(round_even({retail_sql('o_totalprice')}, 0) AS BIGINT) AS retail_price,
 CAST(round_even({wholesale_sql('o_totalprice')} * (1.0::DOUBLE + 0.03::DOUBLE) + 1000.0::DOUBLE, 0) AS BIGINT) AS custom_price FROM orders""")
def channel_markup(spark, d):
    p = F.col("o_totalprice")
    return X.table(spark, d, "orders").select(
        "o_orderkey", M.channel_price(p, F.lit("opt")).alias("opt_price"), M.channel_price(p, F.lit("retail")).alias("retail_price"),
        M.channel_price(p, F.lit("opt"), pct=F.lit(0.03), flat=F.lit(1000.0)).alias("custom_price"))


@query("round_up_step", "SELECT o_orderkey, CAST(floor((o_totalprice + 999) / 1000) * 1000 AS BIGINT) AS up_1000, CAST(floor((floor(o_totalprice) + 99) / 100) * 100 AS BIGINT) AS up_100 FROM orders")
def round_up_step(spark, d):
    return X.table(spark, d, "orders").select(
        "o_orderkey", M.round_up("o_totalprice", F.lit(1000)).alias("up_1000"), M.round_up(F.floor("o_totalprice"), F.lit(100)).alias("up_100"))


@query("answer_markup", f"SELECT o_orderkey, CAST({wholesale_sql('CAST(floor(o_totalprice) AS BIGINT)')} AS BIGINT) AS price FROM orders")
def answer_markup(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", M.answer_price(F.floor("o_totalprice")).alias("price"))


@query("price_format", "SELECT o_orderkey, replace(format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)), ',', ' ') AS shown FROM orders")
def price_format(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", fmt_price("o_totalprice").alias("shown"))


# overrides of a channel (a region) live on brands or on full paths; others use the channel default
OV_SQL = """ov AS (SELECT CAST(r_regionkey AS VARCHAR) AS channel_id, path_key, value FROM region CROSS JOIN (
 SELECT DISTINCT concat_ws('|', p_type, p_brand) AS path_key, CAST(p_size % 7 AS DOUBLE) AS value, p_type, p_brand, p_size FROM part WHERE p_name = 'red plate' AND p_size % 3 = 0
 UNION ALL SELECT DISTINCT concat_ws('|', p_type, p_brand, p_name), CAST(p_size AS DOUBLE), p_type, p_brand, p_size FROM part WHERE p_name = 'blue ring' AND p_size % 2 = 0) WHERE p_size % 5 = r_regionkey),
ov1 AS (SELECT channel_id, path_key, max(value) AS value FROM ov GROUP BY ALL)"""


def _overrides(spark, d):
    part = X.table(spark, d, "part")
    low = part.filter("p_name = 'red plate' AND p_size % 3 = 0").selectExpr("concat_ws('|', p_type, p_brand) AS path_key", "CAST(p_size % 7 AS DOUBLE) AS value", "p_size")
    deep = part.filter("p_name = 'blue ring' AND p_size % 2 = 0").selectExpr("concat_ws('|', p_type, p_brand, p_name) AS path_key", "CAST(p_size AS DOUBLE) AS value", "p_size")
    return low.unionByName(deep).selectExpr("CAST(p_size % 5 AS STRING) AS channel_id", "path_key", "value").groupBy("channel_id", "path_key").agg(F.max("value").alias("value"))


def _per_region(spark, d, rows, name):
    """Each row once for each key of ``region``; the keys come in one row."""
    keys = X.table(spark, d, "region").agg(F.collect_set("r_regionkey").alias("_keys"))
    return rows.crossJoin(F.broadcast(keys)).withColumn(name, F.explode("_keys")).drop("_keys")


@query("markup_override", f"""WITH {OV_SQL}, node AS (SELECT DISTINCT CAST(r_regionkey AS VARCHAR) AS channel_id, p_type, p_brand, p_name, 3.0::DOUBLE + r_regionkey AS dflt FROM part CROSS JOIN region)
SELECT n.channel_id, p_type AS cat, p_brand AS brand, p_name AS model, coalesce(a.value, b.value, dflt) AS markup FROM node n
LEFT JOIN ov1 a ON a.channel_id = n.channel_id AND a.path_key = concat_ws('|', p_type, p_brand, p_name)
LEFT JOIN ov1 b ON b.channel_id = n.channel_id AND b.path_key = concat_ws('|', p_type, p_brand)""")
def markup_override(spark, d):
    nodes = X.catalog(spark, d).select("cat", "brand", "model").distinct()
    rows = _per_region(spark, d, nodes, "r").selectExpr(
        "cat", "brand", "model", "array(cat, brand, model) AS path", "CAST(r AS STRING) AS channel_id", "3.0D + r AS markup_default")
    return P.resolve_markup(rows, _overrides(spark, d)).select("channel_id", "cat", "brand", "model", "markup")


@query("markup_summary", f"""WITH {OV_SQL}, pre AS (SELECT channel_id, path_key, value, split_part(path_key, '|', 1) AS k1, split_part(path_key, '|', 1) || '|' || split_part(path_key, '|', 2) AS k2 FROM ov1),
allk AS (SELECT channel_id, path_key, value, k1 AS key FROM pre UNION ALL SELECT channel_id, path_key, value, k2 FROM pre UNION ALL SELECT channel_id, path_key, value, path_key FROM pre WHERE path_key <> k2)
SELECT channel_id, key, coalesce(max(CASE WHEN path_key = key THEN value END), min(value)) AS value, max(CASE WHEN path_key = key THEN value END) IS NULL AS is_from, count(DISTINCT value) AS n_values FROM allk GROUP BY ALL""")
def markup_summary(spark, d):
    nodes = X.catalog(spark, d).select(F.array("cat", "brand", "model").alias("path"))
    return P.markup_summary(nodes, _overrides(spark, d))


@query("channel_rules", f"""SELECT c_custkey AS channel_id, coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 'retail' ELSE 'opt' END, 'opt') AS mode,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 0.05::DOUBLE WHEN c_custkey % 10 = 3 THEN 0.07::DOUBLE ELSE 0.01::DOUBLE END AS pct FROM customer""")
def channel_rules(spark, d):
    cust = X.table(spark, d, "customer")
    channels = cust.selectExpr("c_custkey AS channel_id", "CASE WHEN c_custkey % 10 = 3 AND c_mktsegment <> 'BUILDING' THEN 'ten' ELSE c_mktsegment END AS name", "'opt' AS type")
    rules = spark.sql("SELECT * FROM VALUES ('building', 'retail', 'legacy', 0.05D, 0.0D, 0), ('ten', 'opt', 'legacy', 0.07D, 0.0D, 0), "
                      "('default', 'opt', 'legacy', 0.01D, 0.0D, 0) AS t(rule_key, mode, base_mode, pct, flat, round_step)")
    return P.resolve_channel_rule(channels, rules).select("channel_id", "mode", "pct")


@query("pricing_ready", "SELECT c_custkey AS channel_id FROM customer WHERE c_custkey % 2 = 0 OR c_acctbal > 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def pricing_ready(spark, d):
    channels = X.table(spark, d, "customer").selectExpr(
        "c_custkey AS channel_id", "c_custkey % 2 = 1 AS pricing_custom", "CASE WHEN c_acctbal > 0 THEN c_acctbal END AS markup_default")
    ov = X.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("channel_id"))
    return P.pricing_ready(channels, ov).select("channel_id")


@query("channel_defaults", "SELECT c_custkey AS channel_id, CASE WHEN c_custkey % 3 = 0 THEN 'retail' ELSE 'opt' END AS type, c_custkey % 3 = 0 AS with_images, false AS round_prices, 'pct' AS markup_type FROM customer")
def channel_defaults(spark, d):
    ch = X.table(spark, d, "customer").selectExpr("c_custkey AS channel_id", "CASE WHEN c_custkey % 3 = 0 THEN 'retail' END AS type")
    return P.with_channel_defaults(ch).select("channel_id", "type", "with_images", "round_prices", "markup_type")


# ------------------------------------------------------- paths and catalogue
SPEC = "(VALUES (0, 'ECONOMY'), (1, 'SMALL|Brand#3'), (1, 'LARGE|Brand#4|red plate|x'), (2, 'PROMO|Brand#1|blue ring'), (3, 'NONE'))"


@query("path_prefix_filter", f"""WITH spec(channel_id, s) AS (SELECT * FROM {SPEC}), node AS (SELECT DISTINCT r_regionkey AS channel_id, concat_ws('|', p_type, p_brand, p_name) AS p FROM part CROSS JOIN region)
SELECT channel_id, p AS path FROM node n WHERE NOT EXISTS (SELECT 1 FROM spec WHERE spec.channel_id = n.channel_id)
 OR EXISTS (SELECT 1 FROM spec WHERE spec.channel_id = n.channel_id AND (starts_with(p || '|', s || '|') OR starts_with(s || '|', p || '|')))""")
def path_prefix_filter(spark, d):
    nodes = X.catalog(spark, d).select(F.array("cat", "brand", "model").alias("path")).distinct()
    nodes = _per_region(spark, d, nodes, "channel_id")
    spec = spark.sql(f"SELECT * FROM {SPEC} AS t(channel_id, s)")
    out = B.path_prefix_match(nodes, spec.select("channel_id", F.split("s", r"\|").alias("spec_path")), ["channel_id"])
    return out.select("channel_id", F.array_join("path", "|").alias("path"))


@query("catalog_reorder", """WITH o AS (SELECT 'Brand#' || n_nationkey AS brand, CAST(row_number() OVER (ORDER BY n_name) AS INT) AS new_pos FROM nation WHERE n_regionkey <> 3)
SELECT DISTINCT p_type AS cat, p_brand AS brand, new_pos IS NULL AS is_last, CAST(coalesce(new_pos, CAST(substr(p_brand, 7) AS INT)) AS INT) AS place FROM part LEFT JOIN o ON o.brand = p_brand""")
def catalog_reorder(spark, d):
    rows = X.catalog(spark, d).select("cat", "brand").distinct().withColumn("brand_pos", F.substring("brand", 7, 9).cast("int"))
    from pyspark.sql import Window
    # 25 nations: a fixed-size reference table
    order = X.table(spark, d, "nation").filter("n_regionkey <> 3").select(
        F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("brand"), F.row_number().over(Window.orderBy("n_name")).alias("new_pos"))
    return C.reorder_catalog(rows, {"brand": order}).select("cat", "brand", F.col("brand_rank.last").alias("is_last"), F.col("brand_rank.pos").alias("place"))


@query("catalog_order", "SELECT p_type AS cat, p_name AS model, min(p_partkey) AS variant_id, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY ALL")
def catalog_order(spark, d):
    return B.catalog_order(X.catalog(spark, d).select("cat", "model", "variant_id", "brand"), ["cat"], "model", ["variant_id"])


@query("short_ids", "SELECT p_partkey AS variant_id, substr(md5(concat_ws(':', p_type, p_brand, p_name)), 1, 8) AS short_id FROM part")
def short_ids(spark, d):
    return C.short_ids(X.catalog(spark, d), ["cat", "brand", "model"]).select("variant_id", "short_id")


@query("short_id_collisions", "SELECT substr(md5(p_type || ':' || p_name), 1, 2) AS short_id, count(DISTINCT (p_type, p_name)) AS n_paths FROM part GROUP BY 1 HAVING count(DISTINCT (p_type, p_name)) > 1")
def short_id_collisions(spark, d):
    ids = C.short_ids(X.catalog(spark, d), ["cat", "model"]).withColumn("short_id", F.substring("short_id", 1, 2))
    return C.short_id_collisions(ids, ["cat", "model"])


@query("catalog_edits", """SELECT p_partkey AS variant_id, p_type AS cat, CASE WHEN p_type = 'SMALL' AND p_brand = 'Brand#3' THEN 'Brand#X' ELSE p_brand END AS brand,
 CAST(CAST(substr(p_brand, 7) AS INT) + CASE WHEN p_type = 'SMALL' AND p_brand = 'Brand#3' THEN (SELECT max(CAST(substr(p_brand, 7) AS INT)) + 1 FROM part) ELSE 0 END AS INT) AS brand_pos FROM part WHERE NOT (p_type = 'PROMO' AND p_brand = 'Brand#4')
 UNION ALL SELECT NULL, 'ECONOMY', 'Brand#NEW', (SELECT CAST(max(CAST(substr(p_brand, 7) AS INT)) + 1 AS INT) FROM part)""")
def catalog_edits(spark, d):
    cat = X.catalog(spark, d).select("variant_id", "cat", "brand").withColumn("brand_pos", F.substring("brand", 7, 9).cast("int"))
    edits = spark.sql("SELECT * FROM VALUES ('rename', 'SMALL', 'Brand#3', 'Brand#X'), ('delete', 'PROMO', 'Brand#4', NULL), "
                      "('add', 'ECONOMY', 'Brand#NEW', NULL) AS t(action, cat, brand, new_name)")
    return C.apply_edits(cat, edits, "brand")


@query("variant_list_replace", """SELECT p_type AS cat, p_brand AS brand, p_name AS model, 'v' || p_partkey AS title, CAST(p_size AS INT) AS variant_pos FROM part WHERE p_type <> 'SMALL'
 UNION ALL SELECT DISTINCT p_type, p_brand, p_name, 'new', 0 FROM part WHERE p_type = 'SMALL'""")
def variant_list_replace(spark, d):
    cat = X.catalog(spark, d).selectExpr("cat", "brand", "brand AS series", "model", "0 AS cat_pos", "0 AS brand_pos", "0 AS series_pos", "0 AS model_pos",
                                         "concat('v', variant_id) AS title", "CAST(size AS INT) AS variant_pos")
    rows = cat.filter("cat = 'SMALL'").select(*C.PATH).distinct().withColumns({"title": F.lit("new"), "variant_pos": F.lit(0)})
    return C.replace_variants(cat, rows).select("cat", "brand", "model", "title", "variant_pos")


@query("catalog_skeleton", "SELECT DISTINCT p_type AS cat, p_brand AS brand, p_name AS model FROM part WHERE p_size > 10")
def catalog_skeleton(spark, d):
    v = X.catalog(spark, d).selectExpr("cat", "brand", "brand AS series", "model", "CASE WHEN size > 10 THEN model ELSE ' ' END AS title")
    return C.catalog_skeleton(v).select("cat", "brand", "model")
