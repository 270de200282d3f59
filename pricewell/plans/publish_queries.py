"""Queries over posts, views and competitor pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import competitors as K, match as J, publish as B, rollup as A, views as V
from ..sources import sinks as S
from . import bindings as X
from .offers_queries import wholesale_sql
from .registry import query

EP = X.catalog_exprs("p_partkey")
MODEL = ["cat", "brand", "series", "model"]
# The offers of every 17th variant name one that the catalogue lacks, so it stays unpriced.
OFFERED = "CASE WHEN l_partkey % 17 = 0 THEN -1 - l_partkey ELSE l_partkey END"
PRICED_SQL = f"""mn AS (SELECT {OFFERED} AS k, min({X.PRICE}) AS m FROM lineitem GROUP BY 1),
v AS (SELECT p_partkey, CAST(p_partkey % 12 AS INT) AS pos, {EP['cat']} AS cat, {EP['brand']} AS brand, {EP['model']} AS model, {EP['title']} AS title, m FROM part LEFT JOIN mn ON k = p_partkey)"""


def _priced(spark, d):
    price = X.table(spark, d, "lineitem").groupBy(F.expr(OFFERED).alias("variant_id")).agg(F.min(F.expr(X.PRICE)).alias("min_price"))
    return X.text_catalog(spark, d).join(price, "variant_id", "left")


def _shown(e: str) -> str:
    return f"replace(format('{{:,}}', CAST({e} AS BIGINT)), ',', ' ')"


@query("post_render", f"""WITH {PRICED_SQL}, l AS (SELECT *, title || ' - ' || {_shown(f"round_even({wholesale_sql('m')}, 0)")} AS line FROM v)
SELECT mode, cat, brand, model, CASE WHEN mode = 'opt' THEN string_agg(line, chr(10) ORDER BY pos) ELSE string_agg(coalesce(line, title), chr(10) ORDER BY pos) END AS text
FROM l CROSS JOIN (VALUES ('opt'), ('retail')) AS t(mode) GROUP BY mode, cat, brand, model""")
def post_render(spark, d):
    from ..functions.money import channel_price
    modes = F.explode(F.array(F.lit("opt"), F.lit("retail")))
    lines = _priced(spark, d).withColumn("mode", modes).withColumn("sell_price", channel_price("min_price", F.lit("opt")))
    return B.render_posts(lines, ["mode", "cat", "brand", "model"], order=["variant_pos"])


@query("variant_lines", f"""WITH {PRICED_SQL}, w AS (SELECT mn.k AS k, string_agg(DISTINCT {X.CHANNEL}, ', ' ORDER BY {X.CHANNEL}) AS who FROM lineitem JOIN mn ON mn.k = {OFFERED} AND {X.PRICE} = m GROUP BY 1)
SELECT p_partkey AS variant_id, CASE WHEN m IS NULL THEN title || ' — —' ELSE CASE WHEN p_partkey % 3 = 0 THEN '🇺🇸 ' ELSE '' END || title || ' — ' || {_shown('m')} || ' ₽ (' || who || ')' END AS line FROM v LEFT JOIN w ON w.k = p_partkey""")
def variant_lines(spark, d):
    o = X.table(spark, d, "lineitem").selectExpr(f"{OFFERED} AS variant_id", f"{X.CHANNEL} AS channel", f"{X.PRICE} AS price")
    best = J.best_price(o, ["variant_id"]).select("variant_id", "min_price", "best_channels")
    c = X.text_catalog(spark, d).join(best, "variant_id", "left").withColumn(
        "region_min", F.when(F.col("variant_id") % 3 == 0, F.array(F.lit("us"))).otherwise(F.array().cast("array<string>")))
    return c.select("variant_id", V.variant_line().alias("line"))


# A narrow message, so that a model takes several.
PAGE_TEXT = 200


@query("model_pages", f"""WITH {PRICED_SQL}, l AS (SELECT *, '📚 Каталог / ' || cat || ' / ' || brand || ' / ' || model || chr(10) || chr(10) AS head, title || ' — ' || CASE WHEN m IS NULL THEN '—' ELSE {_shown('m')} || ' ₽' END AS line FROM v),
r AS (SELECT *, {PAGE_TEXT} - length(head) - max(length(line) + 1) OVER (PARTITION BY cat, brand, model) AS room, sum(length(line) + 1) OVER (PARTITION BY cat, brand, model ORDER BY pos) - length(line) - 1 AS before FROM l),
m AS (SELECT cat, brand, model, min(p_partkey) AS k FROM v GROUP BY ALL), g AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY brand ORDER BY k) - 1) / 14) AS INT) AS page FROM m)
SELECT cat, brand, model, CAST(floor(before / greatest(room, 1)) AS INT) AS part_no, any_value(head) || string_agg(line, chr(10) ORDER BY pos) AS text, any_value(page) AS page FROM r JOIN g USING (cat, brand, model) GROUP BY ALL""")
def model_pages(spark, d):
    c = _priced(spark, d).withColumn("best_channels", F.array().cast("array<string>"))
    view = V.render_model_view(c, ["cat", "brand", "model"], regions=None, limit=PAGE_TEXT)
    first = c.groupBy("cat", "brand", "model").agg(F.min("variant_id").alias("k"))
    paged = V.page_numbers(first, ["brand"], ["k"], width=120000.0)
    return view.join(paged, ["cat", "brand", "model"]).select("cat", "brand", "model", "part_no", "text", "page")


@query("drill_down", "SELECT p_brand AS child, count(*) AS n FROM part WHERE p_type = 'ECONOMY' GROUP BY 1")
def drill_down(spark, d):
    c = X.catalog(spark, d).selectExpr("cat", "brand", "brand AS series", "model", "0 AS cat_pos", "0 AS brand_pos", "0 AS series_pos", "0 AS model_pos")
    kids = V.children(c, ["ECONOMY"])
    n = c.filter("cat = 'ECONOMY'").groupBy(F.col("brand").alias("child")).agg(F.count(F.lit(1)).alias("n"))
    return kids.join(n, "child").select("child", "n")


@query("catalog_completeness", "SELECT p_type AS cat, p_brand AS brand, p_name AS model, count(*) FILTER (p_size > 25) AS n_variants, count(*) FILTER (p_size > 25) > 0 AS complete FROM part GROUP BY ALL")
def catalog_completeness(spark, d):
    c = X.catalog(spark, d).selectExpr("cat", "brand", "brand AS series", "model", "CASE WHEN size > 25 THEN model ELSE '' END AS title")
    return V.catalog_completeness(c, c).select("cat", "brand", "model", "n_variants", "complete")


# --------------------------------------------------------------------- plan
POST_SQL = """post AS (SELECT o_orderkey AS message_id, o_orderstatus AS channel_id, 'M' || o_orderkey AS model, CASE WHEN o_orderkey % 7 = 0 THEN 'old' ELSE 'price ' || o_orderkey END AS text, o_orderkey % 11 = 0 AS has_media FROM orders),
want AS (SELECT s AS channel_id, 'M' || p_partkey AS model, CASE WHEN p_partkey % 13 <> 0 THEN 'price ' || p_partkey END AS text, p_partkey % 11 = 0 AND p_partkey % 2 = 0 AS want_media FROM part CROSS JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders))"""


def _posts(spark, d):
    return X.table(spark, d, "orders").selectExpr(
        "o_orderkey AS message_id", "o_orderstatus AS channel_id", "concat('M', o_orderkey) AS model",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'old' ELSE concat('price ', o_orderkey) END AS text", "o_orderkey % 11 = 0 AS has_media")


def _desired(spark, d):
    # the order states are the channels: one row that holds them all
    states = X.table(spark, d, "orders").agg(F.collect_set("o_orderstatus").alias("states"))
    part = X.table(spark, d, "part").crossJoin(F.broadcast(states)).withColumn("channel_id", F.explode("states"))
    return part.selectExpr(
        "channel_id", "concat('M', p_partkey) AS model", "CASE WHEN p_partkey % 13 <> 0 THEN concat('price ', p_partkey) END AS text",
        "p_partkey % 11 = 0 AND p_partkey % 2 = 0 AS want_media")


@query("publication_plan", f"""WITH {POST_SQL} SELECT coalesce(w.channel_id, p.channel_id) AS channel_id, coalesce(w.model, p.model) AS model, p.message_id,
 CASE WHEN w.text IS NULL AND p.message_id IS NOT NULL THEN 'delete' WHEN w.text IS NULL THEN 'skip' WHEN p.message_id IS NULL THEN 'create' WHEN p.has_media <> w.want_media THEN 'switch_media' WHEN p.text <> w.text THEN 'edit' ELSE 'skip' END AS action
FROM want w FULL JOIN post p ON w.channel_id = p.channel_id AND w.model = p.model""")
def publication_plan(spark, d):
    return B.publication_plan(_desired(spark, d), _posts(spark, d), ["channel_id"]).select("channel_id", "model", "message_id", "action")


@query("plan_counts", f"""WITH {POST_SQL} SELECT coalesce(w.channel_id, p.channel_id) AS channel_id, CASE WHEN w.text IS NULL AND p.message_id IS NOT NULL THEN 'delete' WHEN w.text IS NULL THEN 'skip' WHEN p.message_id IS NOT NULL AND w.channel_id = 'F' THEN 'reset' WHEN p.message_id IS NULL THEN 'create' WHEN p.has_media <> w.want_media THEN 'switch_media' WHEN p.text <> w.text THEN 'edit' ELSE 'skip' END AS action, count(*) AS n
FROM want w FULL JOIN post p ON w.channel_id = p.channel_id AND w.model = p.model GROUP BY ALL""")
def plan_counts(spark, d):
    resets = spark.sql("SELECT 'F' AS channel_id")
    return B.plan_counts(B.publication_plan(_desired(spark, d), _posts(spark, d), ["channel_id"], resets), ["channel_id"])


@query("obsolete_posts", f"WITH {POST_SQL} SELECT channel_id, message_id, model FROM post WHERE model IN (SELECT 'M' || p_partkey FROM part) AND (channel_id, model) NOT IN (SELECT (channel_id, model) FROM want WHERE text IS NOT NULL)")
def obsolete_posts(spark, d):
    titles = X.table(spark, d, "part").selectExpr("concat('M', p_partkey) AS title")
    return B.obsolete_posts(_posts(spark, d), titles, _desired(spark, d).filter("text IS NOT NULL"), ["channel_id"]).select("channel_id", "message_id", "model")


@query("vanished_posts", f"WITH {POST_SQL} SELECT channel_id, message_id FROM post WHERE message_id NOT IN (SELECT CASE WHEN l_orderkey % 7 = 3 THEN -l_orderkey ELSE l_orderkey END FROM lineitem)")
def vanished_posts(spark, d):
    seen = X.table(spark, d, "lineitem").selectExpr("CASE WHEN l_orderkey % 7 = 3 THEN -l_orderkey ELSE l_orderkey END AS message_id")
    cache = _posts(spark, d)
    return B.vanished_posts(cache, seen, []).select("channel_id", "message_id")


@query("grouped_posts", "SELECT p_type AS channel_id, CAST(p_partkey AS BIGINT) AS message_id FROM part WHERE p_partkey % 4 = 1 AND p_name <> 'red ' || p_brand")
def grouped_posts(spark, d):
    posts = X.table(spark, d, "part").selectExpr(
        "p_type AS channel_id", "CAST(p_partkey AS BIGINT) AS message_id", "CAST(NULL AS STRING) AS model",
        "CASE WHEN p_partkey % 4 = 1 THEN concat('<b>', p_name, '</b> <b>', p_brand, '</b>') ELSE concat('<b>', p_name, '</b>') END AS text")
    models = X.table(spark, d, "part").selectExpr("p_type AS channel_id", "explode(array(p_name, p_brand)) AS model")
    return B.grouped_posts(B.map_models_to_posts(posts, models, ["channel_id"])).select("channel_id", "message_id")


@query("hide_plan", f"WITH {POST_SQL} SELECT channel_id, message_id FROM post WHERE channel_id IN ('F', 'O') AND model IN (SELECT 'M' || p_partkey FROM part) AND CASE WHEN message_id % 5 = 0 THEN '.' ELSE text END <> '.'")
def hide_plan(spark, d):
    posts = _posts(spark, d).withColumn("text", F.when(F.col("message_id") % 5 == 0, ".").otherwise(F.col("text")))
    channels = spark.sql("SELECT * FROM VALUES ('F', 'opt'), ('O', 'opt'), ('P', 'retail') AS t(channel_id, type)")
    titles = X.table(spark, d, "part").selectExpr("concat('M', p_partkey) AS title")
    return B.hide_plan(posts, channels, titles, ["channel_id"]).select("channel_id", "message_id")


# plan position = part key inside its brand; post ids move forward but for some
MID = "CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 211 = 0 THEN 1 ELSE p_partkey * 10 END"
ORD_SQL = f"ord AS (SELECT p_brand AS brand, p_type AS cat, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS BIGINT) AS pos, CAST({MID} AS BIGINT) AS mid FROM part)"


def _ordered(spark, d):
    from ..operators.windows import numbered
    rows = X.table(spark, d, "part").selectExpr("p_brand AS brand", "p_type AS cat", "CAST(p_partkey AS BIGINT) AS p_partkey", f"CAST({MID} AS BIGINT) AS message_id")
    return numbered(rows, ["brand", "cat"], "p_partkey", 1000.0, "pos")


@query("order_break", f"WITH {ORD_SQL}, g AS (SELECT *, lag(mid) OVER w AS before, lag(pos) OVER w AS bp FROM ord WINDOW w AS (PARTITION BY brand, cat ORDER BY pos)) SELECT brand, cat, bool_or(mid IS NULL OR (bp IS NOT NULL AND (before IS NULL OR before >= mid))) AS needs_reset, count(*) AS n_posts FROM g GROUP BY ALL")
def order_break(spark, d):
    o = _ordered(spark, d)
    return B.order_breaks(o.select("brand", "cat", "pos", "p_partkey"), o.select("p_partkey", "message_id"), ["brand", "cat"], ["p_partkey"])


@query("section_reset", f"""WITH s AS (SELECT p_brand AS brand, CAST(substr(p_brand, 7) AS INT) AS section_pos, CASE WHEN p_brand = 'Brand#20' THEN NULL ELSE CAST(substr(p_brand, 7) AS INT) * 1000000 + min(p_partkey) END AS min_mid, CAST(substr(p_brand, 7) AS INT) * 1000000 + max(p_partkey) AS max_mid FROM part GROUP BY 1),
b AS (SELECT *, min_mid IS NULL OR coalesce(min_mid <= lag(max_mid) OVER (ORDER BY section_pos), false) AS bad FROM s) SELECT brand, section_pos, section_pos >= (SELECT min(section_pos) FROM b WHERE bad) AS republish FROM b""")
def section_reset(spark, d):
    rows = X.table(spark, d, "part").selectExpr("p_brand AS brand", "CAST(substr(p_brand, 7) AS INT) AS section_pos", "CAST(substr(p_brand, 7) AS INT) * 1000000 + p_partkey AS message_id")
    s = A.post_range(rows, ["brand", "section_pos"]).withColumn("min_mid", F.when(F.col("brand") != "Brand#20", F.col("min_mid")))
    return B.section_reset(s.withColumn("one", F.lit(1)), by=["one"]).select("brand", "section_pos", "republish")


@query("post_range", "SELECT o_orderpriority AS section, min(o_orderkey) AS min_mid, max(o_orderkey) AS max_mid FROM orders GROUP BY 1")
def post_range(spark, d):
    return A.post_range(X.table(spark, d, "orders").selectExpr("o_orderpriority AS section", "o_orderkey AS message_id"), ["section"])


@query("navigation_islands", f"""WITH {ORD_SQL}, p AS (SELECT *, CAST(floor(pos / 3) AS BIGINT) AS post FROM ord), r AS (SELECT *, pos - row_number() OVER (PARTITION BY brand, cat, post ORDER BY pos) AS isl FROM p)
SELECT brand, cat, post AS message_id, min(pos) AS first_pos, string_agg('M' || p_partkey, '/' ORDER BY pos) AS label FROM r GROUP BY brand, cat, post, isl""")
def navigation_islands(spark, d):
    o = _ordered(spark, d).select("brand", "cat", F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("model"))
    o = o.withColumn("message_id", F.floor(F.col("pos") / 3).cast("bigint"))
    return B.navigation(o, ["brand", "cat"]).select("brand", "cat", "message_id", "first_pos", "label")


@query("menu_changes", "SELECT p_brand AS brand, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'edit' WHEN p_brand = 'Brand#3' THEN 'create' ELSE 'skip' END AS action FROM part GROUP BY p_brand UNION ALL SELECT DISTINCT 'old ' || p_brand, 'delete' FROM part WHERE p_brand IN ('Brand#4', 'Brand#5')")
def menu_changes(spark, d):
    rows = X.table(spark, d, "part").selectExpr("p_brand AS brand", "'menu' AS title", "p_name AS label", "min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS link").distinct()
    rows = rows.withColumn("pos", F.col("link"))
    now = B.menu_fingerprint(rows, ["brand"])
    # What was posted: one menu with another label, one with two places changed, one not at all, two that are gone.
    ends = rows.groupBy("brand").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    was = rows.filter("brand <> 'Brand#3'").join(ends, "brand").withColumns({
        "label": F.when((F.col("brand") == "Brand#1") & (F.col("pos") == F.col("lo")), "other").otherwise(F.col("label")),
        "pos": F.when(F.col("brand") == "Brand#2", F.col("lo") + F.col("hi") - F.col("pos")).otherwise(F.col("pos"))})
    gone = rows.filter("brand IN ('Brand#4', 'Brand#5')").withColumn("brand", F.concat(F.lit("old "), "brand"))
    posted = B.menu_fingerprint(was.select(rows.columns).unionByName(gone), ["brand"]).withColumn("message_id", F.lit(1))
    return B.menu_changes(now, posted, ["brand"]).select("brand", "action")


@query("due_channels", "SELECT c_custkey AS channel_id FROM customer WHERE c_custkey % 24 = 13 AND c_custkey % 7 <> 0")
def due_channels(spark, d):
    ch = X.table(spark, d, "customer").selectExpr("c_custkey AS channel_id", "concat(lpad(CAST(c_custkey % 24 AS STRING), 2, '0'), ':00') AS publish_time",
                                                  "CASE WHEN c_custkey % 7 = 0 THEN DATE '2024-01-05' END AS last_run")
    return B.due_channels(ch, F.lit("2024-01-05 10:00:00").cast("timestamp"), "publish_time", "last_run").select("channel_id")


# -------------------------------------------------------------- competitors
@query("url_parts", r"""SELECT page_id, trim(split_part(trim(url), '#', 1)) AS request_url, CASE WHEN contains(url, '#') THEN lower(trim(regexp_replace(trim(url), '^[^#]*#', ''))) ELSE '' END AS slug, starts_with(lower(trim(url)), 'http') AS is_http,
 nullif(regexp_extract(trim(url), '^[a-zA-Z]+://([^/?#]+)', 1), '') AS host FROM pages""")
def url_parts(spark, d):
    return K.url_parts(X.table(spark, d, "pages").select("page_id", "url")).select("page_id", "request_url", "slug", "is_http", "host")


@query("page_prices", f"SELECT page_id, CASE WHEN page_id % 8 < 7 THEN {X.PAGE_PRICE} END AS price, page_id % 8 < 7 AS supported FROM pages")
def page_prices(spark, d):
    return K.extract_competitor_prices(X.shop_pages(spark, d)).select("page_id", "price", "supported")


@query("page_titles", r"SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, html IS NULL OR html = '' OR contains(replace(lower(html), ' ', ''), '<title></title>') AS is_stub FROM pages")
def page_titles(spark, d):
    return X.table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), H.is_stub("html").alias("is_stub"))


@query("host_dispatch", "SELECT nullif(regexp_extract(trim(url), '^[a-zA-Z]+://([^/?#]+)', 1), '') AS host, false AS supported, count(*) AS n_pages FROM pages GROUP BY 1")
def host_dispatch(spark, d):
    return K.dispatch(X.table(spark, d, "pages"))


NOW = "TIMESTAMP '2024-01-15 12:00:00'"


@query("cache_freshness", f"SELECT event_id, event_type <> 'error' AS ok, CAST(epoch({NOW}) - floor(epoch(ts)) AS BIGINT) AS age, epoch({NOW}) - floor(epoch(ts)) <= CASE WHEN event_type <> 'error' THEN 43200 ELSE 900 END AS fresh FROM events WHERE ts <= {NOW}")
def cache_freshness(spark, d):
    c = X.table(spark, d, "events").filter(f"ts <= {NOW}").withColumn("ok", F.col("event_type") != "error").withColumn("ts", F.col("ts").cast("timestamp"))
    return K.cache_state(c, F.lit("2024-01-15 12:00:00").cast("timestamp")).select("event_id", "ok", "age", "fresh")


@query("stale_urls", f"""SELECT DISTINCT user_id AS url_key FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts <= {NOW} AND epoch({NOW}) - floor(epoch(ts)) <= CASE WHEN event_type <> 'error' THEN 43200 ELSE 900 END)""")
def stale_urls(spark, d):
    c = X.table(spark, d, "events").filter(f"ts <= {NOW}").withColumns({"ok": F.col("event_type") != "error", "url_key": F.col("user_id"), "ts": F.col("ts").cast("timestamp")})
    urls = X.table(spark, d, "events").select(F.col("user_id").alias("url_key")).distinct()
    return K.stale_urls(urls, c, F.lit("2024-01-15 12:00:00").cast("timestamp"))


@query("changed_cells", "SELECT p_partkey AS row_no, m AS price, CASE WHEN p_size > 10 THEN p_size * 100 END AS old_price FROM part JOIN (SELECT l_partkey, CAST(floor(min(l_quantity)) AS INT) * 100 AS m FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE (CASE WHEN p_size > 10 THEN p_size * 100 END) IS DISTINCT FROM m")
def changed_cells(spark, d):
    new = X.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row_no")).agg((F.floor(F.min("l_quantity")).cast("int") * 100).alias("price"))
    cur = X.table(spark, d, "part").selectExpr("p_partkey AS row_no", "CASE WHEN p_size > 10 THEN p_size * 100 END AS price")
    return K.changed_cells(new, cur, ["row_no"]).select("row_no", "price", "old_price")


@query("sheet_blocks", "SELECT CAST(floor(p_partkey / 400) AS INT) AS block, CAST(min(p_partkey) + 2 AS BIGINT) AS first_row, count(*) AS n_rows, string_agg(p_name, ',' ORDER BY p_partkey) AS names FROM part GROUP BY 1")
def sheet_blocks(spark, d):
    rows = X.table(spark, d, "part").select((F.col("p_partkey") + 2).cast("bigint").alias("row_no"), F.col("p_name").alias("name"))
    return S.chunk_rows(rows).select("block", "first_row", "n_rows", F.array_join(F.transform("rows", lambda r: r["name"]), ",").alias("names"))


@query("sheet_links", "SELECT p_partkey AS row_no, c AS link_col, u AS url FROM (SELECT p_partkey, 'L1' AS c, CASE WHEN p_size > 5 THEN 'https://x/' || p_partkey END AS u FROM part UNION ALL SELECT p_partkey, 'L2', p_name FROM part) WHERE p_partkey <= (SELECT max(p_partkey) FROM part WHERE p_size > 5)")
def sheet_links(spark, d):
    sheet = X.table(spark, d, "part").selectExpr("p_partkey AS row_no", "CASE WHEN p_size > 5 THEN concat('https://x/', p_partkey) END AS L1", "1 AS P1", "p_name AS L2", "2 AS P2")
    return J.sheet_links_long(sheet, [("L1", "P1"), ("L2", "P2")]).select("row_no", "link_col", "url")


@query("doc_calendar", "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, count(*) AS n_docs FROM orders GROUP BY ALL")
def doc_calendar(spark, d):
    return A.doc_calendar(X.table(spark, d, "orders"), "o_orderdate")


@query("next_number", "SELECT greatest(max(o_orderkey) + 1, 100) AS next_no FROM orders")
def next_number(spark, d):
    return A.next_number(X.table(spark, d, "orders"), "o_orderkey")


@query("users_by_role", "SELECT c_mktsegment AS role, count(*) AS n_users FROM customer GROUP BY 1")
def users_by_role(spark, d):
    return A.users_by_role(X.table(spark, d, "customer").select(F.col("c_mktsegment").alias("role")))


@query("run_stats", "SELECT year(l_shipdate) * 100 + month(l_shipdate) AS run_id, count(DISTINCT l_suppkey) AS sources, count(DISTINCT (l_suppkey, l_orderkey)) AS messages, count(*) AS prices FROM lineitem GROUP BY 1 ORDER BY 1 DESC LIMIT 20")
def run_stats(spark, d):
    r = X.table(spark, d, "lineitem").selectExpr("CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS run_id", "l_suppkey AS channel", "l_orderkey AS message_id", "l_extendedprice AS price")
    return A.run_stats(r)


@query("fanout_plan", "SELECT c_nationkey AS account, count(*) AS chats, count(*) FILTER (c_custkey % 3 = 0) AS sent, count(*) FILTER (c_custkey % 3 = 1) AS failed, count(*) FILTER (c_custkey % 3 = 2) AS skipped FROM customer GROUP BY 1")
def fanout_plan(spark, d):
    from ..operators.catalog import fanout_plan as plan
    return plan(X.table(spark, d, "customer").selectExpr("c_nationkey AS account", "CASE c_custkey % 3 WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' ELSE 'skipped' END AS status"))


# ------------------------------------------------- template, paths, look-ups
@query("template_extras", """WITH t AS (SELECT p_partkey, p_type AS cat, p_brand AS brand, p_name AS title FROM part), m AS (SELECT cat, brand, bool_or(p_partkey % 3 > 0) AS has FROM t GROUP BY ALL)
SELECT cat, brand, 0 AS block, p_partkey AS pos, title FROM t WHERE p_partkey % 3 > 0
UNION ALL SELECT cat, brand, 2, p_partkey, title FROM t WHERE p_partkey % 3 = 0 AND (cat, brand, title) NOT IN (SELECT (cat, brand, title) FROM t WHERE p_partkey % 3 > 0)
UNION ALL SELECT DISTINCT cat, brand, 1, 0, '' FROM t JOIN m USING (cat, brand) WHERE has AND p_partkey % 3 = 0 AND (cat, brand, title) NOT IN (SELECT (cat, brand, title) FROM t WHERE p_partkey % 3 > 0)""")
def template_extras(spark, d):
    """Every third title is priced but missing from its template."""
    p = X.table(spark, d, "part").selectExpr("p_type AS cat", "p_brand AS brand", "p_partkey AS pos", "p_name AS title")
    return B.effective_template(p.filter("pos % 3 > 0"), p, ["cat", "brand"]).filter("block < 2 OR pos % 3 = 0").select("cat", "brand", "block", "pos", "title")


@query("blank_lines", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || chr(10) || chr(10) || p_brand WHEN 1 THEN p_name || chr(10) || p_brand WHEN 2 THEN p_name ELSE '' END AS text FROM part")
def blank_lines(spark, d):
    """Runs of blank lines shrink to one, those at the ends go."""
    lines = F.expr("CASE p_partkey % 4 WHEN 0 THEN array('', p_name, '', '', '', p_brand) WHEN 1 THEN array(p_name, p_brand, '', '') WHEN 2 THEN array('', '', p_name) ELSE array('', '') END")
    return X.table(spark, d, "part").select("p_partkey", B.join_lines(lines).alias("text"))


@query("model_region_prefix", """WITH v AS (SELECT p_type AS cat, p_brand AS brand, p_name AS title, p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN '🇺🇸' WHEN 1 THEN NULL ELSE '🇯🇵' END AS flag, p_retailprice AS price FROM part),
m AS (SELECT cat, brand, arg_min(flag, (price, title)) AS flag FROM v WHERE flag IS NOT NULL GROUP BY ALL)
SELECT k AS p_partkey, CASE WHEN coalesce(v.flag, m.flag) IS NULL THEN title ELSE coalesce(v.flag, m.flag) || ' ' || title END AS title FROM v LEFT JOIN m USING (cat, brand)""")
def model_region_prefix(spark, d):
    """Titles take the flags of their own cheapest regions, else of the model's."""
    v = X.table(spark, d, "part").selectExpr("p_partkey", "p_type AS cat", "p_brand AS brand", "p_name AS title", "p_retailprice AS min_price",
                                             "CASE p_partkey % 3 WHEN 0 THEN array('us') WHEN 1 THEN CAST(array() AS ARRAY<STRING>) ELSE array('jp') END AS region_min")
    both = v.join(B.model_regions(v, ["cat", "brand"], ["p_partkey"]), ["cat", "brand"], "left")
    return both.select("p_partkey", B.with_region_prefix("title", "region_min", "model_region").alias("title"))


@query("toggle_paths", "SELECT c_custkey AS channel_id, c_mktsegment || '|' || c_nationkey AS path FROM customer WHERE NOT (c_custkey = 1) UNION ALL SELECT 2, 'NEW'")
def toggle_paths(spark, d):
    """A chosen path goes with its subtree, a new one is added."""
    spec = X.table(spark, d, "customer").selectExpr("c_custkey AS channel_id", "array(c_mktsegment, CAST(c_nationkey AS STRING)) AS spec_path")
    first = spec.filter("channel_id = 1").first()
    out = B.toggle_path(B.toggle_path(spec, first.spec_path[:1], 1), ["NEW"], 2)
    return out.select(F.col("channel_id").cast("bigint").alias("channel_id"), F.array_join("spec_path", "|").alias("path"))


@query("swapped_neighbours", """WITH o AS (SELECT p_brand AS brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT brand, p_partkey, CASE WHEN n > 2 AND pos = 2 THEN 3 WHEN n > 2 AND pos = 3 THEN 2 ELSE pos END AS pos FROM o""")
def swapped_neighbours(spark, d):
    """The second row of every brand moves down."""
    from ..operators.windows import numbered
    rows = numbered(X.table(spark, d, "part").selectExpr("p_brand AS brand", "CAST(p_partkey AS BIGINT) AS p_partkey"), ["brand"], "p_partkey", 1000.0, "pos")
    return B.swap_neighbour(rows.select("brand", "p_partkey", F.col("pos").cast("bigint").alias("pos")), ["brand"], "pos", F.col("pos") == 2, up=False)


@query("lookup_defaults", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'nation' || c_nationkey WHEN c_mktsegment <> 'BUILDING' THEN 'segment' || c_mktsegment ELSE 'all' END AS note FROM customer")
def lookup_defaults(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    keys = c.filter("c_nationkey % 2 = 0").selectExpr("CAST(c_nationkey AS STRING) AS key", "concat('nation', c_nationkey) AS note").unionByName(
        c.filter("c_mktsegment <> 'BUILDING'").selectExpr("c_mktsegment AS key", "concat('segment', c_mktsegment) AS note")).distinct()
    table = keys.unionByName(spark.sql("SELECT 'default' AS key, 'all' AS note"))
    return B.lookup_with_default(c, table, ["c_nationkey", "c_mktsegment"], "note").select("c_custkey", "note")


@query("models_under_path", f"SELECT {EP['cat']} AS cat, {EP['brand']} AS brand, {EP['series']} AS series, {EP['model']} AS model, min(CAST(floor(p_partkey / {X.VARIANTS_PER_MODEL}) AS INT)) AS place FROM part WHERE {EP['brand']} = 'Samsung' GROUP BY ALL")
def models_under_path(spark, d):
    return V.models_under(X.text_catalog(spark, d), ["Планшеты", "Samsung"]).select("cat", "brand", "series", "model", F.col("model_order.model_pos").alias("place"))


@query("priced_leaves", f"WITH {PRICED_SQL} SELECT p_partkey AS variant_id, m AS min_price FROM v WHERE m IS NOT NULL")
def priced_leaves(spark, d):
    return V.priced_leaves(_priced(spark, d)).select("variant_id", "min_price")
