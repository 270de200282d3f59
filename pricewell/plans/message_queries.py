"""Queries over messages and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines as L, text as T, vocab as V
from ..operators import messages as M, windows as W
from ..sources import readers as R
from . import bindings as X
from .registry import query

# The same rules in the other dialect, which has no look-around and ASCII word borders.
BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def clean_sql(x: str) -> str:
    c = rf"regexp_replace({x}, '([\x{{1F1E6}}-\x{{1F1FF}}]{{2}})|[\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}]', '\1', 'g')"
    c = rf"regexp_replace({c}, '[\x{{200D}}\x{{FE0F}}]', '', 'g')"
    return rf"regexp_replace(regexp_replace(replace({c}, chr(160), ' '), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"


LINES_SQL = f"""ln AS (SELECT source AS channel, doc_id AS message_id, list_filter(list_transform(string_split_regex(text, '{BREAK}'), lambda x: {clean_sql('x')}), lambda x: x <> '') AS a FROM documents),
l AS (SELECT channel, message_id, unnest(generate_series(1, len(a))) AS line_no, unnest(a) AS text FROM ln)"""
SEP_SQL = r"""(text = '' OR regexp_matches(text, '^(?:[^\p{L}\p{N}]{6,}|={6,}|_{3,})$') OR (length(text) >= 4 AND NOT regexp_matches(text, '[\p{L}\p{N}]'))
 OR (length(text) >= 8 AND len(list_distinct(string_split(replace(text, ' ', ''), ''))) <= 3))"""
PROBE_SQL = r"""regexp_replace(regexp_replace(regexp_replace(text, '\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b', ' ', 'g'), '\b\d{1,2}:\d{2}\b', ' ', 'g'), '\b20\d{2}\b', ' ', 'g')"""
PRICE_SQL = r"(?:\d{1,3}(?:[ .]\d{3})+|\d{4,6})|(?:\s[-—]\s*\d{1,3}(?:[.,]\d{1,2})?)"
OOS_SQL = r"regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(нет\s*в\s*наличии|out\s*of\s*stock|sold\s*out)($|[^\p{L}\p{N}_])')"
PRODUCT_SQL = rf"(regexp_matches(p, '\p{{L}}') AND regexp_matches(p, '{PRICE_SQL}'))"


@query("message_lines", f"WITH {LINES_SQL} SELECT channel, message_id, CAST(line_no AS INT) AS line_no, text FROM l")
def message_lines(spark, d):
    return M.explode_lines(X.messages(spark, d).select("channel", "message_id", "message"))


@query("separator_lines", f"WITH {LINES_SQL} SELECT message_id, CAST(line_no AS INT) AS line_no, {SEP_SQL} AS is_separator FROM l")
def separator_lines(spark, d):
    lines = M.explode_lines(X.messages(spark, d).select("message_id", "message"))
    return lines.select("message_id", "line_no", L.is_separator("text").alias("is_separator"))


@query("price_like_lines", f"""WITH {LINES_SQL}, m AS (SELECT *, {SEP_SQL} AS sep, {OOS_SQL} AS oos, {PROBE_SQL} AS p FROM l)
SELECT message_id, CAST(count(*) FILTER (NOT sep AND NOT oos AND {PRODUCT_SQL}) AS INT) AS price_like, count(*) FILTER (NOT sep AND NOT oos AND {PRODUCT_SQL}) >= 3 AS is_price_list FROM m GROUP BY 1""")
def price_like_lines(spark, d):
    df = X.messages(spark, d).withColumn("lines", L.split_lines("message")).filter(F.size("lines") > 0)
    n = M.price_like_count(F.col("lines"))
    return df.select("message_id", n.alias("price_like")).withColumn("is_price_list", F.col("price_like") >= 3)


HEADER_SQL = r"""regexp_replace(trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '@[\p{L}\p{N}_]{3,}', '', 'g'), '\s+', ' ', 'g'),
 '(^|[^\p{L}\p{N}_])[a-z]($|[^\p{L}\p{N}_])', '\1 \2', 'g'), '(^|[^\p{L}\p{N}_])[a-z]($|[^\p{L}\p{N}_])', '\1 \2', 'g'), '\s+', ' ', 'g')), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')), '^ | $', '', 'g')"""
FP_SQL = f"""{LINES_SQL}, m AS (SELECT *, {SEP_SQL} AS sep, {OOS_SQL} AS oos, {PROBE_SQL} AS p FROM l),
f AS (SELECT channel, message_id, min(line_no) FILTER (NOT sep AND NOT oos AND {PRODUCT_SQL}) AS first_no FROM m GROUP BY ALL),
h AS (SELECT channel, message_id, line_no, {HEADER_SQL} AS part FROM m JOIN f USING (channel, message_id) WHERE NOT sep AND (first_no IS NULL OR line_no < first_no)),
hp AS (SELECT *, row_number() OVER (PARTITION BY channel, message_id ORDER BY line_no) AS rn FROM h WHERE part <> ''),
fp AS (SELECT channel, message_id, string_agg(part, ' | ' ORDER BY line_no) AS fp FROM hp GROUP BY ALL)"""


@query("header_fingerprint", f"WITH {FP_SQL} SELECT doc_id AS message_id, coalesce(fp, '') AS fingerprint FROM documents LEFT JOIN fp ON channel = source AND message_id = doc_id")
def header_fingerprint(spark, d):
    return M.header_fingerprint(X.messages(spark, d)).select("message_id", "fingerprint")


@query("header_dedupe", f"""WITH {FP_SQL} SELECT source AS channel, max(doc_id) AS message_id FROM documents LEFT JOIN fp ON channel = source AND message_id = doc_id
GROUP BY source, coalesce(fp, '__empty__:' || doc_id)""")
def header_dedupe(spark, d):
    return M.dedupe_by_header(X.messages(spark, d)).select("channel", "message_id")


@query("message_gate", f"""SELECT {X.CHANNEL} AS channel, l_orderkey AS message_id, l_linenumber AS part_no, CASE {X.SHAPE} WHEN 6 THEN 'giveaway_message' END AS drop_reason FROM lineitem""")
def message_gate(spark, d):
    return M.message_gate(X.seller_messages(spark, d)).select("channel", "message_id", "part_no", "drop_reason")


GATE_WORDS = {"giveaway_message": "giveaway", "defect_header_message": "used"}


@query("message_gate_documents", """SELECT doc_id AS message_id, CASE WHEN regexp_matches(text, '^(?:[^\\p{L}\\p{N}]{0,10}\\s*)?(?i:refurb[\\p{L}\\p{N}_]*|ref|used)($|[^\\p{L}\\p{N}_])') THEN 'defect_header_message'
 WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(give\\s*away|giveaway)($|[^\\p{L}\\p{N}_])') OR regexp_matches(text, '[\\p{L}\\p{N}_]@[\\p{L}\\p{N}_]{3,}') OR regexp_matches(text, '_bot($|[^\\p{L}\\p{N}_])') THEN 'giveaway_message' END AS drop_reason FROM documents""")
def message_gate_documents(spark, d):
    return M.message_gate(X.messages(spark, d)).select("message_id", "drop_reason")


ID = f"{X.CHANNEL} AS channel, l_orderkey AS message_id, l_linenumber AS part_no"
_T = X._T


def _row(no: int, text: str, status: str, reason: str, shape: str) -> str:
    return f"SELECT {ID}, {no} AS line_no, {text} AS text, '{status}' AS status, {reason} AS reason FROM lineitem WHERE {X.SHAPE} = {shape}"


_PRICED = f"concat({_T['title']}, ' - ', {X.PRICE_TEXT})"
PARSE_SQL = " UNION ALL ".join([
    _row(1, X.LINE, "kept", "NULL", "0"),
    _row(1, "concat('Galaxy Note ', l_suppkey % 100)", "deleted", "'no_price'", "1"),
    _row(2, f"concat('Galaxy Note ', l_suppkey % 100, ' ', {X._BARE}, ' - ', {X.PRICE_TEXT})", "kept", "NULL", "1"),
    _row(1, _PRICED, "kept", "NULL", "2"),
    _row(1, X.LINE, "deleted", "'defect_context_message'", "4"),
    _row(2, f"concat({_T['model']}, ' царапина - ', {X.PRICE_TEXT})", "deleted", "'defect_context_message'", "4"),
    _row(1, "'======='", "deleted", "'header_or_separator'", "5"),
    _row(2, f"concat('Sold out ', {X.LINE})", "deleted", "'out_of_stock'", "5"),
    _row(3, "'доставка 500 руб'", "deleted", "'info_line'", "5"),
    _row(4, X.LINE, "kept", "NULL", "5"),
    _row(1, "'Розыгрыш!'", "deleted", "'giveaway_message'", "6"),
    _row(2, X.LINE, "deleted", "'giveaway_message'", "6"),
    _row(1, "'Например:'", "deleted", "'example_block'", "7"),
    _row(2, _T["model"], "deleted", "'example_block'", "7"),
    _row(3, "'-----'", "deleted", "'header_or_separator'", "7"),
    _row(4, _PRICED, "kept", "NULL", "7"),
])


@query("line_filter", PARSE_SQL)
def line_filter(spark, d):
    m = X.seller_messages(spark, d).drop("date")
    return M.parsed_lines(m).select("channel", "message_id", "part_no", "line_no", "text", "status", "reason")


@query("line_filter_counts", f"SELECT status, reason, count(*) AS n FROM ({PARSE_SQL}) GROUP BY ALL")
def line_filter_counts(spark, d):
    return M.parsed_lines(X.seller_messages(spark, d)).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("header_attach", f"""SELECT {ID}, {X.LINE} AS text, CASE {X.SHAPE} WHEN 5 THEN 'доставка 500 руб' END AS header FROM lineitem WHERE {X.SHAPE} IN (0, 5)
UNION ALL SELECT {ID}, {_PRICED}, CASE {X.SHAPE} WHEN 7 THEN '-----' END FROM lineitem WHERE {X.SHAPE} IN (2, 7)
UNION ALL SELECT {ID}, concat('Galaxy Note ', l_suppkey % 100, ' ', {X._BARE}, ' - ', {X.PRICE_TEXT}), concat('Galaxy Note ', l_suppkey % 100) FROM lineitem WHERE {X.SHAPE} = 1""")
def header_attach(spark, d):
    return M.parsed_lines(X.seller_messages(spark, d)).filter("status = 'kept'").select("channel", "message_id", "part_no", "text", "header")


TIER_MSG = (
    f"CASE l_linenumber % 3 WHEN 0 THEN concat({_T['title']}, chr(10), 'От 1 шт - ', {X.PRICE_TEXT}, chr(10), {X.PRICE_TEXT}, chr(10), 'от 3 шт - ', {X.PRICE_TEXT}, chr(10), {_T['model']}) "
    f"WHEN 1 THEN concat({_T['title']}, ' 🇺🇸', chr(10), '🇯🇵 от 1 шт - ', {X.PRICE_TEXT}, ' ₽') "
    f"ELSE concat({_T['title']}, chr(10), {X.PRICE_TEXT}, chr(10), {_T['model']}, chr(10), 'от 10 шт - ', {X.PRICE_TEXT}) END"
)


@query("tier_pairs", f"""SELECT {ID}, CASE l_linenumber % 3 WHEN 0 THEN concat({_PRICED}, chr(10), {_T['model']})
 WHEN 1 THEN concat({_T['title']}, ' 🇺🇸 - ', {X.PRICE_TEXT}, ' 🇺🇸🇯🇵') ELSE {_PRICED} END AS text FROM lineitem""")
def tier_pairs(spark, d):
    m = X.derived(spark, d, message=TIER_MSG)
    return m.select("channel", "message_id", "part_no", F.array_join(M.join_tiers(L.split_lines("message")), "\n").alias("text"))


@query("second_price", f"SELECT {ID}, {_PRICED} AS text FROM lineitem")
def second_price(spark, d):
    m = X.derived(spark, d, t=f"concat({_PRICED}, ' - ', CAST(true_price_ - 50 AS STRING))".replace("true_price_", f"({X.PRICE})"))
    return m.select("channel", "message_id", "part_no", L.strip_second_price("t").alias("text"))


@query("strip_emoji", f"SELECT {ID}, {X.LINE} AS text FROM lineitem")
def strip_emoji(spark, d):
    m = X.derived(spark, d, t=f"concat('🔥', {X.LINE}, '✨')")
    return m.select("channel", "message_id", "part_no", T.strip_emoji("t").alias("text"))


@query("source_stats", """SELECT 'src' || s_suppkey AS channel, (SELECT count(*) FROM documents WHERE source = 'src' || s_suppkey) AS messages, (SELECT count(*) FROM documents WHERE source = 'src' || s_suppkey) > 0 AS ok FROM supplier""")
def source_stats(spark, d):
    sources = X.table(spark, d, "supplier").selectExpr("concat('src', s_suppkey) AS channel")
    return M.source_stats(X.messages(spark, d), sources)


@query("last_messages", "SELECT source AS channel, doc_id AS message_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 200")
def last_messages(spark, d):
    return R.last_messages(X.messages(spark, d), 200).select("channel", "message_id")


@query("new_messages", """WITH seen AS (SELECT source, max(doc_id) AS m FROM documents WHERE doc_id % 5 = 0 AND source <> 'src3' AND doc_id < (SELECT count(*) FROM documents) / 2 GROUP BY 1)
SELECT d.source AS channel, doc_id AS message_id FROM documents d LEFT JOIN seen USING (source) WHERE doc_id > coalesce(m, 0)""")
def new_messages(spark, d):
    m = X.messages(spark, d)
    half = m.agg((F.count(F.lit(1)) / 2).alias("_h"))
    seen = m.crossJoin(F.broadcast(half)).filter("message_id % 5 = 0 AND channel <> 'src3' AND message_id < _h")
    return R.read_new_messages(m, seen.select("channel", "message_id")).select("channel", "message_id")


@query("source_search", """SELECT c_custkey AS channel_id FROM customer WHERE (contains(lower(c_name), 'machin') OR contains(lower(c_mktsegment), 'machin')) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def source_search(spark, d):
    dialogs = X.table(spark, d, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS channel_id", "c_name AS title", "c_mktsegment AS username")
    return R.search_sources(dialogs, "@Machin", X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("channel_id"))).select("channel_id")


@query("visible_sources", "SELECT c_custkey AS channel_id FROM customer WHERE c_nationkey % 2 = 0 OR c_nationkey = 7")
def visible_sources(spark, d):
    s = X.table(spark, d, "customer").selectExpr("c_custkey AS channel_id", "CASE WHEN c_nationkey % 2 = 1 THEN c_nationkey END AS user_id")
    return R.visible_sources(s, 7, "custom").select("channel_id")


@query("carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def carry_forward(spark, d):
    e = X.table(spark, d, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return W.carry_forward(e, "p", ["user_id"], "ts", 86400.0, "last_purchase", "event_id").select("event_id", "last_purchase")


@query("previous_row", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn FROM events")
def previous_row(spark, d):
    e = X.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    p = W.with_previous(e, ["event_type"], ["user_id"], "ts", 86400.0, "event_id")
    return W.numbered(p, ["user_id"], "ts", 86400.0, "rn", "event_id").select("event_id", "prev_event_type", F.col("rn").cast("bigint").alias("rn"))


@query("latest_per_group", "SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def latest_per_group(spark, d):
    e = X.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return W.latest_per_group(e, ["user_id", "event_type"], ["ts", "event_id"])
