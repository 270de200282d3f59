"""Queries over buyer messages, events and logs, and their streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import shapes as SH, text as T
from ..operators import catalog as C
from ..session import cut_lineage, shared_dir, spread
from ..sources import sinks as S
from ..streaming import answer as Q, suppress as U
from . import bindings as X
from .registry import query

E = X.catalog_exprs("l_partkey")
ID = f"{X.CHANNEL} AS channel, l_orderkey AS message_id, l_linenumber AS part_no"

TEXTS = ["Продам {t}", "куплю {t}", "забронируй, беру {t}", "{t}", "https://shop.example {t}", "@seller xbox one", "набор сотрудников, ваканси", "{t} $500 и $600", "btc {t}", "привет", "xbox"]
CLASSES = ["spam", "product", "silent", "product", "spam", "product", "spam", "spam", "spam", "spam", "product"]
MSG = f"CASE l_orderkey % 11 " + " ".join(
    f"WHEN {i} THEN " + ("concat('" + t.replace("{t}", "', " + E["title"] + ", '") + "')" if "{t}" in t else f"'{t}'") for i, t in enumerate(TEXTS)) + " END"
CLASS = "CASE l_orderkey % 11 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"


@query("classify_messages", f"SELECT {ID}, {CLASS} AS msg_class FROM lineitem")
def classify_messages(spark, d):
    m = X.derived(spark, d, text=MSG)
    index = cut_lineage(C.build_alias_index(X.text_catalog(spark, d)))
    # Copies of a text have one class.
    classed = SH.once_for_each(m, {"_text": F.col("text")}, lambda t: Q.classify_messages(t, "_text", alias_index=index))
    return classed.select("channel", "message_id", "part_no", "msg_class")


# The class of each user turn; also part of the SQL of the answering stream.
ORACLES_OF_CLASSES = r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(sell|selling)($|[^\p{L}\p{N}_])') THEN 'spam' WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(buy|looking\s*for|need|lf|wtb)($|[^\p{L}\p{N}_])') THEN 'product'
 WHEN len(list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_matches(x, '\b\d{4,}(?:[.,]\d+)?\s*$'))) >= 3 THEN 'spam'
 WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(broadcast|crypto|btc)($|[^\p{L}\p{N}_])') OR regexp_matches(text, 'https?://|t\.me/|@[\p{L}\p{N}_]+') OR regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(id|photo\s*id|usd)($|[^\p{L}\p{N}_])') THEN 'spam'
 WHEN regexp_matches(lower(text), 'iphone|samsung|xiaomi|redmi|realme|oneplus|huawei|honor|google|pixel|oppo|vivo|tecno|infinix|airpods|watch|ipad|whoop|macbook|imac|mac mini|mac studio|pencil|magic mouse|magic keyboard|playstation|ps5|dualsense|xbox|switch|beats|plaud|yandex') THEN 'product' ELSE 'spam' END AS msg_class FROM conversations WHERE role = 'user'"""


@query("classify_conversations", ORACLES_OF_CLASSES)
def classify_conversations(spark, d):
    c = spread(X.table(spark, d, "conversations").filter("role = 'user'"))
    return Q.classify_messages(c).select("conv_id", "turn", "msg_class")


@query("clean_query", f"SELECT {ID}, {E['title']} AS text FROM lineitem")
def clean_query(spark, d):
    m = X.derived(spark, d, text=f"concat('Ищу ', {E['title']}, ' pls!!')")
    return m.select("channel", "message_id", "part_no", T.clean_query("text").alias("text"))


# ---------------------------------------------------------------- suppression
def chain_sql(keys: str, seconds: int, src: str) -> str:
    """Accepted rows by walking from one accepted row to the next."""
    return f"""WITH RECURSIVE src AS ({src}), k AS (SELECT {keys}, min(ts) AS t FROM src GROUP BY ALL),
chain AS (SELECT * FROM k UNION ALL SELECT {', '.join('c.' + x for x in keys.split(', '))}, (SELECT min(s.ts) FROM src s WHERE {' AND '.join(f's.{x} = c.{x}' for x in keys.split(', '))} AND s.ts >= c.t + INTERVAL {seconds} SECOND) FROM chain c WHERE c.t IS NOT NULL)
SELECT event_id, {keys}, ts IN (SELECT t FROM chain c WHERE {' AND '.join(f'c.{x} = src.{x}' for x in keys.split(', '))} AND t IS NOT NULL) AS accepted FROM src"""


EVENTS = "SELECT event_id, user_id, event_type, ts FROM events"


def _events(spark, d):
    return X.table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


@query("suppress_window", chain_sql("event_type", 3600, EVENTS))
def suppress_window(spark, d):
    """Same text anywhere within the window; a few keys hold all rows."""
    return U.suppress(_events(spark, d), ["event_type"], "ts", 3600, "event_id").select("event_id", "event_type", "accepted")


@query("suppress_user_window", chain_sql("user_id, event_type", 86400, EVENTS))
def suppress_user_window(spark, d):
    return U.suppress(_events(spark, d), ["user_id", "event_type"], "ts", 86400, "event_id").select("event_id", "user_id", "event_type", "accepted")


RUN_SRC = """SELECT event_id, user_id, run, ts FROM (SELECT *, sum(CASE WHEN event_type IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
 FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'a' ELSE event_type END AS event_type FROM events)))"""


@query("suppress_same_as_last", f"SELECT event_id, accepted FROM ({chain_sql('user_id, run', 43200, RUN_SRC)})")
def suppress_same_as_last(spark, d):
    e = _events(spark, d).withColumn("reply", F.when(F.col("event_type").isin("view", "click", "signup"), "A").otherwise(F.col("event_type")))
    return U.suppress_same_as_last(e, "user_id", "reply", "ts", 43200, "event_id").select("event_id", "accepted")


# ----------------------------------------------------------------------- logs
NOW = "TIMESTAMP '2024-01-15 12:00:00'"


def _now():
    return F.lit("2024-01-15 12:00:00").cast("timestamp")


@query("log_retention_upsert", f"""SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE ts <= {NOW} GROUP BY ALL HAVING floor(epoch(max(ts))) >= epoch({NOW}) - 86400""")
def log_retention_upsert(spark, d):
    e = X.table(spark, d, "events").filter(f"ts <= {NOW}").select("user_id", "event_type", "ts", "event_id")
    out = S.upsert_log(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], _now(), "ts", 86400)
    return out


@query("expired_logs", f"SELECT event_id FROM events WHERE floor(epoch(ts)) >= epoch({NOW}) - 3600 * 24 * 3")
def expired_logs(spark, d):
    return Q.expire_logs(X.table(spark, d, "events"), _now(), "ts", 3600 * 24 * 3).select("event_id")


@query("daily_clear", f"SELECT event_id FROM events WHERE ts + INTERVAL 3 HOUR >= TIMESTAMP '2024-01-14 23:59:00'")
def daily_clear(spark, d):
    e = X.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return Q.daily_clear(e, _now()).select("event_id")


@query("source_activity", "SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS start_ts, count(*) AS n FROM events GROUP BY ALL")
def source_activity(spark, d):
    return Q.source_activity(_events(spark, d), ["event_type"]).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start_ts"), "n")


@query("query_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
r AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS start_ts, count(*) AS n FROM r GROUP BY user_id, no""")
def query_sessions(spark, d):
    s = Q.query_sessions(_events(spark, d), ["user_id"], gap="6 hours")
    return s.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start_ts"), "n")


@query("work_hours", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS period, count(*) AS n FROM events WHERE hour(ts) >= 9 AND hour(ts) < 18 GROUP BY 1")
def work_hours(spark, d):
    e = _events(spark, d).filter(Q.in_work_hours("ts", 9, 18))
    return Q.source_activity(e, []).select(F.col("window.start").cast("timestamp_ntz").alias("period"), "n")


@query("json_props", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, d):
    e = X.table(spark, d, "events").select("event_type", F.from_json("props", "k INT")["k"].alias("k"))
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("allowed_chats", "SELECT event_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) AND event_type <> 'error' AND user_id <> 8")
def allowed_chats(spark, d):
    e = X.table(spark, d, "events").selectExpr("event_id", "user_id", "-1001000000000 - user_id AS chat_id", "event_type = 'error' AS is_bot")
    src = X.table(spark, d, "supplier").filter("s_suppkey % 2 = 0").selectExpr("1000000000 + s_suppkey AS channel_id")
    return Q.allowed(e, src, own_id=8).select("event_id")


@query("watch_models", "SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN 'Galaxy' ELSE 'Apple Watch Series ' || (c_custkey % 20) END AS model FROM customer")
def watch_models(spark, d):
    c = X.table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 2 THEN 'Samsung' ELSE 'Apple' END AS brand", "'Watch' AS series",
                                                 "CASE c_custkey % 3 WHEN 0 THEN concat('Watch ', c_custkey % 20) WHEN 1 THEN concat('apple watch series ', c_custkey % 20) ELSE 'Galaxy' END AS model")
    return Q.canon_watch(c).select("c_custkey", "model")


@query("upsert_users", "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 = 0 THEN 'new' ELSE c_name END AS name, c_custkey % 8 = 0 AS changed FROM customer")
def upsert_users(spark, d):
    users = X.table(spark, d, "customer").selectExpr("c_custkey AS user_id", "c_name AS name")
    up = X.table(spark, d, "customer").filter("c_custkey % 4 = 0").selectExpr("c_custkey AS user_id", "CASE WHEN c_custkey % 8 = 0 THEN 'new' ELSE c_name END AS name")
    return C.upsert_users(users, up)


@query("blocklist", """WITH e AS (SELECT event_id, 'u' || user_id AS name, event_type = 'error' AS removed FROM events), b AS (SELECT name, arg_max(removed, event_id) AS removed FROM e GROUP BY 1)
SELECT c_custkey FROM customer WHERE 'u' || c_custkey NOT IN (SELECT name FROM b WHERE NOT removed)""")
def blocklist(spark, d):
    edits = X.table(spark, d, "events").selectExpr("event_id AS seq", "concat(CASE WHEN event_type = 'error' THEN '-@u' ELSE '@u' END, user_id) AS text")
    users = X.table(spark, d, "customer").selectExpr("c_custkey", "concat('u', c_custkey) AS username")
    return C.apply_blocklist(users, edits).select("c_custkey")


@query("build_id", "SELECT count(*) AS n_rows, false AS stale FROM part")
def build_id(spark, d):
    p = X.catalog(spark, d)
    a = C.build_id(p, ["cat", "brand", "model"])
    return C.is_stale(a, C.build_id(p.orderBy("model"), ["cat", "brand", "model"])).crossJoin(a.select("n_rows")).select("n_rows", "stale")


# -------------------------------------------------------------------- streams
def _stream(spark, d):
    """The events table as a file stream."""
    schema = X.table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("stream_activity", "SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS start_ts, count(*) AS n FROM events GROUP BY ALL")
def stream_activity(spark, d):
    """Tumbling counts kept by the stream and stored by every trigger."""
    base = _folder(spark, "activity")
    counts = Q.source_activity(_stream(spark, d), ["event_type"])

    def store(df, epoch):
        df.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start_ts"), "n").write.mode("overwrite").parquet(f"{base}/out")

    q = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).foreachBatch(store).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("stream_suppress", chain_sql("event_type", 3600, EVENTS))
def stream_suppress(spark, d):
    """The suppression rule as a stream with a state table."""
    base = _folder(spark, "suppress")

    def sink(df, epoch):
        df.select("event_id", "event_type", "accepted").write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    w = U.suppress_batches(_stream(spark, d), ["event_type"], "ts", 3600, "event_id", sink, f"{base}/state")
    w.option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "event_type", "accepted")
