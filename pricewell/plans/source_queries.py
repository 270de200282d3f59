"""Readers and sinks: files written from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..session import shared_dir
from ..sources import readers as R, sinks as S
from . import bindings as X
from .registry import query

# Rows of one JSON document.
DOC = 100


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _documents(spark, rows, name: str) -> str:
    """Writes (doc, value): one file for each document."""
    path = _folder(spark, name)
    rows.select("doc", "value").write.partitionBy("doc").text(path)
    return path


@query("source_registry", f"""SELECT s_suppkey AS channel_id, s_name AS name, CASE WHEN CAST(floor(s_suppkey / {DOC}) AS BIGINT) % 3 = 0 AND s_suppkey % 2 = 1 THEN 'bot' ELSE 'channel' END AS source_type FROM supplier""")
def source_registry(spark, d):
    """The three layouts of a register: channels and bots, items, a bare list."""
    s = X.table(spark, d, "supplier").selectExpr(f"CAST(floor(s_suppkey / {DOC}) AS BIGINT) AS doc", "s_suppkey % 2 = 1 AS bot", "struct(s_suppkey AS channel_id, s_name AS name) AS item")
    pick = lambda c: F.to_json(F.collect_list(F.when(c, F.col("item"))))
    docs = s.groupBy("doc").agg(pick(F.col("bot")).alias("bots"), pick(~F.col("bot")).alias("channels"), F.to_json(F.collect_list("item")).alias("all"))
    text = F.expr("""CASE doc % 3 WHEN 0 THEN concat('{"channels":', channels, ',"bots":', bots, '}') WHEN 1 THEN concat('{"items":', all, '}') ELSE all END""")
    return R.read_sources(spark, _documents(spark, docs.withColumn("value", text), "registry")).select("channel_id", "name", "source_type")


@query("item_artifacts", "SELECT p_partkey AS item_id, p_name AS title, p_retailprice AS price FROM part")
def item_artifacts(spark, d):
    """Legacy JSON, as a list or under ``items``."""
    p = X.table(spark, d, "part").selectExpr(f"CAST(floor(p_partkey / {DOC}) AS BIGINT) AS doc", "struct(p_partkey AS item_id, p_name AS title, p_retailprice AS price) AS item")
    docs = p.groupBy("doc").agg(F.to_json(F.collect_list("item")).alias("all"))
    text = F.expr("""CASE doc % 2 WHEN 0 THEN concat('{"items":', all, '}') ELSE all END""")
    path = _folder(spark, "items") + ".json"
    docs.withColumn("value", text).select("doc", "value").write.partitionBy("doc").text(path)
    return R.read_items(spark, path, "item_id:bigint,title:string,price:double")


@query("sheet_scan", "SELECT CAST(p_partkey AS INT) AS row_no, CASE WHEN p_partkey % 10 > 0 THEN p_name END AS name, p_partkey % 10 = 0 AS is_blank FROM part")
def sheet_scan(spark, d):
    path = _folder(spark, "sheet")
    X.table(spark, d, "part").selectExpr("CAST(p_partkey AS INT) AS row_no", "CASE WHEN p_partkey % 10 > 0 THEN p_name END AS name").write.option("header", True).csv(path)
    return R.read_sheet(spark, path)


@query("post_scan", "SELECT o_orderstatus AS channel_id, o_orderkey AS message_id, 'price ' || o_custkey AS text FROM orders")
def post_scan(spark, d):
    path = _folder(spark, "posts")
    X.table(spark, d, "orders").selectExpr("o_orderstatus AS channel_id", "CAST(o_orderkey AS BIGINT) AS message_id", "concat('price ', o_custkey) AS text").write.parquet(path)
    return R.read_posts(spark, path).select("channel_id", "message_id", "text")


@query("channel_paths", "SELECT CAST(c_custkey AS VARCHAR) AS channel_id, c_mktsegment || '/' || c_nationkey AS path FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def channel_paths(spark, d):
    """A map of channel to paths; blank levels and empty paths drop out."""
    c = X.table(spark, d, "customer").selectExpr(
        f"CAST(floor(c_custkey / {DOC}) AS BIGINT) AS doc", "CAST(c_custkey AS STRING) AS k",
        "CASE WHEN c_custkey % 2 = 0 THEN array(concat(c_mktsegment, ' | |', c_nationkey), concat('|', c_mktsegment), ' | ') ELSE array(concat(c_mktsegment, '|', c_nationkey)) END AS v")
    docs = c.groupBy("doc").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value"))
    return R.read_channel_config(spark, _documents(spark, docs, "paths")).select("channel_id", F.array_join("spec_path", "/").alias("path"))


@query("pricing_rule_scan", "SELECT 'c' || c_custkey AS rule_key, 'opt' AS mode, CAST(c_custkey % 7 AS DOUBLE) AS pct, CAST(c_nationkey AS INT) AS round_step FROM customer")
def pricing_rule_scan(spark, d):
    c = X.table(spark, d, "customer").selectExpr(f"CAST(floor(c_custkey / {DOC}) AS BIGINT) AS doc", "concat('c', c_custkey) AS k",
                                                 "struct('opt' AS mode, CAST(c_custkey % 7 AS DOUBLE) AS pct, CAST(c_nationkey AS INT) AS round_step) AS v")
    docs = c.groupBy("doc").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value"))
    return R.read_pricing_rules(spark, _documents(spark, docs, "rules")).select("rule_key", "mode", "pct", "round_step")


@query("offer_layouts", """SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS DOUBLE) AS price, 'S' || l_suppkey AS channel, l_returnflag AS raw FROM lineitem""")
def offer_layouts(spark, d):
    """Flat and nested layouts under other names come to one form."""
    li = X.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(floor(l_extendedprice) AS BIGINT) AS p", "concat('S', l_suppkey) AS c", "l_returnflag AS r")
    flat = li.filter("l_orderkey % 2 = 0").selectExpr("l_orderkey", "l_linenumber", "p AS min_price", "c AS seller", "r AS line")
    deep = li.filter("l_orderkey % 2 = 1").selectExpr("l_orderkey", "l_linenumber", "struct(p AS cost, c AS source, r AS text) AS offer")
    cols = ["l_orderkey", "l_linenumber", F.col("price").cast("double").alias("price"), "channel", "raw"]
    return R.reconcile_offers(flat).select(*cols).unionByName(R.reconcile_offers(deep).select(*cols))


EP = X.catalog_exprs("p_partkey")


@query("catalog_tree", f"SELECT {EP['cat']} AS cat, {EP['brand']} AS brand, {EP['series']} AS series, {EP['model']} AS model, {EP['title']} AS title, CAST(row_number() OVER (PARTITION BY {EP['model']} ORDER BY p_partkey) - 1 AS INT) AS variant_pos FROM part")
def catalog_tree(spark, d):
    """A nested tree for each model, written as JSON lines and flattened."""
    path = _folder(spark, "tree")
    c = X.text_catalog(spark, d)
    models = c.groupBy("cat", "brand", "series", "model").agg(F.sort_array(F.collect_list(F.struct("variant_id", "title")))["title"].alias("titles"))
    tree = F.to_json(F.create_map("cat", F.create_map("brand", F.create_map("series", F.create_map("model", "titles")))))
    models.select(tree.alias("value")).write.text(path)
    flat = C.flatten_catalog(spark.read.text(path).withColumnRenamed("value", "tree"))
    return flat.select("cat", "brand", "series", "model", "title", "variant_pos")


@query("tenant_reset", "SELECT c_custkey, c_nationkey AS tenant_id FROM customer WHERE c_nationkey <> 3")
def tenant_reset(spark, d):
    """The outputs of one tenant go, those of the others stay."""
    path = _folder(spark, "tenants")
    S.write_tenant(X.table(spark, d, "customer").selectExpr("c_custkey", "c_nationkey AS tenant_id"), path)
    S.reset_tenant(spark, path, 3)
    S.reset_tenant(spark, path, 3)
    return spark.read.schema("c_custkey BIGINT, tenant_id BIGINT").parquet(path).select("c_custkey", "tenant_id")
