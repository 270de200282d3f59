"""A tree of two to eight levels from ``part``: choice of paths, inherited mark-ups, subtree totals, and the walk of its JSON form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import trees as T
from ..session import shared_dir, spread
from . import bindings as X
from .registry import query

# Element i of a part's path, and how many of them it has.
WIDTHS = [2, 3, 4, 5, 6, 7, 8]
DEPTH = "(2 + p_partkey % 7)"
ELEMENTS = [f"concat('n{i}_', CAST(p_partkey % {w} AS VARCHAR(20)))" for i, w in enumerate(WIDTHS)] + ["concat('p', CAST(p_partkey AS VARCHAR(20)))"]
# A mark (override, choice) lies on a part's path at some depth.
MARK = "(1 + p_partkey % 6)"
NODES = f"SELECT p_partkey, p_retailprice, p_size, {DEPTH} AS depth, [{', '.join(ELEMENTS)}] AS e FROM part"
KEY = "array_to_string(e[1:depth], '|')"
PREFIX = f"array_to_string(e[1:least({MARK}, depth)], '|')"


def _nodes(spark, d):
    return spread(X.table(spark, d, "part")).selectExpr("p_partkey", "p_retailprice", "p_size", f"slice(array({', '.join(ELEMENTS)}), 1, CAST({DEPTH} AS INT)) AS path")


def _marks(nodes):
    return nodes.withColumn("spec_path", F.expr(f"slice(path, 1, CAST({MARK} AS INT))"))


@query("deep_markup", f"""WITH n AS ({NODES}), m AS (SELECT {PREFIX} AS k, max(CAST(p_size AS DOUBLE)) AS v FROM n WHERE p_partkey % 11 = 0 GROUP BY 1)
SELECT p_partkey, (SELECT arg_max(v, length(k)) FROM m WHERE starts_with({KEY} || '|', k || '|')) AS nearest FROM n""")
def deep_markup(spark, d):
    """The override of a node or of its nearest ancestor, whatever the level."""
    n = _nodes(spark, d)
    marks = _marks(n.filter("p_partkey % 11 = 0")).select(T.path_key("spec_path").alias("path_key"), F.col("p_size").cast("double").alias("value"))
    return T.nearest_mark(n, marks, []).select("p_partkey", "nearest")


@query("deep_path_filter", f"""WITH n AS ({NODES}), c AS (SELECT DISTINCT p_partkey % 3 AS g, {PREFIX} AS k FROM n WHERE p_partkey % 37 = 0 AND p_partkey % 3 <> 2)
SELECT p_partkey FROM n WHERE p_partkey % 3 = 2 OR EXISTS (SELECT 1 FROM c WHERE c.g = p_partkey % 3 AND (starts_with({KEY} || '|', k || '|') OR starts_with(k || '|', {KEY} || '|')))""")
def deep_path_filter(spark, d):
    n = _nodes(spark, d).withColumn("g", F.col("p_partkey") % 3)
    spec = _marks(n.filter("p_partkey % 37 = 0 AND g <> 2")).select("g", "spec_path")
    return T.chosen_rows(n, spec, ["g"]).select("p_partkey")


@query("deep_subtree", f"""WITH n AS ({NODES}), x AS (SELECT CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS v, e, unnest(range(1, depth + 1)) AS depth FROM n)
SELECT {KEY} AS key, CAST(depth AS INT) AS depth, count(*) AS n_leaves, count(v) AS n_valued, min(v) AS least, max(v) AS greatest FROM x GROUP BY ALL""")
def deep_subtree(spark, d):
    n = _nodes(spark, d).withColumn("v", F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice")))
    return T.subtree_totals(n, "v")


@query("ragged_tree", f"""WITH n AS ({NODES}) SELECT p_partkey, {KEY} AS path, CASE WHEN p_partkey % 3 = 0 THEN 'one' ELSE 'a' END AS leaf, depth AS n_positions FROM n WHERE p_partkey % 3 <> 1
UNION ALL SELECT p_partkey, {KEY}, unnest(['x', 'y {{z']), depth + 1 FROM n WHERE p_partkey % 3 = 1""")
def ragged_tree(spark, d):
    """A JSON tree for each part, two to eight levels deep with a scalar or a list at its end, written as lines, read and walked."""
    path = f"{shared_dir(spark)}/ragged-{uuid.uuid4().hex}"
    leaf = F.expr("CASE p_partkey % 3 WHEN 0 THEN '\"one\"' WHEN 1 THEN '[\"x\", \"y {z\"]' ELSE '\"a\"' END")
    nested = F.aggregate(F.reverse("path"), leaf, lambda inner, name: F.concat(F.lit('{"'), name, F.lit('": '), inner, F.lit("}")))
    _nodes(spark, d).select(F.concat_ws("\t", F.col("p_partkey").cast("string"), nested).alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.split("value", "\t")[0].cast("long").alias("p_partkey"), F.split("value", "\t")[1].alias("tree"))
    return T.flatten_tree(lines).select("p_partkey", T.path_key("path").alias("path"), "leaf", F.size("positions").cast("long").alias("n_positions"))
