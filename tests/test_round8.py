"""Codes of large catalogues are distinct; a message no rule decides is looked up in the catalogue; the quick looks at a line say what the careful ones say."""

from pyspark.sql import functions as F

from pricewell.functions import attributes as A, money as M, shapes as S, vocab as V
from pricewell.functions.text import flags_of, lit_map
from pricewell.operators import catalog as C, match as J
from pricewell.plans import bindings as X, text_queries as TQ
from pricewell.streaming import answer as Q

from .test_round6 import AMOUNTS, ENDS, HEADS


def test_every_model_has_its_own_code(spark):
    """Beyond ten thousand models codes differ, and each is read back from its line."""
    keys = spark.range(0, 1000000, 37).selectExpr("id * 12 AS k").unionByName(spark.createDataFrame([(12000,), (120000,), (120012,)], "k long")).distinct()
    codes = keys.withColumn("code", F.expr(TQ._code("k"))).localCheckpoint()
    assert codes.select("code").distinct().count() == codes.count()
    assert codes.filter("k = 12000").first().code == "MQ1000A" and codes.filter("k = 120000").first().code == "MQ0000B"
    read = codes.withColumn("sku", F.upper(A.sku_of(F.concat("code", F.lit(" - 64 307")))))
    assert read.filter("sku IS NULL OR sku <> code").count() == 0


def test_undecided_messages_are_looked_up(spark):
    """A text without a hint is a product only if the catalogue knows it; prices on two lines are many prices."""
    catalog = X.text_catalog(spark, "/root/testdata/sf0.001").filter("variant_id < 24")
    index = C.build_alias_index(catalog).localCheckpoint()
    title = catalog.filter("variant_id = 13").first().title
    want = {title: "product", f"{title} - 64 307": "product", f"есть\n{title}": "product", "Galaxy Tab 128GB": "spam", "привет": "spam", None: "spam", "Redmi": "product", f"Продам {title}": "spam",
            "xbox $1000\n$5": "spam", "xbox $1000": "product"}
    rows = spark.createDataFrame([(t,) for t in want] * 2, "text string")
    got = Q.classify_messages(rows, alias_index=index).collect()
    assert len(got) == 2 * len(want) and {r.text: r.msg_class for r in got} == want
    alone = {r.text: r.msg_class for r in Q.classify_messages(rows).collect()}
    assert alone == {**want, title: "spam", f"{title} - 64 307": "spam", f"есть\n{title}": "spam"}


def test_quick_looks_at_a_line(spark):
    """Shape, price and region of a line are those of the careful reading, whatever the line."""
    heads = [*HEADS, "", " ", "17 256", "Мас М4", "Зеон", "Ноутбук хeоn", "ноутбук Rуzеn 7", "a -", "x 64 307", "8/256 "]
    amounts = [*AMOUNTS, "15", "2024", "9", "012345", "38 500", "30 128", "643 071", "1234567", "64307 руб", "64 307 - 63 100"]
    ends = [*ENDS, "🇺🇸", " 🇦🇶🇯🇵", "🇦", " !"]
    lines = spark.createDataFrame([(h + d + a + e,) for h in heads for d in (" - ", " – ", "-", " — ") for a in amounts for e in ends] + [(None,), ("64 307",), (" - 64307",), ("a\n - 64307",), ("a - b\n64307",)], "t string").coalesce(4)
    t, none = F.col("t"), F.array().cast("array<string>")
    some = F.array(F.lit("64"), F.lit("777"), F.lit("L6"))
    for options in ({}, {"taken": none, "regions": False, "diagonals": True}, {"taken": some, "diagonals": True}, {"taken": none, "context": F.lit("Apple Watch"), "regions": False}):
        pairs = lines.select("t", S.line_shape("t", **options).alias("a"), S.careful_shape(t, **options).alias("b"))
        assert pairs.filter("NOT a <=> b").take(3) == []
    assert lines.filter(~M.extract_price("t").eqNullSafe(M._any_price(t))).take(3) == []
    regions = lit_map(V.FLAG_REGION)
    region = F.try_element_at(F.filter(F.transform(flags_of("t"), lambda f: F.try_element_at(regions, f)), lambda r: r.isNotNull()), F.lit(1))
    assert lines.filter(~A.flagged_region("t").eqNullSafe(region)).take(3) == []


def test_variants_with_keys_are_not_broadcast(spark):
    """A row with its keys is estimated at a few bytes, so a large catalogue looked small enough for the driver."""
    v = spark.createDataFrame([(i, [f"model:{i // 2}", f"model:_default:{i // 2}"]) for i in range(8)], "variant_id int, keys array<string>")
    o = spark.createDataFrame([(5, ["model:1", "model:_default:1"]), (7, ["model:_default:3"])], "n int, keys array<string>")
    pairs = J.candidate_pairs(v, o, ["variant_id"], ["n"])
    assert {tuple(r) for r in pairs.collect()} == {(2, 5), (3, 5), (6, 7), (7, 7)} and pairs.count() == 4
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
