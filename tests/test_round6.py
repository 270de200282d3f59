"""Lines of one kind are resolved and read once: closing prices and flags make no further shapes."""

from pyspark.sql import functions as F

from pricewell.functions import shapes as S
from pricewell.operators import catalog as C, resolve as R, rollup
from pricewell.plans import device_queries as D

HEADS = ["iPhone 17 Pro 256GB Black", "17 pro 256", "aw u2 black", "u2 49", "Ultra 3 black", "watch SE", "AW S11 46 black", "S11 42mm jet black", "Series 11", "Galaxy S25 Ultra 12/256", "S25",
         "fold 7 256", "Note 14 8/256", "X7 8/256", "iPad Air 11 M3 128 wifi", "pro 13 M4 wifi", "Air M4 (16/512) 2024", "Milanese Loop", "Magic Keyboard Folio", "Станция Мини 3", "A55", "17", "17 16",
         "MXA12", "17 air esim", "Xiaomi Poco X7", "ноутбук i7", "ipad", "прочее", "x.SE", "Мacbook М4 16/512", "Ремешок 22 mm", "SE3"]
AMOUNTS = ["64307", "7999", "12024", "104500", "64 307", "77 128", "44 500", "49 024", "100 500", "128 000", "31 064", "999 999", "202024"]
ENDS = ["", " 🇺🇸", " 🇯🇵🇪🇺"]
FIELDS = ["model", "region", "sim", "storage", "ram", "color", "screen_size", "watch_size_mm", "connectivity", "code", "chip", "year", "band_type", "band_color", "colors"]


def test_prices_and_flags_make_no_shapes(spark):
    none = F.array().cast("array<string>")
    prices = spark.range(31000, 109000, 7).selectExpr("CASE WHEN id % 2 = 0 THEN concat(floor(id / 1000), ' ', right(id, 3)) ELSE CAST(id AS STRING) END AS p", "CASE id % 3 WHEN 0 THEN '' ELSE ' 🇺🇸' END AS f")
    shapes = lambda head: prices.select(S.line_shape(F.concat(F.lit(head), "p", "f"), none, False, True)).distinct().count()
    assert shapes("Redmi Turbo 8/256GB Black - ") == 1 and shapes("MQ0007A - ") == 2
    assert shapes("Apple Watch SE - ") > 100


def test_kinds_read_like_lines(spark):
    rows = [(i, *p, "") for i, p in enumerate(D.DEVICES)]
    cat = spark.createDataFrame(rows, "i int, cat string, brand string, series string, model string, title_end string, sku string").select(
        "cat", "brand", "series", "model", F.concat("model", "title_end").alias("title"), *[F.lit(0).alias(p) for p in C.POSITIONS[:3]], F.col("i").alias("model_pos"), F.lit(0).alias("variant_pos"))
    index = C.build_alias_index(cat).localCheckpoint()
    lines = spark.createDataFrame([(f"{h} - {a}{e}",) for h in HEADS for a in AMOUNTS for e in ENDS], "text string").coalesce(4)
    found = R.resolve_texts(lines, index)
    own = R.A.with_attributes(found, "text", cat="cat", brand="brand", series="series", model="model").select("text", *FIELDS).localCheckpoint()
    assert own.select("model").distinct().count() > 10
    marked, kinds = R.normalize_kinds(lines, index, catalog_rules=False)
    by_kind = marked.join(kinds, "_kind").select("text", *FIELDS)
    assert own.exceptAll(by_kind).take(3) == [] and by_kind.exceptAll(own).take(3) == []
    each = R.normalize_queries(lines, index, catalog_rules=False).select("text", *FIELDS)
    assert own.exceptAll(each).take(3) == [] and each.exceptAll(own).take(3) == []
    # a header counts as part of the line
    headed = lines.crossJoin(spark.createDataFrame([("Apple Watch SE 3",), ("Galaxy",)], "header string"))
    plain = R.resolve_texts(headed.select(R._headed_line("header", "text").alias("t")), index, text="t").select("t", "model")
    shaped = R.with_shape(headed, index, "text", F.col("header")).select(R._headed_line("header", "text").alias("t"), R._headed_line("header", "_shape").alias("s"))
    by_shape = shaped.join(R.resolve_texts(shaped.select("s"), index, text="s"), "s").select("t", "model")
    assert plain.exceptAll(by_shape).take(3) == [] and by_shape.exceptAll(plain).take(3) == []


def test_regions_are_read_at_the_lowest_price_alone(spark):
    rows = [(1, 5.0, "a 🇺🇸", 2), (1, 5.0, "a 🇯🇵", 1), (1, 9.0, "a 🇪🇺", 0), (2, 3.0, "b", 0), (2, 4.0, "b 🇺🇸", 1)]
    offers = spark.createDataFrame(rows, "k int, price double, raw string, seq int").localCheckpoint()
    best = offers.groupBy("k").agg(F.min("price").alias("min_price")).withColumn("own", F.lit("ru"))
    got = rollup.regions_at_min(offers, ["k"], best, "own")
    assert {r.k: r.region_min for r in got.collect()} == {1: ["jp", "us"], 2: ["ru"]}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "1F1E6" in line]
