"""What larger tables brought to light: ties, long numbers, lines read once for each shape."""

from pyspark.sql import functions as F

from pricewell.functions import attributes as A, html as H, shapes as S
from pricewell.operators import publish as B, resolve as R


def test_long_price_in_page(rows):
    span = lambda p: f'<span class="price_value">{p}&nbsp;</span>'
    got = rows([span("1234567"), span("12345678"), span("1 234 567"), span("12345"), span("123 456 руб")], H.by_class(F.col("t"), "span", "price_value"))
    assert got == [1234567, 12345678, 1234567, 12345, 123456]


def test_tied_regions_of_a_model(spark):
    rows = [(k, "m", 5.0, "same", [r]) for k, r in ((4, "jp"), (1, "us"), (3, "eu"), (2, "jp"))]
    df = spark.createDataFrame(rows, "k int, model string, min_price double, title string, region_min array<string>")
    for order in (F.col("k"), F.col("k").desc()):
        assert B.model_regions(df.coalesce(1).sortWithinPartitions(order), ["model"], ["k"]).collect()[0].model_region == ["us"]


AMOUNTS = ["64307", "7999", "2024", "12024", "104500", "64 307", "77 128", "46 500", "100 500", "128 000", "31 064", "17 256", "999 999", "1 200"]
HEADS = ["iPhone 17 Pro 256GB Black", "Apple Watch S11 46mm Jet Black sport band Blue S/M", "iPad Air M3 128 Wi-Fi", "Galaxy S25 12/256 us", "MacBook Air M4 (16, 512) 2024",
         "watch SE 44", "Milanese Loop 42mm", "SM-X210B MXA12", "PS5 slim disc", "AirPods 4 anc usb-c", "JBL Tune", "nano sim + esim iPhone 13", "ремешок ultra 2", "пусто"]
ENDS = ["", " 🇺🇸", " 🇯🇵🇪🇺", " руб", " eu"]


def test_shapes_read_like_lines(spark):
    """Whatever closes a line, its shape has the attributes and the reading of the line itself."""
    lines = [(f"{h} - {a}{e}",) for h in HEADS for a in AMOUNTS for e in ENDS] + [("",), (None,), ("- 64307",), ("x\ny - 64307",)]
    df = spark.createDataFrame(lines, "text string").coalesce(4)
    shapes = df.select("text", S.line_shape("text").alias("s"), S.line_shape("text", F.array().cast("array<string>"), False, True).alias("r"))
    prices = spark.range(31000, 99000, 7).selectExpr("concat('X - ', CASE WHEN id % 2 = 0 THEN concat(floor(id / 1000), ' ', right(id, 3)) ELSE CAST(id AS STRING) END, ' 🇺🇸') AS text")
    assert prices.select(S.line_shape("text")).distinct().count() < 250 < prices.count() / 30
    both = A.with_attributes(shapes, "s").drop("price", "r")
    own = A.with_attributes(shapes, "text").drop("price", "r")
    assert own.exceptAll(both).count() == 0 and both.exceptAll(own).count() == 0
    read = lambda c: [*R.line_flags(F.col(c)).values(), A.model_remainder(c), R.title_mode(F.col(c))]
    for i, (a, b) in enumerate(zip(read("text"), read("r"))):
        assert shapes.filter(~a.eqNullSafe(b)).limit(3).collect() == [], i


def test_shape_keeps_numbers_of_names(spark):
    index = spark.createDataFrame([("tune 510",), ("boox 77777",), ("watch se 2",)], "alias_key string")
    df = spark.createDataFrame([("A - 64 510",), ("A - 64307",), ("A - 64 511",), ("A - 643 07",)], "text string").crossJoin(S.numbers_of(index))
    assert [r.s for r in df.select(S.line_shape("text", F.col("_taken")).alias("s")).collect()] == ["A - 64 510", "A - 64307", "A - 64 777", "A - 643 07"]
