"""Unit cases of the column functions."""

from pyspark.sql import functions as F

from pricewell.functions import attributes as A, html as H, lines as L, money as M, text as T


def test_price(rows):
    got = rows(
        ["iPhone 16 Pro 256 Black - 89 500 🇺🇸", "17 256 Black eSim 84500", "17 256 84 500", "Watch SE 2024 - 21000", "AirPods 4 - 15", "AirPods 4 - 15 руб"],
        M.extract_price("t"))
    assert got == [89500, 84500, 84500, 21000, 15000, None]


def test_storage_ram(rows):
    got = rows(["Redmi Note 14 8/256 Black", "MacBook Air 13 (M4, 24GB, 512GB)", "x 1024GB", "iPhone 16 256GB Black", "MacBook (M4, 16, 512GB)", "none"], A.storage_ram("t"))
    assert [(r.storage, r.ram) for r in got] == [("256GB", 8), ("512GB", 24), ("1TB", None), ("256GB", None), ("512GB", 16), (None, None)]


def test_sim(rows):
    assert rows(["2 sim", "nano sim + esim", "eSim", "sim", "x"], A.sim_of("t")) == ["2sim", "sim+esim", "esim", "sim+esim", None]


def test_default_sim(spark):
    cases = [("iPhone 13", "us", "sim+esim"), ("iPhone 14", "us", "esim"), ("iPhone 14", "hk", "2sim"), ("iPhone 17", "jp", "esim"), ("iPhone 17", "hk", "sim+esim"),
             ("iPhone 17 Air", "eu", "esim"), ("iPhone 16", "ch", "2sim")]
    df = spark.createDataFrame([(i, m, r) for i, (m, r, _) in enumerate(cases)], "i int, model string, region string")
    none = F.lit(None).cast("string")
    sim = A.default_sim(none, F.lit("Смартфоны"), F.lit("Apple"), F.lit("iPhone"), F.col("model"), F.col("region"))
    assert [r.s for r in df.select("i", sim.alias("s")).orderBy("i").collect()] == [c[2] for c in cases]


def test_colors(rows):
    got = rows(["Space Black phone", "rose gold case", "чёрный", "jet-black", "nothing here"], A.colors_of("t"))
    assert got[0][0] == "Space Black" and "Black" in got[0]
    assert got[1][0] == "Rose Gold" and got[2] == ["Black"] and got[3][0] == "Jet Black" and got[4] == []


def test_second_price(rows):
    got = rows(["X - 17900 - 17850", "Y 17 256 - 45900", "Z 2024 - 45900"], L.strip_second_price("t"))
    assert got == ["X - 17900", "Y 17 256 - 45900", "Z 2024 - 45900"]


def test_strip_emoji_is_idempotent_and_keeps_flags(rows):
    once = rows(["🔥 A 🇺🇸✨", "🇯🇵🇺🇸"], T.strip_emoji("t"))
    assert once == [" A 🇺🇸", "🇯🇵🇺🇸"]
    assert rows(once, T.strip_emoji("t")) == once


def test_money_rules(spark):
    r = spark.range(1).select(
        M.price_retail(F.lit(4000)), M.price_retail(F.lit(45000)), M.price_opt(F.lit(12345)),
        *[M.wholesale_step(F.lit(p)) for p in (19999, 20000, 150000, 250000)], *[M.retail_step(F.lit(p)) for p in (10000, 10001, 200001)],
        M.round_up(F.lit(47250), F.lit(1000)), M.round_up(F.lit(48000), F.lit(1000)), T.fmt_price(F.lit(None).cast("double")), T.fmt_price(F.lit(1234567.5)),
    ).first()
    assert list(r) == [5200, 47250, 12845, 300, 500, 1000, 2000, 1500, 2000, 20000, 48000, 48000, "—", "1 234 568"]


def test_ldjson(rows):
    tag = '<script type="application/ld+json">%s</script>'
    got = rows([tag % '{"offers":{"price":"12 900"}}', tag % '{"@graph":[{"offers":[{"lowPrice":5000}]}]}', tag % '{"offers":{"x":1},"price":7000}',
                tag % "{broken" + tag % '{"offers":{"price":8800}}', "<p>none</p>"], H.ldjson_price(F.col("t")))
    assert got == [12900, 5000, 7000, 8800, None]


def test_url(rows):
    assert rows(["https://h/p#ESIM"], H.request_url("t")) == ["https://h/p"]
    assert rows(["https://h/p#ESIM", "https://h/p"], H.fragment("t")) == ["esim", ""]
    assert rows(["ftp://x", "https://x"], H.is_http("t")) == [False, True]


def test_sku(rows):
    assert rows(["MacBook Air M4 16GB 512GB MXN63", "Galaxy S25 256GB", "SM-F966B/DS phone"], A.sku_of("t")) == ["MXN63", None, "F966B"]
