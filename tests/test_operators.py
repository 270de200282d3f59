"""Operators on small fixtures, partly against brute force."""

import random

from pyspark.sql import functions as F

from pricewell.operators import catalog as C, match as J, messages as M, publish as B, resolve as R, rollup as A
from pricewell.session import cut_lineage
from pricewell.streaming import suppress as U


def test_header_dedupe(spark):
    msgs = [("a", 5, "Прайс Apple\niPhone - 50000"), ("a", 9, "Прайс Apple\niPhone - 51000"), ("b", 5, "Прайс Apple\niPhone - 50000"), ("a", 1, ""), ("a", 2, "")]
    df = spark.createDataFrame(msgs, "channel string, message_id long, message string").withColumn("date", F.lit(None).cast("timestamp"))
    once = M.dedupe_by_header(df)
    assert sorted((r.channel, r.message_id) for r in once.collect()) == [("a", 1), ("a", 2), ("a", 9), ("b", 5)]
    assert M.dedupe_by_header(once).count() == 4


def test_parse_keeps_every_line(spark):
    text = "iPad Air 11 M3 Wi-Fi\n256GB Blue - 35500\n=======\nSold out iPhone 50000\nGalaxy S25 - 70500\nчасы"
    df = spark.createDataFrame([("a", 1, text)], "channel string, message_id long, message string")
    got = [(r.text, r.status, r.reason) for r in M.parsed_lines(df).orderBy("line_no").collect()]
    assert got == [
        ("iPad Air 11 M3 Wi-Fi", "deleted", "no_price"), ("iPad Air 11 M3 Wi-Fi 256GB Blue - 35500", "kept", None), ("=======", "deleted", "header_or_separator"),
        ("Sold out iPhone 50000", "deleted", "out_of_stock"), ("Galaxy S25 - 70500", "kept", None), ("часы", "deleted", "no_price")]


def _chain(times, window):
    last, out = None, []
    for t in times:
        if last is None or t - last >= window:
            out.append(t)
            last = t
    return out


def test_suppress_against_brute_force(spark):
    rnd = random.Random(7)
    rows, want = [], set()
    for key, n, span in (("hot", 1500, 20000), ("warm", 60, 20000), ("one", 1, 10), ("same", 5, 1)):
        times = sorted(rnd.randrange(span) for _ in range(n))
        start = len(rows)
        rows += [(start + i, key, t) for i, t in enumerate(times)]
        want |= {(key, t) for t in _chain(times, 60)}
    df = spark.createDataFrame(rows, "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = U.suppress(df, ["k"], "ts", 60, "id", windows_per_bucket=3).filter("accepted").select("k", "s").collect()
    assert len(got) == len(want) and {(r.k, r.s) for r in got} == want


def test_suppress_fixture_and_state(spark):
    df = spark.createDataFrame([(i, "x", t) for i, t in enumerate([0, 30, 61, 90, 130])], "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.s for r in U.suppress(df, ["k"], "ts", 60, "id").filter("accepted").orderBy("s").collect()] == [0, 61, 130]
    state = spark.createDataFrame([("x", -20 * 1_000_000)], "k string, _last long")
    assert [r.s for r in U.suppress(df, ["k"], "ts", 60, "id", state).filter("accepted").orderBy("s").collect()] == [61, 130]


def test_same_reply(spark):
    rows = [(1, "u", "a", 0), (2, "u", "a", 10), (3, "u", "b", 20), (4, "u", "a", 25), (5, "u", "a", 50)]
    df = spark.createDataFrame(rows, "id long, u string, r string, m long").withColumn("ts", F.timestamp_seconds(F.col("m") * 60))
    assert [r.id for r in U.suppress_same_as_last(df, "u", "r", "ts", 1800, "id").filter("accepted").orderBy("id").collect()] == [1, 3, 4]


def test_best_price_and_dedupe(spark):
    rows = [(1, "S1", 100.0, "x", 1), (1, "s1", 100.0, "X", 2), (1, "S2", 100.0, "y", 3), (1, "S3", 105.0, "z", 4)]
    df = spark.createDataFrame(rows, "v int, channel string, price double, raw string, seq int")
    one = J.dedupe_offers(df, ["v"])
    assert one.count() == 3
    best = J.best_price(one, ["v"]).first()
    assert best.min_price == 100.0 and best.best_channels == ["S2", "s1"]


def test_winner_index(spark):
    def run(items):
        df = spark.createDataFrame([("c", "b", "s", "m", "T", p, ch, reg, i) for i, (p, ch, reg) in enumerate(items)],
                                   "cat string, brand string, series string, model string, title string, min_price double, best_channels array<string>, region_min array<string>, seq int")
        r = A.winner_index(df).first()
        return r.min_price, r.best_channels, r.region_min

    assert run([(100.0, ["a"], ["us"]), (90.0, ["b"], ["jp"])]) == (90.0, ["b"], ["jp"])
    assert run([(100.0, ["a"], ["us"]), (100.0, ["b"], ["jp"])]) == (100.0, ["a"], ["us", "jp"])
    assert run([(None, ["a"], []), (90.0, ["b"], [])]) == (90.0, ["b"], [])


def test_path_prefix(spark):
    nodes = spark.createDataFrame([(["A", "B", "C"],), (["A", "B"],), (["Z"],)], "path array<string>")
    spec = lambda *ps: spark.createDataFrame([(p,) for p in ps], "spec_path array<string>")
    got = lambda s: sorted("|".join(r.path) for r in B.path_prefix_match(nodes, s, []).collect())
    assert got(spec(["A", "B"])) == ["A|B", "A|B|C"]
    assert got(spec(["A", "B", "C", "D"])) == ["A|B", "A|B|C"]
    assert got(spec(["A", "X"])) == []
    assert got(spark.createDataFrame([], "spec_path array<string>")) == ["A|B", "A|B|C", "Z"]


def test_order_breaks(spark):
    plan = spark.createDataFrame([(b, p, f"{b}{p}") for b in "abc" for p in (1, 2, 3)], "brand string, pos int, model string")
    mids = {"a": [10, 12, 15], "b": [10, 15, 12], "c": [10, None, 15]}
    posts = spark.createDataFrame([(f"{b}{i + 1}", m) for b, ms in mids.items() for i, m in enumerate(ms) if m], "model string, message_id int")
    got = {r.brand: r.needs_reset for r in B.order_breaks(plan, posts, ["brand"], ["model"]).collect()}
    assert got == {"a": False, "b": True, "c": True}


def test_resolution_of_shorthand(spark):
    import json

    tree = {"Смартфоны": {"Apple": {"iPhone 17": {"iPhone 17": ["iPhone 17 256GB Black"]}}, "Xiaomi": {"Redmi": {"Redmi Note 14": ["Redmi Note 14 8/256GB Black"]}}},
            "Умные часы": {"Apple": {"Watch": {"Apple Watch Series 11": ["Apple Watch Series 11 46mm"]}}}}
    cat = C.flatten_catalog(spark.createDataFrame([(json.dumps(tree, ensure_ascii=False),)], "tree string"))
    lines = ["17 256 Black eSim 84500", "Note 14 8/256 Black - 15500", "AW S11 46 black - 30000", "что-то - 15000", "iPhone 17 case - 1500"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, text string")
    got = {r.i: r.model for r in R.resolve_models(df, C.build_alias_index(cat)).collect()}
    assert got == {0: "iPhone 17", 1: "Redmi Note 14", 2: "Apple Watch Series 11"}


def test_theta_rules(spark):
    base = dict(cat="Смартфоны", brand="Apple", series="s", model="A", storage="256GB", ram=None, color="Black", color_1=None, color_2=None, colors=[], region=None, sim=None,
                code=None, band_type=None, band_color=None, band_size=None, screen_size=None, watch_size_mm=None, connectivity=None, drive=None, chip=None, year=None, anc=None,
                case=None, nano_glass=False, no_watches=False, game=False)
    from pricewell.schemas import PARAMS

    schema = "n int, cat string, brand string, series string, model string, " + PARAMS
    cols = [c.strip().split(" ")[0].strip("`") for c in schema.split(", ")]
    cases = [({}, {}, None), ({}, {"storage": None}, "storage"), ({}, {"ram": 8}, None), ({"cat": "Ноутбуки"}, {"cat": "Ноутбуки", "ram": 8}, "ram"),
             ({"code": "MXN63"}, {"code": "MXN63", "color": "White"}, None), ({"code": "HS08"}, {"code": "HS08", "color": "White"}, "color"),
             ({"color": "Silver"}, {"color": "White"}, None), ({"color": "Red"}, {"color": None}, "color"),
             ({"model": "S25 Ultra", "color": "Jet Black"}, {"model": "S25 Ultra", "color": "Black"}, "color"),
             ({"cat": "Умные часы", "band_type": "Sport Band"}, {"cat": "Умные часы"}, None)]
    mk = lambda i, over: tuple((base | {"n": i} | over)[c] for c in cols)
    v = J.prepare(spark.createDataFrame([mk(i, c[0]) for i, c in enumerate(cases)], schema)).alias("v")
    o = J.prepare(spark.createDataFrame([mk(i, c[1]) for i, c in enumerate(cases)], schema)).alias("o")
    got = {r.n: r.reason for r in v.join(o, F.col("v.n") == F.col("o.n")).select("v.n", J.mismatch().alias("reason")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_stateful_stream_equals_batch(spark, tmp_path):
    times = [0, 30, 61, 90, 130]
    df = spark.createDataFrame([(i, "x", t) for i, t in enumerate(times)], "id long, k string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1700000000))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "10 minutes")
    out = U.suppress_stateful(stream, ["k"], "ts", 60, "id")
    q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.s for r in spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect()) == [0, 61, 130]


def test_answers_to_buyers(spark):
    import json

    from pricewell.streaming import answer as Q

    tree = {"Смартфоны": {"Apple": {"iPhone 17": {"iPhone 17": ["iPhone 17 256GB Black", "iPhone 17 512GB White"]}}}}
    cat = C.flatten_catalog(spark.createDataFrame([(json.dumps(tree, ensure_ascii=False),)], "tree string"))
    price = F.when(F.col("variant_pos") == 0, 80000).otherwise(95000)
    offers = cut_lineage(C.build_variants(cat).withColumn("price", price).withColumn("region", F.lit(None).cast("string")))
    rows = [(1, 7, "2024-01-01 10:00:00", "Куплю iPhone 17 256GB Black"), (2, 8, "2024-01-01 10:00:30", "куплю  iphone 17 256gb black"),
            (3, 9, "2024-01-01 10:05:00", "Продам iPhone 17"), (4, 9, "2024-01-01 10:06:00", "ищу iPhone 17 1TB Red")]
    batch = spark.createDataFrame(rows, "message_id long, user_id long, t string, text string").withColumn("ts", F.to_timestamp("t")).drop("t")
    out = Q.answer_batch(batch, offers, cut_lineage(C.build_alias_index(cat)))
    got = out["matched"].filter("accepted").collect()
    assert [(r.message_id, r.reply) for r in got] == [(1, "iPhone 17 256GB Black - 80 500 ₽ (sim+esim)")]
    assert [(r.message_id, r.reason) for r in out["unmatched"].collect()] == [(4, "color")]


def test_answers_across_batches(spark, tmp_path):
    """Three micro-batches: the windows hold over their edges, a known model needs no hint word, lost lines are logged."""
    import json

    from pricewell.streaming import answer as Q

    tree = {"Смартфоны": {"Apple": {"iPhone 17": {"iPhone 17": ["iPhone 17 256GB Black"]}}}, "Наушники": {"JBL": {"Tune": {"Tune zbb": ["Tune zbb Black"]}}}}
    cat = C.flatten_catalog(spark.createDataFrame([(json.dumps(tree, ensure_ascii=False),)], "tree string"))
    offers = cut_lineage(C.build_variants(cat).withColumn("price", F.lit(80000)).withColumn("region", F.lit(None).cast("string")))
    index = cut_lineage(C.build_alias_index(cat))
    sources = spark.createDataFrame([("-1005",)], "channel_id string")
    phone, tune = "Куплю iPhone 17 256GB Black", "Tune zbb Black"
    batches = [
        [(1, 7, -1005, "10:00:00", phone), (2, 9, -1005, "10:00:10", tune), (3, 9, -1006, "10:00:20", phone)],
        [(4, 8, -1005, "10:00:40", phone), (5, 7, -1005, "10:01:30", phone), (6, 6, -1005, "10:01:40", "Куплю что-то\nпогода сегодня")],
        [(7, 7, -1005, "10:10:00", "куплю iPhone 17 256GB black"), (8, 8, -1005, "10:45:00", phone), (9, 8, -1005, "10:50:00", "хорошая погода")],
    ]
    schema = "message_id long, user_id long, chat_id string, t string, text string"
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(m, u, str(c), f"2024-01-01 {t}", x) for m, u, c, t, x in rows], schema)
        df.select("message_id", "user_id", "chat_id", F.to_timestamp("t").alias("ts"), "text").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={n}"))
    logs = {}

    def sink(name, df, epoch):
        logs.setdefault(name, []).extend((epoch, *r) for r in df.collect())

    files = spark.read.parquet(str(tmp_path / "in" / "b=0"))
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    static = lambda s: {"offers": offers, "alias_index": index, "sources": sources}
    q = Q.answer_stream(stream, static, sink, str(tmp_path / "state")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    sent = sorted((r[0], r[1], r[-1]) for r in logs["matched"])
    # 4 repeats 1 within a minute; 5 is its user's own text within two minutes; 7 would be answered as 1 was within half an hour.
    assert sent == [(0, 1, True), (0, 2, True), (2, 7, False), (2, 8, True)], sent
    assert (1, 6, "no_parsed_or_not_allowed") in {(r[0], r[1], r[-1]) for r in logs["unmatched"]}
    assert {(r[1], r[2]) for r in logs["spam"]} == {(9, "spam")}
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["epoch=1", "epoch=2"]
