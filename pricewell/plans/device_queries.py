"""Lines that shorten, name or contradict real devices: every order line asks for one in the words sellers use."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C, match as J, resolve as R
from ..session import cut_lineage
from . import bindings as X
from .registry import query

PHONE, PAD, CLOCK, EXTRA, SPEAKER = "Смартфоны", "Планшеты", "Умные часы", "Аксессуары", "Умные колонки"
# (category, brand, series, model, what its title adds)
DEVICES = [
    (PHONE, "Apple", "iPhone 17", "iPhone 17", " 256GB Black"), (PHONE, "Apple", "iPhone 17", "iPhone 17 Pro", " 256GB Black"), (PHONE, "Apple", "iPhone 17", "iPhone 17 Air", " 256GB Black"),
    (PHONE, "Samsung", "Galaxy S", "Galaxy S25", " 12/256GB Black"), (PHONE, "Samsung", "Galaxy S", "Galaxy S25 Ultra", " 12/256GB Black"),
    (PHONE, "Samsung", "Galaxy A", "Galaxy A55", " 8/256GB Black"), (PHONE, "Samsung", "Galaxy Z", "Galaxy Z Fold 7", " 256GB Black"),
    (PHONE, "Xiaomi", "Redmi", "Redmi Note 14", " 8/256GB Black"), (PHONE, "Xiaomi", "Poco", "Poco X7", " 8/256GB Black"),
    (PAD, "Apple", "iPad Air", "iPad Air 11 M3", " 128GB Blue Wi-Fi"), (PAD, "Apple", "iPad Pro", "iPad Pro 13 M4", " 256GB Black Wi-Fi"),
    (CLOCK, "Apple", "Watch", "Apple Watch Series 11", " 46mm Black"), (CLOCK, "Apple", "Watch", "Apple Watch Ultra 3", " 49mm Black"), (CLOCK, "Apple", "Watch", "Apple Watch SE 3", " 44mm Black"),
    (EXTRA, "Apple", "Клавиатуры", "Magic Keyboard Folio", " iPad 11"), (EXTRA, "Apple", "Ремешки", "Milanese Loop 42mm", " Black"),
    (SPEAKER, "Яндекс", "Станция", "Яндексстанция Мини 3", " Black"), (SPEAKER, "Яндекс", "Станция", "Яндексстанция Макс", " Black"),
]
# What a line says, and the model it means; {g} is a storage, {c} a colour.
SHORT = [
    ("17 pro {g} {c}", "iPhone 17 Pro"), ("17 {g} {c}", "iPhone 17"), ("s25 12/{g} {c}", "Galaxy S25"), ("s25 ultra 12/{g} {c}", "Galaxy S25 Ultra"), ("a55 8/{g} {c}", "Galaxy A55"),
    ("x7 8/{g} {c}", "Poco X7"), ("note 14 8/{g} {c}", "Redmi Note 14"), ("fold 7 {g} {c}", "Galaxy Z Fold 7"), ("air 11 m3 wifi {g} {c}", "iPad Air 11 M3"),
    ("pro 13 m4 wifi {g} {c}", "iPad Pro 13 M4"), ("aw s11 46 {c}", "Apple Watch Series 11"), ("s11 46mm {c}", "Apple Watch Series 11"), ("u3 49mm {c}", "Apple Watch Ultra 3"),
    ("se 3 44 {c}", "Apple Watch SE 3"), ("air {g} esim {c}", "iPhone 17 Air"), ("станция мини 3 {c}", "Яндексстанция Мини 3"), ("станция макс {c}", "Яндексстанция Макс"), ("17 pro max {g} {c}", None),
]
TITLES = [("Magic Keyboard Folio iPad 11 {c}", "Magic Keyboard Folio"), ("Ремешок Milanese Loop 42mm {c}", "Milanese Loop 42mm"), ("ремешок watch ultra 3 {c}", "Apple Watch Ultra 3"), ("Чехол Silicone {c}", None)]
AGAINST = [
    ("galaxy s25 jbl {c}", ["Galaxy S25"]), ("ipad air 11 m3 keyboard {c}", ["iPad Air 11 M3"]), ("iphone 17 pro ipad {c}", ["iPhone 17", "iPhone 17 Pro"]), ("iphone 17 plus {g} {c}", ["iPhone 17"]),
    ("redmi note 14 pro {c}", ["Redmi Note 14"]), ("apple watch series 11 ultra {c}", ["Apple Watch Series 11"]), ("iphone 17 air {g} {c}", []), ("galaxy s25 {g} {c}", []),
]
STORAGE = "CASE l_suppkey % 3 WHEN 0 THEN '256gb' WHEN 1 THEN '512gb' ELSE '1tb' END"
COLOR = "CASE l_linenumber % 3 WHEN 0 THEN 'black' WHEN 1 THEN 'white' ELSE 'blue' END"


def _pick(values: list, n: int) -> str:
    return f"CASE l_partkey % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _text(lines: list) -> str:
    return _pick(["concat('" + t.replace("{g}", f"', {STORAGE}, '").replace("{c}", f"', {COLOR}, '") + "')" for t, _ in lines], len(lines))


def _model(lines: list) -> str:
    return _pick(["NULL" if m is None else f"'{m}'" for _, m in lines], len(lines))


def _lines(spark, d, lines: list):
    return X.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_text(lines)} AS text")


def _index(spark, d):
    """The devices as catalogue rows; every part stands for one of them."""
    n = len(DEVICES)
    pick = lambda i: f"CASE p_partkey % {n} " + " ".join(f"WHEN {k} THEN '{v[3] + v[4] if i == 4 else v[i]}'" for k, v in enumerate(DEVICES)) + " END"
    names = ["cat", "brand", "series", "model", "title"]
    rows = X.table(spark, d, "part").selectExpr(f"CAST(p_partkey % {n} AS INT) AS model_pos", *[f"{pick(i)} AS {c}" for i, c in enumerate(names)]).distinct()
    return cut_lineage(C.build_alias_index(rows.withColumns({"cat_pos": F.lit(0), "brand_pos": F.lit(0), "series_pos": F.lit(0), "variant_pos": F.lit(0)})))


@query("shorthand_resolve", f"SELECT l_orderkey, l_linenumber, {_model(SHORT)} AS model FROM lineitem")
def shorthand_resolve(spark, d):
    """Shortened names of phones, tablets, watches and speakers."""
    return R.resolve_models(_lines(spark, d, SHORT), _index(spark, d), how="left").select("l_orderkey", "l_linenumber", "model")


@query("title_resolve", f"SELECT l_orderkey, l_linenumber, {_model(TITLES)} AS model FROM lineitem")
def title_resolve(spark, d):
    """Accessory lines, looked up by the words of their titles."""
    return R.resolve_models(_lines(spark, d, TITLES), _index(spark, d), how="left").select("l_orderkey", "l_linenumber", "model")


@query("speaks_against", f"SELECT l_orderkey, l_linenumber, unnest({_pick([str(m) + '::VARCHAR[]' for _, m in AGAINST], len(AGAINST))}) AS model FROM lineitem")
def speaks_against(spark, d):
    """Models a line names and contradicts."""
    lines = _lines(spark, d, AGAINST)
    return lines.join(R.speaks_against(lines, _index(spark, d)), "text").select("l_orderkey", "l_linenumber", "model")


# --------------------------------------------------- sheets and edit logs
@query("wildcard_sheet", f"""WITH n AS (SELECT p_partkey AS k, {X.catalog_exprs('p_partkey')['model']} AS model, {X.catalog_exprs('p_partkey')['true_storage']} AS storage, {X.catalog_exprs('p_partkey')['true_color']} AS color FROM part),
o AS (SELECT n.*, {X.PRICE} AS price FROM n JOIN lineitem ON l_partkey = k), s AS (SELECT k, model, CASE WHEN k % 3 <> 0 THEN storage END AS storage, CASE WHEN k % 5 <> 0 THEN color END AS color FROM n)
SELECT s.k, count(*) AS n_offers, min(o.price) AS min_price FROM s JOIN o ON o.model = s.model AND (s.storage IS NULL OR s.storage = o.storage) AND (s.color IS NULL OR s.color = o.color) GROUP BY 1""")
def wildcard_sheet(spark, d):
    """Sheet rows, some without storage or colour, against all offers."""
    e = X.catalog_exprs("p_partkey")
    named = X.table(spark, d, "part").selectExpr("p_partkey AS k", f"{e['model']} AS model", f"{e['true_storage']} AS storage", f"{e['true_color']} AS color")
    priced = X.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.expr(X.PRICE).alias("price"))
    # Offers of one variant meet a row together, so they are counted first.
    offers = priced.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("price")).join(named, "k")
    sheet = named.selectExpr("k", "model", "CASE WHEN k % 3 <> 0 THEN storage END AS storage", "CASE WHEN k % 5 <> 0 THEN color END AS color")
    pairs = J.wildcard_match(sheet, offers, "model", ["storage", "color"], ["k"], ["n", "price"])
    return pairs.groupBy("k").agg(F.sum("n").alias("n_offers"), F.min("price").alias("min_price"))


# A log over few names, so that renames chain and names are given again.
EDITS = """SELECT o_orderpriority AS cat, o_orderkey AS seq, CASE WHEN o_orderkey % 17 = 5 THEN 'delete' ELSE 'rename' END AS action, concat('b', CAST(o_custkey % 4000 AS VARCHAR(20))) AS name,
 concat('b', CAST((o_custkey * 7 + o_orderkey) % 4000 AS VARCHAR(20))) AS new_name FROM orders"""


@query("edit_chains", f"""WITH RECURSIVE e AS ({EDITS}), n AS (SELECT cat, name, min(seq) AS seq FROM e GROUP BY ALL),
x AS (SELECT e.cat, e.seq, CASE WHEN e.action = 'rename' THEN e.new_name END AS result, f.seq AS next FROM e ASOF LEFT JOIN e f ON f.cat = e.cat AND f.name = CASE WHEN e.action = 'rename' THEN e.new_name END AND e.seq < f.seq),
w AS (SELECT n.cat, n.name, x.result, x.next, CAST(1 AS BIGINT) AS n FROM n JOIN x USING (cat, seq) UNION ALL SELECT w.cat, w.name, x.result, x.next, w.n + 1 FROM w JOIN x ON x.cat = w.cat AND x.seq = w.next)
SELECT cat, name, coalesce(result, '-') AS final, n AS n_edits FROM w WHERE next IS NULL""")
def edit_chains(spark, d):
    X.table(spark, d, "orders").createOrReplaceTempView("_edit_orders")
    edits = spark.sql(EDITS.replace("FROM orders", "FROM _edit_orders"))
    return C.replay_edits(edits.select("cat", "name").distinct(), edits, ["cat"]).withColumn("final", F.coalesce("final", F.lit("-")))


_G = "CAST(floor(p_partkey / 12) AS BIGINT)"


@query("index_increment", f"""WITH m AS (SELECT DISTINCT {_G} AS g FROM part), a AS (SELECT count(*) AS n, count(*) FILTER (g % 10 = 3) AS renamed, count(*) FILTER (g % 10 = 7) AS removed FROM m)
SELECT 'again' AS step, n AS n_models, CAST(0 AS BIGINT) AS n_rebuilt, false AS stale, CAST(0 AS BIGINT) AS n_different FROM a UNION ALL SELECT 'edited', n - removed, renamed, renamed + removed > 0, 0 FROM a""")
def index_increment(spark, d):
    """A tenth of the models renamed and a tenth removed: what is rebuilt, and the rows in which the index differs from one built anew."""
    before = X.text_catalog(spark, d)
    g = F.floor(F.col("variant_id") / 12)
    after = before.filter(g % 10 != 7).withColumns({"model": F.when(g % 10 == 3, F.concat("model", F.lit(" Neo"))).otherwise(F.col("model"))})
    state, cols = C.index_state(before), ["cat", "brand", "series", "model", "title"]
    out = []
    for step, catalog in (("again", before.orderBy("title")), ("edited", after)):
        new = C.index_state(catalog, state)
        index, whole = C.index_of_state(*new).select("alias_key", "model_id", "n_models"), C.build_alias_index(catalog).select("alias_key", "model_id", "n_models")
        different = index.exceptAll(whole).unionAll(whole.exceptAll(index)).agg(F.count(F.lit(1)).alias("n_different"))
        rebuilt = new[0].join(state[0].select("model_id", "digest"), ["model_id", "digest"], "left_anti").agg(F.count(F.lit(1)).alias("n_rebuilt"))
        stale = C.is_stale(C.build_id(before, cols), C.build_id(catalog, cols)).select("stale")
        counts = new[0].agg(F.count(F.lit(1)).alias("n_models"))
        out.append(counts.crossJoin(F.broadcast(rebuilt)).crossJoin(F.broadcast(stale)).crossJoin(F.broadcast(different)).select(F.lit(step).alias("step"), "n_models", "n_rebuilt", "stale", "n_different"))
    return out[0].unionByName(out[1])
