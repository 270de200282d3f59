"""Queries over price-line texts: attributes, resolution, matching from text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attributes as A, money as M, shapes as S, text as T
from ..operators import catalog as C, match as J, phrases as PH, resolve as R, rollup
from ..session import cut_lineage, spread
from . import bindings as X
from .registry import query

E = X.catalog_exprs("l_partkey")
EP = X.catalog_exprs("p_partkey")
ID = f"{X.CHANNEL} AS channel, l_orderkey AS message_id, l_linenumber AS part_no"
KEYS = ["channel", "message_id", "part_no"]


# ----------------------------------------------------------------- attributes
@query("money_extract", f"SELECT {ID}, {X.PRICE} AS price FROM lineitem")
def money_extract(spark, d):
    return X.offer_lines(spark, d).select(*KEYS, M.extract_price("text").alias("price"))


@query("line_attributes", f"""SELECT {ID}, {X.PRICE} AS price, {E['true_storage']} AS storage, {E['true_color']} AS color, {E['true_ram']} AS ram, {X.REGION} AS region,
 CASE WHEN {E['cat']} = 'Планшеты' THEN 'LTE' END AS tablet FROM lineitem""".replace("'LTE' END AS tablet", "'Wi-Fi' END AS connectivity"))
def line_attributes(spark, d):
    read = lambda t: A.with_attributes(t, "_shape").drop("price")
    df = S.once_for_each(X.offer_lines(spark, d), {"_shape": S.line_shape("text")}, read).withColumn("price", M.extract_price("text"))
    return df.select(*KEYS, "price", "storage", "color", "ram", "region", "connectivity")


SIM_TOK = X._case("CAST(l_quantity AS BIGINT) % 5", ["", " eSim", " 2 sim", " nano sim + esim", " Dual SIM"])
GEN = "CASE l_orderkey % 4 WHEN 0 THEN 13 WHEN 1 THEN 14 WHEN 2 THEN 16 ELSE 17 END"
SIM_LINE = f"concat('iPhone ', CAST({GEN} AS VARCHAR(20)), ' 256GB Black', {SIM_TOK}, {X._case('l_suppkey % 4', ['', ' 🇺🇸', ' 🇯🇵', ' 🇭🇰'])})"


@query("sim_default", f"""SELECT {ID}, CASE CAST(l_quantity AS BIGINT) % 5 WHEN 1 THEN 'esim' WHEN 2 THEN '2sim' WHEN 3 THEN 'sim+esim' WHEN 4 THEN '2sim' ELSE
 CASE WHEN {GEN} = 13 THEN 'sim+esim' WHEN l_suppkey % 4 = 1 THEN 'esim' WHEN l_suppkey % 4 = 2 AND {GEN} = 17 THEN 'esim' WHEN l_suppkey % 4 = 3 AND {GEN} <> 17 THEN '2sim' ELSE 'sim+esim' END END AS sim FROM lineitem""")
def sim_default(spark, d):
    df = X.derived(spark, d, text=SIM_LINE, model=f"concat('iPhone ', CAST({GEN} AS VARCHAR(20)))").withColumns(
        {"cat": F.lit("Смартфоны"), "brand": F.lit("Apple"), "series": F.lit("iPhone")})
    sim = A.default_sim(A.sim_of("_text"), F.col("_cat"), F.col("_brand"), F.col("_series"), F.col("_model"), A.region_of("_text"))
    keys = {"_" + c: F.col(c) for c in ("text", "cat", "brand", "series", "model")}
    return S.once_for_each(df, keys, lambda t: t.withColumn("sim", sim)).select(*KEYS, "sim")


DEV = {
    "band_type": ["sport band", "SL", "milanese loop", "braided solo loop", "ocean", "trail loop"],
    "band": ["Sport Band", "Sport Loop", "Milanese Loop", "Braided Solo Loop", "Ocean Band", "Trail Loop"],
    "size": ["S/M", "M/L", "sm", "ml"], "size_out": ["S/M", "M/L", "S/M", "M/L"],
    "conn": ["Wi-Fi + Cellular", "WiFi", "5G", "LTE"], "conn_out": ["Wi-Fi+Cellular", "Wi-Fi", "5G", "LTE"],
    "chip": ["M3 Pro", "m4", "A16 Bionic", "M2 Max"], "chip_out": ["M3 Pro", "M4", "A16 Bionic", "M2 Max"],
    "case": ["USB-C", "MagSafe", "Lightning", ""], "case_out": ["'usb-c'", "'magsafe'", "'lightning'", "NULL"],
    "drive": ["disc", "digital", "с дисководом", "цифровая"], "drive_out": ["disc", "digital", "disc", "digital"],
}
WATCH_LINE = f"concat('Apple Watch S11 46mm Jet Black ', {X._case('l_orderkey % 6', DEV['band_type'])}, ' Blue ', {X._case('l_linenumber % 4', DEV['size'])}, ' - ', CAST({X.PRICE} AS VARCHAR(20)))"
PAD_LINE = f"concat('iPad Air 11 ', {X._case('l_orderkey % 4', DEV['chip'])}, ' 128GB ', {X._case('l_linenumber % 4', DEV['conn'])}, CASE WHEN l_suppkey % 2 = 0 THEN ' nano-texture' ELSE '' END, ' ', CAST(2018 + l_suppkey % 10 AS VARCHAR(20)))"
POD_LINE = f"concat('AirPods 4 ', {X._case('l_orderkey % 4', DEV['case'])}, CASE WHEN l_suppkey % 3 = 0 THEN ' ANC' ELSE '' END)"
BOX_LINE = f"concat('PS5 slim ', {X._case('l_orderkey % 4', DEV['drive'])}, CASE WHEN l_suppkey % 3 = 0 THEN ' Mario' WHEN l_suppkey % 3 = 1 THEN ' игра' ELSE '' END)"


@query("device_attributes", f"""SELECT {ID}, {X._case('l_orderkey % 6', DEV['band'])} AS band_type, {X._case('l_linenumber % 4', DEV['size_out'])} AS band_size, 'Blue' AS band_color, '46' AS watch_mm,
 {X._case('l_linenumber % 4', DEV['conn_out'])} AS connectivity, {X._case('l_orderkey % 4', DEV['chip_out'])} AS chip, l_suppkey % 2 = 0 AS nano_glass, CAST(2018 + l_suppkey % 10 AS VARCHAR) AS year, '11' AS screen,
 CASE l_orderkey % 4 {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(DEV['case_out']))} END AS case_type, CASE WHEN l_suppkey % 3 = 0 THEN 'anc' END AS anc,
 {X._case('l_orderkey % 4', DEV['drive_out'])} AS drive, l_suppkey % 3 < 2 AS game FROM lineitem""")
def device_attributes(spark, d):
    df = X.derived(spark, d, w=WATCH_LINE, p=PAD_LINE, a=POD_LINE, b=BOX_LINE)
    # Lines that differ in their price alone are read once.
    return S.once_for_each(df, {"_w": S.line_shape("w"), "_p": F.col("p"), "_a": F.col("a"), "_b": F.col("b")}, _device_columns).select(*KEYS, *DEV_COLS)


DEV_COLS = ["band_type", "band_size", "band_color", "watch_mm", "connectivity", "chip", "nano_glass", "year", "screen", "case_type", "anc", "drive", "game"]


def _device_columns(t):
    ear = A.context_flags("_a")["earphone"]
    watch = A.context_flags("_w")["watch"]
    return t.select(
        "_w", "_p", "_a", "_b", F.when(watch, A.band_type("_w")).alias("band_type"), F.when(watch, A.band_size("_w")).alias("band_size"),
        A.band_color("_w").alias("band_color"), A.screen_size("_w", watch).alias("watch_mm"), A.connectivity_of("_p").alias("connectivity"),
        A.chip_of("_p").alias("chip"), A.nano_glass("_p").alias("nano_glass"), A.year_of("_p").alias("year"),
        A.screen_size("_p", A.context_flags("_p")["watch"], brand=F.lit("Apple")).alias("screen"),
        F.when(ear, A.case_type("_a")).alias("case_type"), F.when(ear & F.rlike("_a", F.lit(A.P.NOISE_CANCEL)), F.lit("anc")).alias("anc"),
        A.drive_of("_b").alias("drive"), A.game_flag("_b").alias("game"),
    )


SKU = "concat('MX', translate(CAST(l_partkey % 10 AS VARCHAR(20)), '0123456789', 'ABCDEFGHJK'), lpad(CAST(l_partkey % 100 AS VARCHAR(20)), 2, '0'))"
SERIAL = "concat('C02X', lpad(CAST(l_partkey AS VARCHAR(20)), 8, '0'))"


@query("sku_extract", f"SELECT {ID}, {SKU} AS code FROM lineitem")
def sku_extract(spark, d):
    df = X.derived(spark, d, text=f"concat('SM-X210B MacBook Air (M4, 16GB, 512GB) S25 ', {SKU}, ' 46mm 2024 - 95500')")
    return S.once_for_each(df, {"_text": F.col("text")}, lambda t: t.withColumn("code", A.sku_of("_text"))).select(*KEYS, "code")


@query("serial_extract", f"SELECT {ID}, CASE l_linenumber % 3 WHEN 0 THEN {SERIAL} WHEN 1 THEN {SERIAL} ELSE lpad(CAST(l_orderkey AS VARCHAR), 15, '3') END AS serial FROM lineitem")
def serial_extract(spark, d):
    imei = "lpad(CAST(l_orderkey AS VARCHAR(20)), 15, '3')"
    text = (f"CASE l_linenumber % 3 WHEN 0 THEN concat('iPhone', chr(10), 'Serial No. ', {SERIAL}, chr(10), 'IMEI ', {imei}) "
            f"WHEN 1 THEN concat('S/N:', chr(10), {SERIAL}) ELSE concat('model A1', chr(10), 'IMEI: ', {imei}) END")
    return X.derived(spark, d, text=text).select(*KEYS, A.serial_of("text").alias("serial"))


@query("first_int", r"""SELECT doc_id, TRY_CAST(nullif(replace(regexp_extract(replace(text, chr(160), ' '), '(\d{1,3}(?: ?\d{3})+|\d{4,})', 1), ' ', ''), '') AS BIGINT) AS first_int FROM documents""")
def first_int(spark, d):
    return X.messages(spark, d).select(F.col("message_id").alias("doc_id"), M.first_int("message").alias("first_int"))


@query("price_coercion", "SELECT o_orderkey, o_totalprice AS price FROM orders")
def price_coercion(spark, d):
    o = X.table(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN concat(CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS STRING), ' руб') END AS a",
        "replace(concat('₽ ', CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS STRING)), '.', ',') AS b")
    return o.select("o_orderkey", M.coerce_price("a", "b").alias("price"))


@query("line_context", f"""SELECT {E['cat']} AS cat, count(*) AS n, count(*) FILTER ({E['cat']} = 'Планшеты') AS tablets, CAST(0 AS BIGINT) AS watches, CAST(0 AS BIGINT) AS laptops FROM lineitem GROUP BY 1""")
def line_context(spark, d):
    df = X.derived(spark, d, text=X.LINE, cat=E["cat"])
    f = A.context_flags("text")
    return df.groupBy("cat").agg(F.count(F.lit(1)).alias("n"), F.count_if(f["tablet"]).alias("tablets"), F.count_if(f["watch"]).alias("watches"),
                                 F.count_if(A.looks_like_laptop("text")).alias("laptops"))


@query("model_remainder", f"SELECT {ID}, CASE {E['cat']} WHEN 'Планшеты' THEN concat({E['model']}, ' Wi-Fi') WHEN 'Ноутбуки' THEN concat({E['model']}, ' ( , )') ELSE {E['model']} END AS rest FROM lineitem")
def model_remainder(spark, d):
    lines = S.once_for_each(X.offer_lines(spark, d), {"_shape": S.line_shape("text", regions=False)}, lambda t: t.withColumn("rest", A.model_remainder("_shape")))
    return lines.select(*KEYS, "rest")


@query("title_keys", r"""SELECT variant_id, k AS title_key, regexp_replace(k, '\b\d{1,2}\s*/\s*(\d{2,4}\s*(?:gb|tb))\b', '\1', 'g') AS no_ram FROM (
 SELECT p_partkey AS variant_id, lower(TITLE) AS k FROM part)""".replace("TITLE", EP["title"]))
def title_keys(spark, d):
    k = T.title_key(F.concat(F.lit("  "), F.col("title")))
    return X.text_catalog(spark, d).select("variant_id", k.alias("title_key")).withColumn("no_ram", T.strip_ram("title_key"))


@query("sheet_names", f"SELECT p_partkey AS variant_id, {EP['title']} AS name FROM part")
def sheet_names(spark, d):
    v = X.text_catalog(spark, d)
    noisy = F.concat(F.lit("Смартфон  "), F.col("title"), F.lit(" (Global, EAC)"))
    return v.select("variant_id", T.clean_sheet_name(noisy).alias("name"))


@query("post_titles", "SELECT p_partkey AS variant_id, CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, '|', p_brand) ELSE p_name END AS titles FROM part")
def post_titles(spark, d):
    p = X.table(spark, d, "part").selectExpr(
        "p_partkey AS variant_id", "CASE WHEN p_partkey % 2 = 0 THEN concat('<b>', p_name, '</b> x', chr(10), '<b>', p_brand, '</b>') ELSE concat('<i>', p_name, '</i>', chr(10), 'x') END AS text")
    return p.select("variant_id", F.array_join(T.post_titles("text"), "|").alias("titles"))


@query("chat_ids", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 1234500000 + c_custkey ELSE 77 + c_custkey END AS chat FROM customer")
def chat_ids(spark, d):
    c = X.table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN -1001234500000 - c_custkey ELSE 77 + c_custkey END AS id")
    return c.select("c_custkey", T.norm_chat_id("id").alias("chat"))


@query("query_lines", f"SELECT {ID}, 1 AS line_no, {E['title']} AS line FROM lineitem UNION ALL SELECT {ID}, 2, {E['model']} FROM lineitem WHERE l_linenumber % 2 = 0")
def query_lines(spark, d):
    q = X.derived(spark, d, text=f"concat('— Куплю ', {E['title']}, ' пожалуйста?', CASE WHEN l_linenumber % 2 = 0 THEN concat(chr(10), '• ищу ', {E['model']}, ' -> 15000') ELSE '' END)")
    q = S.once_for_each(q, {"_text": F.col("text")}, lambda t: t.withColumn("lines", T.query_lines("_text")))
    return q.select(*KEYS, F.posexplode("lines").alias("p", "line")).select(*KEYS, (F.col("p") + 1).alias("line_no"), "line")


@query("normal_keys", f"""SELECT {ID}, trim(regexp_replace(lower({E['title']}), '[^a-z0-9 ]+', '', 'g')) AS key FROM lineitem""".replace("lower(" + E["title"] + ")", "regexp_replace(lower(" + E["title"] + "), '[-/ ]+', ' ', 'g')"))
def normal_keys(spark, d):
    return X.derived(spark, d, text=E["title"]).select(*KEYS, T.norm_key("text").alias("key"))


# ------------------------------------------------------------------- indexes
ALIAS_SQL = f"""SELECT DISTINCT alias_key, path FROM (
SELECT lower({EP['model']}) AS alias_key, concat_ws('|', {EP['cat']}, {EP['brand']}, {EP['series']}, {EP['model']}) AS path FROM part
UNION ALL SELECT lower(replace({EP['model']}, 'Redmi ', '')), concat_ws('|', {EP['cat']}, {EP['brand']}, {EP['series']}, {EP['model']}) FROM part WHERE {EP['brand']} = 'Xiaomi'
UNION ALL SELECT lower(replace({EP['model']}, 'Galaxy ', '')), concat_ws('|', {EP['cat']}, {EP['brand']}, {EP['series']}, {EP['model']}) FROM part WHERE {EP['brand']} = 'Samsung')"""


def _index(spark, d):
    """The alias index is read by several stages of a job, so it is written once."""
    return cut_lineage(C.build_alias_index(X.text_catalog(spark, d)))


@query("alias_index", ALIAS_SQL)
def alias_index(spark, d):
    return C.build_alias_index(X.text_catalog(spark, d)).select("alias_key", F.col("model_id").alias("path"))


def _named(spark, d):
    return X.catalog(spark, d).selectExpr("cat", "brand", "'' AS series", "model", "model AS title", "0 AS cat_pos", "0 AS brand_pos", "0 AS series_pos",
                                          "variant_id AS model_pos", "0 AS variant_pos", "variant_id")


@query("alias_collisions", """SELECT p_name AS alias_key, arg_min(concat_ws('|', p_type, p_brand, p_name), p_partkey) AS model_id, count(DISTINCT (p_type, p_brand)) AS n_models FROM part GROUP BY 1 HAVING count(DISTINCT (p_type, p_brand)) > 1""")
def alias_collisions(spark, d):
    return C.alias_collisions(_named(spark, d))


@query("code_index", "SELECT 'MXN' || (p_partkey % 500) AS sku, arg_min(concat_ws('|', p_type, p_brand, p_name), (SELECT min(q.p_partkey) FROM part q WHERE q.p_type = part.p_type AND q.p_brand = part.p_brand AND q.p_name = part.p_name)) AS model_id, count(DISTINCT (p_type, p_brand, p_name)) AS n_models FROM part GROUP BY 1")
def code_index(spark, d):
    v = _named(spark, d).withColumn("code", F.concat(F.lit("mxn"), (F.col("variant_id") % 500).cast("string")))
    return C.build_code_index(v).select("sku", "model_id", "n_models")


@query("canonical_names", f"SELECT DISTINCT {EP['model']} AS model, {EP['model']} AS canonical FROM part")
def canonical_names(spark, d):
    return C.models_of(X.text_catalog(spark, d)).select("model", "canonical")


# ---------------------------------------------------------------- resolution
@query("strict_resolve", f"SELECT {ID}, {E['model']} AS model FROM lineitem WHERE {E['cat']} IN ('Смартфоны', 'Наушники', 'Ноутбуки')")
def strict_resolve(spark, d):
    lines = X.offer_lines(spark, d)
    return R.resolve_strict(lines, _index(spark, d)).select(*KEYS, "model")


@query("ngram_resolve", r"""WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(trim(regexp_replace(lower(text), '[^\p{L} ]+', ' ', 'g')), ' +'), lambda x: x <> '') AS a FROM conversations),
w AS (SELECT list_filter(string_split_regex(trim(regexp_replace(lower(text), '[^\p{L} ]+', ' ', 'g')), ' +'), lambda x: x <> '') AS a, item_id FROM benchmark),
idx AS (SELECT k AS alias_key, min(item_id) AS item_id FROM (SELECT unnest(a) AS k, item_id FROM w UNION ALL SELECT array_to_string(a[i:i+1], ' '), item_id FROM (SELECT a, item_id, unnest(generate_series(1, len(a) - 1)) AS i FROM w)) GROUP BY 1),
g AS (SELECT conv_id, turn, 1 AS n, unnest(generate_series(1, len(a))) AS pos, unnest(a) AS k FROM t UNION ALL
 SELECT conv_id, turn, 2, i, array_to_string(a[i:i+1], ' ') FROM (SELECT conv_id, turn, a, unnest(generate_series(1, len(a) - 1)) AS i FROM t))
SELECT conv_id, turn, alias_key, n, CAST(pos AS INT) AS pos, item_id FROM g JOIN idx ON k = alias_key QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, pos) = 1""")
def ngram_resolve(spark, d):
    toks = F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L} ]+", " ")), " +"), lambda t: t != "")
    words = X.table(spark, d, "benchmark").select("item_id", toks.alias("w"))
    pairs = F.filter(F.transform("w", lambda w, i: F.when(i > 0, F.concat_ws(" ", F.get("w", i - 1), w))), lambda g: g.isNotNull())
    index = words.select("item_id", F.explode(F.concat("w", pairs)).alias("alias_key")).groupBy("alias_key").agg(F.min("item_id").alias("item_id"))
    conv = spread(X.table(spark, d, "conversations")).select("conv_id", "turn", toks.alias("toks"))
    return R.ngram_lookup(conv, index, ["conv_id", "turn"], max_n=2)


@query("resolve_cascade", f"SELECT {ID}, {E['model']} AS model, {E['brand']} AS brand FROM lineitem")
def resolve_cascade(spark, d):
    lines = X.offer_lines(spark, d)
    return R.resolve_models(lines, _index(spark, d)).select(*KEYS, "model", "brand")


@query("header_resolution", f"SELECT {ID}, {E['model']} AS model FROM lineitem")
def header_resolution(spark, d):
    bare = f"concat({E['true_color']}, ' - ', {X.PRICE_TEXT})"
    # 0: line and header name it; 1: the line names its model; 2: only the header does; 3: the header names another brand
    lines = X.derived(spark, d, text=f"CASE WHEN l_linenumber % 4 = 2 THEN {bare} ELSE {X.LINE} END",
                      header=f"CASE l_linenumber % 4 WHEN 1 THEN NULL WHEN 2 THEN {E['model']} WHEN 0 THEN {E['model']} ELSE CASE {E['brand']} WHEN 'Xiaomi' THEN 'Google Pixel' WHEN 'Samsung' THEN 'Google' ELSE 'прайс' END END")
    return R.resolve_with_header(lines, _index(spark, d)).select(*KEYS, "model")


# Every model has a seller's code of its own; the line names nothing else.  Codes have four digits, so three letters count the ten thousands.
def _code(key: str) -> str:
    group = f"CAST(floor({key} / {X.VARIANTS_PER_MODEL}) AS BIGINT)"
    letter = lambda n, first: f"chr(CAST(65 + (floor({group} / {10000 * 26 ** n}) + {first}) % 26 AS INT))"
    digits = f"lpad(CAST({group} % 10000 AS VARCHAR(20)), 4, '0')"
    return f"concat({letter(2, 12)}, {letter(1, 16)}, {digits}, {letter(0, 0)})"


@query("code_resolve", f"SELECT {ID}, {E['model']} AS model FROM lineitem")
def code_resolve(spark, d):
    codes = C.build_code_index(X.text_catalog(spark, d).withColumn("code", F.expr(_code("variant_id"))))
    lines = X.derived(spark, d, text=f"concat({_code('l_partkey')}, ' - ', {X.PRICE_TEXT})")
    return R.resolve_models(lines, _index(spark, d), cut_lineage(codes)).select(*KEYS, "model")


# Every fourth line names nothing of the catalogue.
SOLD = f"CASE WHEN l_linenumber % 4 = 0 THEN concat('прочее, ', {X.PRICE_TEXT}) ELSE {X.LINE} END"


def _sold(spark, d):
    lines = X.derived(spark, d, text=SOLD, header="CAST(NULL AS STRING)")
    return R.build_offers(lines, _index(spark, d))


@query("offers_from_lines", f"SELECT {ID}, CASE WHEN l_linenumber % 4 > 0 THEN {E['model']} END AS model, CAST({X.PRICE} AS BIGINT) AS price FROM lineitem")
def offers_from_lines(spark, d):
    return _sold(spark, d).select(*KEYS, "model", F.col("price").cast("bigint").alias("price"))


@query("unmatched_lines", f"SELECT {X.CHANNEL} AS channel, l_orderkey AS message_id, {SOLD} AS raw, 'no_catalog_match' AS reason FROM lineitem WHERE l_linenumber % 4 = 0")
def unmatched_lines(spark, d):
    return R.unmatched_lines(_sold(spark, d)).select("channel", "message_id", "raw", "reason")


# ------------------------------------------------------------------ matching
_ATTRS = ["cat", "brand", "series", "model", "storage", "ram", "color", "color_1", "color_2", "colors", "region", "sim", "code", "band_type", "band_color", "band_size",
          "screen_size", "watch_size_mm", "connectivity", "drive", "chip", "year", "anc", "case", "nano_glass", "no_watches", "game"]


def _offers_from_text(spark, d, index=None):
    """(lines with their kind, kinds in attribute form): a kind is resolved and read once, whatever number of lines and prices it has."""
    return R.normalize_kinds(X.offer_lines(spark, d), index or _index(spark, d), catalog_rules=False)


def _variants(spark, d):
    return cut_lineage(C.build_variants(X.text_catalog(spark, d)))


FROM_TEXT_SQL = f"""offer AS (SELECT l_partkey AS variant_id, {X.CHANNEL} AS channel, CAST({X.PRICE} AS DOUBLE) AS price FROM lineitem),
mn AS (SELECT variant_id, min(price) AS min_price, count(*) AS n_offers FROM offer GROUP BY 1),
win AS (SELECT variant_id, string_agg(DISTINCT channel, ',' ORDER BY channel) AS best_channels FROM offer JOIN mn USING (variant_id) WHERE price = min_price GROUP BY 1)"""


@query("match_from_text", f"WITH {FROM_TEXT_SQL} SELECT variant_id, CAST(min_price AS BIGINT) AS min_price, n_offers, best_channels FROM mn JOIN win USING (variant_id)")
def match_from_text(spark, d):
    """Price lines to best price per catalogue variant, from the text alone."""
    lines, kinds = _offers_from_text(spark, d)
    pairs = J.match_variants(_variants(spark, d), kinds, ["variant_id"], ["_kind"])
    offers = lines.select("_kind", "channel", M.extract_price("text").alias("price")).join(pairs, "_kind")
    best = J.best_price(offers, ["variant_id"])
    return best.select("variant_id", F.col("min_price").cast("bigint").alias("min_price"), "n_offers", F.array_join("best_channels", ",").alias("best_channels"))


@query("blocking_candidates", f"""WITH o AS (SELECT CAST(floor(l_partkey / 12) AS BIGINT) AS g, count(DISTINCT {X.LINE}) AS n FROM lineitem GROUP BY 1)
SELECT p_partkey AS variant_id, n AS n_candidates FROM part JOIN o ON g = CAST(floor(p_partkey / 12) AS BIGINT)""")
def blocking_candidates(spark, d):
    lines, kinds = _offers_from_text(spark, d)
    v = _variants(spark, d).select("variant_id", J.blocking_keys().alias("keys"))
    # texts of equal keys are counted before they meet a variant
    texts = lines.select("_kind", "text").distinct().groupBy("_kind").agg(F.count(F.lit(1)).alias("n"))
    o = kinds.select("_kind", J.blocking_keys().alias("keys")).join(texts, "_kind").groupBy("keys").agg(F.sum("n").alias("n"))
    return J.candidate_pairs(v, o, ["variant_id"], ["n"]).groupBy("variant_id").agg(F.sum("n").alias("n_candidates"))


# Every fifth model is offered under another name; two variants of each model in a colour the catalogue does not have.
UNMATCHED_SQL = """WITH p AS (SELECT p_partkey AS k, CAST(floor(p_partkey / 12) AS BIGINT) AS g, p_partkey % 12 AS v FROM part), o AS (SELECT DISTINCT l_partkey AS k, CAST(floor(l_partkey / 12) AS BIGINT) AS g FROM lineitem)
SELECT k AS variant_id, CASE WHEN g % 5 = 0 OR g NOT IN (SELECT g FROM o) THEN 'no_candidates' ELSE 'no_candidate_passed' END AS reason FROM p WHERE g % 5 = 0 OR v IN (3, 7) OR k NOT IN (SELECT k FROM o)"""


@query("unmatched_variants", UNMATCHED_SQL)
def unmatched_variants(spark, d):
    """Candidates and matches of all offers: the lines are read as text, copies of a line once."""
    v = _variants(spark, d)
    e = X.catalog_exprs("l_partkey")
    other = f"CASE WHEN CAST(floor(l_partkey / 12) AS BIGINT) % 5 = 0 THEN concat('Nova ', {e['title']}) ELSE {e['title']} END"
    gold = f"CASE WHEN l_partkey % 12 IN (3, 7) THEN regexp_replace({other}, ' (Black|White|Green|Yellow)', ' Gold') ELSE {other} END"
    asked = X.derived(spark, d, text=gold).select("text", F.col("true_variant").alias("k")).groupBy("text").agg(F.min("k").alias("k"))
    named = asked.join(v.select(F.col("variant_id").alias("k"), "cat", "brand", "series", "model", "cat_pos"), "k").withColumn(
        "model", F.when(F.floor(F.col("k") / 12) % 5 == 0, F.concat(F.lit("Nova "), "model")).otherwise(F.col("model")))
    offers = cut_lineage(A.with_attributes(named, "text", cat="cat", brand="brand", series="series", model="model"))
    matches = J.match_variants(v, offers, ["variant_id"], ["text"])
    seen = J.with_candidates(v.select("variant_id", J.blocking_keys().alias("keys")), offers.select(J.blocking_keys().alias("keys")), ["variant_id"])
    return J.unmatched_variants(X.text_catalog(spark, d).filter("trim(title) <> ''").select("variant_id"), seen, matches, ["variant_id"])


@query("theta_match_nullsafe", f"""WITH o AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
p AS (SELECT o.k, o.n, p_partkey AS v, CAST(floor(p_partkey / 12) AS BIGINT) % 4 AS fam FROM o JOIN part ON CAST(floor(p_partkey / 12) AS BIGINT) = CAST(floor(o.k / 12) AS BIGINT))
SELECT fam, CASE WHEN k = v THEN NULL WHEN fam = 3 OR CAST(floor((k % 12) / 4) AS BIGINT) <> CAST(floor((v % 12) / 4) AS BIGINT) THEN 'color' ELSE 'storage' END AS reason, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY ALL""")
def theta_match_nullsafe(spark, d):
    """Outcome of the predicate for all pairs of one model; equal offers are counted before pairing."""
    counts = X.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("variant_id")).agg(F.count(F.lit(1)).alias("n"))
    v = _variants(spark, d)
    fam = (F.floor(F.col("variant_id") / 12) % 4).alias("fam")
    return J.count_outcomes(v.select("*", fam), v.join(counts, "variant_id"), ["fam"])


COLORS = ["silver", "white", "starlight", "jet black", "black", "navy", "icy blue", "blue", "mint", "green", "red"]


@query("color_compat_match", f"""WITH fam(c, f) AS (VALUES ('silver','w'),('white','w'),('starlight','w'),('jet black','b'),('black','b'),('navy','u'),('icy blue','u'),('blue','u'),('mint','g'),('green','g'),('red','r')),
p AS (SELECT {X._case('p_size % 12', COLORS)} AS vc, {X._case('CAST(l_quantity AS BIGINT) % 12', COLORS)} AS oc, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT vc, oc, n, CASE WHEN vc IS NULL AND oc IS NULL THEN true WHEN vc IS NULL OR oc IS NULL THEN false ELSE (SELECT f FROM fam WHERE c = vc) = (SELECT f FROM fam WHERE c = oc) END AS ok FROM p""")
def color_compat_match(spark, d):
    part = X.table(spark, d, "part").selectExpr("p_partkey AS k", f"{X._case('p_size % 12', COLORS)} AS vc")
    li = X.table(spark, d, "lineitem").selectExpr("l_partkey AS k", f"{X._case('CAST(l_quantity AS BIGINT) % 12', COLORS)} AS oc").groupBy("k", "oc").agg(F.count(F.lit(1)).alias("n"))
    pairs = li.join(part, "k").groupBy("vc", "oc").agg(F.sum("n").alias("n"))

    def side(col):
        none = F.lit(None).cast("string")
        return J.prepare(pairs.select("vc", "oc", "n", F.col(col).alias("color"), none.alias("color_1"), none.alias("color_2"), none.alias("cat"), none.alias("brand"),
                                      F.lit("x").alias("model"), none.alias("code"), none.alias("connectivity"), none.alias("band_color"), F.array().cast("array<string>").alias("colors")))

    v, o = side("vc").alias("v"), side("oc").alias("o")
    j = v.join(o, F.col("v.vc").eqNullSafe(F.col("o.vc")) & F.col("v.oc").eqNullSafe(F.col("o.oc")))
    return j.select("v.vc", "v.oc", "v.n", J.colors_match("v", "o", F.lit("phones")).alias("ok"))


@query("sheet_match", f"""WITH o AS (SELECT l_partkey AS k, {X.PRICE} AS price, {X.CHANNEL} AS channel, {X.LINE} AS raw, (l_orderkey, l_linenumber, l_suppkey) AS seq FROM lineitem)
SELECT p_partkey + 2 AS row_no, min(price) AS min_price, arg_min(channel, (price, seq)) AS best_channel, count(k) AS n_offers FROM part LEFT JOIN o ON k = p_partkey GROUP BY 1""")
def sheet_match(spark, d):
    """A price sheet of raw names, resolved and filled with the best offers."""
    index = _index(spark, d)
    lines, kinds = _offers_from_text(spark, d, index)
    sheet = X.text_catalog(spark, d).select((F.col("variant_id") + 2).alias("row_no"), F.concat(F.col("title"), F.lit(" (Global)")).alias("name"))
    rows = cut_lineage(R.resolve_sheet(sheet, index))
    pairs = J.match_variants(rows, kinds, ["row_no"], ["_kind"])
    matches = lines.select("_kind", F.col("text").alias("raw"), "channel", "seq", M.extract_price("text").alias("price")).join(pairs, "_kind")
    return J.sheet_best(rows.select("row_no"), matches).select("row_no", "min_price", "best_channel", "n_offers")


@query("sheet_summary", """SELECT count(*) AS rows_total, count(*) AS rows_named, count(mn) AS rows_priced, count(*) - count(mn) AS rows_unpriced, CAST(sum(n) AS BIGINT) AS offers_total
FROM (SELECT p_partkey, min(l_extendedprice) AS mn, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = CASE WHEN l_partkey % 17 = 0 THEN -1 - l_partkey ELSE l_partkey END GROUP BY 1)""")
def sheet_summary(spark, d):
    sheet = X.catalog(spark, d).select(F.col("variant_id").alias("row_no"), F.col("model").alias("name"))
    m = X.table(spark, d, "lineitem").selectExpr(
        "CASE WHEN l_partkey % 17 = 0 THEN -1 - l_partkey ELSE l_partkey END AS row_no", f"{X.CHANNEL} AS channel", "l_extendedprice AS price", "l_returnflag AS raw", "l_orderkey AS seq")
    return J.sheet_summary(J.sheet_best(sheet, m))


@query("best_offer_for_query", f"""WITH offer AS (SELECT l_partkey AS k, min({X.PRICE}) AS price FROM lineitem GROUP BY 1), n AS (SELECT count(*) AS n FROM offer),
q AS (SELECT DISTINCT o_custkey % (SELECT count(*) FROM part) AS k, o_orderkey % 3 AS want FROM orders)
SELECT q.k, q.want, CASE WHEN want < 2 THEN offer.price END AS price, CASE WHEN want = 2 OR offer.k IS NULL THEN 'model' END AS reason FROM q LEFT JOIN offer USING (k)""")
def best_offer_for_query(spark, d):
    """Queries name a variant; every third asks for a region no offer has."""
    v = _variants(spark, d)
    price = X.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("variant_id")).agg(F.min(F.expr(X.PRICE)).alias("price"))
    offers = v.join(price, "variant_id").withColumn("region", F.lit("eu"))
    total = X.table(spark, d, "part").agg(F.count(F.lit(1)).alias("_parts"))
    asked = X.table(spark, d, "orders").crossJoin(F.broadcast(total)).selectExpr("o_custkey % _parts AS k", "o_orderkey % 3 AS want").distinct()
    q = asked.join(v.withColumnRenamed("variant_id", "k"), "k").withColumn("region", F.when(F.col("want") == 2, "us").when(F.col("want") == 1, "eu"))
    out = J.answer_queries(q, offers, ["k", "want"], ["price"])
    return out.select("k", "want", F.col("offer.price").alias("price"), "reason")


@query("top_reason", "SELECT k, arg_min(r, (-n, r)) AS reason, max(n) AS n FROM (SELECT l_suppkey AS k, l_returnflag AS r, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def top_reason(spark, d):
    a = X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("reason"))
    return J.top_reason(a, ["k"])


@query("regions_at_min", f"""WITH mn AS (SELECT l_partkey AS k, min({X.PRICE}) AS m FROM lineitem GROUP BY 1),
r AS (SELECT k, {X.REGION} AS r, min((l_orderkey, l_linenumber, l_suppkey)) AS s FROM lineitem JOIN mn ON k = l_partkey AND {X.PRICE} = m WHERE {X.REGION} IS NOT NULL GROUP BY ALL)
SELECT mn.k AS variant_id, m AS min_price, coalesce(string_agg(r, ',' ORDER BY s), '') AS regions FROM mn LEFT JOIN r USING (k) GROUP BY ALL""")
def regions_at_min(spark, d):
    o = X.offer_lines(spark, d).selectExpr("true_variant AS variant_id", "true_price AS price", "text AS raw", "seq")
    best = o.groupBy("variant_id").agg(F.min("price").alias("min_price"))
    return rollup.regions_at_min(o, ["variant_id"], best).select("variant_id", "min_price", F.array_join("region_min", ",").alias("regions"))


# -------------------------------------------------------------------- phrases
# Every sentence part of the benchmark, looked for in every document; the check tries each pair.
PARTS_SQL = "SELECT item_id * 1000 + i AS phrase_id, trim(ps[i]) AS phrase FROM (SELECT item_id, string_split(replace(text, ',', '.'), '.') AS ps, unnest(range(1, len(string_split(replace(text, ',', '.'), '.')) + 1)) AS i FROM benchmark) WHERE trim(ps[i]) <> ''"


@query("phrase_hits", f"""WITH p AS ({PARTS_SQL}), q AS (SELECT phrase_id, '[^a-z0-9]' || array_to_string(list_transform(list_filter(string_split(lower(phrase), ' '), lambda w: w <> ''), lambda w: regexp_escape(w)), '[\\s._-]+') || '[^a-z0-9]' AS pattern FROM p)
SELECT d.doc_id, q.phrase_id FROM documents d, q WHERE d.text IS NOT NULL AND regexp_matches(' ' || lower(d.text) || ' ', q.pattern)""")
def phrase_hits(spark, d):
    cut = F.split(F.translate("text", ",", "."), r"\.")
    parts = X.table(spark, d, "benchmark").select("item_id", F.posexplode(cut).alias("i", "phrase")).filter("trim(phrase) <> ''")
    parts = parts.select((F.col("item_id") * 1000 + F.col("i") + 1).alias("phrase_id"), "phrase")
    return PH.phrase_hits(spread(X.table(spark, d, "documents")), parts, "doc_id")
