"""How the given tables play the parts of the domain.

``part`` is the catalogue and ``lineitem`` the offers.  The text forms (titles,
price lines, messages, pages) are derived from their rows one by one, so their
volume grows with the tables.  The expressions use the common part of both SQL
dialects and are therefore shared with the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import prefer_small_methods, spread

VARIANTS_PER_MODEL = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prefer_small_methods(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(expr: str, values: list) -> str:
    whens = " ".join(f"WHEN {i} THEN {v!r}" if isinstance(v, str) else f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


def catalog_exprs(key: str) -> dict[str, str]:
    """Catalogue columns of a part key."""
    group = f"CAST(floor({key} / {VARIANTS_PER_MODEL}) AS BIGINT)"
    v = f"{key} % {VARIANTS_PER_MODEL}"
    fam = f"{group} % 4"
    word = f"concat('z', translate(CAST({group} AS VARCHAR(20)), '0123456789', 'abcdefghij'))"
    storage = _case(f"{v} % 4", ["128GB", "256GB", "512GB", "1TB"])
    color = _case(f"CAST(floor(({v}) / 4) AS BIGINT)", ["Black", "White", "Blue"])
    color12 = _case(v, ["Black", "White", "Blue", "Green", "Red", "Pink", "Purple", "Yellow", "Orange", "Teal", "Indigo", "Brown"])
    lead = _case(fam, ["Redmi Turbo ", "Galaxy Tab ", "MateBook ", "Tune "])
    model = f"concat({lead}, {word})"
    return {
        "cat": _case(fam, ["Смартфоны", "Планшеты", "Ноутбуки", "Наушники"]),
        "brand": _case(fam, ["Xiaomi", "Samsung", "Huawei", "JBL"]),
        "series": _case(fam, ["Redmi", "Galaxy Tab", "MateBook", "Tune"]),
        "model": model,
        "title": (
            f"CASE {fam} WHEN 0 THEN concat({model}, ' 8/', {storage}, ' ', {color}) "
            f"WHEN 1 THEN concat({model}, ' ', {storage}, ' ', {color}, ' Wi-Fi') "
            f"WHEN 2 THEN concat({model}, ' (16GB, ', {storage}, ') ', {color}) "
            f"ELSE concat({model}, ' ', {color12}) END"
        ),
        "true_storage": f"CASE WHEN {fam} < 3 THEN {storage} END",
        "true_color": f"CASE WHEN {fam} < 3 THEN {color} ELSE {color12} END",
        "true_ram": f"CASE {fam} WHEN 0 THEN 8 WHEN 2 THEN 16 END",
    }


# Whole roubles above 3000, so that no price looks like a year.
PRICE = "CAST(floor(l_extendedprice) AS BIGINT) + 3000"
PRICE_TEXT = (
    f"CASE WHEN l_linenumber % 2 = 0 AND {PRICE} >= 31000 "
    f"THEN concat(CAST(CAST(floor(({PRICE}) / 1000) AS BIGINT) AS VARCHAR(20)), ' ', lpad(CAST(({PRICE}) % 1000 AS VARCHAR(20)), 3, '0')) "
    f"ELSE CAST({PRICE} AS VARCHAR(20)) END"
)
FLAG = _case("l_suppkey % 4", ["", " 🇺🇸", " 🇯🇵", " 🇪🇺"])
REGION = "CASE l_suppkey % 4 WHEN 1 THEN 'us' WHEN 2 THEN 'jp' WHEN 3 THEN 'eu' END"
CHANNEL = "concat('S', CAST(l_suppkey AS VARCHAR(20)))"
LINE = f"concat({catalog_exprs('l_partkey')['title']}, ' - ', {PRICE_TEXT}, {FLAG})"
UNIT_PRICE = "l_extendedprice / l_quantity"


def text_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows with titles; positions follow the part key."""
    e = catalog_exprs("p_partkey")
    group = f"CAST(floor(p_partkey / {VARIANTS_PER_MODEL}) AS INT)"
    return spread(table(spark, sf_dir, "part")).selectExpr(
        "p_partkey AS variant_id", *[f"{x} AS {c}" for c, x in e.items()],
        "0 AS cat_pos", "0 AS brand_pos", "0 AS series_pos", f"{group} AS model_pos",
        f"CAST(p_partkey % {VARIANTS_PER_MODEL} AS INT) AS variant_pos",
    )


def derived(spark: SparkSession, sf_dir: str, **exprs: str) -> DataFrame:
    """``lineitem`` with text columns built step by step, so that shared pieces are computed once."""
    t = catalog_exprs("l_partkey")
    base = spread(table(spark, sf_dir, "lineitem")).selectExpr(
        "*", f"{t['title']} AS _title", f"{t['model']} AS _model", f"{PRICE_TEXT} AS _price", f"{FLAG} AS _flag", f"{CHANNEL} AS channel"
    ).selectExpr("*", "concat(_title, ' - ', _price, _flag) AS _line")

    def short(e: str) -> str:
        for long, name in ((LINE, "_line"), (t["title"], "_title"), (t["model"], "_model"), (PRICE_TEXT, "_price"), (FLAG, "_flag")):
            e = e.replace(long, name)
        return e

    return base.selectExpr(
        "channel", "l_orderkey AS message_id", "l_linenumber AS part_no", "l_shipdate AS date", "l_partkey AS true_variant",
        f"{PRICE} AS true_price", "struct(l_orderkey, l_linenumber, l_suppkey) AS seq",
        *[f"{short(e)} AS {c}" for c, e in exprs.items()],
    )


def offer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price line per order line."""
    return derived(spark, sf_dir, text=LINE)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain offers: variant, channel, unrounded unit price."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS variant_id", f"{CHANNEL} AS channel", f"{UNIT_PRICE} AS price", "l_returnflag AS raw",
        "l_shipdate AS seq",
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain catalogue: type, brand and name are the path."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS variant_id", "p_type AS cat", "p_brand AS brand", "p_name AS model", "p_size AS size", "p_retailprice AS list_price"
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).selectExpr(
        "source AS channel", "doc_id AS message_id", "CAST(NULL AS TIMESTAMP) AS date", "text AS message"
    )


# Shapes a seller's message takes, chosen per order line.
SHAPE = "(l_orderkey + l_linenumber) % 8"
_T = catalog_exprs("l_partkey")
_BARE = f"concat({_case('l_orderkey % 4', ['128GB', '256GB', '512GB', '1TB'])}, ' Black')"
MESSAGE = (
    f"CASE {SHAPE} "
    f"WHEN 0 THEN {LINE} "
    f"WHEN 1 THEN concat('Galaxy Note ', CAST(l_suppkey % 100 AS VARCHAR(20)), chr(10), {_BARE}, ' - ', {PRICE_TEXT}) "
    f"WHEN 2 THEN concat({_T['title']}, chr(10), 'От 1 шт - ', {PRICE_TEXT}) "
    f"WHEN 3 THEN concat({_T['title']}, chr(10), 'От 5 шт - ', {PRICE_TEXT}) "
    f"WHEN 4 THEN concat({LINE}, chr(10), {_T['model']}, ' царапина - ', {PRICE_TEXT}) "
    f"WHEN 5 THEN concat('=======', chr(10), 'Sold out ', {LINE}, chr(10), 'доставка 500 руб', chr(10), {LINE}) "
    f"WHEN 6 THEN concat('Розыгрыш!', chr(10), {LINE}) "
    f"ELSE concat('Например:', chr(10), {_T['model']}, chr(10), '-----', chr(10), {_T['title']}, ' - ', {PRICE_TEXT}, ' - ', {PRICE_TEXT}) END"
)


def seller_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, message=MESSAGE).select("channel", "message_id", "part_no", "date", "message")


# Every shop of the default rules by page, with its price markup inside the page.
PAGE_PRICE = "(10000 + page_id * 7)"
PAGE_SHOP = _case("page_id % 8", ["store77.net", "cordstore.ru", "biggeek.ru", "upstore24.ru", "appmistore.ru", "alikson.ru", "store77.net", "example.org"])
_PP = f"CAST({PAGE_PRICE} AS VARCHAR(20))"
PAGE_SNIPPET = (
    "CASE page_id % 8 "
    f"WHEN 0 THEN concat('<script type=\"application/ld+json\">{{bad</script><script type=\"application/ld+json\">{{\"@graph\":[{{\"offers\":[{{\"lowPrice\":', {_PP}, '}}]}}]}}</script>') "
    f"WHEN 1 THEN concat('<span class=\"price_value\">', {_PP}, '&nbsp;</span>') "
    f"WHEN 2 THEN concat('<div class=\"prod-info-price\" data-price=\"1\"></div><a class=\"prod-info-price__check-item on\" data-slug=\"esim\" data-price=\"', {_PP}, '\"></a>') "
    f"WHEN 3 THEN concat('<span class=\"product-price js-product-price\">', {_PP}, ' RUB</span>') "
    f"WHEN 4 THEN concat('<span class=\"price__new-val font_24\">1<meta itemprop=\"price\" content=\"', {_PP}, '\"></span>') "
    f"WHEN 5 THEN concat('<span class=\"product-card-price__cost--discount\">', {_PP}, '</span>') "
    f"WHEN 6 THEN concat('<meta property=\"product:price:amount\" content=\"', {_PP}, '\">') "
    "ELSE '' END"
)


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).selectExpr(
        "page_id", f"concat('https://', {PAGE_SHOP}, '/p/', CAST(page_id AS VARCHAR(20)), '#ESIM') AS url",
        f"concat(html, {PAGE_SNIPPET}) AS html",
    )
