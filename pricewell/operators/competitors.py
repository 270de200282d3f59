"""Competitor price observations from a page table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as H, vocab as V

# ---------------------------------------------------------------- fixed values
# Per shop: host fragment and the ordered places its price may stand in.
SHOP_RULES = {
    "store77.net": [
        "ldjson", "class:p.price_title_product", "meta:product:price:amount", "itemprop", "jsonprice", "rubles",
    ],
    "cordstore.ru": ["class:span.price_value", "ldjson"],
    "biggeek.ru": [
        "slug:prod-info-price__check-item", "data:prod-info-price", "checked:prod-info-price__check-item",
        "data:prod-info-price__check-item", "class:span.total-prod-price",
    ],
    "upstore24.ru": ["class:span.js-product-price", "ldjson"],
    "appmistore.ru": ["class:span.price__new-val", "itemprop", "ldjson"],
    "alikson.ru": ["class:span.product-card-price__cost--discount", "ldjson"],
}
# ------------------------------------------------------------ end fixed values


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumns(
        {"request_url": H.request_url(url), "slug": H.fragment(url), "url_key": F.trim(url), "is_http": H.is_http(url),
         "host": H.host(url)}
    )


def extract_price(html: Column, slug: Column, rules: list[str]) -> Column:
    """First rule that yields a number."""
    return F.coalesce(*[H.rule(html, slug, r) for r in rules])


def extract_competitor_prices(pages: DataFrame, rules: dict[str, list[str]] | None = None, url: str = "url",
                              html: str = "html") -> DataFrame:
    """Price, support and stub flags per page.

    The shop of a page is decided once by its host; a CASE over the shops keeps
    the whole extraction inside one stage.
    """
    rules = rules or SHOP_RULES
    df = url_parts(pages, url)
    low = F.lower("request_url")
    shop = F.when(F.lit(False), F.lit(None).cast("string"))
    for s in rules:
        shop = shop.when(F.contains(low, F.lit(s)), F.lit(s))
    df = df.withColumn("shop", shop)
    price = F.when(F.lit(False), F.lit(None).cast("bigint"))
    for s, places in rules.items():
        price = price.when(F.col("shop") == s, extract_price(F.col(html), F.col("slug"), places))
    return df.withColumns({
        "price": F.when(F.col("is_http"), price),
        "supported": F.col("shop").isNotNull(),
        "is_stub": F.col("shop").eqNullSafe(F.lit("store77.net")) & H.is_stub(html),
    })


def dispatch(pages: DataFrame, rules: dict[str, list[str]] | None = None, url: str = "url") -> DataFrame:
    """Pages per host and whether the host is supported."""
    df = url_parts(pages, url)
    known = F.exists(F.array(*[F.lit(s) for s in (rules or SHOP_RULES)]), lambda s: F.contains(F.lower("request_url"), s))
    return df.groupBy("host", known.alias("supported")).agg(F.count(F.lit(1)).alias("n_pages"))


def cache_state(cache: DataFrame, now: Column) -> DataFrame:
    """Age of each entry and whether it is still valid; hits and misses live differently long."""
    age = F.unix_timestamp(now) - F.unix_timestamp("ts")
    ttl = F.when(F.col("ok"), V.CACHE_TTL_OK_SECONDS).otherwise(V.CACHE_TTL_MISS_SECONDS)
    return cache.withColumns({"age": age, "fresh": age <= ttl})


def fresh_prices(cache: DataFrame, now: Column) -> DataFrame:
    return cache_state(cache, now).filter(F.col("fresh"))


def stale_urls(urls: DataFrame, cache: DataFrame, now: Column, key: str = "url_key") -> DataFrame:
    """URLs without a valid entry: these are fetched."""
    return urls.join(fresh_prices(cache, now).select(key).distinct(), key, "left_anti")


def changed_cells(new: DataFrame, current: DataFrame, keys: list[str], value: str = "price") -> DataFrame:
    """Cells with a new price that differs from the present one."""
    cur = current.select(*keys, F.col(value).alias("_cur"))
    return new.join(cur, keys, "left").filter(
        F.col(value).isNotNull() & ~F.col(value).eqNullSafe(F.col("_cur"))
    ).withColumnRenamed("_cur", "old_" + value)
