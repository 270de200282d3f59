"""Prices inside HTML and URL parts, as JVM expressions on the page text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lines import rx
from .money import whole_int
from .text import _c


def request_url(col) -> Column:
    """Without the fragment, which never reaches the server."""
    return F.trim(F.split_part(F.trim(_c(col)), F.lit("#"), F.lit(1)))


def fragment(col) -> Column:
    """Variant slug behind '#', lower case, empty if there is none."""
    u = F.trim(_c(col))
    return F.when(F.contains(u, F.lit("#")), F.lower(F.trim(F.regexp_replace(u, "^[^#]*#", "")))).otherwise(F.lit(""))


def is_http(col) -> Column:
    return F.startswith(F.lower(F.trim(_c(col))), F.lit("http"))


def host(col) -> Column:
    return F.nullif(F.regexp_extract(F.trim(_c(col)), r"^[a-zA-Z]+://([^/?#]+)", 1), F.lit(""))


def text_of(col) -> Column:
    """Visible text of a piece of markup."""
    c = F.regexp_replace(_c(col), "(?s)<[^>]+>", " ")
    c = F.regexp_replace(c, "&nbsp;|&#160;|&#xa0;", " ")
    return F.regexp_replace(c, "&amp;", "&")


def _attr(tag: Column, name: str) -> Column:
    return F.nullif(
        F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("")
    )


def _tags(html: Column, name: str, condition) -> Column:
    """Opening tags of an element that satisfy a condition."""
    return F.filter(F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0)), condition)


def _has_class(tag: Column, cls: str) -> Column:
    classes = F.split(F.lower(F.coalesce(_attr(tag, "class"), F.lit(""))), r"\s+")
    return F.array_contains(classes, cls.lower())


def by_class(html: Column, name: str, cls: str) -> Column:
    """First number in the first element of a class (or in a price ``meta`` inside it)."""
    body = F.regexp_extract(html, rf"(?is)<{name}\b[^>]*class\s*=\s*[\"'](?:[^\"']*\s)?{cls}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</{name}>", 1)
    meta = F.regexp_extract(body, r"(?is)<meta\b[^>]*itemprop\s*=\s*[\"']price[\"'][^>]*>", 0)
    return F.coalesce(whole_int(_attr(meta, "content")), whole_int(text_of(body)))


def by_meta(html: Column, prop: str) -> Column:
    tags = _tags(html, "meta", lambda t: F.coalesce(_attr(t, "property") == prop, F.lit(False)))
    return whole_int(_attr(F.try_element_at(tags, F.lit(1)), "content"))


def by_itemprop(html: Column) -> Column:
    tag = F.regexp_extract(html, r"(?is)<[a-z0-9]+\b[^>]*itemprop\s*=\s*[\"']price[\"'][^>]*>", 0)
    body = F.regexp_extract(html, r"(?is)<[a-z0-9]+\b[^>]*itemprop\s*=\s*[\"']price[\"'][^>]*>([^<]*)<", 1)
    return whole_int(F.coalesce(_attr(tag, "content"), _attr(tag, "value"), body))


def by_data_price(html: Column, cls: str) -> Column:
    tags = _tags(html, "[a-z0-9]+", lambda t: _has_class(t, cls) & _attr(t, "data-price").isNotNull())
    return whole_int(_attr(F.try_element_at(tags, F.lit(1)), "data-price"))


def by_slug(html: Column, slug: Column, cls: str) -> Column:
    tags = _tags(
        html, "[a-z0-9]+",
        lambda t: _has_class(t, cls) & F.coalesce(F.lower(_attr(t, "data-slug")) == slug, F.lit(False)) & (slug != ""),
    )
    return whole_int(_attr(F.try_element_at(tags, F.lit(1)), "data-price"))


def by_checked(html: Column, cls: str) -> Column:
    """Price of the variation whose radio button is checked."""
    radio = F.try_element_at(
        _tags(html, "input", lambda t: F.coalesce(_attr(t, "name") == "product_variation_radio", F.lit(False)) & rx(t, r"(?i)\schecked\b")),
        F.lit(1),
    )
    variation = F.regexp_extract(_attr(radio, "value"), r"#(\d+)#", 1)
    tags = _tags(
        html, "[a-z0-9]+",
        lambda t: _has_class(t, cls) & F.coalesce(_attr(t, "data-variation-id") == variation, F.lit(False)),
    )
    return whole_int(_attr(F.try_element_at(tags, F.lit(1)), "data-price"))


def _node_price(node: Column) -> Column:
    """price, lowPrice, highPrice of a JSON object text; empty and zero values do not count."""
    return F.coalesce(*[
        F.nullif(whole_int(F.get_json_object(node, f"$.{k}")), F.lit(0).cast("bigint")) for k in ("price", "lowPrice", "highPrice")
    ])


def _json_items(text: Column) -> Column:
    """A JSON array as its items, anything else as one item."""
    return F.when(F.startswith(F.trim(text), F.lit("[")), F.from_json(text, "array<string>")).otherwise(F.array(text))


def ldjson_price(html: Column) -> Column:
    """Product price in the JSON-LD blocks: broken blocks are skipped, ``@graph`` comes after the nodes."""
    bodies = F.regexp_extract_all(
        html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)
    )
    valid = F.filter(F.transform(bodies, lambda s: F.trim(s)), lambda b: F.try_parse_json(b).isNotNull())

    def nodes(block):
        top = F.coalesce(_json_items(block), F.array().cast("array<string>"))
        graph = F.flatten(F.transform(
            F.filter(F.transform(top, lambda n: F.get_json_object(n, "$.@graph")), lambda g: g.isNotNull()), _json_items))
        return F.concat(top, F.coalesce(graph, F.array().cast("array<string>")))

    def price(node):
        offers = F.get_json_object(node, "$.offers")
        from_offers = F.filter(F.transform(_json_items(offers), _node_price), lambda p: p.isNotNull())
        own = F.nullif(whole_int(F.get_json_object(node, "$.price")), F.lit(0).cast("bigint"))
        return F.coalesce(F.try_element_at(from_offers, F.lit(1)), own)

    prices = F.filter(F.transform(F.flatten(F.transform(valid, nodes)), price), lambda p: p.isNotNull())
    return F.try_element_at(prices, F.lit(1))


def is_stub(col) -> Column:
    """Pages an anti-robot shield sends instead of the product."""
    low = F.lower(_c(col))
    return (
        (F.coalesce(low, F.lit("")) == "")
        | F.contains(low, F.lit('meta name="robots" content="noindex, noarchive"'))
        | F.contains(low, F.lit("created with ajaxload.info"))
        | F.contains(F.replace(low, F.lit(" "), F.lit("")), F.lit("<title></title>"))
    )


def rule(html: Column, slug: Column, name: str) -> Column:
    """One price rule, named as ``kind:argument``."""
    kind, _, arg = name.partition(":")
    if kind == "ldjson":
        return ldjson_price(html)
    if kind == "class":
        tag, _, cls = arg.partition(".")
        return by_class(html, tag, cls)
    if kind == "meta":
        return by_meta(html, arg)
    if kind == "itemprop":
        return by_itemprop(html)
    if kind == "data":
        return by_data_price(html, arg)
    if kind == "slug":
        return by_slug(html, slug, arg)
    if kind == "checked":
        return by_checked(html, arg)
    if kind == "jsonprice":
        return F.regexp_extract(html, r'"price"\s*:\s*"?(\d{3,})"?', 1).try_cast("bigint")
    if kind == "rubles":
        return whole_int(F.regexp_extract(html, r"(\d{1,3}(?:[ \x{A0}]?\d{3})+)\s*₽", 1))
    raise ValueError(name)
