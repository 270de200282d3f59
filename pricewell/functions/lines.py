"""Predicates and rewrites of one text line."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P
from .text import _c, flags_of, let, strip_emoji


def rx(col, pattern: str) -> Column:
    return F.rlike(_c(col), F.lit(pattern))


def squeeze(col) -> Column:
    """Spaces and tabs collapse, line ends stay out of it.  Most lines are squeezed already, which one look tells."""
    def tight(c):
        c = F.replace(c, F.lit("\u00a0"), F.lit(" "))
        return F.regexp_replace(F.regexp_replace(c, "[ \t]{2,}", " "), r"(?U)^\s+|\s+$", "")

    return let(_c(col), lambda c: F.when(rx(c, P.LOOSE), tight(c)).otherwise(c))


def wide(col) -> Column:
    """Letters beyond Latin-1: without them no Cyrillic word can match, and the ``_LATIN`` patterns say all."""
    return rx(col, P.WIDE)


def _either(c: Column, pattern: str, latin: str | None) -> Column:
    return F.when(wide(c), rx(c, pattern)).otherwise(F.lit(False) if latin is None else rx(c, latin))


def _unclean(m: Column) -> Column:
    return rx(m, P.LOOSE) | rx(m, P.SIGNS) | rx(m, P.LONE_PART)


def split_lines(col) -> Column:
    """Cleaned non-empty lines of a message in order.  One look at the message tells whether any line needs cleaning."""
    cleaned = lambda m: F.transform(F.split(m, P.LINE_BREAK), lambda s: squeeze(strip_emoji(s)))
    lines = lambda m: F.when(_unclean(m), cleaned(m)).otherwise(F.split(m, P.LINE_BREAK))
    return F.filter(let(_c(col), lines), lambda s: s != "")


def is_separator(col) -> Column:
    """Banners and rules: no letters or digits, or hardly any distinct character."""
    c = _c(col)
    return (
        (c == "")
        | rx(c, P.BANNER)
        | ((F.length(c) >= 4) & ~rx(c, r"[\p{L}\p{N}]"))
        | ((F.length(c) >= 8) & rx(c, P.FEW_CHARACTERS))
    )


def mask_dates(col) -> Column:
    """Dates, times and years are no prices."""
    masked = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, P.DATE, " "), P.TIME, " "), P.YEAR, " ")
    return squeeze(let(_c(col), lambda c: F.when(rx(c, P.MAY_BE_DATE), masked(c)).otherwise(c)))


def has_price(col) -> Column:
    return rx(mask_dates(col), P.PRICED)


def is_product_line(col) -> Column:
    """A letter and a price, dates set aside."""
    return let(mask_dates(col), lambda probe: rx(probe, r"\p{L}") & rx(probe, P.PRICED))


def out_of_stock(col) -> Column:
    return _either(_c(col), P.OUT_OF_STOCK_LED, P.OUT_OF_STOCK_LATIN)


def defective(col) -> Column:
    return _either(_c(col), P.DEFECT_LED, P.DEFECT_LATIN)


def strip_second_price(col) -> Column:
    """``X - 17900 - 17850`` keeps the first price and the flags.

    Years, digits glued to a word and ``17 256`` memory pairs are no prices; the
    two prices must have a dash between them.
    """
    return let(_c(col), lambda c: F.when(rx(c, P.MAY_BE_PAIR), _first_price(c)).otherwise(c))


def _first_price(c: Column) -> Column:
    # A price that may count: neither a year nor a memory pair nor part of a longer token.
    token = (
        r"(?<![\p{L}\p{N}])(?!20\d{2}(?!\d))(?!(?:[0-9]|[12]\d|30) (?:128|256|512)(?!\d))"
        r"(?:\d{1,3}(?:[ .]\d{3})+|\d{4,6})(?!\d)"
    )
    short = r"(?<![\p{L}\p{N}])\s[-—]\s*\d{1,3}(?:[.,]\d{1,2})?(?!\d)"
    any_price = "(?:" + token + "|" + short + ")"
    pair = "(?iu)^(.*?" + any_price + r")(?:(?!" + any_price + r").)*?[-—](?:(?!" + any_price + r").)*?" + any_price + ".*$"
    head = F.when(rx(c, pair), F.regexp_replace(c, pair, "$1"))
    flags = flags_of(c)
    with_flags = F.when(F.size(flags) > 0, F.concat(head, F.lit(" "), F.array_join(flags, " "))).otherwise(head)
    return F.coalesce(squeeze(with_flags), c)


def starts_example(col) -> Column:
    """An introduction to an order example, not a product line."""
    return rx(col, P.EXAMPLE_START) & ~has_price(col)


def delete_reason(col, priced: Column | None = None) -> Column:
    """First reason a line is dropped for, NULL when it is a price line."""
    c = _c(col)
    priced = has_price(c) if priced is None else priced
    enum = rx(c, P.ENUM_PREFIX)
    span = rx(c, P.RANGE_PREFIX)

    def judged(out_of_stock: Column, defect: Column, info: Column, tail: Column, tier: Column) -> Column:
        return (
            F.when(is_separator(c), "header_or_separator")
            .when(out_of_stock, "out_of_stock")
            .when(defect, "defective_or_used")
            .when(info, "info_line")
            .when((enum & (span | tail)) | (span & tail), "not_a_price_range")
            .when(priced & tier, "wholesale_tier")
            .when(~priced, "no_price")
        )

    full = [rx(c, p) for p in (P.OUT_OF_STOCK_LED, P.DEFECT_LED, P.INFO_LED, P.NOT_PRICE_TAIL, P.TIER_LINE)]
    latin = [rx(c, p) for p in (P.OUT_OF_STOCK_LATIN, P.DEFECT_LATIN, P.PERCENT, P.PERCENT)]
    return F.when(wide(c), judged(*full)).otherwise(judged(*latin, F.lit(False)))


def norm_header_line(col) -> Column:
    """A header line without mentions, lone letters and punctuation; contact lines vanish."""
    def words(c):
        c = F.regexp_replace(c, P.LONE_LETTER, " ")
        return F.trim(F.regexp_replace(c, r"(?U)\W+", " "))

    named = let(F.lower(F.trim(_c(col))), lambda c: F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, P.MENTION, "")).otherwise(c))
    return let(named, lambda c: F.when(_either(c, P.CONTACT, None), F.lit("")).otherwise(words(c)))


def header_fingerprint(col, limit: int | None = None) -> Column:
    """Normal form of the lines before the first priced product line, in one row expression; ``limit`` compares the first lines alone."""
    lines = F.filter(split_lines(col), lambda s: ~is_separator(s))
    priced = F.transform(lines, lambda s: is_product_line(s) & ~out_of_stock(s))
    first = F.array_position(priced, True)
    head = F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines)
    parts = F.filter(F.transform(head, norm_header_line), lambda s: s != "")
    return F.array_join(parts if limit is None else F.slice(parts, 1, limit), " | ")
