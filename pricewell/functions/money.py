"""Price extraction, coercion and mark-up as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import patterns as P
from . import vocab as V
from .lines import rx
from .text import _c


def _digits(col) -> Column:
    return F.regexp_replace(col, r"[^0-9]", "").try_cast("bigint")


def _is_amount(tok: Column) -> Column:
    """1 000 to 1 000 000, not a year, not a ``17 256`` model and memory pair."""
    memory_pair = rx(tok, r"^(?:[1-9]|[12]\d|30)[ .,_](?:064|128|256|512)$")
    return ~rx(tok, r"^20\d{2}$") & ~memory_pair & F.coalesce(_digits(tok).between(1000, 1000000), F.lit(False))


def extract_price(col) -> Column:
    """Last amount of the line, else a trailing `` - 15`` read as thousands.  Most lines close with their amount, which one look tells."""
    c = _c(col)
    tail = F.substring_index(c, " - ", -1)
    return F.when(rx(tail, P.CLOSING), _digits(tail)).otherwise(_any_price(c))


def _any_price(c: Column) -> Column:
    # "17 256 84 500" is a memory pair followed by a price, not one long number
    c = F.regexp_replace(c, r"(?<!\d)([1-9]|[12]\d|30) (128|256|512) (?=\d{2,3} \d{3}(?!\d))", "$1 $2GB ")
    amounts = F.filter(F.regexp_extract_all(c, F.lit(P.MONEY), F.lit(1)), _is_amount)
    short = F.regexp_extract(c, r"(?:^|\s)[—–-]\s*(\d{1,3})\s*$", 1).try_cast("bigint")
    return F.coalesce(
        _digits(F.try_element_at(amounts, F.lit(-1))),
        F.when(short.between(10, 999) & ~rx(c, P.CURRENCY), short * 1000),
    )


def first_int(col) -> Column:
    """First grouped integer in a text."""
    return _digits(F.regexp_extract(F.translate(_c(col), "\u00a0", " "), r"(\d{1,3}(?: ?\d{3})+|\d{4,})", 1))


def whole_int(col) -> Column:
    """First integer with all its digits, also when their number is no multiple of three."""
    return _digits(F.regexp_extract(F.translate(_c(col), "\u00a0", " "), r"(\d{1,3}(?: ?\d{3})+(?!\d)|\d{4,})", 1))


def coerce_price(*cols) -> Column:
    """First value that reads as a number once currency words and spaces are gone."""

    def one(col):
        c = F.regexp_replace(F.lower(_c(col).cast("string")), r"₽|руб|р\.|rub|rur|\$|usd|€|eur", " ")
        c = F.translate(F.regexp_replace(c, r"[^0-9.,]", ""), ",", ".")
        return F.nullif(c, F.lit("")).try_cast("double")

    return F.coalesce(*[one(c) for c in cols])


def round_half_even(col) -> Column:
    return F.bround(_c(col), 0).cast("bigint")


def _bands(price: Column, bands, top, inclusive: bool) -> Column:
    test = (lambda e: price <= e) if inclusive else (lambda e: price < e)
    start = F.when(test(F.lit(bands[0][0])), F.lit(bands[0][1]))
    return reduce(lambda acc, b: acc.when(test(F.lit(b[0])), F.lit(b[1])), bands[1:], start).otherwise(F.lit(top))


def retail_margin(cost) -> Column:
    return _bands(_c(cost).cast("double"), V.RETAIL_MARGIN_BANDS, V.RETAIL_MARGIN_DEFAULT, True)


def price_min(cost) -> Column:
    return round_half_even(_c(cost).cast("double"))


def price_opt(cost) -> Column:
    return price_min(cost) + V.WHOLESALE_ADD


def price_retail(cost) -> Column:
    return F.ceil(_c(cost).cast("double") * (F.lit(1.0) + retail_margin(cost)))


def wholesale_step(price) -> Column:
    return _bands(_c(price), V.WHOLESALE_STEPS, V.WHOLESALE_STEP_TOP, False)


def retail_step(price) -> Column:
    return _bands(_c(price), V.RETAIL_STEPS, V.RETAIL_STEP_TOP, True)


def round_up(price, step) -> Column:
    """Up to the next multiple of ``step``."""
    p, s = _c(price), _c(step)
    return (F.floor((p + s - 1) / s) * s).cast("bigint")


def channel_price(price, mode, *, pct=None, flat=None, step=None, absolute=None) -> Column:
    """Band step, then percent, then flat amount, then rounding up.

    ``mode`` is 'opt' or 'retail'; an ``absolute`` base skips the band step.
    """
    base = _c(price).cast("double")
    zero = F.lit(0.0)
    stepped = base + F.when(F.lower(_c(mode)) == "opt", wholesale_step(base)).otherwise(retail_step(base))
    p = stepped if absolute is None else F.when(F.coalesce(_c(absolute), F.lit(False)), base).otherwise(stepped)
    p = p * (F.lit(1.0) + (zero if pct is None else F.coalesce(_c(pct).cast("double"), zero)))
    p = p + (zero if flat is None else F.coalesce(_c(flat).cast("double"), zero))
    plain = round_half_even(p)
    if step is None:
        return plain
    s = _c(step)
    return F.when(s > 0, round_up(p, s)).otherwise(plain)


def answer_price(price, bands=None, top=None) -> Column:
    """Mark-up of an answer to a buyer; the bands are job parameters."""
    p = _c(price).cast("bigint")
    add = _bands(p, bands or V.WHOLESALE_STEPS, V.WHOLESALE_STEP_TOP if top is None else top, False)
    return F.when(p > 0, p + add).otherwise(p)
