"""String normalisation as column expressions.

Everything stays in the JVM except :func:`nfkc`, for which Spark has no
built-in; it is an Arrow-batched Pandas UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from . import patterns as P
from . import vocab as V


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lit_array(values) -> Column:
    """A constant array column; one foldable literal however long the list is."""
    values = list(values)
    kind = "int" if isinstance(values[0], int) else "string"
    return F.split(F.lit("\u0001".join(str(v) for v in values)), "\u0001").cast(f"array<{kind}>")


def lit_map(pairs: dict) -> Column:
    """A constant string map, also one foldable literal."""
    return F.str_to_map(
        F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in pairs.items())), F.lit("\u0001"), F.lit("\u0002")
    )


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` mentions it."""
    return F.transform(F.array(value), lambda x: fn(x)).getItem(0)


def null_if_empty(col) -> Column:
    """Absent values have one form: NULL."""
    return F.nullif(F.trim(_c(col)), F.lit(""))


def fold_confusables(col) -> Column:
    """Cyrillic letters that look like Latin ones become Latin."""
    return F.translate(_c(col), V.CONFUSABLE_FROM, V.CONFUSABLE_TO)


def clean_spaces(col) -> Column:
    return F.trim(F.regexp_replace(_c(col), r"(?U)\s+", " "))


def clean_text(col) -> Column:
    """Folding, one dash, spaced pipes, single spaces."""
    c = F.translate(_c(col), V.CONFUSABLE_FROM + "\u00a0", V.CONFUSABLE_TO + " ")
    c = F.regexp_replace(c, "[–—]+", "-")
    c = F.regexp_replace(c, "[|•]+", " | ")
    return clean_spaces(c)


def strip_flags(col) -> Column:
    return F.trim(F.regexp_replace(_c(col), P.FLAG, " "))


def flags_of(col) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(P.FLAG), F.lit(0))


def flag_suffix(col) -> Column:
    """Distinct flags in order of appearance, glued together."""
    return F.array_join(F.array_distinct(flags_of(col)), "")


def strip_emoji(col) -> Column:
    """Drop pictographs and joiners but keep flag pairs; one pass."""
    c = F.regexp_replace(_c(col), "(" + P.FLAG + ")|" + P.EMOJI, "$1")
    return F.regexp_replace(c, r"[\x{200D}\x{FE0F}]", "")


def norm_key(col) -> Column:
    """Lower case; '/', '-', '_' and flags become spaces; letters and digits stay."""
    c = F.lower(F.trim(_c(col)))
    c = F.regexp_replace(c, r"(?U)(?:[\s\-_/]|" + P.FLAG + ")+", " ")
    return F.trim(F.regexp_replace(c, "[^a-z0-9а-яё ]+", ""))


def alias_key(col) -> Column:
    return norm_key(F.regexp_replace(_c(col), r"\+", " plus "))


def tokens(col) -> Column:
    """Non-empty tokens of the normal key."""
    return F.array_remove(F.split(norm_key(col), " +"), "")


def consume(col, regex: str) -> Column:
    """Blank out what the pattern matched so that later extractors cannot reuse it."""
    return clean_spaces(F.regexp_replace(_c(col), regex, " "))


def phrase_pattern(col) -> Column:
    """A token-safe pattern column from a dictionary key; ``. _ -`` equal a space."""
    quoted = F.regexp_replace(F.lower(F.trim(_c(col))), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.concat(
        F.lit("(?i)(?<![a-z0-9])"), F.regexp_replace(quoted, " +", r"[\\s._-]+"), F.lit("(?![a-z0-9])")
    )


def starts_with_tokens(prefix, full) -> Column:
    p, f = norm_key(prefix), norm_key(full)
    return (p != "") & ((f == p) | F.startswith(f, F.concat(p, F.lit(" "))))


def title_key(col) -> Column:
    c = F.lower(F.trim(F.translate(_c(col), "\u00a0", " ")))
    return F.regexp_replace(c, " {2,}", " ")


def strip_ram(col) -> Column:
    """``12/256gb`` -> ``256gb``."""
    return F.regexp_replace(_c(col), r"\b\d{1,2}\s*/\s*(\d{2,4}\s*(?:gb|tb))\b", "$1")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(col) -> Column:
    """NFKC; text that is plain ASCII skips the Python round trip's effect anyway."""
    return _nfkc(_c(col))


def clean_query(col, *, normalise: bool = True) -> Column:
    """Buyer text without intent words, politeness, arrow prices, emoji and end marks."""
    c = nfkc(col) if normalise else _c(col)
    c = F.array_join(
        F.transform(F.split(c, P.LINE_BREAK), lambda s: F.regexp_replace(s, P.ARROW_PRICE, "")), "\n"
    )
    c = F.regexp_replace(c, P.BUY, " ")
    c = F.regexp_replace(c, P.POLITE, " ")
    c = F.regexp_replace(c, r"[\x{1F300}-\x{1FAFF}]+", " ")
    c = F.regexp_replace(c, "[?!.…]+$", "")
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, "\n{2,}", "\n")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def query_lines(col, *, normalise: bool = True) -> Column:
    """Cleaned candidate lines of a buyer text; the whole text if no line is left.

    NFKC is applied once to the whole text, so the lines themselves stay in the JVM.
    """
    whole = nfkc(col) if normalise else _c(col)
    parts = F.transform(
        F.split(whole, P.LINE_BREAK),
        lambda s: clean_query(F.regexp_replace(F.trim(s), r"(?U)^[\s*•\-–—]+", ""), normalise=False),
    )
    kept = F.filter(parts, lambda s: s != "")
    rest = clean_query(whole, normalise=False)
    return F.when(F.size(kept) > 0, kept).when(rest != "", F.array(rest)).otherwise(
        F.array().cast("array<string>")
    )


def clean_sheet_name(col) -> Column:
    """A price-sheet name without category and brand prefix, noise brackets and odd units."""
    c = F.trim(F.translate(_c(col), "\u00a0", " "))
    c = F.regexp_replace(c, r"(?iu)^\s*(смартфон|телефон|планшет|ноутбук|часы|watch)\s+", "")
    c = F.regexp_replace(c, r"(?i)^\s*apple\s+", "")
    brackets = F.regexp_extract_all(c, F.lit(r"\([^)]{1,80}\)"), F.lit(0))
    noise = lit_array(V.SHEET_NOISE_WORDS)
    c = F.aggregate(
        F.filter(
            brackets,
            lambda b: F.arrays_overlap(F.split(F.trim(F.regexp_replace(F.lower(b), "[^a-zа-я0-9]+", " ")), " +"), noise),
        ),
        c,
        lambda acc, b: F.replace(acc, b, F.lit(" ")),
    )
    c = F.regexp_replace(c, r"(?iU)\b(\d+)\s*g(?:b)?\b", "$1GB")
    c = F.regexp_replace(c, "[—–]", "-")
    titan = F.regexp_replace(
        F.regexp_replace(c, r"(?i)\b(desert|natural|black|white)\s+titanium\b", "$1"), r"(?i)\btitanium\b", " "
    )
    return clean_spaces(F.when(F.rlike(c, F.lit(r"(?i)\biphone\b")), titan).otherwise(c))


def fmt_price(col) -> Column:
    """``12 345``; half-even; a dash when there is no price."""
    return F.coalesce(F.translate(F.format_number(F.bround(_c(col).cast("double"), 0), 0), ",", " "), F.lit("—"))


def post_titles(col) -> Column:
    """Titles of a post: every bold span, else its first line without tags."""
    text = _c(col)
    tagless = lambda s: clean_spaces(F.regexp_replace(s, "<[^>]+>", ""))
    bold = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit("(?is)<b>(.*?)</b>"), F.lit(1)), tagless), lambda s: s != ""
    )
    first = tagless(F.element_at(F.split(F.trim(text), P.LINE_BREAK), 1))
    return F.when(F.size(bold) > 0, bold).when(first != "", F.array(first)).otherwise(F.array().cast("array<string>"))


def norm_chat_id(col) -> Column:
    """Chat ids with and without the ``-100`` prefix compare equal."""
    digits = F.abs(_c(col).cast("bigint")).cast("string")
    return F.when(
        (F.length(digits) > 10) & F.startswith(digits, F.lit("100")), F.substring(digits, 4, 40)
    ).otherwise(digits).cast("bigint")


def match_tokens(col) -> Column:
    """Tokens a line is compared with the alias index by.

    The trailing currency and one trailing price go, glued family+number tokens
    are split, years and SKU-like tokens go.
    """
    plus = F.regexp_replace(clean_text(col), r"\+", " plus ")
    key = F.regexp_replace(norm_key(plus), r"( (rub|rur|руб|р|pyb))+$", "")
    # a trailing price, but not a year
    key = F.regexp_replace(key, r"(?:^| )(?!20\d{2}$)([1-9]\d{3,5}|1000000)$", "")
    split_glued = F.regexp_replace(key, r"\bmi\b", "xiaomi")
    split_glued = F.regexp_replace(split_glued, r"(?<![^ ])(s\d{2})(fe)(?![^ ])", "$1 $2")
    split_glued = F.regexp_replace(
        split_glued, r"(?<![^ ])(ipad|pad|note|pixel|iphone|redmi|galaxy)(\d+)([a-z]+)?(?![^ ])", "$1 $2 $3"
    )
    split_glued = F.regexp_replace(split_glued, r"(?<![^ ])([a-z]*\d+)promax(?![^ ])", "$1 pro max")
    split_glued = F.regexp_replace(split_glued, r"(?<![^ ])(\d+)proxl(?![^ ])", "$1 pro xl")
    split_glued = F.regexp_replace(split_glued, r"(?<![^ ])se([23])(?![^ ])", "se $1")
    split_glued = F.regexp_replace(
        split_glued, r"(?<![^ ])([a-z]*\d+)(pro|plus|max|ultra|mini|lite)(?![^ ])", "$1 $2"
    )
    return F.filter(
        F.split(split_glued, " +"), lambda t: (t != "") & ~F.rlike(t, F.lit(r"^20\d{2}$")) & ~looks_like_sku(t)
    )


def looks_like_sku(tok) -> Column:
    """4-7 characters with letters and digits that are not a family or chip name."""
    t = _c(tok)
    return (
        F.length(t).between(4, 7)
        & F.rlike(t, F.lit("[a-zA-Z]"))
        & F.rlike(t, F.lit("[0-9]"))
        & ~F.rlike(t, F.lit(r"(?i)^(?:(?:fold|flip)\d{1,2}|m\d{1,2}|a\d{1,2}|v\d{1,2}s?)$"))
    )


def title_head(col) -> Column:
    """What stands before the price of an accessory line, as a normal key."""
    return let(F.split(clean_spaces(col), r"\s+[—–-]\s+"), _title_head)


def _title_head(segs: Column) -> Column:
    last = F.translate(F.element_at(segs, -1), " _,.", "")
    priced = F.rlike(last, F.lit(r"^\d+$")) & F.coalesce(
        F.try_to_number(last, F.lit("999999999999")).between(1000, 1000000), F.lit(False)
    )
    head = F.array_join(F.when(priced, F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))).otherwise(segs), " ")
    head = F.trim(F.regexp_replace(head, r"(?<!\d)(\d{4,7})(?!\d)\s*$", " "))
    return norm_key(F.regexp_replace(clean_text(head), r"(?i)\baw\b", "apple watch"))
