"""Line shapes: lines that differ in their closing price alone are read once.

A shape is the line with the digits of its closing amount evened out.  Only an amount at the end of the line counts, behind a dash and before
flags at most, and only where no rule takes it for anything but a price: no word of a catalogue name, beside words of watches no case size and no year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, spread_work
from . import patterns as P, vocab as V
from .lines import rx
from .text import _c, fold_confusables, let, norm_key

_TAIL = r"(?s)^(.*?\S [—–-] )(" + P.PLAIN_AMOUNT + "|" + P.GROUPED_AMOUNT + r")((?: ?" + P.FLAG + ")*)$"
# Amounts that a watch rule may read a case size or a year from, and the words without which no such rule runs.
_WATCH_NUMBER = r"^(?:3[89]|4\d) |20\d\d"
_WATCH_WORD = r"watch|часы|ultra|series|mm|\baw\b|\bse[23]?\b|\bu\d{1,2}\b"
# The words without which no line is a laptop's.
_LAPTOP_WORD = P.I + r"\b(?:i[3579]|ryzen|celeron|pentium|athlon|xeon|m\s*\d)"
# The same before Cyrillic letters are folded.
_LAPTOP_UNFOLDED = _LAPTOP_WORD.partition(":")[0] + ":" + "".join(
    f"[{c}{''.join(f for f, t in zip(V.CONFUSABLE_FROM, V.CONFUSABLE_TO) if t.lower() == c)}]" if c.isalpha() and before != "\\" else c
    for before, c in zip(":" + _LAPTOP_WORD.partition(":")[2], _LAPTOP_WORD.partition(":")[2]))
# A word that stays a word in every reading, so that the line is more than numbers.
_WORD = r"(?:^| )[A-Za-zА-Яа-яЁё]{3,} "
# Beside such words amounts keep their form: these stay whole, of others the digits are evened out.
_WHOLE = r"20\d\d| (?:064|128|256|512)$"
_KEPT_GROUP = r"^(?:3[89]|4\d|50|64|128|256|512) "
# A diagonal is looked for at the front of every number.
_DIAGONAL = r"(?:^| )(?:[7-9]|1[0-8])"


def names_watch(text: Column) -> Column:
    """Whether a rule for watches may run on a text."""
    return rx(norm_key(text), _WATCH_WORD) | rx(norm_key(fold_confusables(text)), _WATCH_WORD) | rx(text, r"(?i)\bse\b")


def _says_laptop(text: Column) -> Column:
    """Whether a word of laptops stands in a text.  In most texts plain looks find no part of one."""
    parts = rx(text, "[iImM][ \\t\\n\\x0B\\f\\r]*[0-9]")
    for word in ("ryzen", "celeron", "pentium", "athlon", "xeon"):
        parts = parts | F.contains(F.lower(text), F.lit(word))
    latin = F.octet_length(text) == F.length(text)
    return F.when(latin & ~parts, False).otherwise(rx(text, _LAPTOP_UNFOLDED))


def line_shape(col, taken: Column | None = None, regions: bool = True, diagonals: bool = False, context: Column | None = None) -> Column:
    """The line with an even closing amount.

    ``taken`` holds the numbers catalogue names use (see ``numbers_of``): an amount that reads like one stays.  ``regions=False`` evens the flags out
    too, ``diagonals=True`` keeps apart what a laptop rule tells apart, ``context`` is text that is read together with the line.
    Most lines have no closing amount, or one that no rule could mistake; a few looks tell so, the others are taken apart.
    """
    t = _c(col)
    tail = F.substring_index(t, " - ", -1)
    n = F.length(t) - F.length(tail)
    head = F.left(t, n)
    said = head if context is None else F.concat_ws(" ", context, head)
    closed = rx(tail, P.CLOSING)
    amount = F.regexp_extract(tail, "^[0-9]+(?: [0-9]+)?", 0)
    one = F.when(F.contains(amount, F.lit(" ")) & ~rx(head, _WORD), F.lit("77 777")).otherwise(F.lit("77777"))
    plain = closed & (n > 3) & rx(F.substring(t, n - 3, 1), r"\S") & (~rx(tail, _WATCH_NUMBER) | ~names_watch(said))
    if diagonals:
        plain = plain & ~_says_laptop(said)
    if taken is not None:
        words = F.concat(F.split(amount, " "), F.split(one, " "), F.array(F.concat(F.lit("L"), F.length(amount).cast("string")), F.lit("L5")))
        plain = plain & ((F.size(taken) == 0) | ~F.arrays_overlap(words, taken))
    flags = F.regexp_replace(tail, "^[0-9]+(?: [0-9]+)?", "") if regions else F.lit("")
    open_ = ~closed & ~F.contains(t, F.lit("—")) & ~F.contains(t, F.lit("–"))
    return F.when(plain, F.concat(head, one, flags)).when(open_, t).otherwise(careful_shape(t, taken, regions, diagonals, context))


def careful_shape(t: Column, taken: Column | None = None, regions: bool = True, diagonals: bool = False, context: Column | None = None) -> Column:
    """``line_shape`` of any line."""
    def said(z):
        return z["head"] if context is None else F.concat_ws(" ", context, z["head"])

    def free(words):
        return F.lit(True) if taken is None else ~F.arrays_overlap(words, taken)

    def length(c):
        return F.array(F.concat(F.lit("L"), F.length(c).cast("string")))

    def with_form(z):
        amount, flags = z["amount"], z["flags"]
        seven, five = (F.translate(amount, "0123456789", d * 10) for d in "75")
        digits = F.when(rx(amount, _DIAGONAL), seven).otherwise(five) if diagonals else seven
        digits = F.when(rx(amount, _KEPT_GROUP), F.concat(F.substring_index(amount, " ", 1), F.lit(" "), F.substring_index(digits, " ", -1))).otherwise(digits)
        words = F.flatten(F.array(F.split(amount, " "), F.split(digits, " "), length(amount)))
        digits = F.when(~rx(amount, _WHOLE) & free(words), digits).otherwise(amount)
        return F.concat(z["head"], digits, flags if regions else F.when(flags != "", F.lit(" 🇺🇸")).otherwise(F.lit("")))

    def even(z):
        amount = z["amount"]
        read = rx(amount, _WATCH_NUMBER) & names_watch(said(z))
        if diagonals:
            read = read | rx(fold_confusables(said(z)), _LAPTOP_WORD)
        # Without words a grouped amount is two more numbers, which counts.
        one = F.when(F.contains(amount, F.lit(" ")) & ~rx(z["head"], _WORD), F.lit("77 777")).otherwise(F.lit("77777"))
        words = F.flatten(F.array(F.split(amount, " "), F.split(one, " "), length(amount), F.array(F.lit("L5"))))
        return F.when(~read & free(words), F.concat(z["head"], one, z["flags"] if regions else F.lit(""))).otherwise(with_form(z))

    parts = F.struct(*[F.regexp_extract(t, _TAIL, i).alias(n) for i, n in ((1, "head"), (2, "amount"), (3, "flags"))])
    return let(parts, lambda z: F.when(z["amount"] != "", even(z)).otherwise(t))


def numbers_of(index: DataFrame, key: str = "alias_key") -> DataFrame:
    """One row: the numbers inside the names of an index; of long ones only their length, so the list is short whatever the catalogue."""
    token = F.explode(F.split(key, " ")).alias("t")
    marks = index.select(token).filter(rx("t", r"^\d{2,6}$")).select(F.when(F.length("t") > 3, F.concat(F.lit("L"), F.length("t").cast("string"))).otherwise(F.col("t")).alias("t"))
    return marks.agg(F.collect_set("t").alias("_taken"))


def once_for_each(df: DataFrame, keys: dict[str, Column], fn) -> DataFrame:
    """Rows with the columns ``fn`` adds to the distinct values of ``keys``; ``fn`` gets one row for each of them."""
    keyed = df.withColumns(keys)
    # written once, so that no later filter computes the columns again
    done = cut_lineage(fn(spread_work(keyed.select(*keys).distinct())))
    added = [c for c in done.columns if c not in keys]
    done = done.select(*[F.col(k).alias("_d" + k) for k in keys], *added)
    on = [F.col(k).eqNullSafe(F.col("_d" + k)) for k in keys]
    return keyed.join(done, on, "left").drop(*keys, *["_d" + k for k in keys])
