"""Typed product attributes of a line as column expressions.

``attribute_columns`` assembles them; the context (category, brand, series,
model) is optional, so the same expressions serve catalogue titles, offers,
sheet names and buyer queries.
"""

from __future__ import annotations

import json
from functools import lru_cache, reduce

from pyspark.sql import Column, functions as F

from ..session import built_once
from . import patterns as P
from . import vocab as V
from .lines import rx
from .money import extract_price
from .text import (
    _c, clean_spaces, clean_text, consume, flags_of, fold_confusables, let, lit_array, lit_map, norm_key, null_if_empty, strip_flags,
    tokens,
)


def _ordered(rules, otherwise=None) -> Column:
    """CASE over (condition, value) pairs, first hit wins."""
    case = reduce(lambda acc, r: acc.when(r[0], r[1]) if acc is not None else F.when(r[0], r[1]), rules, None)
    return case if otherwise is None else case.otherwise(otherwise)


def _group(col, pattern: str, idx: int = 1) -> Column:
    return F.nullif(F.regexp_extract(_c(col), pattern, idx), F.lit(""))


def category_key(col) -> Column:
    """One key for every spelling of a category; unknown ones stay as they are."""
    low = F.lower(F.trim(_c(col)))
    mapping = lit_map(V.CATEGORY_KEYS)
    return F.coalesce(F.try_element_at(mapping, low), null_if_empty(low))


# ------------------------------------------------------------------ storage
def storage_ram(col) -> Column:
    """struct(storage, ram).

    Order: ``8/256`` forms (best by: has RAM, has unit, size), sizes with a unit
    (largest is storage, smallest plausible other is RAM), a bare storage size.
    A bare RAM number counts beside storage only inside brackets, so a model
    generation is not taken for RAM.
    """
    return let(clean_text(col), lambda s: let(_memory_parts(s), lambda m: F.struct(
        m["storage"].alias("storage"),
        F.when(m["slash"].isNotNull(), m["slash_ram"]).otherwise(
            F.coalesce(m["ram"], F.when(m["storage"].isNotNull(), _bracket_ram(s)))
        ).alias("ram"),
    )))


def _slash_best(s: Column) -> Column:
    """struct(has_ram, has_unit, size, storage, ram) of the best ``8/256`` form, NULL if none."""
    ram_ok, gb_ok = lit_array(V.RAM_SIZES), lit_array(V.STORAGE_SIZES_GB)

    def parse(m):
        a = F.regexp_extract(m, r"^(\d+)", 1).cast("int")
        b = F.regexp_extract(m, r"/\s*(\d+)", 1).cast("int")
        return let(F.struct(a.alias("a"), b.alias("b"), F.lower(F.regexp_extract(m, r"(?iu)([a-zа-я]+)$", 1)).alias("u")), lambda x: F.struct(
            F.array_contains(ram_ok, x["a"]).cast("int").alias("has_ram"),
            (x["u"] != "").cast("int").alias("has_unit"),
            x["b"].alias("size"),
            F.when(x["u"].isin("tb", "тб"), F.concat(x["b"].cast("string"), F.lit("TB")))
            .when(F.array_contains(gb_ok, x["b"]), F.concat(x["b"].cast("string"), F.lit("GB"))).alias("storage"),
            F.when(F.array_contains(ram_ok, x["a"]), x["a"]).alias("ram"),
        ))

    found = F.concat(
        F.regexp_extract_all(s, F.lit(P.MEM_SLASH_BARE), F.lit(0)), F.regexp_extract_all(s, F.lit(P.MEM_SLASH), F.lit(0))
    )
    best = F.array_max(F.filter(F.transform(found, lambda m: parse(m)), lambda x: x["storage"].isNotNull()))
    return F.when(F.contains(s, F.lit("/")), best)


def _explicit_sizes(s: Column) -> Column:
    """array<struct(n, tb)> of sizes with a unit; 4G and 5G are networks."""
    return F.transform(
        F.filter(
            F.regexp_extract_all(s, F.lit(P.MEM_EXPLICIT), F.lit(0)), lambda m: ~rx(m, "(?i)^[45]g$")
        ),
        lambda m: F.struct(F.regexp_extract(m, r"^(\d+)", 1).cast("int").alias("n"), rx(m, "(?iu)(tb|тб)$").alias("tb")),
    )


def _memory_parts(s: Column) -> Column:
    """struct(storage, slash, slash_ram, ram) of a clean text."""
    ram_ok, gb_ok = lit_array(V.RAM_SIZES), lit_array(V.STORAGE_SIZES_GB)

    def parts(x):
        best, explicit = x["best"], x["explicit"]
        top = F.array_max(F.transform(
            F.filter(explicit, lambda e: e["tb"] | F.array_contains(gb_ok, e["n"])),
            lambda e: F.struct(
                F.when(e["tb"], e["n"] * 1024).otherwise(e["n"]).alias("gb"),
                F.concat(e["n"].cast("string"), F.when(e["tb"], F.lit("TB")).otherwise(F.lit("GB"))).alias("storage"),
            ),
        ))
        other = F.array_min(F.transform(
            F.filter(explicit, lambda e: ~e["tb"] & F.array_contains(ram_ok, e["n"]) & ~F.array_contains(gb_ok, e["n"])),
            lambda e: e["n"],
        ))
        bare = F.concat(_group(s, P.MEM_BARE), F.lit("GB"))
        storage = F.coalesce(best["storage"], top["storage"], F.when(F.size(explicit) == 0, bare))
        return F.struct(
            let(storage, canon_storage).alias("storage"), best["storage"].alias("slash"), best["ram"].alias("slash_ram"),
            F.when(F.size(explicit) >= 2, other).alias("ram"),
        )

    return let(F.struct(_slash_best(s).alias("best"), _explicit_sizes(s).alias("explicit")), parts)


def _bracket_ram(s: Column) -> Column:
    """A plausible RAM number without unit inside brackets."""
    ram_ok, gb_ok = lit_array(V.RAM_SIZES), lit_array(V.STORAGE_SIZES_GB)
    inside = F.regexp_extract(s, r"\(([^)]*)\)", 1)
    numbers = F.regexp_extract_all(
        inside, F.lit(r"(?<![\p{L}\p{N}])(\d{1,3})(?![\p{L}\p{N}])(?!\s*(?:gb|tb|sim|esim))"), F.lit(1)
    )
    return F.array_min(F.filter(
        F.transform(numbers, lambda t: t.cast("int")),
        lambda n: (n >= 4) & F.array_contains(ram_ok, n) & ~F.array_contains(gb_ok, n),
    ))


def canon_storage(col) -> Column:
    """``1024GB`` and ``1TB`` are the same size."""
    s = F.regexp_replace(F.upper(F.trim(_c(col))), r"^0*(\d+)\s*(GB|TB)$", "$1$2")
    for gb, tb in ((1024, 1), (2048, 2)):
        s = F.when(s == f"{gb}GB", F.lit(f"{tb}TB")).otherwise(s)
    return s


# ------------------------------------------------------------------- colours
def _color_key(phrase: str) -> str:
    import re

    folded = phrase.translate(str.maketrans(V.CONFUSABLE_FROM, V.CONFUSABLE_TO)).lower()
    folded = re.sub(r"[\s\-_/]+", " ", folded)
    return re.sub("[^a-z0-9а-яё ]+", "", folded).strip()


def default_color_phrases() -> list[tuple[str, str]]:
    """(phrase, colour) pairs: other words first, then the colours by their own names."""
    return [*V.COLOR_OF.items(), *((c, c) for c in V.COLORS)]


@lru_cache(maxsize=8)
def _color_table(phrases: tuple | None):
    """phrase key -> (rank, colour), longest phrase first."""
    pairs = sorted(phrases or default_color_phrases(), key=lambda kv: -len(kv[0]))
    table: dict[str, tuple[int, str]] = {}
    for phrase, color in pairs:
        key = _color_key(phrase)
        if key:
            table.setdefault(key, (len(table), color))
    return table


@lru_cache(maxsize=8)
def _color_alternation(keys: tuple) -> str:
    """All phrases as one pattern that shares their beginnings and takes the longest."""
    root: dict = {}
    for key in keys:
        node = root
        for ch in key:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [(r"[\s\-_/]+" if ch == " " else ch) + pattern(sub) for ch, sub in node.items() if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + "?" if "" in node else body

    return pattern(root)


def colors_of(col, limit: int | None = None, phrases: tuple | None = None) -> Column:
    """Distinct colours of a text, longest phrase first.

    One look-ahead alternation finds the longest phrase starting at every token;
    shorter phrases that begin the same way come from the constant table.
    """
    table = _color_table(phrases)
    sep = r"[\s\-_/]+"
    longest_first = sorted(table, key=len, reverse=True)
    alternation = _color_alternation(tuple(table))
    pattern = r"(?iu)(?<![\p{L}\p{N}_])(?=((?:" + alternation + r")(?![\p{L}\p{N}_])))"
    entries = {}
    for key in longest_first:
        words = key.split(" ")
        hits = [table[p] for n in range(len(words), 0, -1) if (p := " ".join(words[:n])) in table]
        entries[key] = [{"rank": rank, "color": color} for rank, color in hits]
    lookup = F.from_json(
        F.lit(json.dumps(entries, ensure_ascii=False)), "map<string,array<struct<rank:int,color:string>>>"
    )
    found = F.regexp_extract_all(clean_text(col), F.lit(pattern), F.lit(1))
    keys = F.transform(found, lambda m: F.regexp_replace(F.lower(m), sep, " "))
    ranked = F.array_sort(F.flatten(F.transform(keys, lambda k: F.try_element_at(lookup, k))))
    found = F.array_distinct(F.transform(ranked, lambda x: x["color"]))
    return found if limit is None else F.slice(found, 1, limit)


def line_colors(col, phrases: tuple | None = None) -> Column:
    """A ``Titanium X`` compound alone, else all colours of the line."""
    tail = F.lower(F.regexp_extract(
        clean_text(col), r"(?iU)\btitanium\s+(black|gray|grey|violet|yellow|blue|white|green|orange|red)\b", 1
    ))
    name = F.initcap(F.when(tail == "grey", F.lit("gray")).otherwise(tail))
    return F.when(tail != "", F.array(F.concat(F.lit("Titanium "), name))).otherwise(colors_of(col, phrases=phrases))


def canon_color(col) -> Column:
    """Lower-case colour family name used to compare colours."""
    low = clean_spaces(F.translate(F.lower(F.trim(_c(col))), "-", " "))
    synonyms = {k.lower(): v.lower() for k, v in default_color_phrases() if k.lower() != v.lower()}
    syn = lit_map(synonyms)
    canon = lit_map(V.COLOR_CANON)
    base = F.coalesce(F.try_element_at(syn, low), low)
    return F.coalesce(F.try_element_at(canon, base), base)


def color_families(colors: Column) -> Column:
    """Family ids the canonical colours of an array belong to."""
    member: dict[str, list[str]] = {}
    for family, words in V.COLOR_FAMILIES.items():
        for w in words:
            member.setdefault(w, []).append(family)
    lookup = F.from_json(F.lit(json.dumps(member)), "map<string,array<string>>")
    return F.array_distinct(F.flatten(F.transform(colors, lambda c: F.coalesce(
        F.try_element_at(lookup, c), F.array().cast("array<string>")))))


# -------------------------------------------------------------------- region
def flagged_region(col) -> Column:
    """Region of the first mapped flag, which mostly is the first flag there is."""
    flag_map, first = lit_map(V.FLAG_REGION), F.regexp_extract(_c(col), P.FLAG, 0)
    mapped = F.filter(F.transform(flags_of(col), lambda f: F.try_element_at(flag_map, f)), lambda r: r.isNotNull())
    return F.when(first != "", F.coalesce(F.try_element_at(flag_map, first), F.try_element_at(mapped, F.lit(1))))


def region_of(col) -> Column:
    """First mapped flag, else the first country whose code is a token of the line."""
    raw = _c(col)
    toks = tokens(clean_text(raw))
    by_word = F.try_element_at(F.array_intersect(lit_array(list(V.REGION_CODES)), toks), F.lit(1))
    return F.coalesce(flagged_region(raw), by_word)


def regions_to_flags(codes: Column) -> Column:
    """Array of region codes -> glued flags."""
    back = {}
    for flag, code in V.FLAG_REGION.items():
        back.setdefault(code, flag)
    lookup = lit_map(back)
    return F.array_join(F.filter(F.transform(codes, lambda c: F.try_element_at(lookup, c)), lambda f: f.isNotNull()), "")


# ----------------------------------------------------------------------- sim
def sim_of(col) -> Column:
    s = clean_spaces(col)
    folded = clean_text(s)
    any_of = lambda p: rx(s, p) | rx(folded, p)
    return _ordered(
        [
            (any_of(P.I + r"\b2\s*[- ]?\s*(sim|сим)\b|\bdual\s*(?:nano[\s\-]*)?sim\b"), F.lit("2sim")),
            (any_of(P.I + r"\bsim\s*\+\s*e\s*[- ]?\s*sim\b"), F.lit("sim+esim")),
            (any_of(P.I + r"\be\s*[- ]?\s*sim\b"), F.lit("esim")),
            (rx(s, P.I + r"\bsim\b"), F.lit("sim+esim")),
        ]
    )


def default_sim(sim, cat, brand, series, model, region) -> Column:
    """Missing SIM type from phone generation and region."""
    ctx = clean_spaces(F.concat_ws(" ", brand, series, model))
    gen = F.coalesce(
        _group(ctx, r"(?i)\b(?:iphone\s*(\d{1,2}))\b").cast("int"),
        _group(ctx, r"(?i)\b(\d{1,2})\s*(?:pro|max|plus|mini|e)\b").cast("int"),
    )
    apple = (norm_key(brand) == "apple") & (
        F.contains(norm_key(F.coalesce(series, F.lit(""))), F.lit("iphone"))
        | F.contains(norm_key(F.coalesce(model, F.lit(""))), F.lit("iphone"))
    )
    reg = F.lower(F.trim(_c(region)))
    reg = _ordered([(reg.isin("cn", "china"), F.lit("ch")), (reg == "hongkong", F.lit("hk")), (reg == "uae", F.lit("ae"))], reg)
    air17 = (gen == 17) & F.contains(norm_key(F.coalesce(model, F.lit(""))), F.lit("air"))
    by_gen = _ordered(
        [
            (air17, F.lit("esim")),
            (gen <= 13, F.lit("sim+esim")),
            ((gen == 17) & reg.isin("us", "jp", "ae", "ca"), F.lit("esim")),
            ((gen == 17) & (reg == "ch"), F.lit("2sim")),
            (gen == 17, F.lit("sim+esim")),
            (reg == "us", F.lit("esim")),
            (reg.isin("ch", "hk"), F.lit("2sim")),
        ],
        F.lit("sim+esim"),
    )
    return F.coalesce(
        _c(sim),
        F.when(F.coalesce(apple, F.lit(False)), by_gen).when(category_key(cat) == "phones", F.lit("sim+esim")),
    )


# ------------------------------------------------------------------- context
def context_flags(raw, cat=None, brand=None, series=None, model=None) -> dict[str, Column]:
    """What kind of device the line and its context speak of."""
    none = F.lit(None).cast("string")
    cat, brand, series, model = [none if x is None else _c(x) for x in (cat, brand, series, model)]
    ctx = clean_spaces(F.concat_ws(" ", cat, brand, series, model, _c(raw)))
    nk = norm_key(ctx)
    ck = category_key(cat)
    has = lambda w: F.contains(nk, F.lit(w))
    return {
        "tablet": has("планшет") | has("tablet") | has("ipad") | rx(ctx, P.TABLET_SIGNAL),
        "watch": ~F.coalesce(ck.isin("phones", "tablets", "laptops"), F.lit(False))
        & (
            has("watch") | has("часы") | rx(nk, P.I + r"\baw\b")
            | (rx(nk, P.I + r"\b(ultra|series|se)\b") & rx(nk, P.I + r"\b(apple)\b"))
            | (rx(nk, P.WATCH_MM_BARE) & rx(nk, P.I + r"\bmm\b"))
        ),
        "earphone": has("airpods") | has("air pods"),
        "apple_device": F.exists(
            lit_array(["macbook", "imac", "mac mini", "macmini", "mac studio", "macstudio", "ipad"]),
            lambda w: F.contains(nk, w),
        ),
    }


def looks_like_laptop(raw) -> Column:
    """A diagonal, RAM and a processor."""
    s = clean_text(raw)
    ram = storage_ram(raw)["ram"].isNotNull()
    cpu = rx(s, P.I + r"\b(i[3579]\s*[- ]?\s*\d{3,5}[a-z]{0,2}|ryzen\s*[3579]\b|celeron|pentium|athlon|xeon)\b") | (
        rx(s, P.I + r"\bm\s*\d{1,2}\b")
        & (
            rx(s, P.I + r"\b(mac|macbook|imac|macmini|mac\s*mini|mac\s*studio)\b")
            | (rx(s, P.I + r"\b(air|pro)\b") & rx(s, r"\b1[3-6]\b"))
            | rx(s, r"\(\s*\d+\s*/\s*\d+\s*\)")
        )
    )
    return ram & cpu & rx(s, r"(?<!\d)(?:[7-9]|1[0-8])(?:[.,]\d)?")


def looks_like_band(raw) -> Column:
    s = clean_text(raw)
    return rx(s, P.I + r"\b(3[8-9]|4[0-9])\s*mm\b") & rx(s, P.BAND_LINE)


# ------------------------------------------------------------ watch and band
def band_type(col) -> Column:
    s = clean_text(col)
    return _ordered([(rx(s, P.I + r"\b(?:" + p + r")\b"), F.lit(name)) for p, name in V.BAND_TYPES])


def band_size(col) -> Column:
    s = F.translate(clean_text(col), "\\", "/")
    hit = F.upper(F.coalesce(_group(s, P.BAND_SIZE, 1), _group(s, P.BAND_SIZE, 2)))
    glued = F.upper(_group(s, P.BAND_SIZE_GLUED))
    return F.when(hit.isNotNull(), F.when(hit.isin("S/M", "M/L", "S", "M", "L"), hit)).otherwise(
        F.when(~rx(s, P.WATCH_MODEL_CODE), _ordered([(glued == "SM", F.lit("S/M")), (glued == "ML", F.lit("M/L"))]))
    )


def _first_color(text: Column, phrases) -> Column:
    return F.try_element_at(colors_of(text, 5, phrases), F.lit(1))


def _head_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, " +"), 1, n), " ")


def _last_words(text: Column, n: int) -> Column:
    w = F.split(text, " +")
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.lit(n)), " ")


def band_color(col, phrases: tuple | None = None) -> Column:
    """Colour of the band: behind the band word, else in front of it."""
    s = clean_text(col)
    anchor = P.I + r"\b(?:" + V.BAND_ANCHOR + r")\b"
    word = F.lower(F.regexp_extract(s, anchor, 0))
    tail = F.regexp_extract(s, P.I + r"^.*?\b(?:" + V.BAND_ANCHOR + r")\b(.*)$", 1)
    tail = consume(F.regexp_replace(tail, P.BAND_SIZE, " "), P.BAND_SIZE_GLUED)
    behind = F.coalesce(*[_first_color(_head_words(tail, n), phrases) for n in (3, 2, 1)])
    prefix = F.regexp_extract(s, P.I + r"^(.*?)\b(?:" + V.BAND_ANCHOR + r")\b", 1)
    prefix = consume(F.regexp_replace(prefix, P.I + r"\b(black|natural)\s+titanium\b", " "), P.I + r"\btitanium\b")
    charcoal = F.when(rx(prefix, P.I + r"\bblack\b"), F.lit("Black/Charcoal")).otherwise(F.lit("Charcoal"))
    near = F.coalesce(*[_first_color(_last_words(prefix, n), phrases) for n in (3, 2, 1)])
    return F.when(
        word != "",
        F.coalesce(
            behind,
            F.when(F.contains(word, F.lit("charcoal")), charcoal),
            F.when(~F.lower(near).isin("black titanium", "natural titanium", "natural"), near),
            F.try_element_at(
                F.filter(
                    colors_of(prefix, 5, phrases),
                    lambda c: ~F.lower(c).isin("black titanium", "natural titanium", "natural"),
                ),
                F.lit(-1),
            ),
        ),
    )


def case_color(col, band: Column, phrases: tuple | None = None) -> Column:
    """Colour of a watch case: in front of the band word, the band colour set aside."""
    s = clean_text(col)
    prefix = F.coalesce(_group(s, P.I + r"^(.*?)\b(?:" + V.BAND_ANCHOR + r")\b", 1), s)
    prefix = consume(F.regexp_replace(prefix, P.I + r"\b\d{2,3}\s*mm\b", " "), P.WATCH_MM_BARE)
    key, tail = norm_key(prefix), F.coalesce(norm_key(band), F.lit(""))
    cut = F.when(
        (tail != "") & F.endswith(key, F.concat(F.lit(" "), tail)),
        F.substring(key, F.lit(1), F.length(key) - F.length(tail)),
    ).otherwise(prefix)
    return F.try_element_at(colors_of(cut, 3, phrases), F.lit(1))


# -------------------------------------------------------------------- others
def screen_size(col, watch: Column, cat=None, brand=None, series=None, model=None) -> Column:
    """Millimetres or inches; bare inches only near an Apple tablet or laptop word."""
    s = clean_text(col)
    none = F.lit(None).cast("string")
    ctx = [none if x is None else _c(x) for x in (cat, brand, series, model)]
    nk = norm_key(F.concat_ws(" ", *ctx, _c(col)))
    toks = F.split(nk, " +")
    apple = F.contains(nk, F.lit("apple")) & rx(nk, "ipad|macbook|imac")
    near_words = lit_array(["ipad", "macbook", "air", "pro", "mini"])
    idx = F.sequence(F.lit(1), F.size(toks))
    sizes = F.filter(idx, lambda i: rx(F.element_at(toks, i), "^1[1-7]$"))
    near = F.filter(
        sizes,
        lambda i: F.arrays_overlap(
            F.slice(toks, F.greatest(i - 2, F.lit(1)), F.least(i - 1, F.lit(2)) + F.lit(3)), near_words
        ),
    )
    bare = F.element_at(toks, F.coalesce(F.try_element_at(near, F.lit(1)), F.try_element_at(sizes, F.lit(1))))
    mm = _group(s, P.SIZE_MM)
    return F.when(watch, F.coalesce(mm, _group(s, P.WATCH_MM_BARE))).otherwise(
        F.coalesce(mm, _group(s, P.SIZE_INCH_WORD), F.when(apple, bare))
    )


def connectivity_of(col) -> Column:
    s = clean_text(col)
    return _ordered(
        [
            (rx(s, P.WIFI_CELL) | rx(s, P.CELLULAR), F.lit("Wi-Fi+Cellular")),
            (rx(s, P.WIFI), F.lit("Wi-Fi")),
            (rx(s, P.NET_5G), F.lit("5G")),
            (rx(s, P.NET_4G), F.lit("4G")),
            (rx(s, P.NET_LTE), F.lit("LTE")),
        ]
    )


def drive_of(col) -> Column:
    s = norm_key(col)
    return _ordered(
        [
            (rx(s, P.I + r"\b(disc|disk)\b|\bс\s*дисковод\w*\b"), F.lit("disc")),
            (rx(s, P.I + r"\bdigital\b|\bцифров\w*\b|\bбез\s*дисковод\w*\b"), F.lit("digital")),
        ]
    )


def nano_glass(col) -> Column:
    return rx(col, P.NANO_GLASS) | rx(clean_text(col), P.NANO_GLASS)


def chip_of(col) -> Column:
    s = clean_text(col)
    a, m = _group(s, P.CHIP, 1).cast("int"), _group(s, P.CHIP, 3).cast("int")
    a_suffix, m_suffix = F.initcap(_group(s, P.CHIP, 2)), F.initcap(_group(s, P.CHIP, 4))
    return F.when(a.between(4, 99), F.concat_ws(" ", F.concat(F.lit("A"), a.cast("string")), a_suffix)).when(
        m.between(1, 99), F.concat_ws(" ", F.concat(F.lit("M"), m.cast("string")), m_suffix)
    )


def year_of(col) -> Column:
    return _group(clean_text(col), P.SAFE_YEAR)


def case_type(col) -> Column:
    s = clean_text(col)
    return _ordered(
        [
            (rx(s, P.I + r"\b(usb[\s\-]*c|type[\s\-]*c)\b"), F.lit("usb-c")),
            (rx(s, P.I + r"\b(mag\s*safe|magsafe)\b"), F.lit("magsafe")),
            (rx(s, P.I + r"\b(lightning|lighting)\b"), F.lit("lightning")),
        ]
    )


def sku_of(col) -> Column:
    """Last token that can be a product code; a vendor form only if nothing follows."""
    up = F.upper(fold_confusables(col))
    storage = storage_ram(col)["storage"]
    letters = lambda t: F.length(F.regexp_replace(t, "[^A-Z]", ""))
    digits = lambda t: F.length(F.regexp_replace(t, "[^0-9]", ""))
    found = F.filter(
        F.regexp_extract_all(up, F.lit(P.SKU_TOKEN), F.lit(1)),
        lambda t: F.length(t).between(4, 7)
        & (letters(t) >= 2) & (digits(t) >= 2)
        & ~((F.length(t) == 7) & (digits(t) > 4))
        & ~rx(t, P.SKU_EXCLUDED)
        & ~F.coalesce(t == F.upper(storage), F.lit(False)),
    )
    return F.coalesce(
        F.try_element_at(found, F.lit(-1)), _group(up, P.SKU_VENDOR), _group(up, P.SKU_VENDOR_BARE)
    )


def game_flag(col) -> Column:
    return F.arrays_overlap(tokens(col), lit_array(V.GAME_WORDS)) | rx(col, P.I + r"\bигр\w*\b")


def no_watches_flag(col) -> Column:
    return rx(col, P.I + r"\bбез\s*часов\b")


def serial_of(col) -> Column:
    """Keyed serial, keyed IMEI, a long number, else a mixed code; first line wins in each class."""
    upper = F.transform(
        F.filter(F.transform(F.split(_c(col), P.LINE_BREAK), lambda s: F.trim(s)), lambda s: s != ""), lambda s: F.upper(s)
    )
    n = F.size(upper)
    codes = lambda s: F.regexp_extract_all(s, F.lit("[A-Z0-9]{8,20}"), F.lit(0))
    only = lambda s: F.regexp_replace(s, "[^0-9]", "")
    # each line beside the next one, as the value may stand below its key
    beside = F.arrays_zip(upper.alias("a"), F.slice(upper, F.lit(2), F.greatest(n, F.lit(1))).alias("b"))
    keyed = F.filter(
        F.transform(
            F.filter(beside, lambda z: rx(z["a"], "SERIAL|S/N|S N")),
            lambda z: F.coalesce(
                F.try_element_at(codes(z["a"]), F.lit(-1)),
                F.try_element_at(codes(F.coalesce(z["b"], F.lit(""))), F.lit(-1)),
            ),
        ),
        lambda v: v.isNotNull(),
    )
    imei = F.filter(
        F.transform(F.filter(upper, lambda s: F.contains(s, F.lit("IMEI"))), only), lambda d: F.length(d).between(14, 17)
    )
    long = F.filter(F.transform(upper, only), lambda d: F.length(d) >= 14)
    mixed = F.transform(
        F.filter(upper, lambda s: rx(s, r"\p{N}") & rx(s, r"\p{L}") & (F.length(s) >= 8)),
        lambda s: F.substring(F.regexp_replace(F.replace(s, F.lit("O"), F.lit("0")), "[^A-Z0-9]", ""), 1, 32),
    )
    first = lambda a: F.try_element_at(a, F.lit(1))
    return F.coalesce(first(keyed), F.substring(first(imei), 1, 17), F.substring(first(long), 1, 17), first(mixed))


# ----------------------------------------------------------------- remainder
def model_remainder(col, phrases: tuple | None = None) -> Column:
    """What is left for the model once price, region, SIM, colour and storage are cut off."""
    s = clean_spaces(col)
    amount = (
        r"(?<!\d)(?!(?:[1-9]|[12]\d|30)[ .,_](?:128|256|512)(?!\d))(?:\d{1,3}(?:[ .,_]\d{3})+|\d{4,7})(?!\d)"
    )
    # only the last amount is the price
    s = F.regexp_replace(s, r"(?:\s+[—–-]\s*)?" + amount + "(?!.*" + amount + ")", " ")
    s = consume(s, r"(?iuU)\b(?:rub|rur|руб|р\.?)\b|₽")
    s = strip_flags(s)
    s = consume(s, r"(?iuU)(?:^|(?<=[\s(\[{,;:/-]))(?:eu|uk|ru|by|ua|kz|us|ca|mx|br|hk|cn|ch)(?=$|[\s)\]},;:/-])")
    for p in (r"\b2\s*[- ]?\s*sim\b", r"\bdual\s*sim\b", r"\b(?:nano\s*[- ]?\s*)?sim\s*\+\s*e\s*[- ]?\s*sim\b",
              r"\be\s*[- ]?\s*sim\b", r"\bsim\b"):
        s = F.regexp_replace(s, P.I + p, " ")
    table = _color_table(phrases)
    alternation = _color_alternation(tuple(table))
    s = F.regexp_replace(clean_text(s), r"(?iu)(?<![\p{L}\p{N}_])(?:" + alternation + r")(?![\p{L}\p{N}_])", " ")
    for p in (P.MEM_SLASH, P.MEM_SLASH_BARE, P.MEM_EXPLICIT, P.MEM_BARE, P.I + r"\b(gb|гб|tb|тб|g)\b"):
        s = F.regexp_replace(s, p, " ")
    return clean_spaces(F.regexp_replace(s, r"(?:\s|^)[-—–]+(?:\s|$)", " "))


# ---------------------------------------------------------------- everything
PARAM_FIELDS = [
    "storage", "ram", "color", "color_1", "color_2", "colors", "region", "sim", "code", "band_type", "band_color",
    "band_size", "screen_size", "watch_size_mm", "connectivity", "drive", "chip", "year", "anc", "case", "nano_glass",
    "no_watches", "game",
]


def with_attributes(df, text, *, cat=None, brand=None, series=None, model=None, catalog: bool = False,
                    phrases: tuple | None = None):
    """Add the attribute columns and ``price`` for the line in ``text``.

    Intermediate columns are shared, so every pattern runs once per line.
    """
    for step in _attribute_steps(text, cat, brand, series, model, catalog, phrases):
        df = df.withColumns(step)
    return df.drop("_mem", "_colors", "_watch", "_tablet", "_earphone", "_apple", "_sim", "_conn", "_cat", "_size")


@built_once
def _attribute_steps(text, cat, brand, series, model, catalog: bool, phrases: tuple | None) -> list[dict[str, Column]]:
    """The columns of :func:`with_attributes`, each step from those of the steps before."""
    steps = []
    t = _c(text)
    none = F.lit(None).cast("string")
    c, b, s, m = [none if x is None else _c(x) for x in (cat, brand, series, model)]
    flags = context_flags(t, c, b, s, m)
    ck = category_key(c)
    steps.append(
        {
            "_mem": storage_ram(t),
            "_colors": line_colors(t, phrases),
            "_watch": flags["watch"],
            "_tablet": flags["tablet"],
            "_earphone": flags["earphone"],
            "_apple": flags["apple_device"],
            "region": region_of(t),
            "_sim": sim_of(t),
            "_conn": connectivity_of(t),
            "_cat": ck,
            "price": extract_price(t),
        }
    )
    watch, tablet, conn = F.col("_watch"), F.col("_tablet"), F.col("_conn")
    steps.append(
        {
            "band_type": F.when(watch, band_type(t)),
            "band_size": F.when(watch, band_size(t)),
            "_size": screen_size(t, watch, c, b, s, m),
        }
    )
    steps.append({"band_color": F.when(watch & F.col("band_type").isNotNull(), band_color(t, phrases))})
    c1, c2 = F.try_element_at(F.col("_colors"), F.lit(1)), F.try_element_at(F.col("_colors"), F.lit(2))
    titan = watch & rx(t, P.I + r"\bti\b|\btitanium\b")
    ultra = watch & F.contains(F.coalesce(norm_key(m), F.lit("")), F.lit("ultra"))
    base = F.when(watch & F.col("band_type").isNotNull(), case_color(t, F.col("band_color"), phrases)).otherwise(c1)
    base_ultra = F.coalesce(base, F.when(rx(t, "(?i)natural"), F.lit("Natural")).when(rx(t, "(?i)black"), F.lit("Black")))
    color = (
        F.when(titan & base.isin("Black", "White", "Blue", "Natural"), F.concat(base, F.lit(" Titanium")))
        .when(~titan & ultra & base_ultra.isin("Black", "Natural"), F.concat(base_ultra, F.lit(" Titanium")))
        .otherwise(base)
    )
    steps.append({"color": color})
    only = F.filter(F.col("_colors"), lambda x: norm_key(x) != F.coalesce(norm_key("band_color"), F.lit("")))
    colors = F.when(watch & F.col("color").isNotNull(), F.array("color")).when(
        watch & F.col("band_color").isNotNull(), only
    ).otherwise(F.col("_colors"))
    phone_default = F.when(
        F.lit(not catalog) & (F.col("_cat") == "phones") & (F.coalesce(norm_key(b), F.lit("")) != "")
        & (norm_key(b) != "apple"),
        F.lit("4G"),
    )
    tablet_conn = F.when(
        rx(t, P.I + r"\bsim\b") | conn.isin("5G", "4G", "LTE", "Wi-Fi+Cellular"), F.lit("LTE")
    ).otherwise(F.coalesce(conn, F.lit("Wi-Fi")))
    steps.append(
        {
            "storage": F.col("_mem.storage"),
            "ram": F.col("_mem.ram"),
            "colors": F.slice(colors, 1, 3),
            "color_1": F.coalesce(F.when(watch, F.col("color")), c1),
            "color_2": F.when(~(watch & F.col("color").isNotNull()), c2),
            "sim": F.when(~tablet, default_sim(F.col("_sim"), c, b, s, m, F.col("region"))),
            "code": sku_of(t),
            "screen_size": F.when(~watch, F.col("_size")),
            "watch_size_mm": F.when(watch, F.col("_size")),
            "connectivity": F.when(tablet, tablet_conn).otherwise(F.coalesce(conn, phone_default)),
            "drive": F.when(F.col("_cat") == "consoles", drive_of(t)),
            "chip": F.when(F.col("_apple"), chip_of(t)),
            "year": year_of(t),
            "anc": F.when(F.col("_earphone") & rx(clean_text(t), P.NOISE_CANCEL), F.lit("anc")),
            "case": F.when(F.col("_earphone"), case_type(t)),
            "nano_glass": nano_glass(t),
            "no_watches": (F.coalesce(norm_key(b), F.lit("")) == "яндекс") & no_watches_flag(t),
            "game": F.coalesce(F.col("_cat") == "consoles", F.lit(False)) & game_flag(t),
        }
    )
    return steps
