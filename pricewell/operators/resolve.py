"""Line to catalogue model.

All strategies become candidate phrases of a line, joined once with the alias
index by equality; the order of the strategies is the sort key of the winner.
Distinct texts are resolved once, whatever number of copies a line has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import attributes as A, patterns as P, vocab as V
from ..functions.lines import rx
from ..functions.money import extract_price
from ..functions.text import (
    clean_spaces, clean_text, lit_array, lit_map, match_tokens, norm_key, strip_flags, title_head, tokens,
)
from ..functions.shapes import line_shape, names_watch, numbers_of, once_for_each
from ..session import built_once, cut_lineage, spread_work

MAX_NGRAM, MAX_TITLE_NGRAM = 8, 12

STRATEGIES = {0: "code", 1: "strict", 2: "line", 3: "remainder", 4: "band"}


def _words(*w: str) -> Column:
    return lit_array(list(w))


def _has(toks: Column, *w: str) -> Column:
    return F.arrays_overlap(toks, _words(*w))


def _first(toks: Column) -> Column:
    return F.coalesce(F.try_element_at(toks, F.lit(1)), F.lit(""))


def _behind_first(toks: Column) -> Column:
    return F.slice(toks, F.lit(2), F.greatest(F.size(toks), F.lit(1)))


def _exact_rules(text: Column) -> list[tuple[Column, Column]]:
    """Whole keys that certain wordings stand for; (guard, key text)."""
    year = F.coalesce(
        F.regexp_extract(text, r"(?i)\bSE\b[^\n]{0,30}?(20\d{2})", 1).try_cast("int"), F.lit(None).cast("int")
    )
    gen = F.when(year <= 2024, "2").otherwise("3")
    second = rx(text, r"(?i)\bse\b") & rx(text, r"(?i)\b2nd\s*gen\b")
    air_gen = F.regexp_extract(text, r"(?i)\bair\s*(6|7)\b", 1)
    air = (air_gen != "") & rx(text, r"(?i)\b(ipad|wi[\s-]*fi|lte|cellular)\b")
    chip = F.when(air_gen == "7", "m3").otherwise("m2")
    size = F.nullif(F.regexp_extract(text, r"\b(11|13)\b", 1), F.lit(""))
    poco = F.lower(F.regexp_extract(text, r"(?i)\bpoco\s+([fxm]\d+)\b", 1))
    pro = F.when(rx(text, r"(?i)\bpro\b"), " pro").otherwise("")
    return [
        (year.isNotNull(), F.concat(F.lit("watch se "), gen, F.lit(" "), year.cast("string"))),
        (year.isNotNull(), F.concat(F.lit("watch se "), gen)),
        (year.isNotNull(), F.concat(F.lit("watch se "), gen, F.lit(" 2024"))),
        (second, F.lit("watch se 2")),
        *[(second, F.lit(f"watch se 2 {y}")) for y in (2024, 2023, 2022)],
        (air & size.isNotNull(), F.concat(F.lit("ipad air "), size, F.lit(" "), chip)),
        (air, F.concat(F.lit("ipad air "), chip)),
        (poco != "", F.concat(F.lit("poco "), F.substring(poco, 1, 1), F.lit(" "), poco, pro)),
        (rx(text, r"(?i)\bwhoop\b") & rx(text, r"(?i)\b(life|peak|one)\b"), F.lit("whoop 50")),
    ]


def _station_rules(toks: Column) -> list[tuple[Column, Column]]:
    """Speaker names without their brand."""
    return [(F.size(F.array_except(_words(*words), toks)) == 0, F.lit(name)) for words, name in V.STATION_NAMES]


def _shorthand_rules(p: str) -> list[tuple[Column, Column]]:
    """(guard, tokens to look up) for the ways sellers shorten a name; order is priority."""
    text, toks, nk, storage = F.col(p), F.col(p + "_toks"), F.col(p + "_nk"), F.col(p + "_mem")
    first, rest = _first(toks), _behind_first(toks)
    lead = F.element_at(F.split(nk, " +"), 1)
    has_storage = storage["storage"].isNotNull()
    has_memory = has_storage | storage["ram"].isNotNull()
    plain_start = ~rx(lead, r"^[a-z]{1,3}\d+[a-z]*$")
    gen = first.try_cast("int")
    join = lambda *p: F.concat(*p)
    tabletish = rx(text, r"(?i)\bipad\b") | rx(text, P.TABLET_SIGNAL)
    wifi = rx(text, r"(?i)\bwi[\s-]*fi\b") | _has(toks, "wifi", "lte", "cellular", "5g")
    size_tok = F.when(_has(toks, "11"), "11").when(_has(toks, "13"), "13")
    chip_tok = F.try_element_at(F.filter(toks, lambda t: rx(t, r"^m\d+$")), F.lit(1))
    sized = size_tok.isNotNull()
    color_words = sorted({w for p, c in A.default_color_phrases() for w in (A._color_key(p) + " " + A._color_key(c)).split()})
    focus = F.filter(
        F.array_except(toks, lit_array(color_words)),
        lambda t: ~t.isin("wifi", "wi", "fi", "lte", "cellular", "5g", "gb", "tb"),
    )
    no_brand = F.when(first == "samsung", rest).otherwise(toks)
    nb_first = _first(no_brand)
    joined = F.array_join(toks, " ")
    as_tokens = lambda s: F.filter(F.split(s, " +"), lambda t: t != "")
    # watch spellings: aw -> apple watch, u2 -> ultra 2, s11 -> series 11, 46 -> 46mm
    watchish = (
        _has(toks, "watch", "aw") | rx(nk, r"\baw\b") | F.exists(toks, lambda t: rx(t, r"^u\d{1,2}$"))
        | (_has(toks, "ultra", "se", "series")
           & (F.exists(toks, lambda t: rx(t, "^(3[8-9]|4[0-9])(mm)?$"))
              | _has(toks, "sb", "sl", "tl", "al", "lb", "sport", "loop", "bracelet", "band")))
    ) & ~rx(text, P.TABLET_SIGNAL) & ~_has(toks, "tab")
    aw = F.regexp_replace(joined, r"(?<![^ ])aw(?![^ ])", "apple watch")
    ultra = F.when(
        rx(aw, "apple|watch"), F.regexp_replace(aw, r"(?<![^ ])u(\d{1,2})(?![^ ])", "ultra $1")
    ).otherwise(F.concat(F.lit("apple watch "), F.regexp_replace(aw, r"(?<![^ ])u(\d{1,2})(?![^ ])", "ultra $1")))
    series = F.regexp_replace(aw, r"(?<![^ ])s(\d{1,2})(?![^ ])", "series $1")
    series_no = F.regexp_replace(series, r"(?<![^ ])watch (?:(\S+) )?([1-9]|1\d|20)(?![^ ])", "watch $1 series $2")
    mm = F.regexp_replace(series_no, r"^(.*?)(?<![^ ])(3[8-9]|4[0-9])(?![^ ])", "$1$2mm")
    # implied watch: the line starts with the family itself
    style = r"(?i)^\s*(?:aw\s+)?(?:(?:s|series)\s*(\d{1,2})|(ultra|se)\s*(\d{0,2})|(?<=aw )(\d{1,2}))(?:\s+(\d{2}))?\b"
    implied = ~F.contains(nk, F.lit("watch")) & rx(text, style)
    family = F.lower(F.regexp_extract(text, style, 2))
    number = F.coalesce(*[F.nullif(F.regexp_extract(text, style, i), F.lit("")) for i in (1, 4)])
    implied_tokens = as_tokens(F.concat_ws(
        " ", F.lit("apple watch"),
        F.when(family != "", F.concat_ws(" ", family, F.nullif(F.regexp_extract(text, style, 3), F.lit(""))))
        .otherwise(F.concat_ws(" ", F.lit("series"), number)),
        F.concat(F.nullif(F.regexp_extract(text, style, 5), F.lit("")), F.lit("mm")),
    ))
    watch_number = (
        rx(first, r"^([1-9]|1\d|20)$") & ~_has(toks, "iphone", "ipad", "macbook")
        & (rx(text, r"(?i)\b(3[8-9]|4[0-9])mm\b") | _has(toks, "sm", "ml", "sl", "ultra", "se", "series"))
    )
    watch_family = _has(toks, "ultra", "se", "series")
    iphone_style = (
        ~F.contains(nk, F.lit("iphone")) & plain_start & rx(text, r"(?i)^\s*(1[0-9]|20)(\s*e\b)?(\s+(pro|max|plus|mini))?\b")
        & (has_storage | rx(text, r"(?i)^\s*(?:1[0-9]|20)\s*(e\b|(pro|max|plus|mini)\b)"))
    )
    iphone_implied = (
        plain_start & gen.between(12, 20) & has_storage
        & ~_has(toks, "galaxy", "poco", "redmi", "note", "xiaomi", "samsung", "pixel")
    )
    air_phone = (first == "air") & ~_has(toks, "ipad", "macbook", "airpods") & ~(
        tabletish | wifi | chip_tok.isNotNull()
    )
    short_samsung = rx(nb_first, r"^(s\d{1,2}|a\d{1,3}|z|fold|flip|galaxy)$")
    no_galaxy = ~_has(no_brand, "samsung", "galaxy")
    guards = {
        "tablet": tabletish, "samsung": first == "samsung", "watch": watchish, "poco code": (first == "poco") & rx(_first(rest), r"^[fxm]\d+$"),
        "iphone": iphone_style | iphone_implied, "watch number": watch_number, "watch family": watch_family,
        "air phone, sim": air_phone & F.col(p + "_sim").isNotNull(), "ipad pro, size": _has(toks, "ipad") & _has(toks, "pro") & sized,
        "air, size, chip": (first == "air") & sized & chip_tok.isNotNull() & wifi, "air, size": _has(toks, "air") & sized & wifi,
        "pro, size, chip": (first == "pro") & sized & chip_tok.isNotNull() & wifi, "pro, size": _has(toks, "pro") & sized & wifi,
        "air phone, storage": air_phone & has_storage, "note": has_memory & (first == "note"), "poco": has_memory & (first == "poco"),
        "letter code": has_memory & rx(first, r"^[xfmc]\d{1,2}[a-z]?$"), "a code": has_memory & rx(first, r"^a\d{1,3}$"),
        "short samsung": has_memory & short_samsung & no_galaxy, "fold": has_memory & nb_first.isin("z", "fold", "flip"), "implied watch": implied,
    }
    sources = {
        "all": toks, "rest": rest, "no brand": no_brand, "focus": focus, "aw": as_tokens(aw), "ultra": as_tokens(ultra), "series": as_tokens(series),
        "series number": as_tokens(series_no), "mm": as_tokens(mm), "letter, rest": join(F.array(F.substring(_first(rest), 1, 1)), rest),
        "size, rest": join(F.array(size_tok), F.filter(toks, lambda t: ~t.isin("ipad", "pro") & (t != size_tok))),
        "size, chip": F.array_compact(F.array(size_tok, chip_tok)), "implied": implied_tokens, "implied, all": join(implied_tokens, toks),
        "implied rest, all": join(_behind_first(implied_tokens), toks),
    }
    return [(guards[g], join(_words(*lead), sources[s]) if lead else sources[s]) for g, lead, s in V.SHORTHAND_RULES]


def title_mode(text: Column) -> Column:
    """Accessory, band and console lines are looked up by their title words."""
    return ~rx(text, P.TITLE_MODE_EXCLUDED) & (rx(text, P.TITLE_MODE_MM) | rx(text, P.TITLE_MODE))


def _entry(strategy: int, rule: int, exact: bool, title: bool, toks: Column) -> Column:
    return F.struct(
        F.lit(strategy).alias("strategy"), F.lit(rule).alias("rule"), F.lit(exact).alias("exact"),
        F.lit(title).alias("title"), toks.alias("toks"),
    )


def _prepare(p: str, memory: bool) -> dict[str, Column]:
    """Columns the rules of one text share, computed once per row."""
    t = F.col(p)
    cols = {p + "_toks": match_tokens(t), p + "_title": title_mode(t)}
    if memory:
        cols |= {p + "_raw": tokens(t), p + "_nk": norm_key(strip_flags(t)), p + "_mem": A.storage_ram(t), p + "_sim": A.sim_of(t)}
    return cols


def _plain_phrases(strategy: int, p: str) -> list[Column]:
    """Exact keys, title words, or the tokens themselves."""
    t, toks, title = F.col(p), F.col(p + "_toks"), F.col(p + "_title")
    numbers_only = (F.size(toks) <= 2) & F.forall(toks, lambda x: rx(x, r"^\d+$"))
    words = F.filter(F.split(title_head(t), " +"), lambda x: x != "")
    return [
        *[F.when(g, _entry(strategy, i, True, False, F.split(k, " "))) for i, (g, k) in enumerate(_exact_rules(t))],
        F.when(title, _entry(strategy, 20, False, True, words)),
        F.when(~title & ~numbers_only, _entry(strategy, 21, False, False, toks)),
    ]


def _short_phrases(strategy: int, p: str) -> list[Column]:
    """Shorthand readings of a text that is not an accessory title."""
    toks = F.col(p + "_toks")
    open_ = ~F.col(p + "_title") & ~((F.size(toks) <= 2) & F.forall(toks, lambda x: rx(x, r"^\d+$")))
    return [
        *[F.when(open_ & g, _entry(strategy, 30 + i, True, False, F.split(k, " ")))
          for i, (g, k) in enumerate(_station_rules(F.col(p + "_raw")))],
        *[F.when(open_ & g, _entry(strategy, 40 + i, False, False, t)) for i, (g, t) in enumerate(_shorthand_rules(p))],
    ]


def line_flags(raw: Column) -> dict[str, Column]:
    """What a line says against a class of models."""
    s, nk, toks = clean_text(raw), norm_key(raw), tokens(raw)
    small = rx(s, r"\b(11|13)\b")
    alpha = F.filter(toks, lambda t: rx(t, r"^\p{L}+$"))
    console_words = lit_array(V.CONSOLE_WORDS)
    no_sim = F.regexp_replace(raw, r"(?i)\b(?:nano\s*)?sim\s*\+\s*esim\b", " ")
    return {
        "t_not_phone": A.looks_like_laptop(raw)
        | rx(s, r"(?i)\bipad\b") | rx(s, P.TABLET_SIGNAL)
        | (rx(s, r"(?i)\bwi[\s-]*fi\b|\b(lte|cellular)\b") & small)
        | (rx(s, r"(?i)\bair\b") & small & ~rx(s, r"(?i)\biphone\b"))
        | (rx(s, r"(?i)\bm\d\b") & rx(s, r"(?i)\b(apple|ipad|mac|macbook|imac)\b"))
        | F.arrays_overlap(toks, lit_array(V.PHONE_VETO_WORDS)),
        "t_jbl": F.array_contains(toks, "jbl"),
        "t_not_tablet": rx(nk, P.I + r"\b(folio|cover|case|keyboard)\b|\b(чехол|обложк|клавиатур)\w*\b"),
        "t_not_console": rx(nk, P.I + r"\b(dualsense|dual\s*sense|controller|joycon|ps\s*portal|portal|vr\s*2|headset|camera|"
                            r"dock|case|carrying|deluxe|glass|screen|protector|игр\w*|game|edition\s*of)\b")
        | (rx(nk, r"\bnsw\s*2\b") & ~rx(nk, r"\bswitch\b"))
        | (rx(nk, r"\bps\s*5\b") & (
            ((F.size(alpha) > 0) & ~F.arrays_overlap(alpha, console_words))
            | F.exists(alpha, lambda t: (F.length(t) >= 4) & ~F.array_contains(console_words, t)))),
        "t_not_earphone": rx(nk, "garmin|instinct|solar") | F.contains(raw, F.lit("⌚")) | rx(nk, P.I + r"\b(case|кейc|кейс|чехол)\b"),
        "t_not_pencil": ~rx(nk, P.I + r"\b(pencil|pen|stylus|penne|пенсил|карандаш|стилус)\b"),
        "t_plus": rx(no_sim, r"(?i)\bplus\b|\+"),
        "t_variants": F.array_intersect(toks, lit_array(V.PHONE_VARIANT_WORDS)),
        "t_watch_variants": F.array_intersect(toks, _words("ultra", "se")),
        "t_code_start": rx(nk, r"^[a-z]{1,3}\d+") & ~rx(nk, "iphone|apple"),
    }


def rejected() -> Column:
    """A candidate whose class the line speaks against."""
    lacks = lambda words: F.size(F.array_except(words, F.col("m_toks"))) > 0
    return (
        (F.col("m_phone") & (F.col("t_not_phone") | (F.col("t_jbl") & (F.col("m_brand") == "samsung")) | lacks(F.col("t_variants"))))
        | (F.col("m_tablet") & F.col("t_not_tablet"))
        | (F.col("m_console") & F.col("t_not_console"))
        | (F.col("m_earphone") & F.col("t_not_earphone"))
        | (F.col("m_pencil") & F.col("t_not_pencil"))
        | (F.col("m_watch") & lacks(F.col("t_watch_variants")))
        | (F.col("m_phone_cat") & F.col("t_plus") & ~F.col("m_plus"))
    )


@built_once
def _phrase_columns(text: str, stage: str) -> tuple[list[str], list[Column], dict[str, Column], Column]:
    """Names of the flags, columns of a line, those made of them, and the phrases."""
    t = F.col(text)
    flags = line_flags(t)
    line = [F.col(text).alias("_l"), A.model_remainder(t).alias("_r"), *[c.alias(n) for n, c in flags.items()]]
    if stage == "first":
        more = {**_prepare("_l", False), "_r_toks": match_tokens(F.col("_r"))}
        phrases = [_entry(1, 0, True, False, F.col("_r_toks")), *_plain_phrases(2, "_l")]
    else:
        more = {**_prepare("_l", True), **_prepare("_r", True)}
        band = A.looks_like_band(F.col("_l"))
        phrases = [
            *_short_phrases(2, "_l"), *_plain_phrases(3, "_r"), *_short_phrases(3, "_r"),
            *[F.when(band, _entry(4, i, True, False, F.split(F.lit(k), " ")))
              for i, k in enumerate(("ремешки для apple watch", "ремешки apple watch"))],
        ]
    return list(flags), line, more, F.array_compact(F.array(*phrases))


def candidate_phrases(texts: DataFrame, text: str = "text", stage: str = "first") -> DataFrame:
    """Every n-gram a text may be looked up by, with its place in the order of strategies.

    The first stage holds the strict remainder and the line itself, the second
    the shorthand readings, the remainder and the band fall-back.
    """
    flags, line, more, phrases = _phrase_columns(text, stage)
    base = texts.select(*line).withColumns(more)
    rows = (
        base.select(F.col("_l").alias(text), *flags, F.explode(phrases).alias("_p"))
        .filter(F.size("_p.toks") > 0)
    )
    toks, n_all = F.col("_p.toks"), F.size("_p.toks")
    longest = F.when(F.col("_p.exact"), n_all).otherwise(
        F.least(n_all, F.when(F.col("_p.title"), F.lit(MAX_TITLE_NGRAM)).otherwise(F.lit(MAX_NGRAM)))
    )
    shortest = F.when(F.col("_p.exact"), n_all).when(F.col("_p.title"), F.lit(2)).otherwise(F.lit(1))
    grams = F.when(
        longest >= shortest,
        F.flatten(
            F.transform(
                F.sequence(shortest, longest),
                lambda n: F.transform(
                    F.sequence(F.lit(1), n_all - n + 1),
                    lambda i: F.struct(n.alias("n"), i.alias("pos"), F.array_join(F.slice(toks, i, n), " ").alias("key")),
                ),
            )
        ),
    )
    acc = lit_array(V.ACCESSORY_WORDS)
    return (
        rows.withColumns({
            "t_accessory": F.col("_p.title") & F.arrays_overlap(toks, acc),
            "t_mm_head": F.col("_p.title") & rx(F.element_at(toks, 1), "^(3[8-9]|4[0-9])mm$"),
        })
        .withColumn("_g", F.explode(grams))
        .select(text, *flags, "t_accessory", "t_mm_head", F.col("_p.strategy").alias("strategy"), F.col("_p.rule").alias("rule"),
                F.col("_p.title").alias("title"), F.col("_g.n").alias("n"), F.col("_g.pos").alias("pos"),
                F.col("_g.key").alias("alias_key"))
    )


def _rank() -> Column:
    """Smaller is better: strategy, rule, then title score or longest and leftmost phrase."""
    acc = F.arrays_overlap(F.split("alias_key", " "), lit_array(V.ACCESSORY_WORDS)).cast("int")
    mm = (F.col("t_mm_head") & ~F.col("m_watch")).cast("int")
    on_title = lambda c: F.when(F.col("title"), c).otherwise(F.lit(0))
    return F.struct(
        "strategy", "rule", on_title(F.col("m_phone").cast("int")), on_title(F.col("m_watch").cast("int")),
        (-F.col("n")).alias("n"), on_title(-(acc + mm)), "pos",
    )


_MODEL_COLS = ["model_id", "cat", "brand", "series", "model", "canonical"]


def _spread(texts: DataFrame) -> DataFrame:
    return spread_work(texts)


def _winners(cand: DataFrame, text: str) -> DataFrame:
    picked = cand.select(
        text, _rank().alias("_rank"), F.struct("strategy", "rule", "n", "pos", "alias_key", *_MODEL_COLS).alias("_m")
    )
    return picked


def _stage(texts: DataFrame, alias_index: DataFrame, text: str, stage: str) -> DataFrame:
    cand = candidate_phrases(texts, text, stage).join(alias_index.drop("alias", "rule_no", "n_models"), "alias_key")
    return _winners(
        cand.filter(
            ~rejected()
            & ~((F.col("strategy") >= 2) & (F.col("rule") == 21) & F.col("m_phone") & F.col("t_code_start"))
            & ~(F.col("t_accessory") & (F.col("m_phone") | F.col("m_tablet")))
            & ~(F.col("t_mm_head") & F.col("m_watch"))
        ),
        text,
    )


def _by_code(texts: DataFrame, code_index: DataFrame, text: str) -> DataFrame:
    t = F.col(text)
    flags = line_flags(t)
    coded = (
        texts.select(text, F.upper(A.sku_of(t)).alias("sku"), *[c.alias(n) for n, c in flags.items()])
        .filter("sku IS NOT NULL")
        .join(code_index.drop("alias", "rule_no", "n_models"), "sku").filter(~rejected())
    )
    return _winners(
        coded.withColumns({"strategy": F.lit(0), "rule": F.lit(0), "n": F.lit(1), "pos": F.lit(1), "title": F.lit(False),
                           "t_mm_head": F.lit(False), "alias_key": F.col("sku")}),
        text,
    )


def resolve_texts(texts: DataFrame, alias_index: DataFrame, code_index: DataFrame | None = None,
                  text: str = "text", shorthand: bool = True) -> DataFrame:
    """Winning model of each distinct text: strategy, rule, n, pos and the model columns.

    Every first-stage strategy outranks every second-stage one, so the costly
    shorthand readings are made only for texts the first stage leaves open.  The
    alias index is a dimension: Spark broadcasts it when its size allows and
    otherwise prunes the phrases with a runtime filter before the shuffle join.
    """
    best = lambda df: df.groupBy(text).agg(F.min_by("_m", "_rank").alias("_m")).select(text, "_m.*")
    # read by every stage; making it reads all lines
    distinct = _spread(cut_lineage(texts.select(text).distinct()))
    first = _stage(distinct, alias_index, text, "first")
    if code_index is not None:
        first = first.unionByName(_by_code(distinct, code_index, text))
    if not shorthand:
        return best(first)
    # read twice below; a reliable copy is cheaper than resolving again
    first = cut_lineage(best(first))
    open_ = _spread(distinct.join(first.select(text), text, "left_anti"))
    return first.unionByName(best(_stage(open_, alias_index, text, "second")))


def resolve_models(lines: DataFrame, alias_index: DataFrame, code_index: DataFrame | None = None,
                   text: str = "text", shorthand: bool = True, how: str = "inner") -> DataFrame:
    """Lines with their model; ``how='left'`` keeps unresolved ones.  Lines that differ in their price alone are resolved once."""
    shaped = with_shape(lines, alias_index, text)
    found = resolve_texts(shaped.select("_shape"), alias_index, code_index, "_shape", shorthand)
    return shaped.join(found, "_shape", how).drop("_shape")


def with_shape(lines: DataFrame, alias_index: DataFrame, text: str = "text", context: Column | None = None) -> DataFrame:
    """Lines with ``_shape``, which resolves as the line itself does, behind a header (``context``) too."""
    taken = numbers_of(alias_index)
    return lines.crossJoin(F.broadcast(taken)).withColumn("_shape", line_shape(text, F.col("_taken"), regions=False, diagonals=True, context=context)).drop("_taken")


_CONTEXT = ["cat", "brand", "series", "model"]


def _read_shapes(shapes: DataFrame, context: list[str], catalog: bool, phrases: tuple | None = None) -> DataFrame:
    """Attribute columns of shapes without flags, and what the SIM type of a region is told from."""
    cat, brand, series, model = context
    out = A.with_attributes(shapes, "_shape", cat=cat, brand=brand, series=series, model=model, catalog=catalog, phrases=phrases).drop("price")
    return out.withColumns({"_said_sim": A.sim_of("_shape"), "_tablet": A.context_flags("_shape", *context)["tablet"]})


def _of_flags(rows: DataFrame, flagged: Column) -> DataFrame:
    """Region and SIM type once the flags behind the price, which a shape lacks, are known."""
    sim = F.when(~F.col("_tablet"), A.default_sim(F.col("_said_sim"), *[F.col(c) for c in _CONTEXT], flagged))
    return rows.withColumn("sim", F.when(flagged.isNotNull(), sim).otherwise(F.col("sim"))).withColumn("region", F.coalesce(flagged, "region")).drop("_said_sim", "_tablet")


def _attributes(rows: DataFrame, text: str, catalog: bool = False, phrases: tuple | None = None) -> DataFrame:
    """Attribute columns of resolved lines: once for each shape and model, price and flags from the line itself."""
    shape = line_shape(text, regions=False, context=F.concat_ws(" ", *_CONTEXT))
    keys = {"_shape": shape, **{"_k_" + c: F.col(c) for c in _CONTEXT}}
    read = once_for_each(rows, keys, lambda d: _read_shapes(d, ["_k_" + c for c in _CONTEXT], catalog, phrases))
    return _of_flags(read, A.flagged_region(text)).withColumn("price", extract_price(text))


def normalize_kinds(lines: DataFrame, alias_index: DataFrame, code_index: DataFrame | None = None, text: str = "text",
                    catalog_rules: bool = True) -> tuple[DataFrame, DataFrame]:
    """(lines with ``_kind``, kinds in attribute form): lines of one kind differ in their price alone; those without a model have no kind in the second."""
    marked = with_shape(lines, alias_index, text).withColumn("_flagged", A.flagged_region(text))
    kinds, found = _resolved_kinds(marked, alias_index, code_index)
    # The model may say watch where the line does not: such lines keep the sizes in their prices.
    context = F.concat_ws(" ", *_CONTEXT)
    watches = found.filter(names_watch(context)).select("_shape", context.alias("_context"))
    if not watches.isEmpty():
        kept = marked.withColumnRenamed("_shape", "_before").join(watches.withColumnRenamed("_shape", "_before"), "_before", "left")
        marked = with_shape(kept, alias_index, text, F.col("_context")).drop("_before", "_context")
        kinds, found = _resolved_kinds(marked, alias_index, code_index)
    read = cut_lineage(_read_shapes(_spread(found), _CONTEXT, catalog_rules))
    kind = F.concat_ws("\n", "_shape", "_flagged")
    full = _of_flags(read.join(kinds, "_shape").withColumn("_kind", kind), F.col("_flagged")).drop("_shape", "_flagged")
    return marked.withColumn("_kind", kind).drop("_shape", "_flagged"), cut_lineage(full)


def _resolved_kinds(marked: DataFrame, alias_index: DataFrame, code_index: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Distinct (shape, flags) of lines, and the model of each shape."""
    kinds = cut_lineage(marked.select("_shape", "_flagged").distinct())
    return kinds, cut_lineage(resolve_texts(kinds.select("_shape"), alias_index, code_index, "_shape"))


def resolve_strict(lines: DataFrame, alias_index: DataFrame, text: str = "text") -> DataFrame:
    """Whole-phrase lookup of the remainder only."""
    key = F.array_join(match_tokens(A.model_remainder(F.col("_shape"))), " ")
    keyed = once_for_each(lines, {"_shape": line_shape(text, regions=False)}, lambda d: d.withColumn("alias_key", key))
    return keyed.join(alias_index.select("alias_key", *_MODEL_COLS), "alias_key")


def ngram_lookup(tokens_df: DataFrame, index: DataFrame, key: list[str], toks: str = "toks",
                 index_key: str = "alias_key", max_n: int = MAX_NGRAM) -> DataFrame:
    """Longest, then leftmost n-gram of ``toks`` found in an index; one row per key."""
    arr, size = F.col(toks), F.size(toks)
    grams = F.when(size > 0, F.flatten(F.transform(
        F.sequence(F.lit(1), F.least(size, F.lit(max_n))),
        lambda n: F.transform(
            F.sequence(F.lit(1), size - n + 1),
            lambda i: F.struct(n.alias("n"), i.alias("pos"), F.array_join(F.slice(arr, i, n), " ").alias("k"))))))
    rows = tokens_df.select(*key, F.explode(grams).alias("_g")).select(*key, "_g.*").withColumnRenamed("k", index_key)
    hit = rows.join(index, index_key)
    rest = [c for c in index.columns if c != index_key]
    return (
        hit.groupBy(*key)
        .agg(F.min_by(F.struct(index_key, "n", "pos", *rest), F.struct(-F.col("n"), F.col("pos"))).alias("_m"))
        .select(*key, "_m.*")
    )


def header_brand(header: Column) -> Column:
    """Brand named by a header line."""
    toks = tokens(strip_flags(clean_spaces(header)))
    known = {w: b for b, ws in V.HEADER_BRANDS.items() for w in ws}
    names = lit_map(known)
    return F.try_element_at(F.filter(F.transform(toks, lambda t: F.try_element_at(names, t)), lambda b: b.isNotNull()), F.lit(1))


def resolve_with_header(lines: DataFrame, alias_index: DataFrame, code_index: DataFrame | None = None,
                        text: str = "text", header: str = "header") -> DataFrame:
    """Two passes: the line alone, then ``header + line`` where that fails.

    A match whose brand contradicts the header's brand is void.  Both passes work on
    distinct pairs of a line's shape and its header, so copies and prices cost nothing.
    """
    shaped = with_shape(lines, alias_index, text, F.col(header))
    pairs = _spread(cut_lineage(shaped.select("_shape", header).distinct()))
    first = pairs.join(resolve_texts(pairs, alias_index, code_index, "_shape"), "_shape", "left")
    conflict = (header_brand(F.col(header)) != norm_key("brand"))
    ok = F.col("model_id").isNotNull() & ~F.coalesce(conflict, F.lit(False))
    first = cut_lineage(first.withColumn("_ok", ok))
    done = first.filter("_ok").drop("_ok").withColumn("_headed", F.lit(False))
    open_ = (
        first.filter(~F.col("_ok") & F.col(header).isNotNull()).select("_shape", header)
        .withColumn("parse_line", _headed_line(header, "_shape"))
    )
    second = open_.join(resolve_texts(open_.select(F.col("parse_line")), alias_index, code_index, "parse_line"), "parse_line")
    found = done.unionByName(second.withColumn("_headed", F.lit(True)).select(*done.columns))
    # other names: the pairs come from the lines themselves, and an unresolved line must keep its own text
    found = found.withColumnsRenamed({"_shape": "_found", header: "_header"})
    out = shaped.join(found, F.col("_shape").eqNullSafe(F.col("_found")) & F.col(header).eqNullSafe(F.col("_header")), "left")
    parse_line = F.when(F.col("_headed"), _headed_line(header, text)).when(~F.col("_headed"), F.col(text))
    return out.withColumn("parse_line", parse_line).drop("_shape", "_found", "_header", "_headed")


def _headed_line(header: str, text: str) -> Column:
    return clean_spaces(F.concat_ws(" ", header, text))


def build_offers(lines: DataFrame, alias_index: DataFrame, code_index: DataFrame | None = None,
                 text: str = "text", header: str = "header", phrases: tuple | None = None) -> DataFrame:
    """Kept lines as offers: resolved model, attributes and price; unresolved lines keep NULL models."""
    resolved = resolve_with_header(lines, alias_index, code_index, text, header)
    line = F.coalesce("parse_line", text)
    attrs = _attributes(resolved.withColumn("_line", line), "_line", phrases=phrases)
    return attrs.withColumn("raw", F.col(text)).drop("_line")


def unmatched_lines(offers: DataFrame, text: str = "raw") -> DataFrame:
    return offers.filter(F.col("model_id").isNull()).select(
        "channel", "message_id", text, F.lit("no_catalog_match").alias("reason"), A.model_remainder(F.col(text)).alias("rest")
    )


def normalize_queries(queries: DataFrame, alias_index: DataFrame, code_index: DataFrame | None = None,
                      text: str = "text", catalog_rules: bool = True, how: str = "inner") -> DataFrame:
    """Sheet names or buyer lines to the attribute form offers and variants have."""
    resolved = resolve_models(queries, alias_index, code_index, text, how=how)
    return _attributes(resolved, text, catalog_rules)


def resolve_sheet(sheet: DataFrame, alias_index: DataFrame, code_index: DataFrame | None = None) -> DataFrame:
    """Sheet rows with their model; unresolved rows stay as stubs with context-free attributes."""
    from ..functions.text import clean_sheet_name

    named = sheet.withColumn("clean_name", clean_sheet_name("name"))
    out = normalize_queries(named, alias_index, code_index, "clean_name", how="left")
    return out.withColumn("catalog_matched", F.col("model_id").isNotNull())


def speaks_against(texts: DataFrame, alias_index: DataFrame, text: str = "text") -> DataFrame:
    """(text, model): catalogue models a phrase of the line names, whose class the line speaks against."""
    distinct = _spread(texts.select(text).distinct())
    cand = candidate_phrases(distinct, text, "first").join(alias_index.drop("alias", "rule_no", "n_models"), "alias_key")
    return cand.filter(rejected()).select(text, "model").distinct()
