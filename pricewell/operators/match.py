"""Offers against catalogue variants: candidate keys, attribute predicate, best price.

The strict, null-safe attributes are equality keys of the join itself, so a
popular model does not produce all its variant x offer pairs before filtering.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import attributes as A, vocab as V
from ..functions.lines import rx
from ..functions.text import clean_spaces, norm_key, null_if_empty
from ..session import built_once, cut_lineage

# Equal in every category; NULL equals only NULL.
STRICT_FIELDS = ["anc", "game", "nano_glass", "no_watches", "screen_size", "sim", "storage"]
# Fields of the signature keys, per category.
SIGNATURE_FIELDS = {
    "phones": ["model", "storage", "color", "sim", "connectivity"],
    "tablets": ["model", "screen_size", "storage", "color", "connectivity"],
    "watches": ["model", "watch_size_mm", "band_type", "band_size", "connectivity", "color"],
    "consoles": ["model", "storage", "drive", "color", "game"],
    "headphones": ["model", "color"],
    "laptops": ["model", "ram", "storage", "chip", "code"],
}
DEFAULT_SIGNATURE = ["model", "color", "storage"]
RELAXED_DROP = {"watches": ["band_type", "band_size", "band_color"]}


def norm_value(col) -> Column:
    return null_if_empty(F.lower(F.trim(F.col(col) if isinstance(col, str) else col)))


def norm_connectivity(cat: Column, col) -> Column:
    """Tablets: every cellular form is one, absence is Wi-Fi; others only unify spelling."""
    s = clean_spaces(F.regexp_replace(F.translate(norm_value(col), "_", " "), r"\+", " + "))
    s = F.when(s.isin("wifi", "wi fi", "wi-fi", "wifionly", "wifi only", "wi fi only"), "wi-fi").otherwise(s)
    s = F.when(rx(s, r"^wi[ -]?fi (?:\+ )?cellular$"), "wi-fi+cellular").otherwise(s)
    tablet = (
        F.when(s.isNull(), "wi-fi")
        .when(s.isin("lte", "4g", "5g", "cellular", "cell", "sim", "wi-fi+cellular"), "cellular")
        .otherwise(s)
    )
    return F.when(F.coalesce(cat, F.lit("")) == "tablets", tablet).otherwise(s)


def pick_category(variant: Column, offer: Column) -> Column:
    """The catalogue side decides; the offer's category only where it has none."""
    return F.coalesce(A.category_key(variant), A.category_key(offer), F.lit("_default"))


def color_candidates() -> Column:
    """Distinct lower-case colours of a row, main colour first."""
    one = [norm_value(c) for c in ("color", "color_1", "color_2")]
    rest = F.transform(F.coalesce("colors", F.array().cast("array<string>")), lambda c: F.lower(F.trim(c)))
    return F.array_distinct(F.array_compact(F.concat(F.array(*one), rest)))


def prepare(df: DataFrame) -> DataFrame:
    """Comparison columns, computed once per row and not once per pair."""
    model = F.coalesce(norm_key("model"), F.lit(""))
    out = df.withColumns(
        {
            "k_cat": A.category_key("cat"),
            "k_model": norm_value("model"),
            "k_code": norm_value("code"),
            "k_colors": color_candidates(),
            "k_s25": rx(model, r"\bs25\b"),
            "k_s25_ultra": rx(model, r"\bs25 ultra\b"),
            "k_apple_watch": (F.coalesce(norm_key("brand"), F.lit("")) == "apple") & F.contains(model, F.lit("watch")),
        }
    )
    out = out.withColumn("k_canon", F.array_distinct(F.transform("k_colors", A.canon_color)))
    return out.withColumns(
        {"k_families": A.color_families(F.col("k_canon")), "k_conn": norm_connectivity(F.col("k_cat"), "connectivity"),
         "k_band_color": A.canon_color("band_color")}
    )


def strong_code(code: Column) -> Column:
    """A real product code; short and model-like codes are weak."""
    return (F.length(code) > 4) & ~rx(code, r"(?i)^(hs|hd|ht|ph|sv|v)\d")


def colors_match(v: str, o: str, cat: Column) -> Column:
    """Equal on any pair, else equal family; some product lines keep colours apart."""
    c = lambda side, name: F.col(f"{side}.{name}")
    vc, oc = c(v, "k_colors"), c(o, "k_colors")
    has = lambda side, *words: F.arrays_overlap(c(side, "k_colors"), F.array(*[F.lit(w) for w in words]))

    def apart(both: Column, a: tuple, b: tuple) -> Column:
        return both & ((has(v, *a) & has(o, *b)) | (has(v, *b) & has(o, *a)))

    veto = (
        apart(c(v, "k_s25_ultra") & c(o, "k_s25_ultra"), ("jet black", "jetblack", "jet-black"), ("black",))
        | apart(c(v, "k_s25") & c(o, "k_s25"), ("icy blue", "icyblue", "icy-blue"), ("navy",))
        | apart((cat == "watches") & c(v, "k_apple_watch") & c(o, "k_apple_watch"), ("starlight",), ("silver",))
    )
    loose = F.arrays_overlap(c(v, "k_canon"), c(o, "k_canon")) | F.arrays_overlap(c(v, "k_families"), c(o, "k_families"))
    neither = (F.size(vc) == 0) & (F.size(oc) == 0)
    return F.coalesce(neither | F.arrays_overlap(vc, oc) | (~F.coalesce(veto, F.lit(False)) & loose), F.lit(False))


@built_once
def mismatch(v: str = "v", o: str = "o") -> Column:
    """First attribute that does not agree, NULL for a match.

    The order is alphabetical inside each group: always-equal fields, fields
    compared when both are filled, fields compared when the catalogue has them.
    """
    e, p = (lambda n: F.col(f"{v}.{n}")), (lambda n: F.col(f"{o}.{n}"))
    cat = F.coalesce(e("k_cat"), p("k_cat"), F.lit("_default"))
    val = lambda f, n: norm_value(f(n).cast("string"))
    differs = lambda n: ~val(e, n).eqNullSafe(val(p, n))
    both_differ = lambda n: F.coalesce(val(e, n) != val(p, n), F.lit(False))
    conn_diff = F.when(cat == "watches", F.coalesce(e("k_conn") != p("k_conn"), F.lit(False))).when(
        cat != "phones", ~e("k_conn").eqNullSafe(p("k_conn"))
    ).otherwise(F.lit(False))
    same_code = F.coalesce(e("k_code") == p("k_code"), F.lit(False))
    rules = [
        ("model", ~e("k_model").eqNullSafe(p("k_model"))),
        ("anc", differs("anc")),
        ("band_size", F.when(cat == "watches", both_differ("band_size")).otherwise(differs("band_size"))),
        ("color", ~colors_match(v, o, cat)),
        ("connectivity", conn_diff),
        ("game", ~F.coalesce(e("game"), F.lit(False)).eqNullSafe(F.coalesce(p("game"), F.lit(False)))),
        ("nano_glass", ~F.coalesce(e("nano_glass"), F.lit(False)).eqNullSafe(F.coalesce(p("nano_glass"), F.lit(False)))),
        ("no_watches", ~F.coalesce(e("no_watches"), F.lit(False)).eqNullSafe(F.coalesce(p("no_watches"), F.lit(False)))),
        ("ram", F.when(cat.isin("phones", "tablets"), both_differ("ram")).otherwise(differs("ram"))),
        ("screen_size", differs("screen_size")),
        ("sim", differs("sim")),
        ("storage", differs("storage")),
        ("band_color", F.coalesce(e("k_band_color") != p("k_band_color"), F.lit(False))),
        ("chip", both_differ("chip")),
        ("code", both_differ("code")),
        # asked for by the catalogue only
        ("connectivity", (cat == "phones") & e("k_conn").isNotNull() & ~e("k_conn").eqNullSafe(p("k_conn"))),
        ("watch_size_mm", (cat == "watches") & val(e, "watch_size_mm").isNotNull() & differs("watch_size_mm")),
        ("band_type", (cat == "watches") & both_differ("band_type")),
        ("drive", (cat == "consoles") & val(e, "drive").isNotNull() & differs("drive")),
    ]
    case = F.when(same_code & strong_code(e("k_code")), F.lit(None).cast("string"))
    return reduce(lambda acc, r: acc.when(r[1], F.lit(r[0])), rules, case)


# What the predicate reads beside the model.
COMPARED = ["k_cat", "k_code", "code", "k_colors", "k_s25", "k_s25_ultra", "k_apple_watch", "k_canon", "k_families", "k_conn", "k_band_color", "anc", "band_size", "game",
            "nano_glass", "no_watches", "ram", "screen_size", "sim", "storage", "chip", "watch_size_mm", "band_type", "drive"]


def with_kind(prepared: DataFrame, more: list[str] | None = None) -> DataFrame:
    """``_kind``: equal for rows that the predicate (and ``more``) cannot tell apart, their models aside."""
    return prepared.withColumn("_kind", F.md5(F.to_json(F.struct(*COMPARED, *(more or [])), {"ignoreNullFields": "false"})))


def judge_kinds(pairs: DataFrame, left: DataFrame, right: DataFrame, reason: Column, more: list[str] | None = None) -> DataFrame:
    """``pairs`` (_lk, _rk) of kinds under one model with the ``reason`` for sides l and r: the predicate runs once for each pair of kinds."""
    cols = [*COMPARED, *(more or [])]
    rows = lambda df: df.groupBy("_kind").agg(F.first(F.struct(*cols)).alias("_s")).select("_kind", "_s.*", F.lit("").alias("k_model"))
    met = pairs.select("_lk", "_rk").distinct().alias("m")
    return met.join(rows(left).alias("l"), F.col("l._kind") == F.col("m._lk")).join(rows(right).alias("r"), F.col("r._kind") == F.col("m._rk")).select(
        "_lk", "_rk", reason.alias("reason"))


def count_outcomes(variants: DataFrame, offers: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """How many pairs of one model end with each outcome of the predicate, by columns of the variants; ``n`` counts equal offers."""
    v, o = (cut_lineage(with_kind(prepare(df))) for df in (variants, offers))
    left = v.groupBy(*by, "k_model", F.col("_kind").alias("_lk")).agg(F.count(F.lit(1)).alias("_v"))
    right = o.groupBy("k_model", F.col("_kind").alias("_rk")).agg(F.sum(n).alias("_o"))
    pairs = cut_lineage(left.join(right, "k_model").groupBy(*by, "_lk", "_rk").agg(F.sum(F.col("_v") * F.col("_o")).alias("n")))
    return pairs.join(judge_kinds(pairs, v, o, mismatch("l", "r")), ["_lk", "_rk"]).groupBy(*by, "reason").agg(F.sum("n").alias("n"))


def match_variants(variants: DataFrame, offers: DataFrame, keep_v: list[str], keep_o: list[str]) -> DataFrame:
    """Inner, many-to-many; an offer may serve several variants.

    Two equality joins: on a strong code, and on the model with the strict
    fields.  AQE splits a partition that one popular model makes too large.
    """
    v, o = prepare(variants), prepare(offers)
    out = [F.col(f"v.{c}") for c in keep_v] + [F.col(f"o.{c}") for c in keep_o]
    by_code = (
        v.filter(strong_code(F.col("k_code"))).alias("v")
        .join(o.alias("o"), F.col("v.k_code") == F.col("o.k_code"))
        .select(*out, F.lit("code").alias("matched_by"))
    )
    flags = {"game", "nano_glass", "no_watches"}

    def key(side: str, f: str) -> Column:
        c = F.col(f"{side}.{f}")
        return F.coalesce(c, F.lit(False)) if f in flags else F.coalesce(norm_value(c.cast("string")), F.lit(""))

    on = [F.col("v.k_model") == F.col("o.k_model")] + [key("v", f) == key("o", f) for f in STRICT_FIELDS]
    same_code = F.coalesce((F.col("v.k_code") == F.col("o.k_code")) & strong_code(F.col("v.k_code")), F.lit(False))
    by_model = (
        v.alias("v").join(o.alias("o"), reduce(lambda a, b: a & b, on))
        .filter(~same_code & mismatch().isNull())
        .select(*out, F.lit("attributes").alias("matched_by"))
    )
    return by_code.unionByName(by_model)


# ---------------------------------------------------------------- candidates
def blocking_keys() -> Column:
    """Keys a row may meet its counterpart by: signatures, model, code."""
    cat = F.coalesce(A.category_key("cat"), F.lit("_default"))

    def sig(fields, color) -> Column:
        vals = []
        for f in fields:
            if f is None:
                vals.append(F.lit(""))
            elif f == "color":
                vals.append(F.coalesce(color, F.lit("")))
            elif f == "connectivity":
                vals.append(F.coalesce(norm_connectivity(cat, f), F.lit("")))
            else:
                vals.append(F.coalesce(norm_value(F.col(f).cast("string")), F.lit("")))
        return F.array_join(F.array(*vals), "|")

    main = F.coalesce(norm_value("color"), norm_value("color_1"), F.lower(F.try_element_at("colors", F.lit(1))))
    second = norm_value("color_2")
    model = norm_value("model")

    def per_category(build):
        case = F.when(F.lit(False), F.lit(None).cast("string"))
        for c, fields in SIGNATURE_FIELDS.items():
            case = case.when(cat == c, build(c, fields))
        return case.otherwise(build("_default", DEFAULT_SIGNATURE))

    plain = per_category(lambda c, fs: F.concat(F.lit("sig:"), cat, F.lit(":"), sig(fs, main)))
    relaxed = F.when(cat == "watches", F.concat(F.lit("sig2:"), cat, F.lit(":"), sig(
        [None if f in RELAXED_DROP["watches"] else f for f in SIGNATURE_FIELDS["watches"]], main)))
    with_second = F.when(second.isNotNull(), per_category(
        lambda c, fs: F.concat(F.lit("sigc2:"), cat, F.lit(":"), sig(fs, second)) if "color" in fs else F.lit(None).cast("string")))
    return F.array_distinct(F.array_compact(F.array(
        plain, relaxed, with_second,
        F.concat(F.lit("model:"), cat, F.lit(":"), model), F.concat(F.lit("model:_default:"), model),
        F.when(cat == "laptops", F.concat(F.lit("code:"), norm_value("code"))),
    )))


def candidate_pairs(variants: DataFrame, offers: DataFrame, variant_cols: list[str], offer_cols: list[str],
                    keys: str = "keys", salts: int = 1) -> DataFrame:
    """Pairs sharing a key, each once: a pair counts only under its first common key.

    With ``salts`` > 1 the offers of a key are spread over that many tasks and the
    (small) variant side is repeated.  Spark's estimate takes a row with its keys
    for a few bytes, so it is told not to send the variants through the driver.
    """
    v = variants.select(*variant_cols, F.col(keys).alias("_vk"), F.explode(keys).alias("_k"))
    o = offers.select(*offer_cols, F.col(keys).alias("_ok"), F.explode(keys).alias("_k"))
    on = ["_k"]
    if salts > 1:
        v = v.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        o = o.withColumn("_s", F.pmod(F.xxhash64(*offer_cols), F.lit(salts)).cast("int"))
        on.append("_s")
    return (
        v.hint("merge").join(o, on)
        .filter(F.element_at(F.array_intersect("_vk", "_ok"), 1) == F.col("_k"))
        .select(*variant_cols, *offer_cols)
    )


def with_candidates(variants: DataFrame, offers: DataFrame, key: list[str], keys: str = "keys") -> DataFrame:
    """Variants (key) that share a blocking key with some offer; keys meet once each, no pair is made."""
    offered = offers.select(F.explode(keys).alias("_k")).distinct()
    return variants.select(*key, F.explode(keys).alias("_k")).join(offered, "_k", "left_semi").select(*key).distinct()


def unmatched_variants(variants: DataFrame, candidates: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    """Variants without a match, and whether they had a candidate."""
    none = variants.join(matches.select(*key).distinct(), key, "left_anti")
    seen = candidates.select(*key).distinct().withColumn("_seen", F.lit(True))
    return none.join(seen, key, "left").withColumn(
        "reason", F.when(F.col("_seen"), "no_candidate_passed").otherwise("no_candidates")
    ).drop("_seen")


def unmatched_offers(offers: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    return offers.join(matches.select(*key).distinct(), key, "left_anti")


# ---------------------------------------------------------------- best price
def dedupe_offers(matches: DataFrame, variant: list[str], seq: str = "seq") -> DataFrame:
    """One row per (variant, channel, price, raw) ignoring case; the last written wins."""
    rest = [c for c in matches.columns if c not in variant]
    keys = [F.col(c) for c in variant] + [
        F.lower(F.trim("channel")).alias("_c"), F.col("price").alias("_p"), F.lower(F.trim("raw")).alias("_r")
    ]
    return (
        matches.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_m")).select(*variant, "_m.*")
    )


def best_price(offers: DataFrame, variant: list[str], channel: str = "channel", price: str = "price") -> DataFrame:
    """Minimum price, channels within the tolerance of it, and how many offers there are.

    First per (variant, channel), so that a variant with very many offers shrinks
    to its channels before anything meets in one task.
    """
    per_channel = offers.groupBy(*variant, channel).agg(
        F.min(price).alias("_min"), F.count(F.lit(1)).alias("_n"),
    )
    total = per_channel.groupBy(*variant).agg(
        F.min("_min").alias("min_price"), F.sum("_n").alias("n_offers"), F.count(F.lit(1)).alias("n_channels")
    )
    near = (
        per_channel.join(total, variant)
        .filter(F.col("_min") - F.col("min_price") <= V.WIN_TOLERANCE)
        .groupBy(*variant).agg(F.array_sort(F.collect_set(channel)).alias("best_channels"))
    )
    return total.join(near, variant, "left").withColumn(
        "best_channels", F.coalesce("best_channels", F.array().cast("array<string>"))
    )


def collect_sources(offers: DataFrame, variant: list[str]) -> DataFrame:
    """Distinct channels and raw lines of a variant, one row each, so that none of them is one growing array."""
    pair = F.array(
        F.struct(F.lit("channel").alias("kind"), F.col("channel").alias("value")),
        F.struct(F.lit("raw").alias("kind"), F.col("raw").alias("value")),
    )
    return offers.select(*variant, F.inline(pair)).filter("value IS NOT NULL").distinct()


def channel_wins(best: DataFrame) -> DataFrame:
    """How many variants each channel wins."""
    return best.select(F.explode("best_channels").alias("channel")).groupBy("channel").agg(F.count(F.lit(1)).alias("wins"))


# ------------------------------------------------------------- query answers
def norm_sim(col) -> Column:
    s = F.regexp_replace(F.lower(F.trim(col)), "[ -]", "")
    return (
        F.when(s.isin("1sim", "single", "one", "1", "sim+esim", "1sim+esim", "1plusesim", "1+esim", "1esim"), "sim+esim")
        .when(s.isin("2sim", "dualsim", "dual", "dual_sim", "2"), "2sim")
        .otherwise(F.nullif(s, F.lit("")))
    )


@built_once
def hard_guard(q: str = "p", o: str = "e") -> Column:
    """Attributes a buyer asks for must be equal; first failure, NULL when all hold."""
    a, b = (lambda n: F.col(f"{q}.{n}")), (lambda n: F.col(f"{o}.{n}"))
    asked = lambda n: norm_value(a(n)).isNotNull() & ~norm_value(a(n)).eqNullSafe(norm_value(b(n)))
    return (
        F.when(~F.coalesce(b("price") > 0, F.lit(False)), "no_price")
        .when(asked("color"), "color_mismatch")
        .when(asked("storage"), "storage_mismatch")
        .when(norm_sim(a("sim")).isNotNull() & ~norm_sim(a("sim")).eqNullSafe(norm_sim(b("sim"))), "sim_mismatch")
        .when(asked("region"), "region_mismatch")
    )


def answer_queries(queries: DataFrame, offers: DataFrame, query_key: list[str], offer_cols: list[str]) -> DataFrame:
    """Cheapest offer that passes the predicate and the guards, else the commonest failure.

    Only offers of the same model or strong code are paired; offers of other
    models would all fail on 'model', so their number alone is enough.
    """
    more = ["color", "region"]
    priced = F.coalesce(F.col("price") > 0, F.lit(False)).cast("int")
    # the price of a kind says only whether there is one
    p = cut_lineage(with_kind(prepare(queries), more))
    e = cut_lineage(with_kind(prepare(offers).withColumn("_priced", priced), [*more, "_priced"]))
    total = offers.agg(F.count(F.lit(1)).alias("_total"))
    offer, price = F.struct(*[F.col(c) for c in offer_cols]), F.col("price").cast("bigint")
    kinds = e.groupBy("k_model", F.col("_kind").alias("_lk")).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(offer, price).alias("_offer"), F.min(price).alias("_price"))
    met = cut_lineage(p.select("k_model", F.col("_kind").alias("_rk")).distinct().join(kinds, "k_model"))
    sides = p.withColumn("price", F.lit(None).cast("int")), e.withColumn("price", F.col("_priced"))
    judged = judge_kinds(met, sides[1], sides[0], F.coalesce(mismatch("l", "r"), hard_guard("r", "l")), [*more, "price"])
    merged = [F.sum("_n").alias("_n"), F.min_by("_offer", "_price").alias("_offer"), F.min("_price").alias("_price")]
    outcomes = met.join(judged, ["_lk", "_rk"]).groupBy("k_model", "_rk", "reason").agg(*merged)
    by_model = p.select(*query_key, "k_model", F.col("_kind").alias("_rk")).join(outcomes, ["k_model", "_rk"]).select(*query_key, "reason", "_n", "_offer", "_price")
    by_code = (
        p.alias("p").filter(strong_code(F.col("k_code")))
        .join(e.alias("e"), (F.col("p.k_code") == F.col("e.k_code")) & ~F.col("p.k_model").eqNullSafe(F.col("e.k_model")))
        .select(*[F.col(f"p.{c}") for c in query_key], F.coalesce(mismatch("e", "p"), hard_guard("p", "e")).alias("reason"), F.lit(1).cast("bigint").alias("_n"),
                F.struct(*[F.col(f"e.{c}") for c in offer_cols]).alias("_offer"), F.col("e.price").cast("bigint").alias("_price"))
    )
    counts = by_model.unionByName(by_code).groupBy(*query_key, "reason").agg(*merged)
    per_query = counts.groupBy(*query_key).agg(
        F.max(F.when(F.col("reason").isNull(), F.col("_offer"))).alias("offer"),
        F.sum("_n").alias("_seen"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), F.struct(F.col("_n"), F.col("reason")))).alias("_top"),
        F.max(F.when(F.col("reason").isNotNull(), F.col("_n"))).alias("_top_n"),
    )
    out = queries.select(*query_key).distinct().join(per_query, query_key, "left").crossJoin(F.broadcast(total))
    others = F.col("_total") - F.coalesce("_seen", F.lit(0))
    reason = F.when(F.col("offer").isNotNull(), F.lit(None).cast("string")).when(
        F.col("_total") == 0, "no_match"
    ).when(F.col("_top").isNull() | (others > F.col("_top_n")), "model").otherwise(F.col("_top"))
    return out.select(*query_key, "offer", reason.alias("reason"))


def top_reason(attempts: DataFrame, keys: list[str], reason: str = "reason") -> DataFrame:
    """Most frequent failure per key; ties go to the alphabetically first."""
    counts = attempts.groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(F.struct(reason, "n"), F.struct(-F.col("n"), F.col(reason))).alias("_m")).select(*keys, "_m.*")


# ------------------------------------------------------------------- sheets
def sheet_links_long(sheet: DataFrame, pairs: list[tuple[str, str]], row: str = "row_no") -> DataFrame:
    """Link/price column pairs to long form, up to the last row that has a link."""
    items = F.array(*[
        F.struct(F.lit(link).alias("link_col"), F.lit(price).alias("price_col"), F.col(link).alias("url"),
                 F.col(price).cast("string").alias("price_raw"))
        for link, price in pairs
    ])
    long = sheet.select(row, F.inline(items))
    last = long.filter(F.startswith(F.lower(F.trim("url")), F.lit("http"))).agg(F.max(row).alias("_last"))
    return long.crossJoin(F.broadcast(last)).filter(F.col(row) <= F.col("_last")).drop("_last")


def match_sheet(sheet: DataFrame, offers: DataFrame, row: str = "row_no") -> DataFrame:
    """Sheet rows (resolved, attribute form) with every offer that passes the predicate."""
    return match_variants(sheet, offers, [row], ["channel", "price", "raw", "seq"])


def sheet_best(sheet: DataFrame, matches: DataFrame, row: str = "row_no") -> DataFrame:
    """Minimum price, its first channel and line, and the number of offers per row."""
    best = matches.groupBy(row).agg(
        F.min("price").alias("min_price"),
        F.min_by(F.struct("channel", "raw"), F.struct("price", "seq")).alias("_b"),
        F.count(F.lit(1)).alias("n_offers"),
    )
    return sheet.join(best, row, "left").select(
        *sheet.columns, "min_price", F.col("_b.channel").alias("best_channel"), F.col("_b.raw").alias("best_raw"),
        F.coalesce("n_offers", F.lit(0)).alias("n_offers"),
    )


def sheet_summary(best: DataFrame, name: str = "name") -> DataFrame:
    named = F.coalesce(F.trim(name), F.lit("")) != ""
    return best.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(named).alias("rows_named"),
        F.count_if(named & F.col("min_price").isNotNull()).alias("rows_priced"),
        F.count_if(named & F.col("min_price").isNull()).alias("rows_unpriced"),
        F.sum("n_offers").alias("offers_total"),
    )


# ---------------------------------------------------------------- wildcards
def wildcard_match(rows: DataFrame, offers: DataFrame, model: str, fields: list[str], row_cols: list[str], offer_cols: list[str]) -> DataFrame:
    """Pairs of rows and offers of one model whose fields are equal wherever the row has a value; a row's null field fits every offer, null ones too.

    An offer stands under each subset of its fields, a row under the one subset it fills: an equality join, with 2 ** len(fields) rows an offer at most.
    Values compare without case and outer spaces.  Rows without a model match nothing.
    """
    norm = [F.coalesce(norm_value(F.col(c).cast("string")), F.lit("")) for c in fields]
    key = lambda mask, values: F.concat_ws("|", norm_value(F.col(model)), F.lit(str(mask)), *[v for i, v in enumerate(values) if mask >> i & 1])
    masks = range(1 << len(fields))
    filled = sum((F.when(v != "", 1 << i).otherwise(0) for i, v in enumerate(norm)), F.lit(0))
    own = F.coalesce(*[F.when(filled == m, key(m, norm)) for m in masks])
    left = rows.filter(norm_value(F.col(model)).isNotNull()).select(*row_cols, own.alias("_k"))
    right = offers.filter(norm_value(F.col(model)).isNotNull()).select(*offer_cols, F.explode(F.array(*[key(m, norm) for m in masks])).alias("_k"))
    return left.join(right, "_k").drop("_k")
