"""Catalogue tables: flattening, variants, alias and code indexes, maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import attributes as A, vocab as V
from ..functions.lines import rx
from ..functions.text import alias_key, clean_spaces, lit_array, lit_map, norm_key, null_if_empty, starts_with_tokens
from ..session import cut_lineage, shared_dir

PATH = ["cat", "brand", "series", "model"]
POSITIONS = ["cat_pos", "brand_pos", "series_pos", "model_pos"]
TREE_TYPE = "map<string,map<string,map<string,map<string,string>>>>"


# ------------------------------------------------------------------- reading
def flatten_catalog(trees: DataFrame, col: str = "tree") -> DataFrame:
    """JSON tree category > brand > series > model > [titles] to rows with positions.

    Map order becomes explicit positions, a scalar leaf becomes a list of one and
    malformed levels are skipped (they parse to NULL).
    """
    keep = [c for c in trees.columns if c != col]
    df = trees.withColumn("_n", F.from_json(col, TREE_TYPE))
    for level, name in enumerate(PATH):
        df = df.select(
            *keep, *[c for c in df.columns if c not in keep and c not in (col, "_n")],
            F.posexplode(F.map_entries("_n")).alias(POSITIONS[level], "_e"),
        )
        df = df.withColumn(name, F.col("_e.key")).withColumn("_n", F.col("_e.value")).drop("_e")
    titles = F.coalesce(F.from_json("_n", "array<string>"), F.array("_n"))
    return df.select(*keep, *PATH, *POSITIONS, F.posexplode(titles).alias("variant_pos", "title"))


def path_array(cols=PATH) -> Column:
    return F.array(*[F.col(c) for c in cols])


def path_key(cols=PATH) -> Column:
    """The path as one text, levels joined by a pipe; absent levels drop out."""
    return F.array_join(F.array_compact(F.array(*[null_if_empty(c) for c in cols])), "|")


def build_variants(catalog: DataFrame, phrases: tuple | None = None) -> DataFrame:
    """Catalogue titles with their attribute columns; separators are left out."""
    rows = catalog.filter(F.trim("title") != "")
    return A.with_attributes(
        rows, "title", cat="cat", brand="brand", series="series", model="model", catalog=True, phrases=phrases
    ).drop("price")


# ------------------------------------------------------------------- indexes
def canonical_model(brand="brand", series="series", model="model") -> Column:
    """Short or number-led model names get their series in front."""
    b, s, m = [clean_spaces(F.coalesce(F.col(c), F.lit(""))) for c in (brand, series, model)]
    bk, sk, mk = norm_key(b), norm_key(s), norm_key(m)
    mt, st = F.split(mk, " +"), F.split(sk, " +")
    first = F.element_at(mt, 1)
    named = ((sk != "") & F.contains(mk, sk)) | ((bk != "") & F.contains(mk, bk))
    repeated = rx(F.element_at(st, -1), r"^\d+$") & (first == F.element_at(st, -1)) & (F.size(mt) > 1)
    short = (F.size(mt) == 1) & (F.length(first) <= 4)
    numbered = (F.size(mt) == 2) & rx(first, r"^\d+$")
    rest = F.array_join(F.slice(mt, F.lit(2), F.greatest(F.size(mt), F.lit(1))), " ")
    with_series = clean_spaces(F.concat_ws(" ", s, m))
    return (
        F.when((mk == "") | named | (sk == ""), m)
        .when(repeated, clean_spaces(F.concat_ws(" ", s, rest)))
        .when(rx(first, r"^\d") | short | numbered, with_series)
        .otherwise(m)
    )


def _model_class() -> dict[str, Column]:
    """Device classes of a model row; used to reject wrong candidates."""
    ck, br = A.category_key("cat"), norm_key("brand")
    sr, md = norm_key(F.coalesce("series", F.lit(""))), norm_key("model")
    has = lambda w: F.contains(sr, F.lit(w)) | F.contains(md, F.lit(w))
    apple = br == "apple"
    yes = lambda c: F.coalesce(c, F.lit(False))
    return {
        "m_phone": yes((ck == "phones") | (apple & has("iphone"))),
        "m_phone_cat": yes(ck == "phones"),
        "m_tablet": yes((ck == "tablets") | has("pad")),
        "m_console": yes((ck == "consoles") & ~has("dualsense") & (has("ps5") | has("switch") | has("nintendo"))),
        "m_watch": yes(F.contains(norm_key("cat"), F.lit("watch")) | (apple & has("watch"))),
        "m_pencil": yes((ck == "accessories") & apple & has("pencil")),
        "m_earphone": yes(((ck == "headphones") | apple) & has("airpods")),
        "m_plus": yes(rx("model", r"(?i)\+|\bplus\b") | F.array_contains(F.split(F.concat_ws(" ", sr, md), " +"), "plus")),
        "m_toks": F.split(F.concat_ws(" ", sr, md), " +"),
        "m_brand": br,
    }


def models_of(catalog: DataFrame) -> DataFrame:
    """One row per model with its order, id and class columns."""
    order = F.struct(*[F.col(p) for p in POSITIONS])
    return (
        catalog.filter(F.coalesce(F.trim("model"), F.lit("")) != "")
        .groupBy(*PATH).agg(F.min(order).alias("model_order"))
        .withColumns({"model_id": path_key(), "canonical": canonical_model(), **_model_class()})
    )


def gen_aliases(models: DataFrame) -> DataFrame:
    """(model, rule_no, alias): names a seller may use for a model.

    The rules are data: a guard, and the alias expression that holds under it.
    """
    m, s, b = clean_spaces("model"), clean_spaces(F.coalesce("series", F.lit(""))), clean_spaces(F.coalesce("brand", F.lit("")))
    mk, sk, bk, ck = norm_key(m), norm_key(s), norm_key(b), norm_key("cat")
    ml = F.lower(m)
    sub = lambda pattern, to, base=m: F.regexp_replace(base, pattern, to)
    pre = lambda text, base=m: F.concat(F.lit(text), base)
    shared = F.arrays_overlap(F.split(sk, " +"), F.split(mk, " +"))
    anchored = F.element_at(F.split(mk, " +"), 1).isin(*V.ANCHOR_WORDS)
    iphone = F.contains(ml, F.lit("iphone"))
    samsung, apple = bk == "samsung", bk == "apple"
    tab = samsung & F.contains(F.concat_ws(" ", sk, mk), F.lit("galaxy tab"))
    fold = F.regexp_extract(F.replace(m, F.lit(" ")), r"(?i)^z(fold|flip)\d{1,2}$", 1)
    fold_no = F.regexp_extract(F.replace(m, F.lit(" ")), r"(?i)^z(?:fold|flip)(\d{1,2})$", 1)
    fold_name = F.concat_ws(" ", F.initcap(fold), fold_no)
    case_bucket = F.contains(ck, F.lit("аксесс")) | rx(F.concat_ws(" ", sk, mk), "чехл|case")
    sony_ps5 = (bk == "sony") & (sk == "ps5")
    watch = apple & F.contains(F.concat_ws(" ", sk, mk), F.lit("watch"))
    station = (bk == "яндекс") & F.contains(m, F.lit("Яндекс.Станция"))
    roman = {1: "i", 2: "ii", 3: "iii", 4: "iv", 5: "v", 6: "vi", 7: "vii", 8: "viii", 9: "ix", 10: "x"}
    to_arabic = m
    to_roman = m
    for n in sorted(roman, reverse=True):
        to_arabic = F.regexp_replace(to_arabic, rf"(?i)\b{roman[n]}\b", str(n))
        to_roman = F.regexp_replace(to_roman, rf"\b{n}\b", roman[n].upper())
    major = F.contains(ml, F.lit("major"))
    always = F.lit(True)
    rules: list[tuple[Column, Column]] = [
        (always, m),
        (rx(m, r"\S+ \S.*\b20\d{2}$"), sub(r"\b20\d{2}$", "")),
        (major, to_arabic),
        (major, to_roman),
        (F.contains(m, F.lit("+")), sub(r"\+", " plus ")),
        (starts_with_tokens(b, m), F.substring(m, F.length(b) + 1, F.length(m))),
        (starts_with_tokens(s, m), F.substring(m, F.length(s) + 1, F.length(m))),
        ((s != "") & ~F.contains(mk, sk) & ~shared & ~anchored, F.concat_ws(" ", s, m)),
        (iphone, F.replace(ml, F.lit("iphone"), F.lit(""))),
        (iphone & F.contains(ml, F.lit("pro max")), F.replace(ml, F.lit("pro max"), F.lit("pm"))),
        (iphone & F.contains(ml, F.lit("pro max")), F.replace(ml, F.lit("pro max"), F.lit("p m"))),
        *[(case_bucket, F.lit(t)) for t in ("iphone case", "case for iphone", "iphone rugged case", "rugged case iphone",
                                            "iphone protective case", "protective case iphone")],
        (apple & F.contains(sk, F.lit("iphone")) & rx(m, r"(?i)\bair\b"), F.lit("iPhone Air")),
        (apple & F.contains(F.concat_ws(" ", sk, mk), F.lit("ipad air")) & rx(m, r"\b(11|13)\b"),
         F.concat(F.lit("iPad Air "), F.regexp_extract(m, r"\b(11|13)\b", 1))),
        (samsung & F.contains(sk, F.lit("galaxy s")) & rx(m, r"(?i)^s\d{2,3}(\s*(ultra|plus|edge|fe))?$"), pre("Galaxy ")),
        (samsung & F.contains(sk, F.lit("galaxy s")) & rx(m, r"(?i)^s\d{2,3}\s+plus$"), sub(r"(?i)\s+plus$", "+")),
        (samsung & F.contains(sk, F.lit("galaxy s")) & rx(m, r"(?i)^s\d{2,3}\s+plus$"), pre("Galaxy ", sub(r"(?i)\s+plus$", "+"))),
        (samsung & (sk == "galaxy a") & rx(m, r"(?i)^a\d{2,3}[a-z]?$"), pre("Galaxy ")),
        (tab & F.contains(m, F.lit("Galaxy Tab")), sub("Galaxy Tab", "Tab")),
        (tab & F.contains(m, F.lit("Galaxy Tab")) & F.contains(m, F.lit("+")), sub(r"\+", " Plus", sub("Galaxy Tab", "Tab"))),
        (tab & ~F.contains(m, F.lit("Galaxy Tab")) & F.startswith(sk, F.lit("galaxy tab")), pre("Tab ")),
        *[(fold != "", F.concat(F.lit(p), fold_name)) for p in ("Z ", "")],
        *[(fold != "", F.concat(F.lit(p), F.replace(fold_name, F.lit(" ")))) for p in ("", "Z ")],
        *[((fold != "") & samsung & F.contains(sk, F.lit("galaxy")), F.concat(F.lit(p), fold_name)) for p in ("Galaxy Z ", "Galaxy ")],
        *[(sony_ps5, F.lit(p + t)) for p in ("PS 5", "PS5") for t in ("", " Pro", " Pro Digital", " Slim", " Slim Disc", " Slim Digital", " Digital Slim")],
        *[(sony_ps5, F.lit(t)) for t in ("PlayStation 5", "Play Station 5", "Sony PS 5", "Sony PS5")],
        *[((bk == "meta") & F.contains(mk, F.lit("oculus quest")), sub(r"(?i)oculus\s+quest", t)) for t in ("Meta Quest", "Quest")],
        *[(station, sub(r"Яндекс\.Станция", t)) for t in ("Яндекс Станция", "Станция", "Яндекс")],
        (station, sub("Мини 3 Про", "Мини Про")),
        (station, sub("Мини 3", "Мини")),
        (bk == "poco", F.concat_ws(" ", b, m)),
        (apple & (sk == "pencil"), F.concat_ws(" ", b, s)),
        (apple & (sk == "airpods"), sub("Air[Pp]ods", "Air Pods")),
        *[(watch & rx(ml, r"series \d{1,2}\b"), F.concat(F.lit(p), F.regexp_extract(ml, r"series (\d{1,2})\b", 1)))
          for p in ("Watch S", "Apple Watch S", "AW S", "Series ")],
        *[(watch & rx(ml, r"\bse\s*2\b"), F.lit(t)) for t in ("Watch SE2", "Apple Watch SE2", "AW SE2", "Watch SE 2", "Apple Watch SE 2", "AW SE 2")],
        *[((bk == "whoop") & (sk == "whoop 50"), F.lit("Whoop " + t)) for t in ("Life", "Peak", "One")],
        ((bk == "whoop") & (sk == "whoop 50"), sub(r"Whoop 5\.0", "Whoop")),
    ]
    made = F.array(*[
        F.when(guard, F.struct(F.lit(i).alias("rule_no"), clean_spaces(expr).alias("alias")))
        for i, (guard, expr) in enumerate(rules)
    ])
    out = models.withColumn("_a", F.explode(F.array_compact(made))).select(
        *models.columns, F.col("_a.rule_no").alias("rule_no"), F.col("_a.alias").alias("alias")
    )
    return out.withColumn("alias_key", alias_key("alias")).filter(F.col("alias_key") != "")


def alias_is_safe() -> Column:
    """Generic words, bare numbers, chips and lost pluses make no alias."""
    toks = F.split("alias_key", " ")
    first, n = F.element_at(toks, 1), F.size(toks)
    generic = lit_array(V.GENERIC_ALIAS_WORDS)
    roman = "i|ii|iii|iv|v|vi|vii|viii|ix|x"
    single = (n == 1) & ~F.col("alias_key").isin(*V.STANDALONE_ALIASES)
    chip = F.exists(toks, lambda t: rx(t, "^m[1-5]$")) & ~F.arrays_overlap(toks, lit_array(["mac", "macbook", "imac", "ipad"]))
    pro_form = rx("alias_key", "(^| )pro (xl|fold)$") & ~F.arrays_overlap(toks, lit_array(["pixel", "galaxy"]))
    lost_plus = rx("model", r"(?i)\+| plus") & ~rx("alias", r"(?i)\+| plus")
    return ~(
        F.array_contains(generic, first)
        | single
        | rx("alias_key", r"^\d+ (pro|max|plus)$")
        | rx("alias_key", rf"^\S+ ({roman})$")
        | chip | pro_form | lost_plus
    )


def forced_aliases(models: DataFrame, safe: DataFrame) -> DataFrame:
    """Long aliases for models none of whose aliases is safe."""
    bare = models.join(safe.select("model_id").distinct(), "model_id", "left_anti")
    cand = F.array_compact(F.array(
        F.col("canonical"),
        F.concat_ws(" ", null_if_empty("series"), "model"),
        F.concat_ws(" ", null_if_empty("brand"), null_if_empty("series"), "model"),
        F.concat_ws(" ", null_if_empty("cat"), null_if_empty("series"), "model"),
    ))
    return (
        bare.select(*bare.columns, F.posexplode(cand).alias("_p", "alias"))
        .withColumns({"rule_no": F.col("_p") + 1000, "alias_key": alias_key("alias")})
        .drop("_p").filter(F.col("alias_key") != "")
    )


_META = ["model_id", "canonical", *PATH, "m_phone", "m_phone_cat", "m_tablet", "m_console", "m_watch", "m_pencil",
         "m_earphone", "m_plus", "m_toks", "m_brand"]


def _first_writer(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: the earliest model in catalogue order, then the lowest rule."""
    return (
        rows.groupBy(key)
        .agg(
            F.min_by(F.struct(*_META, "alias", "rule_no"), F.struct("model_order", "rule_no")).alias("_m"),
            F.count_distinct("model_id").alias("n_models"),
        )
        .select(key, "_m.*", "n_models")
    )


def _with_forced(models: DataFrame, safe: DataFrame) -> DataFrame:
    forced = forced_aliases(models, safe)
    # a forced alias must be free; the first free one of a model is taken
    free = forced.join(safe.select("alias_key").distinct(), "alias_key", "left_anti")
    one = free.groupBy("model_id").agg(F.min_by(F.struct(*free.columns), "rule_no").alias("_m")).select("_m.*")
    return safe.unionByName(one)


def alias_candidates(catalog: DataFrame) -> DataFrame:
    models = models_of(catalog)
    return _with_forced(models, gen_aliases(models).filter(alias_is_safe()))


def build_alias_index(catalog: DataFrame) -> DataFrame:
    """alias_key -> model; the first writer wins."""
    return _first_writer(alias_candidates(catalog), "alias_key")


def alias_collisions(catalog: DataFrame) -> DataFrame:
    """Alias keys claimed by more than one model."""
    return build_alias_index(catalog).filter("n_models > 1").select("alias_key", "model_id", "n_models")


def build_code_index(variants: DataFrame) -> DataFrame:
    """SKU code -> model; the first path wins."""
    coded = variants.filter(F.coalesce(F.trim("code"), F.lit("")) != "").select(*PATH, *POSITIONS, F.upper(F.trim("code")).alias("sku"))
    models = models_of(variants)
    rows = coded.join(models, PATH).withColumns({"alias": F.col("sku"), "rule_no": F.lit(0)})
    return _first_writer(rows.select("sku", *_META, "model_order", "alias", "rule_no"), "sku")


def build_id(df: DataFrame, cols: list[str]) -> DataFrame:
    """Order-free content hash of a table, stored beside an index to tell when it is stale."""
    h = F.xxhash64(*cols)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor(h).alias("hash_xor"),
        F.sum(F.pmod(h, F.lit(1000003))).alias("hash_sum"),
    ).withColumn("build_id", F.sha1(F.concat_ws(":", "n_rows", "hash_xor", "hash_sum")))


def is_stale(index_id: DataFrame, current: DataFrame) -> DataFrame:
    return index_id.select(F.col("build_id").alias("_old")).crossJoin(current.select("build_id")).select(
        "build_id", (~F.col("_old").eqNullSafe(F.col("build_id"))).alias("stale")
    )


# --------------------------------------------------------------- maintenance
def short_ids(catalog: DataFrame, cols=PATH) -> DataFrame:
    """First 8 hex digits of the md5 of the path."""
    return catalog.withColumn("short_id", F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8))


def short_id_collisions(ids: DataFrame, cols=PATH) -> DataFrame:
    return (
        ids.groupBy("short_id").agg(F.count_distinct(*cols).alias("n_paths")).filter("n_paths > 1")
    )


def apply_edits(catalog: DataFrame, edits: DataFrame, level: str) -> DataFrame:
    """Rename, delete or add nodes of one level; a rename moves the node to the end.

    ``edits``: (action, key path up to the level as columns, new_name).
    """
    n = PATH.index(level) + 1
    keys, pos = PATH[:n], POSITIONS[n - 1]
    rename = edits.filter("action = 'rename'").select(*keys, "new_name")
    delete = edits.filter("action = 'delete'").select(*keys)
    kept = catalog.join(delete, keys, "left_anti")
    end = catalog.agg((F.max(pos) + 1).alias("_end"))
    moved = (
        kept.join(rename, keys, "left").crossJoin(end)
        .withColumn(pos, F.when(F.col("new_name").isNotNull(), F.col(pos) + F.col("_end")).otherwise(F.col(pos)))
        .withColumn(level, F.coalesce("new_name", level))
        .select(*catalog.columns)
    )
    added = edits.filter("action = 'add'").select(*keys).crossJoin(end).withColumn(pos, F.col("_end"))
    return moved.unionByName(added.select(*keys, pos), allowMissingColumns=True)


def replace_variants(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """The variant list of the models in ``rows`` is replaced; positions come with the rows."""
    models = rows.select(*PATH).distinct()
    places = catalog.groupBy(*PATH).agg(*[F.min(p).alias(p) for p in POSITIONS])
    new = rows.join(places, PATH, "left")
    return catalog.join(models, PATH, "left_anti").unionByName(new.select(*catalog.columns))


def catalog_skeleton(variants: DataFrame) -> DataFrame:
    """Distinct paths that have at least one real variant."""
    return variants.filter(F.trim("title") != "").select(*PATH).distinct()


def reorder_catalog(catalog: DataFrame, orders: dict[str, DataFrame]) -> DataFrame:
    """New position of each level from another tree; unknown keys keep their own order behind.

    ``orders`` maps a level to (level value, new_pos).
    """
    out = catalog
    for level, order in orders.items():
        pos = POSITIONS[PATH.index(level)]
        new = order.select(F.col(level).alias("_k"), F.col("new_pos").alias("_np"))
        out = (
            out.join(new, F.col(level) == F.col("_k"), "left")
            .withColumn(f"{level}_rank", F.struct(F.col("_np").isNull().alias("last"), F.coalesce("_np", pos).alias("pos")))
            .drop("_k", "_np")
        )
    return out


def upsert_users(users: DataFrame, updates: DataFrame, key: str = "user_id") -> DataFrame:
    """Merge profiles; rows that do not change are left as they are."""
    cols = [c for c in users.columns if c != key]
    new = updates.select(key, *[F.col(c).alias("_" + c) for c in cols])
    merged = users.join(new, key, "full_outer")
    present = F.coalesce(*[F.col("_" + c).cast("string") for c in cols]).isNotNull()
    changed = present & ~F.struct(*cols).eqNullSafe(F.struct(*[F.coalesce("_" + c, c).alias(c) for c in cols]))
    return merged.select(
        key, *[F.coalesce("_" + c, c).alias(c) for c in cols], F.coalesce(changed, F.lit(False)).alias("changed")
    )


def normalize_access(users: DataFrame, defaults: dict[str, dict[str, bool]], legacy: dict[str, str]) -> DataFrame:
    """Access map: defaults of the role, then the stored flags under their present names."""
    role_map = F.create_map(*[
        x for role, d in defaults.items()
        for x in (F.lit(role), F.create_map(*[F.lit(y) for kv in d.items() for y in kv]))
    ])
    names = lit_map(legacy)
    stored = F.transform_keys("access", lambda k, v: F.coalesce(F.try_element_at(names, k), k))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<boolean>"))
    base = F.map_filter(
        F.coalesce(F.try_element_at(role_map, F.col("role")), empty), lambda k, v: ~F.map_contains_key(stored, k)
    )
    return users.withColumn("access", F.map_concat(base, F.coalesce(stored, empty)))


def apply_blocklist(stream: DataFrame, edits: DataFrame, user: str = "username") -> DataFrame:
    """``@add`` / ``-@remove`` tokens; the later edit of a name decides; blocked users drop out."""
    return stream.join(blocklist(edits).withColumnRenamed("name", user), user, "left_anti")


def blocklist(edits: DataFrame) -> DataFrame:
    """Current block list from (seq, text) edits."""
    toks = edits.select("seq", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("_p", "tok"))
    named = toks.filter(rx("tok", r"^-?@\w+$")).select(
        F.lower(F.regexp_replace("tok", "^-?@", "")).alias("name"), F.struct("seq", "_p").alias("_o"),
        F.startswith("tok", F.lit("-")).alias("removed"),
    )
    last = named.groupBy("name").agg(F.max_by("removed", "_o").alias("removed"))
    return last.filter(~F.col("removed")).select("name")


def fanout_plan(chats: DataFrame) -> DataFrame:
    """Chats per account with the counts per status."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return chats.groupBy("account").agg(F.count(F.lit(1)).alias("chats"), n("sent"), n("failed"), n("skipped"))


# ----------------------------------------------------------------- edit logs
def replay_edits(nodes: DataFrame, edits: DataFrame, by: list[str]) -> DataFrame:
    """``nodes`` (by, name) with ``final`` and ``n_edits`` after a log of edits (by, seq, action, name, new_name) in order of ``seq``.

    An edit meets whatever bears its name at its time, so renames chain: A to B, then B to C, then C deleted.  Each rename points to the next edit of the
    name it gives; pointers are doubled until none is left to follow, so the rounds follow the logarithm of the longest chain.  A deleted node has a null
    ``final``; a rename to a name in use joins the two nodes; edits of unknown names do nothing.
    """
    log = cut_lineage(edits.select(*by, "seq", "name", F.when(F.col("action") == "rename", F.col("new_name")).alias("to")))
    edit = log.select(*by, F.col("name").alias("_n"), "seq", F.lit(True).alias("_edit"), F.lit(None).cast("string").alias("_from"))
    named = log.filter("to IS NOT NULL").select(*by, F.col("to").alias("_n"), "seq", F.lit(False).alias("_edit"), F.lit(None).cast("string").alias("_from"))
    # The next edit of a name after each time it was given.
    later = Window.partitionBy(*by, "_n").orderBy("seq", F.desc("_edit")).rowsBetween(1, Window.unboundedFollowing)
    following = edit.unionByName(named).withColumn("next", F.first(F.when(F.col("_edit"), F.col("seq")), ignorenulls=True).over(later)).filter("NOT _edit")
    jump = log.join(following.select(*by, "seq", "next"), [*by, "seq"], "left").select(*by, "seq", "to", "next", F.lit(1).cast("long").alias("n"))
    home, turn = f"{shared_dir(nodes.sparkSession)}/edits-{uuid.uuid4().hex}", 0
    while True:
        # A written table has a size of its own; a checkpoint keeps the estimate of its plan, which squares with every self-join.
        jump.write.parquet(f"{home}/{turn}")
        jump, turn = nodes.sparkSession.read.parquet(f"{home}/{turn}"), turn + 1
        if jump.filter("next IS NOT NULL").isEmpty():
            break
        ahead = jump.select(*by, F.col("seq").alias("next"), F.col("to").alias("_to"), F.col("next").alias("_next"), F.col("n").alias("_n"))
        moved = F.col("_n").isNotNull()
        jump = jump.join(ahead, [*by, "next"], "left").select(
            *by, "seq", F.when(moved, F.col("_to")).otherwise(F.col("to")).alias("to"), F.when(moved, F.col("_next")).alias("next"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
    first = log.groupBy(*by, "name").agg(F.min("seq").alias("seq"))
    out = nodes.join(first, [*by, "name"], "left").join(jump.select(*by, "seq", F.col("to").alias("_end"), "n"), [*by, "seq"], "left")
    return out.select(*nodes.columns, F.when(F.col("n").isNull(), F.col("name")).otherwise(F.col("_end")).alias("final"), F.coalesce("n", F.lit(0)).alias("n_edits"))


# --------------------------------------------------------- incremental index
def index_state(catalog: DataFrame, before: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(models, aliases) an alias index is made from, each model with a digest of its own.

    With the state ``before``, aliases are generated for models whose digest is new or has changed alone; those of the others are taken over and those of
    models that are gone dropped.  A place in the catalogue is no part of the digest: it comes from the catalogue each time.
    """
    models = models_of(catalog)
    own = [c for c in models.columns if c != "model_order"]
    models = models.withColumn("digest", F.xxhash64(*own))
    if before is None:
        safe = gen_aliases(models).filter(alias_is_safe())
        return cut_lineage(models), cut_lineage(safe)
    old_models, old_safe = before
    known = old_models.select("model_id", "digest")
    fresh = models.join(known, ["model_id", "digest"], "left_anti")
    kept = old_safe.drop("model_order").join(models.select("model_id", "digest", "model_order"), ["model_id", "digest"])
    made = gen_aliases(fresh).filter(alias_is_safe())
    return cut_lineage(models), cut_lineage(kept.select(made.columns).unionByName(made))


def index_of_state(models: DataFrame, safe: DataFrame) -> DataFrame:
    """The alias index of a state; the first writer of a key is settled over all models, so that collisions follow additions and removals."""
    return _first_writer(_with_forced(models, safe), "alias_key")
