"""Publication plan: desired posts against existing ones, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vocab as V
from ..functions.attributes import region_of, regions_to_flags
from ..functions.text import fmt_price, post_titles
from .trees import chosen_rows


# ------------------------------------------------------------- path prefixes
path_prefix_match = chosen_rows


def toggle_path(spec: DataFrame, path: list[str], channel_id) -> DataFrame:
    """Removes a chosen path with its subtree, or adds it."""
    key = F.array(*[F.lit(x) for x in path])
    inside = (F.col("channel_id") == channel_id) & (F.slice("spec_path", 1, len(path)) == key)
    hit = spec.filter(inside).agg((F.count(F.lit(1)) > 0).alias("_hit"))
    new = hit.filter("NOT _hit").select(F.lit(channel_id).alias("channel_id"), key.alias("spec_path"))
    return spec.filter(~inside).unionByName(new)


# --------------------------------------------------------------------- order
def catalog_order(catalog: DataFrame, by: list[str], title: str, order: list[str]) -> DataFrame:
    """First occurrence of a repeated model in catalogue order."""
    rest = [c for c in catalog.columns if c not in (*by, title)]
    return catalog.groupBy(*by, title).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_m")).select(*by, title, "_m.*")


def swap_neighbour(df: DataFrame, keys: list[str], pos: str, target: Column, up: bool) -> DataFrame:
    """The chosen row and its neighbour exchange positions; positions are dense."""
    step = -1 if up else 1
    chosen = df.filter(target).select(*keys, F.col(pos).alias("_from"), (F.col(pos) + step).alias("_to"))
    ends = df.groupBy(*keys).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    ok = chosen.join(ends, keys).filter(F.col("_to").between(F.col("_lo"), F.col("_hi"))).select(*keys, "_from", "_to")
    return df.join(ok, keys, "left").withColumn(
        pos, F.when(F.col(pos) == F.col("_from"), F.col("_to")).when(F.col(pos) == F.col("_to"), F.col("_from")).otherwise(F.col(pos))
    ).select(*df.columns)


def order_breaks(plan: DataFrame, posts: DataFrame, by: list[str], model: list[str], pos: str = "pos", mid: str = "message_id") -> DataFrame:
    """Groups whose posted ids do not strictly increase in plan order, or miss one.

    Positions are dense inside a group, so the row before is an equality join on
    (group, pos - 1), which spreads a large group over all tasks.
    """
    with_mid = plan.join(posts.select(*model, mid), model, "left").select(*by, pos, mid)
    before = with_mid.select(*by, (F.col(pos) + 1).alias(pos), F.col(mid).alias("_before"), F.lit(True).alias("_there"))
    bad = F.col(mid).isNull() | (F.col("_there").isNotNull() & (F.col("_before") >= F.col(mid)))
    return (
        with_mid.join(before, [*by, pos], "left")
        .groupBy(*by).agg(F.bool_or(F.coalesce(bad, F.lit(True))).alias("needs_reset"), F.count(F.lit(1)).alias("n_posts"))
    )


def section_reset(sections: DataFrame, pos: str = "section_pos", by: list[str] | None = None) -> DataFrame:
    """Everything from the first section whose order breaks on is published anew.

    ``sections`` holds one aggregated row per section (few rows per channel).
    """
    by = by or []
    w = Window.partitionBy(*by).orderBy(pos)
    bad = F.col("min_mid").isNull() | (F.col("min_mid") <= F.col("_prev_max"))
    marked = sections.withColumn("_prev_max", F.lag("max_mid").over(w)).withColumn("_bad", F.coalesce(bad, F.lit(False)))
    start = F.min(F.when(F.col("_bad"), F.col(pos))).over(Window.partitionBy(*by))
    return marked.withColumn("_start", start).withColumn(
        "republish", F.coalesce(F.col(pos) >= F.col("_start"), F.lit(False))
    ).drop("_prev_max", "_bad", "_start")


# ----------------------------------------------------------------- rendering
def effective_template(template: DataFrame, priced: DataFrame, model: list[str]) -> DataFrame:
    """Template lines, then priced titles the template does not have, behind a blank line."""
    t = template.select(*model, F.lit(0).alias("block"), F.col("pos"), F.trim("title").alias("title"))
    extra = (
        priced.select(*model, F.lit(2).alias("block"), F.col("pos"), F.trim("title").alias("title")).filter("title <> ''")
        .join(t.select(*model, "title").distinct(), [*model, "title"], "left_anti")
    )
    gap = extra.select(*model).distinct().join(t.select(*model).distinct(), model, "left_semi").select(
        *model, F.lit(1).alias("block"), F.lit(0).cast("int").alias("pos"), F.lit("").alias("title")
    )
    return t.unionByName(gap.withColumn("pos", F.col("pos").cast(dict(t.dtypes)["pos"]))).unionByName(
        extra.withColumn("pos", F.col("pos").cast(dict(t.dtypes)["pos"]))
    )


def join_lines(ordered: Column) -> Column:
    """Lines to text: no blank line at either end, no two in a row."""
    text = F.array_join(ordered, "\n")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return F.regexp_replace(text, "^\n+|\n+$", "")


def with_region_prefix(title, regions, fallback=None) -> Column:
    """Flags of the winning regions before a title that names no region itself."""
    t = F.col(title) if isinstance(title, str) else title
    flags = F.nullif(regions_to_flags(F.col(regions)), F.lit(""))
    if fallback is not None:
        flags = F.coalesce(flags, F.nullif(regions_to_flags(F.col(fallback)), F.lit("")))
    return F.when(region_of(t).isNull() & flags.isNotNull(), F.concat_ws(" ", flags, t)).otherwise(t)


def model_regions(catalog: DataFrame, model: list[str], ties: list[str] | None = None) -> DataFrame:
    """Regions of the cheapest variant of a model that has any; variants of one price and title are taken in the order of ``ties``."""
    return (
        catalog.filter(F.size(F.coalesce("region_min", F.array().cast("array<string>"))) > 0).groupBy(*model)
        .agg(F.min_by("region_min", F.struct(F.col("min_price").isNull(), "min_price", "title", *(ties or []))).alias("model_region"))
    )


def render_posts(lines: DataFrame, keys: list[str], mode: str = "mode", order: list[str] | None = None,
                 price: str = "sell_price", title: str = "title") -> DataFrame:
    """One text per post.  Wholesale hides unpriced variants, retail keeps their titles.

    A post holds the variants of one model, so the gathered list is one message.
    """
    order = order or ["pos"]
    opt = F.lower(F.col(mode)) == "opt"
    blank = F.trim(title) == ""
    line = (
        F.when(blank, F.lit(""))
        .when(F.col(price).isNotNull(), F.concat(F.col(title), F.lit(" - "), fmt_price(price)))
        .when(~opt, F.col(title))
    )
    shown = lines.withColumn("_line", line)
    grouped = shown.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct(*order, "_line")))), lambda x: x["_line"]
        ).alias("_lines"),
        F.bool_or(~blank & F.col(price).isNotNull()).alias("_priced"), F.bool_or(opt).alias("_opt"),
    )
    text = F.nullif(join_lines(F.col("_lines")), F.lit(""))
    return grouped.select(
        *keys, F.when(F.col("_opt"), F.when(F.col("_priced"), text)).otherwise(F.coalesce(text, F.lit("—"))).alias("text")
    )


# ---------------------------------------------------------------------- plan
def map_models_to_posts(posts: DataFrame, models: DataFrame, by: list[str]) -> DataFrame:
    """Model -> post id, from the post's own model or its first known title."""
    titled = posts.select(*by, "message_id", "model", F.posexplode(F.when(
        F.col("model").isNotNull(), F.array("model")).otherwise(post_titles("text"))).alias("_p", "title"))
    known = titled.join(models.select(*by, F.col("model").alias("title")).distinct(), [*by, "title"], "left_semi")
    first = known.groupBy(*by, "message_id").agg(F.min_by("title", "_p").alias("model"), F.count_distinct("title").alias("n_models"))
    return first


def grouped_posts(mapped: DataFrame) -> DataFrame:
    """Old posts that hold more than one model."""
    return mapped.filter("n_models > 1")


def vanished_posts(cache: DataFrame, seen: DataFrame, by: list[str]) -> DataFrame:
    """Cached posts that are not in the channel any more."""
    return cache.join(seen.select(*by, "message_id").distinct(), [*by, "message_id"], "left_anti")


def obsolete_posts(posts: DataFrame, titles: DataFrame, desired: DataFrame, by: list[str]) -> DataFrame:
    """Posts of a known model that is not wanted any more."""
    known = posts.join(titles.select(F.col("title").alias("model")).distinct(), "model", "left_semi")
    return known.join(desired.select(*by, "model").distinct(), [*by, "model"], "left_anti")


def publication_plan(desired: DataFrame, posts: DataFrame, by: list[str], resets: DataFrame | None = None) -> DataFrame:
    """One action per desired or existing post.

    ``desired``: by, model, text, want_media; ``posts``: by, model, message_id,
    text, has_media; ``resets``: groups (by + any of model's columns) published anew.
    """
    d = desired.select(*by, "model", F.col("text").alias("new_text"), "want_media")
    p = posts.select(*by, "model", "message_id", F.col("text").alias("old_text"), "has_media")
    if resets is not None:
        d = d.join(resets.withColumn("_reset", F.lit(True)), [c for c in resets.columns], "left")
    else:
        d = d.withColumn("_reset", F.lit(False))
    j = d.join(p, [*by, "model"], "full_outer")
    wanted, posted = F.col("new_text").isNotNull(), F.col("message_id").isNotNull()
    action = (
        F.when(~wanted & posted, "delete")
        .when(~wanted, "skip")
        .when(posted & F.coalesce("_reset", F.lit(False)), "reset")
        .when(~posted, "create")
        .when(~F.col("has_media").eqNullSafe(F.col("want_media")), "switch_media")
        .when(~F.col("new_text").eqNullSafe(F.col("old_text")), "edit")
        .otherwise("skip")
    )
    return j.select(*by, "model", "message_id", "new_text", action.alias("action"))


def plan_counts(plan: DataFrame, by: list[str]) -> DataFrame:
    return plan.groupBy(*by, "action").agg(F.count(F.lit(1)).alias("n"))


def hide_plan(posts: DataFrame, channels: DataFrame, titles: DataFrame, by: list[str]) -> DataFrame:
    """Wholesale model posts that are not hidden yet."""
    opt = channels.filter(F.lower("type") == "opt").select(*by)
    return (
        posts.join(opt, by, "left_semi").join(titles.select(F.col("title").alias("model")).distinct(), "model", "left_semi")
        .filter(F.trim("text") != ".")
    )


def navigation(posts: DataFrame, by: list[str], pos: str = "pos", mid: str = "message_id", title: str = "model") -> DataFrame:
    """Menu rows: neighbours that share a post are one row ``A/B``.

    A run is a row whose predecessor has another post; dense positions make the
    predecessor an equality join, and runs meet by their post and run start.
    """
    before = posts.select(*by, (F.col(pos) + 1).alias(pos), F.col(mid).alias("_before"))
    starts = posts.join(before, [*by, pos], "left").withColumn("_start", ~F.col("_before").eqNullSafe(F.col(mid)))
    w = Window.partitionBy(*by, mid).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    runs = starts.withColumn("_run", F.max(F.when(F.col("_start"), F.col(pos))).over(w))
    return runs.groupBy(*by, mid, "_run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, title))), lambda x: x[title]), "/").alias("label"),
    ).withColumnRenamed("_run", "first_pos")


def menu_fingerprint(rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Digest of the title and of the label and link at each place of every menu.

    Two sums of row hashes that contain the place: they combine on the map side, so no menu is gathered as a list, and rows that change places change them.
    """
    row = [F.col(pos), F.col("label"), F.col("link").cast("string")]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(*keys).agg(
        F.sha2(F.concat_ws("\n", F.max("title"), total(1), total(2), F.count(F.lit(1)).cast("string")), 256).alias("fingerprint"), F.count("label").alias("n_rows"),
    )


def menu_changes(menus: DataFrame, posted: DataFrame, keys: list[str]) -> DataFrame:
    """create / edit / skip / delete per menu."""
    j = menus.alias("m").join(posted.select(*keys, F.col("fingerprint").alias("old"), "message_id"), keys, "full_outer")
    empty = F.coalesce("n_rows", F.lit(0)) == 0
    return j.select(
        *keys, "message_id",
        F.when(empty & F.col("message_id").isNotNull(), "delete").when(empty, "skip")
        .when(F.col("message_id").isNull(), "create")
        .when(F.col("fingerprint").eqNullSafe(F.col("old")), "skip").otherwise("edit").alias("action"),
    )


def due_channels(channels: DataFrame, now: Column, time_col: str, last_col: str) -> DataFrame:
    """Channels whose local minute has come and that have not run today."""
    local = F.from_utc_timestamp(now, V.LOCAL_ZONE)
    return channels.filter(
        (F.date_format(local, "HH:mm") == F.col(time_col)) & ~F.to_date(local).eqNullSafe(F.col(last_col))
    )


def read_posts_alive(posts: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Newest posts of a channel; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("message_id"))
    return posts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def lookup_with_default(df: DataFrame, table: DataFrame, keys: list[str], value: str, default_key: str = "default", out: str | None = None) -> DataFrame:
    """Value by the first key column that hits, else the table's default row.

    ``table``: (key, value).
    """
    result = df
    found = []
    for i, k in enumerate(keys):
        t = table.select(F.col("key").alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        result = result.join(t, F.col(k).cast("string") == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(F.col(f"_v{i}"))
    default = table.filter(F.col("key") == default_key).agg(F.first(value).alias("_vd"))
    return result.crossJoin(F.broadcast(default)).select(*df.columns, F.coalesce(*found, "_vd").alias(out or value))
