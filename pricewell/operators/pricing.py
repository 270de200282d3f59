"""Sell prices: margin bands, channel mark-up, overrides and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import money as M
from ..functions.text import null_if_empty
from .trees import nearest_mark, path_key, path_prefixes


def price_variants(df: DataFrame, cost: str = "min_price") -> DataFrame:
    """The three prices of a cost: as is, wholesale, retail."""
    return df.withColumns(
        {"price_min": M.price_min(cost), "price_opt": M.price_opt(M.price_min(cost)), "price_retail": M.price_retail(M.price_min(cost))}
    )


def resolve_channel_rule(channels: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule by channel id, else by name, else the default; the channel type is the last mode.

    ``rules``: (rule_key, mode, base_mode, pct, flat, round_step); the key 'default' is the fall-back.
    """
    fields = ["mode", "base_mode", "pct", "flat", "round_step"]
    r = rules.select(F.lower(F.trim("rule_key")).alias("_k"), F.struct(*fields).alias("_r"))
    by_id = r.select(F.col("_k").alias("_kid"), F.col("_r").alias("_rid"))
    by_name = r.select(F.col("_k").alias("_kname"), F.col("_r").alias("_rname"))
    default = r.filter("_k = 'default'").agg(F.first("_r").alias("_rdef"))
    out = (
        channels.withColumns({"_kid": F.lower(F.col("channel_id").cast("string")), "_kname": F.lower(F.trim("name"))})
        .join(by_id, "_kid", "left").join(by_name, "_kname", "left").crossJoin(F.broadcast(default))
        .withColumn("_r", F.coalesce("_rid", "_rname", "_rdef"))
    )
    return out.select(
        *channels.columns,
        F.coalesce(null_if_empty("_r.mode"), null_if_empty("type"), F.lit("opt")).alias("mode"),
        *[F.col(f"_r.{f}").alias(f) for f in fields[1:]],
    )


def resolve_markup(df: DataFrame, overrides: DataFrame, path: str = "path", nearest: bool = True) -> DataFrame:
    """Mark-up of a row: the override of its path, else of its nearest ancestor, else the channel default.

    Any depth; ``nearest=False`` looks at the full path only.  ``overrides``: (channel_id, path_key, value).
    """
    if nearest:
        out = nearest_mark(df, overrides, ["channel_id"], path, out="_v")
    else:
        own = overrides.groupBy("channel_id", F.col("path_key").alias("_key")).agg(F.max("value").alias("_v"))
        out = df.withColumn("_key", path_key(path)).join(own, ["channel_id", "_key"], "left")
    return out.select(*df.columns, F.coalesce("_v", "markup_default", F.lit(0.0)).alias("markup"))


def apply_markup(df: DataFrame, price: str = "min_price", out: str = "sell_price") -> DataFrame:
    """Needs mode, markup_type, markup, and optionally base_mode and round_step columns."""
    pct = F.when(F.col("markup_type") == "pct", F.col("markup") / 100.0)
    flat = F.when(F.col("markup_type") == "flat", F.col("markup"))
    step = F.coalesce("round_step", F.lit(0)) if "round_step" in df.columns else F.lit(0)
    absolute = (F.lower("base_mode") == "absolute") if "base_mode" in df.columns else F.lit(False)
    return df.withColumn(out, M.channel_price(price, F.col("mode"), pct=pct, flat=flat, step=step, absolute=absolute))


def pricing_ready(channels: DataFrame, overrides: DataFrame) -> DataFrame:
    """Custom pricing needs a default or at least one override."""
    some = overrides.select("channel_id").distinct().withColumn("_some", F.lit(True))
    return (
        channels.join(some, "channel_id", "left")
        .filter(~F.coalesce("pricing_custom", F.lit(False)) | F.col("markup_default").isNotNull() | F.coalesce("_some", F.lit(False)))
        .drop("_some")
    )


def markup_summary(catalog: DataFrame, overrides: DataFrame, path: str = "path") -> DataFrame:
    """Per channel and node: its own value, else the least of its subtree, marked ``from``."""
    nodes = catalog.select(F.explode(path_prefixes(F.col(path))).alias("_n")).select("_n.key", "_n.depth").distinct()
    above = overrides.select("channel_id", "value", F.explode(path_prefixes(F.split("path_key", r"\|"))).alias("_n"),
                             F.col("path_key")).select("channel_id", "value", "path_key", F.col("_n.key").alias("key"))
    agg = above.groupBy("channel_id", "key").agg(
        F.max(F.when(F.col("path_key") == F.col("key"), F.col("value"))).alias("exact"),
        F.min("value").alias("least"), F.count_distinct("value").alias("n_values"),
    )
    return nodes.join(agg, "key").select(
        "channel_id", "key", F.coalesce("exact", "least").alias("value"), F.col("exact").isNull().alias("is_from"), "n_values"
    )


def with_channel_defaults(channels: DataFrame) -> DataFrame:
    """Settings a channel has when nothing was chosen."""
    defaults = {
        "type": F.lit("opt"), "text_mode": F.lit("default"), "round_prices": F.lit(False), "pricing_custom": F.lit(False),
        "markup_type": F.lit("pct"), "markup_default": F.lit(None).cast("double"), "publish_time": F.lit(None).cast("string"),
        "hide_time": F.lit(None).cast("string"), "announce_time": F.lit(None).cast("string"),
    }
    cols = {c: (F.coalesce(F.col(c), d) if c in channels.columns else d) for c, d in defaults.items()}
    out = channels.withColumns(cols)
    image = F.col("type") == "retail"
    return out.withColumn("with_images", F.coalesce("with_images", image) if "with_images" in channels.columns else image)
