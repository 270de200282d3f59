"""From matches to the price catalogue and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.attributes import region_of
from ..functions.text import strip_ram, title_key
from .catalog import PATH


# -------------------------------------------------------------- winner index
def regions_at_min(offers: DataFrame, key: list[str], best: DataFrame, own_region: str | None = None) -> DataFrame:
    """Regions of the offers at the minimum price, in order of first appearance.

    One row per (variant, region) is left before regions are gathered, so the
    gathered list is no longer than the region vocabulary.
    """
    at_min = offers.join(best.select(*key, "min_price"), key).filter(F.col("price") == F.col("min_price"))
    # no filter on the region: it would move in front of the join and read every line
    firsts = at_min.groupBy(*key, region_of("raw").alias("_r")).agg(F.min("seq").alias("_seq"))
    found = F.collect_list(F.when(F.col("_r").isNotNull(), F.struct("_seq", "_r")))
    lists = firsts.groupBy(*key).agg(F.transform(F.array_sort(found), lambda x: x["_r"]).alias("_regions"))
    lists = lists.withColumn("_regions", F.when(F.size("_regions") > 0, F.col("_regions")))
    out = best.join(lists, key, "left")
    own = F.array_compact(F.array(F.col(own_region))) if own_region else F.array().cast("array<string>")
    return out.withColumn("region_min", F.coalesce("_regions", own)).drop("_regions")


def winner_index(items: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Per (path, title key): lowest price; channels of its first item; regions of all at that price.

    ``items``: path columns, title, min_price, best_channels, region_min, seq.
    """
    key = key or [*PATH, "title_key"]
    keyed = items if "title_key" in items.columns else items.withColumn("title_key", title_key("title"))
    keyed = keyed.filter(F.col("title_key") != "")
    heads = keyed.groupBy(*key, "min_price").agg(F.min_by("best_channels", "seq").alias("best_channels"), F.min("seq").alias("_seq"))
    best = heads.groupBy(*key).agg(
        F.min_by(F.struct("min_price", "best_channels"), F.struct(F.col("min_price").isNull(), "min_price")).alias("_m")
    ).select(*key, "_m.*")
    region = (
        keyed.select(*key, "min_price", "seq", F.posexplode("region_min").alias("_p", "_r"))
        .groupBy(*key, "min_price", "_r").agg(F.min(F.struct("seq", "_p")).alias("_o"))
        .groupBy(*key, "min_price")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_r"))), lambda x: x["_r"]).alias("region_min"))
    )
    return best.join(region, [*key, "min_price"], "left").select(
        *key, "min_price", "best_channels", F.coalesce("region_min", F.array().cast("array<string>")).alias("region_min")
    )


def price_lookup(variants: DataFrame, index: DataFrame, path: list[str] | None = None, title: str = "title") -> DataFrame:
    """Exact title key, else the key without RAM if only one index row has it."""
    path = path or PATH
    cols = [c for c in index.columns if c not in (*path, "title_key")]
    exact = index.select(*path, F.col("title_key").alias("_k"), F.struct(*cols).alias("_exact"))
    stripped = (
        index.withColumn("_k", strip_ram("title_key")).filter(F.col("_k") != F.col("title_key"))
        .groupBy(*path, "_k").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*cols)).alias("_one"))
        .filter("_n = 1").select(*path, "_k", "_one")
        .join(exact.select(*path, "_k"), [*path, "_k"], "left_anti")
        .select(*path, "_k", F.col("_one").alias("_exact"))
    )
    full = exact.unionByName(stripped)
    v = variants.withColumn("_k", title_key(title))
    v = v.withColumn("_k2", strip_ram("_k"))
    first = v.join(full, [*path, "_k"], "left")
    second = full.select(*path, F.col("_k").alias("_k2"), F.col("_exact").alias("_by_ram"))
    return (
        first.join(second, [*path, "_k2"], "left")
        .withColumn("_hit", F.coalesce("_exact", F.when(F.col("_k2") != F.col("_k"), F.col("_by_ram"))))
        .select(*variants.columns, *[F.col(f"_hit.{c}").alias(c) for c in cols])
    )


def price_catalog(variants: DataFrame, index: DataFrame) -> DataFrame:
    """Every catalogue variant with its price information or none."""
    return price_lookup(variants, index)


def price_tree(catalog: DataFrame) -> DataFrame:
    """JSON leaf per model for export: [(title, price, channels)] in catalogue order."""
    item = F.struct("variant_pos", "title", "min_price", "best_channels", "region_min")
    return catalog.groupBy(*PATH).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("leaf"))


def merge_tenant(base: DataFrame, own: DataFrame) -> DataFrame:
    """Base matches and a tenant's own matches together; own ones come later in order."""
    b = base.withColumn("seq", F.struct(F.lit(0).alias("part"), F.col("seq").alias("no")))
    o = own.withColumn("seq", F.struct(F.lit(1).alias("part"), F.col("seq").alias("no")))
    return winner_index(b.unionByName(o, allowMissingColumns=True))


def tenant_sources(own: DataFrame, tenants: DataFrame) -> DataFrame:
    """Which rows each tenant sees: its own (custom/own mode, if it has any), else the base.

    The base is not copied per tenant; readers follow ``source``.
    """
    have = own.select("tenant_id").distinct().withColumn("_own", F.lit(True))
    return tenants.join(have, "tenant_id", "left").select(
        "tenant_id", F.when((F.col("mode") != "default") & F.coalesce("_own", F.lit(False)), "own").otherwise("base").alias("source")
    )


def tenant_view(base: DataFrame, own: DataFrame, tenants: DataFrame, tenant_id) -> DataFrame:
    """The rows of one tenant."""
    mine = tenant_sources(own, tenants).filter(F.col("tenant_id") == tenant_id)
    key = lambda df, src: df.withColumn("source", F.lit(src)).join(mine.select("source"), "source", "left_semi")
    return key(own.filter(F.col("tenant_id") == tenant_id), "own").unionByName(key(base, "base"), allowMissingColumns=True)


# ----------------------------------------------------------------- summaries
def attribute_values(items: DataFrame, attrs: list[str]) -> DataFrame:
    """(attr, value, n) over the given attributes; one pass, combined on the map side."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attrs])
    return (
        items.select(F.inline(pairs)).filter("value IS NOT NULL AND value <> ''")
        .groupBy("attr", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def attribute_coverage(items: DataFrame, attrs: list[str]) -> DataFrame:
    """Rows, filled rows and distinct values per attribute."""
    total = items.agg(F.count(F.lit(1)).alias("n_rows"))
    per = attribute_values(items, attrs).groupBy("attr").agg(
        F.sum("n").alias("n_filled"), F.count(F.lit(1)).alias("n_distinct")
    )
    return per.crossJoin(F.broadcast(total))


def top_values(items: DataFrame, attrs: list[str], n: int) -> DataFrame:
    """The n commonest values of each attribute; the counts are aggregated first."""
    w = Window.partitionBy("attr").orderBy(F.desc("n"), F.asc("value"))
    return attribute_values(items, attrs).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def coverage_rollup(catalog: DataFrame, levels: list[str], priced: Column) -> DataFrame:
    """Variants and priced variants at every level of the hierarchy."""
    return catalog.rollup(*levels).agg(
        F.count(F.lit(1)).alias("n_variants"), F.count_if(priced).alias("n_priced"),
        F.grouping_id().cast("int").alias("level"),
    )


def subtree_priced(catalog: DataFrame, levels: list[str]) -> DataFrame:
    """Whether anything below each path has a price."""
    return coverage_rollup(catalog, levels, F.col("min_price").isNotNull()).withColumn("has_price", F.col("n_priced") > 0)


def catalog_counts(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count_distinct(*PATH).alias("n_models"), F.count(F.lit(1)).alias("n_variants"))


def model_titles(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.trim("model").alias("title")).filter("title <> ''").distinct()


def post_range(posts: DataFrame, by: list[str], mid: str = "message_id") -> DataFrame:
    return posts.filter(F.col(mid).isNotNull()).groupBy(*by).agg(F.min(mid).alias("min_mid"), F.max(mid).alias("max_mid"))


def doc_calendar(docs: DataFrame, date: str) -> DataFrame:
    """Days that have documents, with their number."""
    return docs.groupBy(F.year(date).alias("y"), F.month(date).alias("m"), F.dayofmonth(date).alias("d")).agg(
        F.count(F.lit(1)).alias("n_docs")
    )


def next_number(docs: DataFrame, no: str, start: int = 100) -> DataFrame:
    return docs.agg(F.greatest(F.coalesce(F.max(no) + 1, F.lit(start)), F.lit(start)).alias("next_no"))


def users_by_role(users: DataFrame) -> DataFrame:
    return users.groupBy("role").agg(F.count(F.lit(1)).alias("n_users"))


def run_stats(runs: DataFrame, last: int = 20) -> DataFrame:
    """Totals of the newest monitoring runs."""
    return (
        runs.groupBy("run_id").agg(
            F.count_distinct("channel").alias("sources"), F.count_distinct("channel", "message_id").alias("messages"),
            F.count("price").alias("prices"),
        ).orderBy(F.desc("run_id")).limit(last)
    )
