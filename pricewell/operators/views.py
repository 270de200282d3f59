"""Price views: drill-down, variant lines, model messages, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vocab as V
from ..functions.text import fmt_price
from .catalog import PATH, POSITIONS
from .publish import join_lines, with_region_prefix
from .windows import numbered


def models_under(catalog: DataFrame, path: list[str]) -> DataFrame:
    """Model leaves below a path with their order."""
    cond = [F.col(PATH[i]) == v for i, v in enumerate(path)]
    rows = catalog
    for c in cond:
        rows = rows.filter(c)
    return rows.groupBy(*PATH).agg(F.min(F.struct(*POSITIONS)).alias("model_order"))


def children(catalog: DataFrame, path: list[str]) -> DataFrame:
    """Next level below a path with its order."""
    rows = catalog
    for i, v in enumerate(path):
        rows = rows.filter(F.col(PATH[i]) == v)
    level = len(path)
    return rows.groupBy(F.col(PATH[level]).alias("child")).agg(F.min(POSITIONS[level]).alias("pos"))


def variant_line(title: str = "title", price: str = "min_price", channels: str = "best_channels", regions: str | None = "region_min"):
    """``flag title — price ₽ (channels)``; ``title — —`` without a price."""
    named = with_region_prefix(title, regions) if regions else F.col(title)
    who = F.array_join(F.filter(F.transform(F.col(channels), lambda s: F.trim(s)), lambda c: c != ""), ", ")
    return F.when(F.col(price).isNull(), F.concat(F.col(title), F.lit(" — —"))).otherwise(
        F.concat(named, F.lit(" — "), fmt_price(price), F.lit(" ₽"),
                 F.when(who != "", F.concat(F.lit(" ("), who, F.lit(")"))).otherwise(F.lit("")))
    )


def render_model_view(catalog: DataFrame, keys: list[str] | None = None, order: list[str] | None = None,
                      regions: str | None = "region_min", limit: int = V.VIEW_TEXT_LIMIT) -> DataFrame:
    """Breadcrumb and variant lines of each model: (keys, part_no, text), in as many parts as the message limit asks for.

    A part begins where the lines before it fill a multiple of the room: the limit without the breadcrumb and the longest line, so that none exceeds it.
    """
    keys, order = keys or PATH, order or ["variant_pos"]
    line = F.when(F.trim("title") == "", F.lit("")).otherwise(variant_line(regions=regions))
    head = F.concat(F.concat_ws(" / ", F.lit("📚 Каталог"), *keys), F.lit("\n\n"))
    of = Window.partitionBy(*keys)
    size = F.length("_line") + 1
    room = F.greatest(F.lit(limit) - F.length(head) - F.max(size).over(of), F.lit(1))
    before = F.sum(size).over(of.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - size
    lines = catalog.withColumn("_line", line).withColumn("part_no", F.floor(before / room).cast("int"))
    body = join_lines(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("_line")))), lambda x: x["_line"]))
    return lines.groupBy(*keys, "part_no").agg(body.alias("_body")).select(*keys, "part_no", F.concat(head, F.col("_body")).alias("text"))


def page_numbers(df: DataFrame, by: list[str], order: list, size: int = V.PAGE_SIZE, width: float | None = None) -> DataFrame:
    """Page and place on the page of every row of a menu (the children of one node).

    With ``width`` the single numeric order column is cut into buckets, for nodes
    with very many children.
    """
    if width is None:
        rows = df.withColumn("_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    else:
        rows = numbered(df, by, order[0], width, "_no")
    return rows.withColumns(
        {"page": F.floor((F.col("_no") - 1) / size).cast("int"), "place": ((F.col("_no") - 1) % size + 1).cast("int")}
    ).drop("_no")


def page(df: DataFrame, by: list[str], order: list, page_no: int, size: int = V.PAGE_SIZE) -> DataFrame:
    """One page; a page number outside the range is clamped."""
    paged = page_numbers(df, by, order, size)
    last = paged.groupBy(*by).agg(F.max("page").alias("_last"))
    return paged.join(last, by).filter(
        F.col("page") == F.greatest(F.least(F.lit(page_no), F.col("_last")), F.lit(0))
    ).drop("_last")


def priced_leaves(catalog: DataFrame) -> DataFrame:
    """Variants with a price, as offers."""
    return catalog.filter(F.col("min_price").isNotNull())


def catalog_completeness(catalog: DataFrame, variants: DataFrame) -> DataFrame:
    """Models and whether they have a variant list."""
    n = variants.filter(F.trim("title") != "").groupBy(*PATH).agg(F.count(F.lit(1)).alias("n_variants"))
    return catalog.select(*PATH).distinct().join(n, PATH, "left").withColumns(
        {"n_variants": F.coalesce("n_variants", F.lit(0)), "complete": F.col("n_variants").isNotNull()}
    )
