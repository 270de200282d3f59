"""Table scans.  Every reader takes an explicit schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..functions.money import coerce_price
from ..functions.text import null_if_empty
from ..operators.windows import top_per_group


def _scan(spark: SparkSession, path: str, schema: str, fmt: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    reader = reader.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_messages(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Messages with text; blank ones are dropped."""
    df = _scan(spark, path, S.MESSAGES, fmt, stream, files_per_trigger)
    return df.filter(F.trim("message") != "")


def last_messages(messages: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` messages of each source; each task passes on at most so many rows of a source."""
    return top_per_group(messages, ["channel"], [F.desc("message_id")], limit)


def read_new_messages(messages: DataFrame, seen: DataFrame, limit: int | None = None) -> DataFrame:
    """All messages above the last seen id of their source; with ``limit`` the oldest so many of each, the rest with the next poll.

    ``seen``: (channel, message_id) of what was already read.
    """
    marks = seen.groupBy("channel").agg(F.max("message_id").alias("_last"))
    new = messages.join(marks, "channel", "left").filter(F.col("message_id") > F.coalesce("_last", F.lit(0))).drop("_last")
    return new if limit is None else top_per_group(new, ["channel"], [F.asc("message_id")], limit)


_SOURCE_ITEM = "array<struct<channel_id:bigint,name:string,username:string,account:string,user_id:bigint,type:string>>"


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source registry in any of its three layouts: channels/bots, items, bare list."""
    raw = spark.read.text(path, wholetext=True)
    doc = lambda p: F.from_json(F.get_json_object("value", p), _SOURCE_ITEM)
    bare = F.from_json(F.when(F.startswith(F.trim("value"), F.lit("[")), F.col("value")), _SOURCE_ITEM)
    empty = F.array().cast(_SOURCE_ITEM)
    typed = lambda items, kind: F.transform(
        F.coalesce(items, empty),
        lambda x: F.struct(F.coalesce(null_if_empty(x["type"]), F.lit(kind)).alias("source_type"), x["channel_id"].alias("channel_id"),
                           x["name"].alias("name"), x["username"].alias("username"), x["account"].alias("account"),
                           x["user_id"].alias("user_id")))
    rows = F.concat(typed(doc("$.channels"), "channel"), typed(doc("$.bots"), "bot"), typed(doc("$.items"), "channel"), typed(bare, "channel"))
    return raw.select(F.inline(rows))


def visible_sources(sources: DataFrame, tenant_id: int | None, mode: str = "default") -> DataFrame:
    """Default sources, or a tenant's own ones."""
    if mode == "default" or tenant_id is None:
        return sources.filter("user_id IS NULL")
    if mode == "own":
        return sources.filter(F.col("user_id") == tenant_id)
    return sources.filter(F.col("user_id").isNull() | (F.col("user_id") == tenant_id))


def search_sources(dialogs: DataFrame, query: str, sources: DataFrame) -> DataFrame:
    """Dialogs whose title or user name holds the text and which are not registered yet."""
    q = F.lower(F.trim(F.lit(query.lstrip("@"))))
    hit = F.contains(F.lower(F.coalesce("title", F.lit(""))), q) | F.contains(F.lower(F.coalesce("username", F.lit(""))), q)
    return dialogs.filter(hit).join(sources.select("channel_id").distinct(), "channel_id", "left_anti")


def read_items(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """Item artefacts: typed Parquet, or legacy JSON as a list or under ``items``."""
    if path.endswith(".json"):
        raw = spark.read.text(path, wholetext=True)
        kind = f"array<struct<{item_schema}>>"
        items = F.coalesce(F.from_json(F.get_json_object("value", "$.items"), kind),
                           F.from_json(F.when(F.startswith(F.trim("value"), F.lit("[")), F.col("value")), kind))
        return raw.select(F.inline(items))
    return spark.read.parquet(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Price sheet: row number and name; blank rows stay and are marked."""
    return _scan(spark, path, S.SHEET, "csv").withColumn("is_blank", F.coalesce(F.trim("name"), F.lit("")) == "")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _scan(spark, path, S.PAGES, fmt)


def read_posts(spark: SparkSession, path: str, fmt: str = "parquet", alive: int | None = None) -> DataFrame:
    """Posts, with ``alive`` only the newest so many of each channel."""
    posts = _scan(spark, path, S.POSTS, fmt)
    return posts if alive is None else top_per_group(posts, ["channel_id"], [F.desc("message_id")], alive)


def read_channel_config(spark: SparkSession, path: str) -> DataFrame:
    """(channel_id, spec_path) from a JSON map of channel -> list of ``A|B|C`` paths."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("channel_id", "_paths"))
    rows = rows.select("channel_id", F.explode("_paths").alias("_p"))
    parts = F.filter(F.transform(F.split("_p", r"\|"), lambda s: F.trim(s)), lambda s: s != "")
    return rows.select("channel_id", parts.alias("spec_path")).filter(F.size("spec_path") > 0)


def read_pricing_rules(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    kind = "map<string,struct<mode:string,base_mode:string,pct:double,flat:double,round_step:int>>"
    return raw.select(F.explode(F.from_json("value", kind)).alias("rule_key", "_r")).select("rule_key", "_r.*")


def reconcile_offers(df: DataFrame) -> DataFrame:
    """Price, channel and raw text under whatever names a layout uses."""
    have = set(df.columns)
    nested = next((c for c in ("parsed", "item", "offer") if c in have), None)
    inner = set(df.schema[nested].dataType.names) if nested else set()

    def pick(*names: str) -> list[Column]:
        return [F.col(n) for n in names if n in have] + [F.col(f"{nested}.{n}") for n in names if n in inner]

    price = pick("price", "min_price", "value", "cost")
    channel = pick("channel", "best_channel", "source", "seller")
    raw = pick("raw", "raw_parsed", "text", "line")
    none = F.lit(None).cast("string")
    return df.select(
        coerce_price(*price).alias("price") if price else none.cast("double").alias("price"),
        F.coalesce(*channel, none).alias("channel"), F.coalesce(*raw, none).alias("raw"),
        *[c for c in df.columns if c not in ("price", "channel", "raw")],
    )
