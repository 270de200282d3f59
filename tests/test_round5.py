"""Rules that take a first look at a text say what they say without it; costly predicates run once for each kind of pair."""

from pyspark.sql import functions as F

from pricewell.functions import lines as L, patterns as P
from pricewell.operators import messages as M

TEXTS = [
    "", " ", "a  b", " a", "a\n", "a\tb", "a\t\tb", "x y", "Black 🇺🇸", "🔥 Black", "🇺", "🇺🇸🇯", "a‍b", "12.05.2024 5", "12:30", "20245", "2024", "1 [10:30] 234",
    "12 10:30 345", "64 307", "X - 5", "X - 17900 - 17850 🇺🇸", "used", "uſed", "РЕФ ref", "50%a", "5 %", "aabbcc", "abcabc abc", "aaaa bbbb cccc", "aaaa bbbb ccdd", "........",
    "уценка", "Доставка 500", "нет  в наличии", "Sold OUT", "@name x y", "контакт", "a - - b c!", "Например:", "é" * 9,
]


def test_first_looks_lose_nothing(rows):
    rx = L.rx
    full = lambda s: F.regexp_replace(F.regexp_replace(F.translate(s, " ", " "), "[ \t]{2,}", " "), r"(?U)^\s+|\s+$", "")
    masked = lambda s: full(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, P.DATE, " "), P.TIME, " "), P.YEAR, " "))
    t = F.col("t")
    chars = F.size(F.array_distinct(F.split(F.replace(t, F.lit(" "), F.lit("")), ""))) <= 3
    for new, old in ((L.squeeze(t), full(t)), (L.mask_dates(t), masked(t)), (L.has_price(t), rx(masked(t), P.PRICE)), (L.out_of_stock(t), rx(t, P.OUT_OF_STOCK)),
                     (L.defective(t), rx(t, P.DEFECT)), (rx(t, P.FEW_CHARACTERS), chars), (rx(t, P.INFO_LED), rx(t, P.INFO)), (rx(t, P.GIVEAWAY_LED), rx(t, P.GIVEAWAY))):
        assert rows(TEXTS, new) == rows(TEXTS, old)


def test_plain_messages_skip_the_costly_steps(spark):
    """The time of the message queries: what a message does not need is not in the way of the others."""
    plan = M.parsed_lines(spark.createDataFrame([(1, "x")], "message_id int, message string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(split" not in plan and "drop_reason" in plan


ATTRS = ["cat", "brand", "model", "color", "color_1", "color_2", "storage", "ram", "sim", "code", "band_type", "band_color", "band_size", "screen_size", "watch_size_mm",
         "connectivity", "drive", "chip", "anc"]


def test_kinds_count_like_pairs(spark):
    """Outcomes counted by kinds of rows equal those of all pairs of a model, and the predicate does not run on the pairs."""
    from pricewell.operators import match as J

    made = []
    for i in range(60):
        row = dict.fromkeys(ATTRS)
        row.update(cat=["Смартфоны", "Планшеты", "Часы"][i % 3], brand="b", model=f"m{i % 2}", color=["Black", "Navy", None][i % 3], storage=["128GB", None][i % 2], ram=str(i % 2),
                   code=["MX1234", None, "MX9"][i % 3] if i % 5 == 0 else None)
        made.append((i, *[row[a] for a in ATTRS], ["Black"] if i % 4 == 0 else None, i % 7 == 0))
    schema = "id int, " + ", ".join(f"{a} string" for a in ATTRS) + ", colors array<string>, game boolean"
    df = spark.createDataFrame(made, schema).withColumns({"nano_glass": F.lit(None).cast("boolean"), "no_watches": F.lit(None).cast("boolean"), "n": F.lit(3)})
    df = df.withColumn("fam", F.col("id") % 2).coalesce(2)
    v, o = J.prepare(df).alias("v"), J.prepare(df).alias("o")
    want = v.join(o, F.col("v.k_model") == F.col("o.k_model")).select("v.fam", J.mismatch().alias("reason"), "o.n").groupBy("fam", "reason").agg(F.sum("n").alias("n"))
    got = J.count_outcomes(df, df, ["fam"])
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
