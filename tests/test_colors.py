"""Colours: whole words count, other forms of the words do not."""

from pyspark.sql import functions as F

from pricewell.functions import attributes as A

CASES = {
    "белый 128": "White", "белой 128": None, "черной": None, "чёрная": "Black", "золотый": None, "золотой": "Gold", "голубый": None, "голубая": "Blue",
    "серой": None, "темно-синий": "Navy", "ti black": "Black Titanium", "whitesilver": "White", "Space Grey": "Space Gray", "sand": "Gravel Gray", "серебристой": None,
}


def test_oblique_forms_are_no_colours(spark):
    rows = spark.createDataFrame(list(CASES), "string").select("value", F.get(A.colors_of("value"), 0).alias("color"))
    assert {r.value: r.color for r in rows.collect()} == CASES
