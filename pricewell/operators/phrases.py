"""Which dictionary phrases a text holds.

An inverted index on the dictionary: a phrase meets a text only under its rarest token, and only then are order, separators and borders verified.  So
texts and phrases meet in an equality join, whatever their numbers, and a frequent word draws no pairs as long as the phrase has a rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import phrase_pattern

# Characters of a gram, the key of phrases without a token of Latin letters and digits.
GRAM = 3


def latin_tokens(text: Column) -> Column:
    """Distinct maximal runs of a-z and 0-9; a phrase's borders fall between such runs, so every one of a phrase is a whole one in the text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def _grams(text: Column) -> Column:
    """Distinct pieces of ``GRAM`` characters of the words of a text, and its shorter words whole."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda t: t != ""))
    cut = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - GRAM + 1, F.lit(1))), lambda i: F.substring(w, i, GRAM)))
    return F.transform(F.array_distinct(F.flatten(cut)), lambda g: F.concat(F.lit("~"), g))


def phrase_hits(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text", phrase_key: str = "phrase_id", phrase: str = "phrase") -> DataFrame:
    """(key, phrase_key) of every phrase found in a text, each once.

    Case does not count; ``. _ -`` and white space stand for a space of the phrase; no Latin letter or digit may touch its ends.  Null and blank phrases are
    found nowhere, null texts hold nothing.  ``key`` is unique; equal phrases are each reported.
    """
    phrases = phrases.select(phrase_key, F.trim(phrase).alias("_phrase")).filter("_phrase <> ''")
    # A phrase whose only words are shorter than a gram and not Latin could stand inside longer words: it is looked up by its first letter.
    tokens = latin_tokens(F.col("_phrase"))
    grams = F.filter(_grams(F.col("_phrase")), lambda g: F.length(g) == GRAM + 1)
    letters = F.transform(F.array_distinct(F.filter(F.split(F.lower("_phrase"), ""), lambda c: F.trim(c) != "")), lambda c: F.concat(F.lit("~~"), c))
    keyed = phrases.withColumn("_tokens", F.when(F.size(tokens) > 0, tokens).when(F.size(grams) > 0, grams).otherwise(letters))
    words = keyed.select(phrase_key, "_phrase", F.explode("_tokens").alias("_token"))
    # Only the kinds of keys that the dictionary needs are made of the texts.
    kinds = words.agg(F.coalesce(F.bool_or(F.startswith("_token", F.lit("~")) & ~F.startswith("_token", F.lit("~~"))), F.lit(False)).alias("_g"),
                      F.coalesce(F.bool_or(F.startswith("_token", F.lit("~~"))), F.lit(False)).alias("_c"))
    none = F.array().cast("array<string>")
    chars = F.transform(F.array_distinct(F.split(F.lower(text), "")), lambda c: F.concat(F.lit("~~"), c))
    made = texts.filter(F.col(text).isNotNull()).crossJoin(F.broadcast(kinds)).select(
        key, F.explode(F.concat(latin_tokens(F.col(text)), F.when(F.col("_g"), _grams(F.col(text))).otherwise(none), F.when(F.col("_c"), chars).otherwise(none))).alias("_token"))
    held = made.join(words.select("_token").distinct(), "_token", "left_semi")
    often = held.groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    # A token that no text has makes its phrase hopeless; of the others the rarest decides.
    rated = words.join(often, "_token", "left").groupBy(phrase_key, "_phrase").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_token").alias("token"))).alias("_r"))
    seeds = rated.filter("_r.n > 0").select(phrase_key, "_phrase", F.col("_r.token").alias("_token"))
    met = held.join(seeds, "_token").select(key, phrase_key, evened(F.col("_phrase")).alias("_words"), phrase_pattern(F.col("_phrase")).alias("_pattern"))
    # A pattern is compiled for each pair, so it runs only where the words stand side by side.
    lowered = texts.select(key, F.lower(text).alias("_text"), evened(F.col(text)).alias("_even"))
    found = met.join(lowered, key).filter(F.when(F.contains("_even", "_words"), F.expr("_text rlike _pattern")).otherwise(F.lit(False)))
    return found.select(key, phrase_key)


def evened(text: Column) -> Column:
    """Lower case, one space for each run of what may stand for a space of a phrase: a text that holds a phrase holds its evened words."""
    return F.regexp_replace(F.lower(text), r"[\s._-]+", " ")
