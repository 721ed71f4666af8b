"""Relative frequency of neighbouring words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jsplit


def neighbours(df: DataFrame, text: str, window: int = 2) -> DataFrame:
    """(word, neighbour) for each pair of tokens up to ``window`` apart; lines with fewer than two tokens are skipped.
    Neighbours come from slices of the same row, so no token pair needs a join."""
    tokens = df.select(jsplit(text, " ").alias("_t")).filter(F.size("_t") >= 2)
    rows = tokens.select("_t", F.posexplode("_t").alias("_i", "word"))
    start = F.greatest(F.col("_i") - window, F.lit(0))
    around = F.concat(F.slice("_t", start + 1, F.col("_i") - start), F.slice("_t", F.col("_i") + 2, F.lit(window)))
    return rows.select("word", F.explode(around).alias("neighbour"))


def relative_frequency(df: DataFrame, text: str, window: int = 2) -> DataFrame:
    """(word, neighbour, frequency): a neighbour's share of all neighbours of the word.  A word's total needs no pairs:
    each of its places has so many neighbours as the window and the line's ends allow, summed before the shuffle.  It
    is joined to the counted pairs, so no task has to hold or sort all neighbours of a frequent word."""
    tokens = df.select(jsplit(text, " ").alias("_t")).filter(F.size("_t") >= 2)
    places = tokens.select(F.size("_t").alias("_m"), F.posexplode("_t").alias("_i", "word"))
    around = F.least(F.col("_i"), F.lit(window)) + F.least(F.col("_m") - 1 - F.col("_i"), F.lit(window))
    totals = places.groupBy("word").agg(F.sum(around).alias("_total"))
    counts = neighbours(df, text, window).groupBy("word", "neighbour").agg(F.count("*").alias("_n"))
    return counts.join(totals, "word").select("word", "neighbour", (F.col("_n") / F.col("_total")).alias("frequency"))
