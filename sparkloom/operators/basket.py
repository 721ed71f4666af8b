"""Market baskets: item sets and association rules."""

from __future__ import annotations

from itertools import combinations as _combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def combinations(items: Column | str, size: int) -> Column:
    """All sets of ``size`` distinct items, each sorted, as an array of arrays; size 0 gives the empty set.  Built by
    extending sets with later items, inside the JVM."""
    items = F.array_sort(F.array_distinct(items))
    def extended(s: Column) -> Column:
        later = F.filter(items, lambda x: (F.size(s) == 0) | (x > F.try_element_at(s, F.lit(-1))))
        return F.transform(later, lambda x: F.concat(s, F.array(x)))

    out = F.array(F.array().cast("array<string>"))
    for _ in range(size):
        out = F.flatten(F.transform(out, extended))
    return out


def power_set(items: list[str], most: int | None = None) -> list[list[str]]:
    """All sets of a list's distinct items, the empty one first."""
    items = sorted(set(items))
    return [list(c) for n in range((len(items) if most is None else min(most, len(items))) + 1) for c in _combinations(items, n)]


def baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    """(basket, items): the distinct items of each basket, sorted."""
    return df.filter(F.col(item).isNotNull()).groupBy(basket).agg(F.array_sort(F.collect_set(F.col(item).cast("string"))).alias("items"))


def itemset_counts(df: DataFrame, basket: str, item: str, size: int = 2) -> DataFrame:
    """(items, count): how many baskets hold each set of ``size`` items."""
    sets = baskets(df, basket, item).select(F.explode(combinations("items", size)).alias("items"))
    return sets.groupBy("items").agg(F.count("*").alias("count"))


def itemsets_up_to(df: DataFrame, basket: str, item: str, max_size: int) -> DataFrame:
    """(items, count) for all sets of 1 to ``max_size`` items.  A basket of k items has k**max_size sets or so, hence
    the bound.  All sizes come from one pass over the baskets, inside the JVM."""
    sets = F.concat(*[combinations("items", n) for n in range(1, max_size + 1)])
    return baskets(df, basket, item).select(F.explode(sets).alias("items")).groupBy("items").agg(F.count("*").alias("count"))


def association_rules(df: DataFrame, basket: str, item: str, max_size: int = 3) -> DataFrame:
    """(antecedent, consequent, confidence, support): each set of 2 to ``max_size`` items gives a rule for each of its
    items, with confidence count(set) / count(set without the item).  Both sides of the join read one count."""
    counts = itemsets_up_to(df, basket, item, max_size)
    supers = counts.filter(F.size("items") > 1).select("items", F.col("count").alias("support"), F.explode("items").alias("consequent"))
    supers = supers.withColumn("antecedent", F.array_remove("items", F.col("consequent")))
    rules = supers.join(counts.select(F.col("items").alias("antecedent"), F.col("count").alias("_n")), "antecedent")
    return rules.select("antecedent", "consequent", (F.col("support") / F.col("_n")).alias("confidence"), "support")
