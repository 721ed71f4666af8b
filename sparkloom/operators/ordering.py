"""Secondary sort, top-N and partitioned order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: the prime that the seeded hash of words starts from.
HASH_SEED = 1125899906842597


def secondary_sort(df: DataFrame, key: str, order: str, value: str, on_dup: str = "sum", out: str = "series") -> DataFrame:
    """Per key its (order, value) pairs as an array sorted by order.  ``on_dup``: values of the same key and order are
    added ("sum", combined before the shuffle) or all kept, sorted by value ("keep")."""
    if on_dup == "sum":
        df = df.groupBy(key, order).agg(F.sum(value).alias(value))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias(out))


def partition_sort(df: DataFrame, key: str, value: str, n: int, desc: bool = True) -> DataFrame:
    """Hash partitions by key, sorted by key and value inside: one shuffle, no total order."""
    way = F.desc if desc else F.asc
    return df.repartition(n, key).sortWithinPartitions(way(key), way(value))


def modulo_partitions(df: DataFrame, key: str, n: int) -> DataFrame:
    """Partition i holds the keys that are i modulo ``n``, in ascending order."""
    return df.repartitionById(n, F.pmod(F.col(key), F.lit(n)).cast("int")).sortWithinPartitions(key)


def ordered_concat(df: DataFrame, key: str, order: Sequence[str], item: Column, sep: str = "", desc: bool = False, out: str = "joined") -> DataFrame:
    """Per key the items as one text, in the order of ``order``; each item is followed by ``sep``."""
    items = F.sort_array(F.collect_list(F.struct(*order, item.alias("_item"))), not desc)
    sorted_items = df.groupBy(key).agg(items.alias("_items"))
    return sorted_items.select(key, F.concat(F.array_join("_items._item", sep), F.lit(sep)).alias(out))


def top_n(df: DataFrame, name: str, weight: str, n: int = 10, ties: str = "unique_freq", desc: bool = True) -> DataFrame:
    """The ``n`` rows of greatest weight.  ``ties``: one name a weight, the greatest ("unique_freq"), or plain top n by
    weight and name ("keep").  Each task sends its own top n only."""
    if ties == "unique_freq":
        df = df.groupBy(weight).agg(F.max(name).alias(name))
    best = df.select(name, weight).orderBy(F.desc(weight), F.asc(name)).limit(n)
    return best if desc else best.orderBy(F.asc(weight), F.desc(name))


def top_n_two_phase(df: DataFrame, name: str, weight: str, n: int = 10, ties: str = "unique_freq") -> DataFrame:
    """Weights of equal names are added first."""
    return top_n(df.groupBy(name).agg(F.sum(weight).alias(weight)), name, weight, n, ties)


def top_per_key(df: DataFrame, key: str, weight: str, tie: str, n: int, least: float | None = None) -> DataFrame:
    """The ``n`` rows of greatest weight of each key, with their ``rank``; ties by ``tie``.  Rows below ``least`` go."""
    df = df if least is None else df.filter(F.col(weight) >= F.lit(least))
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(weight), F.asc(tie)))).filter(F.col("rank") <= n)


def seeded_hash(c: Column | str, seed: int = HASH_SEED) -> Column:
    """h = 31 * h + unit over the UTF-16 units of a text, in 64 bits that wrap around; null counts as 0.  Computed in
    decimals, as longs don't overflow silently."""
    c = F.col(c) if isinstance(c, str) else c
    units = F.transform(F.sequence(F.lit(0), (F.length(F.hex(F.encode(c, "UTF-16BE"))) / 4).cast("int") - 1), lambda i: F.conv(F.substr(F.hex(F.encode(c, "UTF-16BE")), (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("decimal(38,0)"))
    whole = F.lit(str(1 << 64)).cast("decimal(38,0)")
    start = F.lit(seed).cast("decimal(38,0)")
    h = F.when(F.length(c) == 0, start).otherwise(F.aggregate(units, start, lambda a, u: ((a * 31 + u) % whole).cast("decimal(38,0)")))
    signed = F.when(h >= F.lit(str(1 << 63)).cast("decimal(38,0)"), h - whole).otherwise(h)
    return F.coalesce(signed.cast("long"), F.lit(0).cast("long"))


def hash_partition(c: Column | str, n: int, seed: int = HASH_SEED) -> Column:
    """The partition of a key: the absolute remainder of its seeded hash; null keys go to the first."""
    return F.abs(seeded_hash(c, seed) % n).cast("int")
