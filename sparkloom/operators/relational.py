"""Relational basics: counts, sums, averages, views, unions, set operations."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def group_count(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key, as ``count``; null is a key of its own."""
    return df.groupBy(*keys).count()


def aggregate_by_key(df: DataFrame, key: str, value: str, out: str = "total") -> DataFrame:
    """Sum of values per key, combined before the shuffle."""
    return df.groupBy(key).agg(F.sum(value).alias(out))


def average(c: Column | str) -> Column:
    """Mean of the values that aren't null; not a number where there are none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.avg(c), F.lit(float("nan")))


def register_average(spark: SparkSession, name: str = "myAverage") -> None:
    """The same mean as an aggregate for SQL over long values, with Arrow batches of a group; for plain SQL, avg is
    the faster one."""

    @F.pandas_udf("double")
    def mean(x: pd.Series) -> float:
        return float(x.mean()) if x.notna().any() else float("nan")

    ship(spark)
    spark.udf.register(name, mean)


def total_length(df: DataFrame, text: str, out: str = "total_length") -> DataFrame:
    """Sum of the lengths of all lines."""
    return df.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias(out))


def distinct_per_key(df: DataFrame, key: str, attribute: str, values: str = "values", n: str = "n") -> DataFrame:
    """The distinct values of each key, sorted, and their number."""
    collected = df.groupBy(key).agg(F.sort_array(F.collect_set(attribute)).alias(values))
    return collected.withColumn(n, F.size(values).cast("long"))


def bag_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def sorted_intersection(a: Column | str, b: Column | str) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def without_items(a: Column | str, b: Column | str) -> Column:
    return F.array_except(a, b)


def view(df: DataFrame, name: str, everywhere: bool = False) -> None:
    """A view of this session, which replaces one of the same name, or (``everywhere``) of all sessions of the application
    as global_temp.``name``, which must not exist yet."""
    df.createGlobalTempView(name) if everywhere else df.createOrReplaceTempView(name)


def having_positive(df: DataFrame, count: str = "count") -> DataFrame:
    return df.filter(F.col(count) > 0)


def prefixed(c: Column | str, prefix: str = "Name: ") -> Column:
    return F.concat(F.lit(prefix), F.col(c) if isinstance(c, str) else c)


def well_formed(df: DataFrame, line: str, sep: str, n: int, at_least: bool = False) -> DataFrame:
    """Lines with ``n`` parts (or at least so many); others are skipped.  The parts come as the column ``parts``."""
    from ..functions.text import jsplit

    parts = df.withColumn("parts", jsplit(line, sep))
    return parts.filter(F.size("parts") >= n if at_least else F.size("parts") == n)


def log_key(tokens: Column | str, fields: dict[str, int]) -> Column:
    """The field that a log line's type (its first token) points to; the empty string for other types."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    out = None
    for kind, i in fields.items():
        hit = F.get(tokens, 0) == kind
        out = F.when(hit, F.get(tokens, i)) if out is None else out.when(hit, F.get(tokens, i))
    return F.coalesce(out, F.lit("")) if out is not None else F.lit("")


def frame(spark: SparkSession, rows: Sequence, names: str) -> DataFrame:
    """A table of strings from rows and a string of column names, such as "name age"."""
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{n}` string" for n in names.split()))
