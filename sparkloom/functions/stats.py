"""Student's t-tests from distributed moments."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction (modified Lentz steps)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def two_sided_p(t: float, df: float) -> float:
    """The probability of a t at least as far from 0."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    return 1.0 if t == 0 else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def p_value(t: Column, df: Column, undefined: float = math.nan) -> Column:
    """The two-sided probability; ``undefined`` where there is none."""
    ship()

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([math.nan if x is None or y is None else two_sided_p(x, y) for x, y in zip(a.astype("float64"), b.astype("float64"), strict=True)])

    return F.coalesce(F.nanvl(run(t, df), F.lit(undefined)), F.lit(undefined))


def t_test(df: DataFrame, group: str, value: str, first, second, undefined: float = math.nan) -> DataFrame:
    """One row: n1, n2, t, df, p for the values of two groups.

    Two singletons: not a number.  One singleton: a one-sample test of the other group against it.  Else the
    two-sample test for unequal variances.  Where no probability can be told (an empty group, no variance) p is
    ``undefined``, by custom not a number or 0.  The data is read once, and only moments leave the executors.
    """
    moments = [e for i, g in enumerate((first, second), 1) for x in [F.when(F.col(group) == F.lit(g), F.col(value).cast("double"))] for e in (F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_samp(x).alias(f"v{i}"))]
    m = df.agg(*moments)
    n1, n2, m1, m2, v1, v2 = (F.col(c).cast("double") for c in ("n1", "n2", "m1", "m2", "v1", "v2"))
    e1, e2 = F.try_divide(v1, n1), F.try_divide(v2, n2)
    welch = F.try_divide(m1 - m2, F.sqrt(e1 + e2))
    welch_df = F.try_divide((e1 + e2) * (e1 + e2), F.try_divide(e1 * e1, n1 - 1) + F.try_divide(e2 * e2, n2 - 1))
    t = F.when((n1 > 1) & (n2 > 1), welch).when((n1 > 1) & (n2 == 1), F.try_divide(m1 - m2, F.sqrt(e1))).when((n1 == 1) & (n2 > 1), F.try_divide(m2 - m1, F.sqrt(e2)))
    dof = F.when((n1 > 1) & (n2 > 1), welch_df).when((n1 > 1) & (n2 == 1), n1 - 1).when((n1 == 1) & (n2 > 1), n2 - 1)
    return m.select("n1", "n2", t.alias("t"), dof.alias("df")).withColumn("p", p_value(F.col("t"), F.col("df"), undefined))
