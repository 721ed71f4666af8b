"""Rows in ascending id order over many partitions, without one task that sees them all."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a table in id order, at most: at 100 TB a part has some 5 GB, which its task streams in sorted order.
MOST_PARTS = 20_000


def cut_points(ids: DataFrame, id: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 ids that cut the table into parts of about the same number of rows."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    got = ids.select(F.percentile_approx(id, shares, F.lit(max(10_000, 20 * parts)))).first()[0]
    return sorted(set(got or []))


def shard_of(id: str | Column, cuts: list[int]) -> Column:
    """The part an id falls into: the number of cut points that are not above it; null ids go to the first."""
    points = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def part(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, x.fillna(np.iinfo(np.int64).min).to_numpy(dtype=np.int64), side="right").astype(np.int32))

    return part(F.col(id).cast("long") if isinstance(id, str) else id.cast("long"))


def input_parts(df: DataFrame) -> int:
    """The number of partitions in which Spark reads the table, which follows the size of the input, up to a bound that
    keeps shuffles of every part to every part possible."""
    return min(max(1, df.rdd.getNumPartitions()), MOST_PARTS)
