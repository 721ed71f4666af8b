"""Enrichment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_outer_enrich(facts: DataFrame, dim: DataFrame, on: str, attribute: str, default: str = "UNKNOWN") -> DataFrame:
    """All rows of ``facts`` with ``attribute`` of ``dim``; ``default`` where the key is missing.  Of several rows of a
    key in ``dim`` the greatest attribute counts.  Whether to broadcast is left to the optimizer, which knows sizes."""
    one = dim.groupBy(on).agg(F.max(attribute).alias(attribute))
    return facts.join(one, on, "left").fillna(default, [attribute])


def join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Any of Spark's join types (an extension: the patterns here need the left outer one only)."""
    return left.join(right, on, how)
