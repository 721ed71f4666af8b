"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, materialize, maybe_among, row_key, salted_join, text_or_empty


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", prefix: int = 64, normalise: Column | None = None, all_digests: bool = False) -> DataFrame:
    """One row per document: ``id``, keep_id, group_size, kept, full_hash.

    Round 1 groups by byte length and a hash of the first ``prefix`` characters (a pair that occurs twice implies a
    length that does, so one aggregation serves both steps).  Round 2 reads the full text of surviving rows only and
    groups by its SHA-256.  Texts never enter a shuffle.  With ``all_digests`` full_hash is there for every row, else
    it is null where a text needed no full hash.

    Null texts count as empty; empty texts are equal.  The largest id of equal texts stays; rows that repeat an id
    with the same text are one document and share ``kept``.  A null id stays only where no other id of its group is
    there.  An empty table gives an empty result; other columns are ignored.
    """
    content = text_or_empty(text) if normalise is None else F.coalesce(normalise, F.lit(""))
    rows = docs.select(F.col(id).alias("_id"), content.alias("_text")).withColumn("_length", F.octet_length("_text")).withColumn("_prefix", F.xxhash64(F.substring("_text", 1, prefix)))
    groups = rows.groupBy("_length", "_prefix").agg(F.count("*").alias("_n")).filter("_n > 1").select("_length", "_prefix")
    groups = materialize(groups, "lengths")
    full = F.sha2(F.col("_text").cast("binary"), 256)
    marked = maybe_among(rows, groups, ["_length", "_prefix"])
    keys = marked.select("_id", "_length", "_maybe", (full if all_digests else F.when(F.col("_maybe"), full)).alias("full_hash"))
    keys = materialize(keys.withColumn("_full", F.when(F.col("_maybe"), F.col("full_hash"))).drop("_maybe"), "exact")
    same = keys.filter("_full IS NOT NULL").groupBy("_full", "_length").agg(F.count("*").alias("_n"), F.max("_id").alias("_keep")).filter("_n > 1")
    out = salted_join(keys, same, ["_full", "_length"], "_id", "left")
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(F.col("_id").alias(id), keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), "full_hash")


def unique_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", prefix: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts one row, that of the largest id; of rows that repeat both id and
    text one, by the least hash of the whole row.  Rows that share an id, not a text, stay all; a null text counts as
    empty, a null id as smaller than all."""
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"), row_key(text).alias("_row"))
    same = exact_dedup(rows.select(F.struct("_id", "_row").alias("_key"), "_text"), "_key", "_text", prefix).filter("group_size > 1")
    same = materialize(same.select("_key.*", "kept"), "equal")
    return keep_rows(docs, same.filter("NOT kept").select("_id", "_row"), same.filter("kept").select("_id", "_row"), id, text)
