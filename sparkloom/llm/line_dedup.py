"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, materialize, salted_join, text_or_empty

#: Boilerplate lines (32 bytes each) up to which they are broadcast; beyond, pages meet them in salted joins.
BROADCAST_LINES = 200_000
#: Pages of a host that one salt of such a join takes.
PAGES_A_SALT = 50_000


def _key(line: Column) -> Column:
    return F.md5(F.trim(line))


def boilerplate(docs: DataFrame, text: str, host: str, ratio: float, min_pages: int) -> tuple[DataFrame, DataFrame]:
    """(_host, _line), the keys of the lines that stand on at least ``ratio`` of a host's pages and on ``min_pages`` at
    least, and (_host, _pages).  A host has at most (mean lines of a page) / ``ratio`` such lines."""
    pages = docs.select(F.col(host).alias("_host"), text_or_empty(text).alias("_text")).filter("_host IS NOT NULL")
    lines = F.array_distinct(F.transform(F.filter(F.split("_text", "\n", -1), lambda x: F.trim(x) != ""), _key))
    counts = pages.select("_host", F.explode(lines).alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_pages)
    totals = materialize(pages.groupBy("_host").agg(F.count("*").alias("_pages")), "hosts")
    often = salted_join(counts, totals, ["_host"], "_line").filter(F.col("_n") >= F.col("_pages") * F.lit(float(ratio)))
    return materialize(often.select("_host", "_line"), "boilerplate"), totals


def line_dedup(docs: DataFrame, text: str = "text", host: str = "host", salt: str = "doc_id", ratio: float = 0.07, min_pages: int = 2) -> DataFrame:
    """``docs`` with the boilerplate lines of each page's host dropped from ``text``; adds n_lines and n_dropped.

    Lines end at \\n and count as equal if they are after trimming blanks; a line counts once a page.  Blank lines
    stay.  Pages without host keep all lines, null text becomes empty (no line), an empty table stays empty; repeated
    rows are pages of their own.  Input columns named n_lines or n_dropped are replaced.
    """
    lines, totals = boilerplate(docs, text, host, ratio, min_pages)
    marks = lines.groupBy("_host").agg(F.collect_set("_line").alias("_boilerplate"))
    # the row travels as one struct, so that no name of it can clash
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col(host).alias("_host"), F.col(text).alias("_text"), F.xxhash64(F.col(salt), F.col(text)).alias("_from"))
    if lines.count() <= BROADCAST_LINES:  # texts stay where they are
        joined = rows.join(F.broadcast(marks), "_host", "left")
    else:
        most = totals.agg(F.max("_pages")).first()[0] or 0
        joined = salted_join(rows, marks, ["_host"], "_from", "left", max(SALTS, most // PAGES_A_SALT))
    lines = F.when(text_or_empty("_text") == "", F.array().cast("array<string>")).otherwise(F.split("_text", "\n", -1))
    kept = F.when(F.col("_boilerplate").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: ~F.array_contains("_boilerplate", _key(x)) | (F.trim(x) == "")))
    out = joined.withColumn("_lines", lines).withColumn("_kept", kept)
    given = [F.array_join("_kept", "\n").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*given, F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"))
