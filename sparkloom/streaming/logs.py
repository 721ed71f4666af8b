"""Streaming log analytics without custom state: word counts, log types, sliding windows.

Each transform works on a batch table and on a stream alike; the wrappers below run a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import jsplit
from ..operators.relational import log_key
from ..sources.scratch import new_folder

#: Types of the site log and the field that each is counted by.
SITE_LOG = {"dpc_js": 5, "dpc_visit": 1}
#: Fields of the ad log.
AD_TYPES = ("rtb_creative", "rtb_show", "rtb_click")


def word_counts(df: DataFrame, text: str = "value") -> DataFrame:
    """Words between single blanks and their counts."""
    return df.select(F.explode(jsplit(text, " ")).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def windowed_word_counts(df: DataFrame, ts: str, text: str = "value", width: str = "10 seconds") -> DataFrame:
    """Counts in tumbling windows: what a micro-batch of that interval would count."""
    words = df.select(ts, F.explode(jsplit(text, " ")).alias("word"))
    return words.groupBy(F.window(ts, width).alias("window"), "word").agg(F.count("*").alias("count"))


def log_type_counts(df: DataFrame, line: str = "value", fields: dict[str, int] | None = None) -> DataFrame:
    """Counts by the field that a line's type points to; lines of other types count under the empty string."""
    keyed = df.select(log_key(jsplit(line, "\x01"), fields or SITE_LOG).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("count"))


def event_time(df: DataFrame, ts: str, delay: str | None = "1 hour") -> DataFrame:
    """``ts`` as a timestamp (watermarks refuse those without time zone), and on a stream a watermark."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, delay) if df.isStreaming and delay else df


def sliding_counts(df: DataFrame, ts: str, key: str, width: str, slide: str, delay: str | None = "1 hour") -> DataFrame:
    """(window_start, window_end, key, count): every row counts in each window that covers it.  Empty keys are skipped;
    windows without rows don't exist, so no zero counts need filtering.  On a stream rows may be ``delay`` late, and
    windows that ended longer ago leave the state (None: all stay)."""
    rows = event_time(df, ts, delay).filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    counts = rows.groupBy(F.window(ts, width, slide).alias("_w"), key).agg(F.count("*").alias("count"))
    return counts.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), key, "count")


def sliding_counts_by_slide(df: DataFrame, ts: str, key: str, width_s: int, slide_s: int) -> DataFrame:
    """The same counts for a batch, when windows are many slides wide: rows are counted by slide first, and only those
    counts are copied to the windows."""
    start = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / slide_s) * slide_s
    slides = df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(start.alias("_s"), key).agg(F.count("*").alias("_n"))
    spread = slides.withColumn("_w", F.explode(F.sequence(F.col("_s") - width_s + slide_s, F.col("_s"), F.lit(slide_s))))
    sums = spread.groupBy("_w", key).agg(F.sum("_n").alias("count"))
    return sums.select(F.timestamp_seconds("_w").alias("window_start"), F.timestamp_seconds(F.col("_w") + width_s).alias("window_end"), key, "count")


def creative_urls(lines: DataFrame, line: str = "value", kind: str = "rtb_creative", field: int = 23) -> DataFrame:
    """The url of each ad-log line of one type."""
    tokens = jsplit(line, "\x01")
    return lines.filter(F.get(tokens, 0) == kind).select("*", F.get(tokens, field).alias("url")).filter("url != ''")


def ad_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """(ad_id, push_id, type, ts) of the ad log; other lines are skipped."""
    t = jsplit(line, "\x01")
    rows = lines.select(F.get(t, 6).alias("ad_id"), F.get(t, 7).alias("push_id"), F.get(t, 0).alias("type"), F.try_to_timestamp(F.get(t, 4), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"))
    return rows.filter(F.col("type").isin(*AD_TYPES) & F.col("ts").isNotNull())


def start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", once: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Runs ``write`` on each micro-batch; a stream started again with its checkpoint folder goes on where it ended."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _batches(df: DataFrame, shape: DataFrame, mode: str, make: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Runs a stream over all data there is; what ``make`` gives for each micro-batch is the folder of that batch, so
    that a batch that runs again replaces itself.  Results go through files in the shared folder, not the driver."""
    spark = df.sparkSession
    base = new_folder(spark, "stream")
    spark.createDataFrame([], shape.schema).write.parquet(f"{base}/out/part=-1")
    whole = mode == "complete"  # each result replaces the one before

    def write(batch: DataFrame, number: int) -> None:
        make(batch, number).write.mode("overwrite").parquet(f"{base}/out/part={-1 if whole else number}")

    query = start(df, write, f"{base}/checkpoint", mode, once=True)
    query.awaitTermination()
    return spark.read.schema(shape.schema).parquet(f"{base}/out/part=*")


def drain(df: DataFrame, mode: str = "complete") -> DataFrame:
    """The output of a stream over all data there is, as a table: of complete mode the last result, else all that was
    emitted; nothing if the stream is empty."""
    return _batches(df, df, mode, lambda batch, _: batch)


def batch_counts(df: DataFrame, counts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(batch, and the columns of ``counts``): the counts of each micro-batch on its own, as an interval of a discretized
    stream has them; batches are numbered from 0 on."""
    numbered = lambda x, n: x.withColumn("batch", F.lit(n).cast("long"))
    shape = numbered(counts(df.sparkSession.createDataFrame([], df.schema)), 0)
    return _batches(df, shape, "append", lambda batch, n: numbered(counts(batch), n))
