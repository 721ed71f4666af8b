"""What the operators share: intermediate tables, skew-proof joins and bounded Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: A word of the contracts: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one round of a numpy kernel handles at a time (one longer text is handled whole).
KERNEL_BYTES = 1 << 18
#: Rows that Spark sends to Python at once; the default of 10,000 could hold gigabytes of long texts.
ARROW_ROWS = 500
#: Shares into which a hot key is dealt in a salted join.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) a local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder from whatever file system it lies on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back: this cuts the lineage, survives lost
    executors and lets the next plan start from known sizes.  The table goes when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    table = spark.read.schema(schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes materialized tables that no later plan reads."""
    for t in tables:
        delete(t.sparkSession, t.stored_at)


def prepare_workers(spark: SparkSession) -> None:
    """Before a Python stage: ships the package and bounds the rows of an Arrow batch, unless the session asks for
    fewer."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))


def salted_join(left: DataFrame, right: DataFrame, key: list[str], salt_from: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Joins ``left``, whose keys may be very frequent, with ``right``, where each key is unique.

    Rows of ``left`` get a salt; ``right`` is copied to just the (key, salt) pairs that occur (at most ``salts`` a
    key, found by an aggregate that combines on the map side).  So no task gets more than a ``salts``-th of a hot key,
    with nothing broadcast and no row dropped.  Null keys match nothing.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_from)), F.lit(salts)).cast("int"))
    wanted = salted.select(*key, "_salt").distinct()
    copies = wanted.join(right, key)
    return salted.join(copies, [*key, "_salt"], how).drop("_salt")


#: Rows up to which a narrow table (a few numbers a row) is broadcast.
BROADCAST_ROWS = 1_000_000


def keyed_join(left: DataFrame, right: DataFrame, key: list[str], salt_from: str, how: str = "inner") -> DataFrame:
    """A salted join, unless ``right`` - a materialized narrow table, so that counting it only reads file footers - is
    small: then a broadcast saves the shuffles."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    return salted_join(left, right, key, salt_from, how)


#: Bits of the membership filter, at least and at most (1 and 32 MB), and bits for each key between the two.
FILTER_BITS, MOST_BITS, BITS_A_KEY = 1 << 23, 1 << 28, 16


def maybe_among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Adds ``_maybe``: false if the row's key is surely not in ``keys``.  One bit of a broadcast filter stands for each
    hash, so a row may be marked without need, never missed.  The filter's size follows the number of keys up to a
    fixed bound; beyond that it marks more rows."""
    bits = min(max(FILTER_BITS, 1 << (BITS_A_KEY * keys.count()).bit_length()), MOST_BITS)
    place = F.pmod(F.xxhash64(*on), F.lit(bits)) + 1
    bitmaps = keys.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    rows = rows.withColumn("_place", place).withColumn("_bucket", F.bitmap_bucket_number("_place")).withColumn("_bit", F.bitmap_bit_position("_place"))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2), F.col("_bit") % 8).cast("int"))
    return rows.join(F.broadcast(bitmaps), "_bucket", "left").withColumn("_maybe", F.coalesce(bit != 0, F.lit(False))).drop("_bits", "_place", "_bucket", "_bit")


def row_key(text: str) -> Column:
    """A 64-bit hash of the text (null as empty): with the id it tells rows apart that repeat an id."""
    return F.xxhash64(text_or_empty(text))


def keep_rows(docs: DataFrame, dropped: DataFrame, single: DataFrame, id: str, text: str) -> DataFrame:
    """``docs`` without the rows whose id and text are in ``dropped`` (_id, _row; see ``row_key``); of rows that repeat
    an id and a text in ``single``, one stays.  Rows that the membership filter of the ids clears stay where they are;
    only the doubtful ones are shuffled for the exact tests."""
    gone = materialize(dropped.distinct(), "dropped")
    twice = materialize(single.groupBy("_id", "_row").agg(F.count("*").alias("_n")).filter("_n > 1").select("_id", "_row"), "repeated")
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("_whole")
    rows = docs.select(whole, F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))
    marked = maybe_among(rows, gone.select("_id").unionByName(twice.select("_id")), ["_id"])
    clear = marked.filter("NOT _maybe").select("_whole.*")
    doubtful = marked.filter("_maybe").select("_whole", "_id", row_key("_text").alias("_row"))
    same = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_row"] == b["_row"])
    left = doubtful.join(gone, same(doubtful, gone), "left_anti")
    if not twice.limit(1).count():
        return clear.unionByName(left.select("_whole.*"))
    ones = left.join(twice, same(left, twice), "left_semi").groupBy("_id", "_row").agg(F.min_by("_whole", F.xxhash64(F.to_json("_whole"))).alias("_whole"))
    return clear.unionByName(left.join(twice, same(left, twice), "left_anti").select("_whole.*")).unionByName(ones.select("_whole.*"))


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = KERNEL_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``most`` bytes in each; a single longer row stays whole."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column).fill_null("")).to_numpy(zero_copy_only=False), dtype=np.int64)
        row = 0
        while row < batch.num_rows:
            before = int(ends[row - 1]) if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(row, stop - row)
            row = stop


def give_back() -> None:
    """Returns freed memory to the system: a Python worker stays after its task, and what it holds adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers hand back their memory after each partition."""

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(frugal, schema)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (uint8 and int64) of a string column; null counts as empty."""
    a = column.fill_null("").cast(pa.large_string())
    a = pa.concat_arrays([a])  # drops the offset of a slice
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
