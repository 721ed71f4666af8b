"""Sources and sinks.  Connectors that need extra jars or modules are looked up by name when used."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, path, format: str = "parquet", schema=None, **options) -> DataFrame:
    """A file of any format that Spark reads; a list of paths and globs works too."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def json_lines(spark: SparkSession, path, schema=None) -> DataFrame:
    return load(spark, path, "json", schema)


def csv(spark: SparkSession, path, sep: str = ";", header: bool = True, schema=None) -> DataFrame:
    """Types are inferred unless a schema is given."""
    return load(spark, path, "csv", schema, sep=sep, header=str(header).lower(), inferSchema=str(schema is None).lower())


def lines(spark: SparkSession, paths) -> DataFrame:
    """Lines as the column ``value``; ``paths`` may be a list, or one string of paths and globs between commas."""
    return spark.read.text([p for p in paths.split(",") if p] if isinstance(paths, str) else list(paths))


def query_file(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """SQL on a file, without a view."""
    return spark.sql(f"SELECT * FROM {format}.`{path}`")


def delimited(spark: SparkSession, paths, sep: str, schema: str) -> DataFrame:
    """Positional text: ``schema`` such as "name string, age int" names the fields; lines of other shape are skipped."""
    from ..functions.text import jsplit

    fields = [f.strip().split(None, 1) for f in schema.split(",")]
    parts = lines(spark, paths).select(jsplit("value", sep).alias("_p")).filter(F.size("_p") >= len(fields))
    return parts.select(*[F.trim(F.get("_p", F.lit(i))).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])


def sequence_file(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a sequence file of simple writables."""
    return spark.sparkContext.sequenceFile(path).toDF(["key", "value"])


def suffixes(spark: SparkSession, path: str) -> list[str]:
    """The distinct trimmed lines of a list of domain suffixes (a few hundred); fails if there is no such file."""
    return sorted(r[0] for r in lines(spark, path).select(F.trim("value").alias("v")).filter("v != ''").distinct().collect())


def non_empty(spark: SparkSession, path: str) -> bool:
    """Whether any file that the path or glob names has content, on whatever file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return any(fs.getContentSummary(s.getPath()).getLength() > 0 for s in (fs.globStatus(at) or []))


def numbers_sequence(spark: SparkSession, path: str, n: int) -> None:
    """A sequence file (cat1, 0..99) to try top-N on."""
    rows = spark.range(1, n).select(F.concat(F.lit("cat"), "id").alias("k"), F.floor(F.rand(7) * 100).cast("int").alias("v"))
    write_sequence(rows, path)


def products_sequence(spark: SparkSession, path: str, keys: int = 5, n: int = 5) -> None:
    """A sequence file of keys key1, key2, ..., each with the first ``n`` multiples of its number."""
    i, j = F.expr(f"id div {n} + 1"), F.expr(f"id % {n} + 1")
    write_sequence(spark.range(keys * n).select(F.concat(F.lit("key"), i).alias("k"), (i * j).alias("v")), path)


def stream(spark: SparkSession, format: str, schema=None, **options) -> DataFrame:
    """An unbounded table: kafka (subscribe, startingOffsets), socket, rate or files."""
    reader = spark.readStream.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load()


def kafka_options(servers: str, topics: str, starting: str = "latest", group: str | None = None) -> dict[str, str]:
    """What the Kafka connector is told; offsets live in the stream's checkpoint, never in the group."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topics, "startingOffsets": starting}
    return out | ({"kafka.group.id": group} if group else {})


def kafka(spark: SparkSession, servers: str, topics: str, starting: str = "latest", group: str | None = None) -> DataFrame:
    """Values of Kafka topics (between commas) as text; needs the Kafka connector on the class path."""
    return stream(spark, "kafka", **kafka_options(servers, topics, starting, group)).select(F.col("value").cast("string"), "timestamp")


def socket(spark: SparkSession, host: str, port: int = 9999) -> DataFrame:
    return stream(spark, "socket", host=host, port=str(port), includeTimestamp="true")


def collection(spark: SparkSession, uri: str, format: str = "mongodb", **options) -> DataFrame:
    """Documents of a collection; with format="json" a folder of JSON lines stands in."""
    return spark.read.format(format).options(**options).load(uri) if format == "json" else spark.read.format(format).option("connection.uri", uri).options(**options).load()


def rewrite_collection(spark: SparkSession, source: str, target: str, where: str, columns: list[str], format: str = "mongodb") -> DataFrame:
    """Reads a collection, keeps ``columns`` of the rows that ``where`` (SQL) selects, writes them in place of
    ``target`` and returns them."""
    rows = collection(spark, source, format).filter(where).select(*columns)
    writer = rows.write.format(format).mode("overwrite")
    writer.save(target) if format == "json" else writer.option("connection.uri", target).save()
    return collection(spark, target, format)


# --- sinks ---


def save(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", **options) -> None:
    df.write.format(format).mode(mode).options(**options).save(path)


def save_tuples(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines ``(a,b)``."""
    df.select(F.concat(F.lit("("), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns]), F.lit(")"))).write.mode(mode).text(path)


def save_tabbed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines ``key<tab>value``."""
    df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns])).write.mode(mode).text(path)


def save_by_prefix(df: DataFrame, path: str, key: str, value: str, length: int = 2, mode: str = "overwrite") -> None:
    """A folder for each prefix of the key, with lines ``key<tab>value``; a shorter key is an error."""
    short = F.when(F.length(key) < length, F.raise_error(F.concat(F.lit("key too short: "), F.col(key)))).otherwise(F.substring(key, 1, length))
    df.select(short.alias("prefix"), F.concat_ws("\t", key, value).alias("value")).write.mode(mode).partitionBy("prefix").text(path)


def save_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def write_sequence(df: DataFrame, path: str) -> None:
    """(key, value) as a sequence file."""
    df.rdd.map(tuple).saveAsSequenceFile(path)


class Store(Protocol):
    """A key-value store client, made where rows are written."""

    def incr(self, key: str, n: int) -> None: ...

    def hincr(self, key: str, field: str, n: int) -> None: ...

    def put(self, key: str, value: str) -> None: ...


def each_partition(df: DataFrame, write: Callable[[Iterator[Row]], None]) -> None:
    """Runs ``write`` on the executors, once a partition."""
    df.foreachPartition(write)


def increment(df: DataFrame, key: str, count: str, connect: Callable[[], Store]) -> None:
    """Adds counts to a store; one client for each partition.  A retried task adds again, so prefer ``put_absolute``
    for windows."""

    def write(rows: Iterable[Row]) -> None:
        store = connect()
        for r in rows:
            store.incr(r[key], int(r[count]))

    df.foreachPartition(write)


def increment_fields(df: DataFrame, key: str, fields: list[str], connect: Callable[[], Store]) -> None:
    """Adds the counters of each key, summed over the batch first."""
    sums = df.groupBy(key).agg(*[F.sum(f).alias(f) for f in fields])

    def write(rows: Iterable[Row]) -> None:
        store = connect()
        for r in rows:
            for f in fields:
                if r[f]:
                    store.hincr(r[key], f, int(r[f]))

    sums.foreachPartition(write)


def put_absolute(df: DataFrame, keys: list[str], count: str, connect: Callable[[], Store]) -> None:
    """Writes the absolute value for each key, so that writing a batch twice changes nothing."""

    def write(rows: Iterable[Row]) -> None:
        store = connect()
        for r in rows:
            store.put("|".join(str(r[k]) for k in keys), str(r[count]))

    df.foreachPartition(write)


def batch_banner(df: DataFrame, batch: int, limit: int = 20) -> str:
    """The number of a batch and its first rows, for a console."""
    return "\n".join([f"---- batch {batch} ----", *(str(tuple(r)) for r in df.take(limit))])
