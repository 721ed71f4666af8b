import os

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import logs, state

TYPES = ["rtb_creative", "rtb_show", "rtb_click"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def as_stream(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def events(spark, data):
    return spark.createDataFrame(data, "k string, t double, kind string").select("k", F.timestamp_seconds(F.col("t") + 1_000_000).alias("ts"), "kind")


def test_windows_stream_equals_batch(spark, tmp_path):
    df = events(spark, [("a", float(t), "x") for t in (0, 3, 7, 12, 31, 33)] + [("b", 14.0, "x"), ("", 1.0, "x")])
    batch = rows(logs.sliding_counts(df, "ts", "k", "30 seconds", "5 seconds"))
    assert rows(logs.drain(logs.sliding_counts(as_stream(spark, df, tmp_path / "e"), "ts", "k", "30 seconds", "5 seconds"))) == batch
    by_slide = logs.sliding_counts_by_slide(df.filter("k != ''"), "ts", "k", 30, 5)
    assert rows(by_slide) == batch


def test_word_counts(spark, tmp_path):
    df = spark.createDataFrame([("a b a",), ("b ",)], "value string")
    expected = [("a", 2), ("b", 2)]
    assert rows(logs.word_counts(df)) == expected == rows(logs.drain(logs.word_counts(as_stream(spark, df, tmp_path / "w"))))
    log = spark.createDataFrame([("dpc_visit\x01u",), ("dpc_js\x01\x01\x01\x01\x01v",), ("no\x01x",)], "value string")
    assert rows(logs.log_type_counts(log)) == [("", 1), ("u", 1), ("v", 1)]
    timed = df.withColumn("ts", F.timestamp_seconds(F.lit(5)))
    assert logs.windowed_word_counts(timed, "ts").count() == 2


def test_ad_lines(spark):
    line = ["rtb_show", "", "", "", "2024-01-01 00:00:01", "", "ad", "push"] + [""] * 15 + ["url"]
    df = spark.createDataFrame([("\x01".join(line),), ("other",)], "value string")
    assert logs.ad_events(df).select("ad_id", "push_id", "type").collect() == [("ad", "push", "rtb_show")]
    assert logs.creative_urls(df, kind="rtb_show").select("url").collect() == [("url",)]


def test_cumulative(spark, tmp_path):
    df = spark.createDataFrame([("hello",), ("hello",), ("new",)], "w string")
    initial = {"hello": 1, "world": 1}
    batch = rows(state.cumulative_counts_batch(df, "w", initial))
    assert batch == [("hello", 3), ("new", 1)]
    emitted = logs.drain(state.cumulative_counts(as_stream(spark, df, tmp_path / "c"), "w", initial), "update")
    assert rows(emitted.groupBy("w").agg(F.max("total"))) == batch


FUNNELS = [
    ("whole", 0.0, TYPES[0]), ("whole", 1.0, TYPES[1]), ("whole", 2.0, TYPES[2]),
    ("early", 20.0, TYPES[0]), ("early", 5.0, TYPES[1]), ("early", 40.0, TYPES[2]),
    ("late", 100.0, TYPES[0]), ("late", 5.0, TYPES[1]),
    ("none", 1.0, TYPES[2]), ("none", 2.0, TYPES[1]),
]


def test_ordered_funnel(spark, tmp_path):
    df = events(spark, FUNNELS)
    batch = rows(state.funnel_steps_batch(df, ["k"], "ts", "kind", TYPES))
    assert batch == [("early", 3), ("late", 1), ("whole", 3)]
    stream = state.funnel_steps(as_stream(spark, df, tmp_path / "f"), ["k"], "ts", "kind", TYPES)
    assert rows(logs.drain(stream, "update").groupBy("k").agg(F.max("step"))) == batch


def test_ordered_funnel_over_batches(spark, tmp_path):
    first, second = events(spark, FUNNELS[1:2] + FUNNELS[4:5]), events(spark, FUNNELS[:1] + FUNNELS[2:4] + FUNNELS[5:])
    first.write.parquet(str(tmp_path / "g"))
    second.write.mode("append").parquet(str(tmp_path / "g"))
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "g"))
    got = logs.drain(state.funnel_steps(stream, ["k"], "ts", "kind", TYPES), "update").groupBy("k").agg(F.max("step"))
    assert rows(got) == [("early", 3), ("late", 1), ("whole", 3)]


def test_advance_keeps_order():
    assert state.advance(0, 0.0, [(1, 2), (0, 1)], 30) == (2, 1)
    assert state.advance(0, 0.0, [(1, 2)], 30) == (0, 0.0)


def test_bits(spark, tmp_path):
    df = events(spark, [*FUNNELS[:3], ("slow", 0.0, TYPES[0]), ("slow", 90.0, TYPES[1]), ("odd", 3.0, TYPES[2])])
    assert rows(state.funnel_bits_batch(df, ["k"], "ts", "kind", TYPES, 60)) == [("odd", 4), ("slow", 1), ("whole", 7)]
    out = logs.drain(state.funnel_bits(as_stream(spark, df, tmp_path / "b"), ["k"], "ts", "kind", TYPES, 60, "10 minutes"), "update")
    assert rows(out.groupBy("k").agg(F.bit_or("bits"))) == [("odd", 4), ("slow", 1), ("whole", 7)]
    counters = state.ad_counters(out.withColumnRenamed("k", "ad_id"))
    assert rows(counters) == [("odd", 0, 1), ("slow", 0, 0), ("whole", 1, 1)]


def test_bits_of_a_key_that_comes_in_pieces(spark, tmp_path):
    """Spark hands a key's rows to Python in pieces; the later ones may hold the earlier events."""
    df = events(spark, [("k", 500.0, TYPES[2]), ("k", 400.0, TYPES[0]), ("k", 90.0, TYPES[1]), ("k", 0.0, TYPES[0]), ("k", 30.0, TYPES[2])]).coalesce(1)
    stream = as_stream(spark, df, tmp_path / "p")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        got = rows(logs.drain(state.funnel_bits(stream, ["k"], "ts", "kind", TYPES, 60, "10 minutes"), "update").groupBy("k").agg(F.bit_or("bits")))
    finally:
        spark.conf.set(key, usual)
    assert got == rows(state.funnel_bits_batch(df, ["k"], "ts", "kind", TYPES, 60)) == [("k", 5)]


def test_checkpoint_goes_on(spark, tmp_path):
    seen = []
    df = spark.createDataFrame([("a",)], "w string")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        logs.start(stream, lambda b, i: seen.append((i, b.count())), str(tmp_path / "ck"), "append", once=True).awaitTermination()
    assert seen == [(0, 1)]
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(str(tmp_path / "none")).count()


def test_empty_stream(spark, tmp_path):
    schema = "value string"
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(schema).text(str(tmp_path / "none"))
    assert logs.drain(logs.word_counts(stream)).collect() == []
    assert logs.batch_counts(stream, logs.word_counts).columns == ["word", "count", "batch"]


def test_each_batch_and_each_row(spark, tmp_path):
    for i, words in enumerate((["a", "b", "a"], ["a"])):
        spark.createDataFrame([(w,) for w in words], "value string").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in logs.batch_counts(stream, logs.word_counts).select("word", "count").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]
    totals = sorted(tuple(r) for r in logs.drain(state.cumulative_counts(stream, "value", {"a": 5}, each_row=True), "update").collect())
    assert totals == [("a", 6), ("a", 7), ("a", 8), ("b", 1)]


def test_idle_keys_leave_the_state(spark, tmp_path):
    """The watermark has passed the first key's event by days when a batch without it comes, so it starts anew."""
    for i, (user, day, kind) in enumerate(((1, 1, "view"), (2, 9, "view"), (3, 15, "view"), (1, 20, "click"))):
        spark.sql(f"SELECT {user}L AS u, timestamp'2024-01-{day:02d} 00:00:00' AS ts, '{kind}' AS k").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        os.utime(next((tmp_path / "in" / f"{i}").glob("*.parquet")), (1000 + i * 100, 1000 + i * 100))
    stream = spark.readStream.schema("u long, ts timestamp, k string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in logs.drain(state.funnel_steps(stream, ["u"], "ts", "k", ["view", "click"], tolerance=1e9), "update").collect())
    assert got == [(1, 1), (2, 1), (3, 1)]
    kept = sorted(tuple(r) for r in logs.drain(state.funnel_steps(stream, ["u"], "ts", "k", ["view", "click"], tolerance=1e9, idle=None), "update").collect())
    assert kept == [(1, 1), (1, 2), (2, 1), (3, 1)]
