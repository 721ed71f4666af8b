"""Exact dedup, mixing and line dedup against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.common import keep_rows, maybe_among, salted_join
from sparkloom.llm.exact_dedup import exact_dedup
from sparkloom.llm.line_dedup import line_dedup
from sparkloom.llm.mixing import mix_sources, mixed_documents, taken_words


def test_salted_join_loses_nothing(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(1, "hot"), (4500, "cold")], "k long, x string")
    assert salted_join(left, right, ["k"], "v").groupBy("x").count().orderBy("x").collect() == [("cold", 1), ("hot", 4000)]
    assert salted_join(left, right, ["k"], "v", "left").count() == 5000


def test_membership_filter_never_misses(spark):
    rows, keys = spark.range(3000), spark.range(0, 3000, 7)
    marked = maybe_among(rows, keys, ["id"])
    assert marked.filter("id % 7 = 0 AND NOT _maybe").count() == 0
    assert marked.filter("id % 7 != 0 AND _maybe").count() < 30


def test_keep_rows(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("t"), "id").alias("text"))
    key = F.xxhash64("text").alias("_row")
    gone = rows.filter("id % 7 = 0").select(F.col("id").alias("_id"), key)
    other = gone.select("_id", (F.col("_row") + 1).alias("_row"))
    assert keep_rows(rows, gone, gone.limit(0), "id", "text").count() == 3000 - 429
    assert keep_rows(rows, other, gone, "id", "text").count() == 3000
    twice = rows.unionByName(rows.filter("id < 50"))
    both = twice.filter("id < 20").select(F.col("id").alias("_id"), key)
    assert keep_rows(twice, gone.limit(0), both, "id", "text").count() == 3030


def test_exact(docs, corpus):
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[t or ""].append(i)
    got = exact_dedup(docs, all_digests=True).collect()
    assert len(got) == len(corpus)
    texts = {i: t or "" for i, t, *_ in corpus}
    for r in got:
        g = groups[texts[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(g), len(g), r["doc_id"] == max(g))
        assert r["full_hash"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    lazy = {r["doc_id"]: r["full_hash"] for r in exact_dedup(docs).collect()}
    assert any(v is None for v in lazy.values())
    assert all(lazy[i] for g in groups.values() if len(g) > 1 for i in g)


def test_exact_edges(odd, empty):
    got = exact_dedup(odd)
    assert got.count() == odd.count()
    assert got.filter("doc_id IS NULL").count() == 2
    assert exact_dedup(empty).count() == 0


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        spare = total - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        goal = {s: most * sizes[s] if s in full else spare * weight[s] / open_ for s in names}
        new = {s for s in names if s not in full and goal[s] > most * sizes[s]}
        if not new:
            return goal
        full |= new


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_mix(docs, corpus, block):
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in corpus}
    source = {i: s for i, _, _, s, _ in corpus}
    by_source = Counter()
    for i, n in sizes.items():
        by_source[source[i]] += n
    goal = targets(dict(by_source))
    positions, pieces = mix_sources(docs, block=block)
    got = taken_words(positions, pieces).collect()
    assert len(got) == len(corpus)
    taken = Counter()
    for r in got:
        assert r["size"] == sizes[r["_id"]] and r["source_size"] == by_source[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert {s: abs(taken[s] - goal[s]) < 1 for s in goal} == dict.fromkeys(goal, True)
    slots = [r["_s"] for r in pieces.select("slot", "_s").distinct().orderBy("slot").collect()]
    if block == 7:  # any stretch of the schedule has about the sources' shares
        half = Counter(slots[: len(slots) // 2])
        for s, n in Counter(slots).items():
            assert abs(half[s] - n / 2) <= 6


def test_mix_agrees_with_itself(docs):
    a = taken_words(*mix_sources(docs)).select("_id", "taken").orderBy("_id").collect()
    assert a == taken_words(*mix_sources(docs.repartition(3))).select("_id", "taken").orderBy("_id").collect()


def test_mix_edges(spark, odd, empty):
    assert taken_words(*mix_sources(odd)).count() == odd.count()
    assert taken_words(*mix_sources(empty)).count() == 0
    assert mixed_documents(odd).columns == odd.columns
    assert mixed_documents(empty).count() == 0
    none = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in taken_words(*mix_sources(none)).collect()] == [0, 0]
    assert mixed_documents(none).count() == 2


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_lines(spark, monkeypatch, broadcast):
    monkeypatch.setattr("sparkloom.llm.line_dedup.BROADCAST_LINES", broadcast)
    pages = [(i, "h", f"Header\nbody {i}\n  Header \n\nfooter") for i in range(20)] + [(100 + i, "g", f"only {i}\nHeader") for i in range(3)] + [(200, None, "Header\nx"), (201, "h", None)]
    df = spark.createDataFrame(pages, "doc_id long, host string, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup(df, ratio=0.5).collect()}
    assert got[3] == ("body 3\n", 5, 3)
    assert got[100] == ("only 0", 2, 1)
    assert got[200] == ("Header\nx", 2, 0)
    assert got[201] == ("", 0, 0)
    rare = line_dedup(df, ratio=0.5, min_pages=4).filter("doc_id = 100").first()
    assert rare["n_dropped"] == 0


def test_lines_edges(odd, empty):
    got = line_dedup(odd, host="source")
    assert got.count() == odd.count() and set(got.columns) == {*odd.columns, "n_dropped"}
    assert got.select("_row").distinct().collect() == [("y",)]
    assert line_dedup(empty, host="source").count() == 0
