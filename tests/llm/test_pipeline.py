"""The pipeline against its stages in plain Python."""

from collections import Counter

import corpus_pipeline as C
from llm_helpers import SCHEMA
from test_near import brute

from sparkloom.llm import quality


def test_stages(spark, corpus, tmp_path):
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in corpus]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:70]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    assert [n for n, _ in C.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.collect())
    given = {r[0]: r for r in rows}
    trusted = spark.read.parquet(f"{d}/labels.parquet").selectExpr("doc_id AS _id")
    good = {r["doc_id"] for r in quality.classify(spark.read.parquet(f"{d}/documents.parquet"), trusted).filter("kept").collect()}
    assert {r["doc_id"] for r in seen[0]} == good
    keep = {}
    for r in seen[0]:
        keep[r["text"]] = max(keep.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in seen[1]} == set(keep.values())
    groups = brute([(r["doc_id"], r["text"]) for r in seen[1]], 5, 80)
    assert {r["doc_id"] for r in seen[2]} == {c for _, c in groups.values()}
    words = lambda part: sum((Counter({r["source"]: len((r["text"] or "").split())}) for r in part), Counter())
    before, after = words(seen[2]), words(seen[3])
    assert all(after[s] <= 3 * before[s] + 1 for s in before)
    assert abs(sum(after.values()) - sum(before.values())) < 0.25 * sum(before.values())
    assert len(seen[4]) == len(seen[3])
    assert all(tuple(given[r["doc_id"]]) == tuple(r) for r in seen[3])
    again = sorted(map(tuple, C.run(spark, d).collect()))
    assert again == sorted(map(tuple, seen[4]))


def test_dedup_stages_remove_rows_not_ids(spark, empty):
    """Rows that share an id are told apart by their text; rows that are the same in all are one."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, "A a"), (9, "A a"), (5, "B only here"), (7, "C"), (7, "C"), (None, "A a"), (None, "D"), (None, None), (3, ""), (11, long), (11, long + " tail"), (12, long + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    left = C.exact(spark, docs, "")
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted([("9", "A a"), ("5", "B only here"), ("7", "C"), ("None", "D"), ("3", ""), ("11", long), ("11", long + " tail"), ("12", long + " end")])
    got = [(r["doc_id"], r["text"]) for r in C.near(spark, left, "").collect()]
    assert sum(i in (11, 12) for i, _ in got) == 1 and len(got) == 6
    assert [i for i, t in got if t.startswith("w0")] == [11]


def test_stages_take_odd_rows(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns
        stage(spark, odd, str(tmp_path)).count()
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert C.STAGES[-1][1](spark, odd, str(tmp_path)).count() == odd.count()
