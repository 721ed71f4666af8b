"""Near-dedup against all pairs."""

import random
import re

import numpy as np
import pytest
from llm_helpers import prose
from pyspark.sql import functions as F

from sparkloom.llm import near_dedup as N


def brute(rows, words, share):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words", [4, 5])
def test_near(docs, corpus, words):
    expected = brute([(i, t) for i, t, *_ in corpus], words, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_dedup(docs, words=words).collect()}
    assert got == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in N.near_dedup(docs, words=words).collect())


def hot_group(seed):
    rng = random.Random(seed)
    base = prose(rng, 70).split(" ")
    rows = [(1000, " ".join(base))]
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(words[: rng.choice([70, 70, 60, 50])])))
    return rows


@pytest.mark.parametrize("seed, docs", [(3, 1024), (3, 40), (4, 16), (5, 7)])
def test_hot_group(spark, monkeypatch, seed, docs):
    """One large group of near copies, some of whose members are near only to a few others; in one unit, and dealt over
    many."""
    monkeypatch.setattr(N, "UNIT_DOCS", docs)
    monkeypatch.setattr(N, "UNITS_A_ROW", 2)
    rows = hot_group(seed)
    expected = {i: c for i, (_, c) in brute(rows, 4, 80).items()}
    got = {r["doc_id"]: r["component_id"] for r in N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == expected


@pytest.mark.parametrize("docs", [1024, 5])
def test_crowded_bucket(spark, monkeypatch, docs):
    """One bucket of documents most of which are near to nobody: the near pairs are compared all the same."""
    monkeypatch.setattr(N, "UNIT_DOCS", docs)
    rng = random.Random(8)
    rows = [(i, prose(rng, 60)) for i in range(40)]
    for i in range(4):
        words = rows[30 + i][1].split(" ")
        for j in range(3):
            words[10 * j + i] = f"x{j}"
            rows.append((100 + 10 * i + j, " ".join(words)))
    signed = N.signatures
    monkeypatch.setattr(N, "signatures", lambda *a: signed(*a).withColumn("_bands", F.expr("if(_n > 0, array(0L), null)")))
    expected = {i: c for i, (_, c) in brute(rows, 4, 80).items()}
    assert len(set(expected.values())) < len(rows)
    got = {r["doc_id"]: r["component_id"] for r in N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == expected


def test_repeated_ids(spark):
    """Rows that share an id are documents of their own."""
    rng = random.Random(2)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (1, b), (3, b + " tail"), (4, a + " end"), (2, "alone here"), (2, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in N.near_dedup(df).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (2, 2, True), (3, 1, False), (4, 1, False)]
    assert sorted((r["doc_id"], r["text"]) for r in N.unique_documents(df).collect()) == sorted([(1, a), (1, b), (2, "alone here")])


def test_overlaps(monkeypatch):
    monkeypatch.setattr(N, "COLUMNS", 3)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(12)]
    assert N.overlaps(sets).tolist() == [[float(len(np.intersect1d(x, y))) for y in sets] for x in sets]
    assert N.overlaps([np.array([i], dtype=np.uint64) for i in range(3)]).tolist() == np.eye(3).tolist()
    a = np.arange(5, dtype=np.uint64)
    assert N.stars([a, a[:4]], 80).tolist() == [0, 0] and N.stars([a, a[:3]], 80).tolist() == [0, 1]


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(60)]
    star = [(500, i) for i in range(501, 700)]
    mixed = [(a * 7919 % 1009 + 1000, b * 7919 % 1009 + 1000) for a, b in path]
    edges = path + star + mixed
    rng.shuffle(edges)
    nodes = sorted({x for e in edges for x in e} | {5000})
    got = {r["_id"]: r["_root"] for r in N.components(spark.createDataFrame([(n,) for n in nodes], "_id long"), spark.createDataFrame(edges, "_a long, _b long")).collect()}
    assert got[60] == 0 and got[699] == 500 and got[5000] == 5000
    least = min(x for e in mixed for x in e)
    assert {got[x] for e in mixed for x in e} == {least}


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    every = np.sort(rng.integers(0, 1 << 63, 900, dtype=np.uint64) << np.uint64(1))
    a, b = np.sort(every[:600]), np.sort(np.r_[every[60:600], every[600:660]])
    same = (N.sketch(a) == N.sketch(b)).mean()
    assert abs(same - 540 / 660) < 0.1
    few = np.sort(every[rng.permutation(900)[:3]])
    assert len(np.unique(N.sketch(few))) == 3  # empty bins are filled by different donors


def test_edges(odd, empty, spark):
    got = N.near_dedup(odd)
    assert got.count() == odd.count()
    assert got.filter("doc_id IS NULL AND component_id IS NULL AND kept").count() == 2
    assert N.near_dedup(empty).count() == 0
    assert N.near_dedup(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).filter("kept").count() == 2
