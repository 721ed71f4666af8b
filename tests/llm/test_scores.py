"""Quality and toxicity: formulas against plain Python, and held-out accuracy."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from llm_helpers import prose
from pyspark.sql import functions as F

from sparkloom.llm import quality as Q
from sparkloom.llm import queries
from sparkloom.llm import toxicity as T

TABLES = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def symbols(text):
    return [32] * (Q.ORDER - 1) + Q.ALPHABET[np.frombuffer(text.encode("utf-16-le"), dtype="<u2")].tolist()


def kneser_ney(texts):
    """The model by the book, over dictionaries."""
    n = Q.ORDER
    counts = {n: Counter(tuple(s[i : i + n]) for s in map(symbols, texts) for i in range(len(s) - n + 1))}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, totals, spare = {}, {}, {}
    for k, c in counts.items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + 2 * m[2] else 0.5
        raw = [1 - 2 * y * m[2] / m[1] if m[1] else y, 2 - 3 * y * m[3] / m[2] if m[2] else 2 * y, 3 - 4 * y * m[4] / m[3] if m[3] else 3 * y]
        discounts[k] = [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]
        totals[k], spare[k] = Counter(), Counter()
        for g, x in c.items():
            totals[k][g[:-1]] += x
            spare[k][g[:-1]] += discounts[k][min(x, 3) - 1]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(counts[1]) + 1)
        lower, context = p(gram[1:]), gram[:-1]
        if not totals[k][context]:
            return lower
        x = counts[k][gram]
        own = x - discounts[k][min(x, 3) - 1] if x else 0
        return own / totals[k][context] + spare[k][context] / totals[k][context] * lower

    return p


def by_the_book(texts, text):
    """Perplexity and its lower bound."""
    p, s = kneser_ney(texts), symbols(text)
    loss = [-math.log(p(tuple(s[i - Q.ORDER + 1 : i + 1]))) for i in range(Q.ORDER - 1, len(s))]
    return math.exp(sum(loss) / len(loss)), math.exp(np.mean(loss) - Q.ERRORS * np.std(loss) / math.sqrt(len(loss)))


@pytest.mark.parametrize("rows, block", [(2_000_000, 16_000_000), (0, 16_000_000), (0, 300)])
def test_model_by_the_book(spark, monkeypatch, rows, block):
    """Every document by the model it is due, broadcast and joined in shards."""
    monkeypatch.setattr(Q, "MODEL_ROWS", rows)
    monkeypatch.setattr(Q, "BLOCK_BYTES", block)
    rng = random.Random(2)
    texts = [prose(rng, 40) for _ in range(12)] + ["日本語 の 文 です 𝒳𝒴 🎉", "日本語 も 文"]
    trained = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "_text string, _fold int")
    model = Q.train(trained)
    asked = [(i, t, m) for i, t in enumerate([*texts, "Unseen zebra, 77!", "Ж", "", None]) for m in range(3)]
    got = {(r["doc_id"], r["_model"]): r for r in Q.perplexities(spark.createDataFrame(asked, "doc_id long, text string, _model int"), model).collect()}
    assert len(got) == len(asked)
    for i, t, m in asked:
        r = got[i, m]
        if not t:
            assert r["perplexity"] is None and r["perplexity_low"] is None
            continue
        plain, low = by_the_book([x for j, x in enumerate(texts) if j % 2 != m], t)
        assert r["perplexity"] == pytest.approx(plain, rel=1e-4) and r["perplexity_low"] == pytest.approx(low, rel=1e-3)


def test_probabilities_sum_to_one(spark):
    rng = random.Random(4)
    texts = [prose(rng, 60) for _ in range(6)]
    table = Q.train(spark.createDataFrame([(t, 0) for t in texts], "_text string, _fold int")).toArrow()
    scores = Q.Scores(*(table.column(c).to_numpy().astype(t) for c, t in (("_model", np.int8), ("_order", np.int8), ("_gram", np.uint64), ("_p", np.float64), ("_back", np.float64))))
    seen = sorted({x for t in texts for x in symbols(t)})
    for context in ("the", "zzz", "  ", "a z", "日本 "):
        c = 0
        for x in symbols(context)[-(Q.ORDER - 1) :]:
            c = c << 16 | x
        every = np.array([c << 16 | x for x in [*seen, 0xFFFF]], dtype=np.uint64)
        assert np.exp(scores(2, every)).sum() == pytest.approx(1, abs=1e-6)


def test_classify_by_the_book(spark):
    """Held-out perplexities, quantiles by language and decisions, against the contract read plainly."""
    rng = random.Random(6)
    rows = [(i, prose(rng, 60), "en" if i % 3 else None) for i in range(30)]
    rows += [(100 + i, "".join(rng.choice("qxzj !#") for _ in range(200)), "en") for i in range(5)] + [(200, prose(rng, 50), "fr"), (201, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    folds = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(Q.FOLDS))).collect()}
    trusted = {i: t for i, t, _ in rows if i < 24}
    held = {}
    for i, t, _ in rows:
        if t:
            held[i] = by_the_book([x for j, x in trusted.items() if i not in trusted or folds[j] != folds[i]], t)
    got = {r["doc_id"]: r for r in Q.classify(docs, spark.range(24).withColumnRenamed("id", "_id"), rejected=0.2).collect()}
    assert len(got) == len(rows)
    langs = {i: g for i, _, g in rows}
    for i, r in got.items():
        known = sorted(held[j][0] for j in trusted if langs[j] == langs[i] or langs[i] == "fr")
        limit = known[math.ceil(0.8 * len(known)) - 1] * Q.SLACK
        assert r["threshold"] == pytest.approx(limit, rel=1e-4)
        assert r["kept"] == (i in held and held[i][1] <= limit)
        assert (r["perplexity"] or 0) == pytest.approx(held[i][0] if i in held else 0, rel=1e-4)
    assert not any(got[i]["kept"] for i in range(100, 105)) and sum(r["kept"] for r in got.values()) >= 24


def test_quality_edges(spark, docs, odd, empty, corpus):
    trusted = spark.createDataFrame([(r[0],) for r in corpus[:60]], "_id long")
    got = {r["doc_id"]: r for r in Q.classify(docs, trusted).collect()}
    assert len(got) == len(corpus)
    blank = [i for i, t, *_ in corpus if not t]
    assert all(got[i]["perplexity"] is None and not got[i]["kept"] for i in blank)
    kept = Q.keep_good(docs, trusted)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["kept"])
    assert Q.keep_good(odd, trusted).columns == odd.columns
    assert Q.classify(odd, trusted).count() == odd.count()
    assert Q.classify(empty, trusted).count() == 0
    nobody = spark.createDataFrame([], "_id long")
    assert Q.classify(docs, nobody).filter("kept").count() == len(corpus) - len(blank)


@needs_tables
def test_quality_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    seen = labels.filter("quality = 1 AND toxic = 0 AND doc_id % 2 = 0").select(F.col("doc_id").alias("_id"))
    out = Q.classify(docs, seen).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("toxic = 0").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = {r[0]: r[1] for r in out}
    assert share[1] >= 0.98 and share[0] <= 0.2


@needs_tables
def test_toxicity_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    chain = T.train_chain(docs, labels.filter("doc_id % 3 != 0"), ["low_quality", "toxic"])
    rows = T.score(docs, chain).join(labels.filter("doc_id % 3 = 0"), "doc_id").select("toxic", "is_toxic").collect()
    hits = Counter(map(tuple, rows))
    assert hits[1, True] >= 0.7 * (hits[1, True] + hits[1, False])
    assert hits[0, True] <= 0.05 * (hits[0, True] + hits[0, False])


def test_chain_uses_earlier_categories():
    """The second category follows the first's word only through the first one's probability."""
    rng = np.random.default_rng(0)
    n = 600
    first = rng.random(n) < 0.4
    doc = np.concatenate([np.arange(n), np.flatnonzero(first)])
    word = np.concatenate([rng.integers(10, 400, n), np.full(first.sum(), 5)]).astype(np.uint64)
    order = np.argsort(doc, kind="stable")
    chain = T.fit_chain(doc[order], word[order], np.c_[first, first], np.arange(n) % T.FOLDS, ["a", "b"])
    assert len(chain.links[1].earlier) == 1 and chain.links[1].earlier[0] > 0.5
    assert 5 in chain.links[0].words.tolist()


def test_fit_sees_all_words_and_rows(spark, monkeypatch):
    """The telling word is among 1,200 of its text, beyond any bound on words, and every labelled row takes part."""
    seen = {}
    fit = T.fit_chain
    monkeypatch.setattr(T, "fit_chain", lambda doc, word, y, *rest: seen.update(rows=len(y)) or fit(doc, word, y, *rest))
    long = " ".join(f"w{i}" for i in range(3_000))
    for telling in ("vile", "rotten", "nasty", "foul"):
        docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit(long), F.when(F.col("id") % 2 == 1, f" {telling}").otherwise("")).alias("text"))
        labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
        chain = T.train_chain(docs, labels, ["toxic"])
        assert len(chain.links[0].words) == 1 and seen["rows"] == 60
        assert T.score(docs, chain).filter("is_toxic <> (doc_id % 2 = 1)").count() == 0


def test_toxicity_edges(spark, docs, odd, empty):
    labels = spark.createDataFrame([(1, 0), (4, 1), (7, 0), (10, None)], "doc_id long, toxic int")
    chain = T.train_chain(docs, labels, ["toxic"])
    assert T.score(odd, chain).columns == [*odd.columns, "p_toxic", "is_toxic"]
    assert T.score(empty, chain).count() == 0
    nothing = T.train_chain(docs, labels.limit(0), ["toxic"])
    assert T.score(docs, nothing).filter("is_toxic").count() == 0
    bounded = T.train_chain(docs, spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic")), ["toxic"], max_rows=20)
    assert len(bounded.links) == 1
    assert queries.QUERIES
