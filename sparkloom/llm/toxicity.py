"""Toxicity by a classifier chain of linear models over words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .common import flat, map_arrow, materialize, maybe_among, prepare_workers, row_key, slices

#: Words that a link of the chain weighs, and folds of the out-of-fold predictions.
MAX_WORDS, FOLDS = 512, 5
#: Ridge penalty and Newton steps of the fits.
RIDGE, STEPS = 1.0, 25
#: Rows of the fit that are dense at a time.
DENSE_ROWS = 4_096


@dataclass
class Link:
    """A linear model: hashes of its words with a weight each, weights of the earlier categories, and a bias."""

    category: str
    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    threshold: float = 0.5


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)


def word_sets(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(document, word) of each distinct word of each text: runs of letters and digits, A-Z lower-cased, as hashes."""
    data, offsets = flat(batch.column(column))
    hashes, first = kernels.word_hashes(data, offsets, space=kernels.MARKS)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(first)), hashes


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dense(hits: tuple[np.ndarray, np.ndarray], k: int, earlier: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Rows ``lo`` to ``hi``: their words, the earlier categories and a one for the bias."""
    x, y = np.searchsorted(hits[0], [lo, hi])
    out = np.zeros((hi - lo, k), dtype=np.float32)
    out[hits[0][x:y] - lo, hits[1][x:y]] = 1
    return np.c_[out, earlier[lo:hi], np.ones(hi - lo, dtype=np.float32)]


def _pieces(n: int) -> list[tuple[int, int]]:
    return [(lo, min(lo + DENSE_ROWS, n)) for lo in range(0, n, DENSE_ROWS)]


def _fit(hits: tuple[np.ndarray, np.ndarray], k: int, earlier: np.ndarray, y: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression of the rows ``inside`` by Newton's method; the last weight is the bias."""
    w = np.zeros(k + earlier.shape[1] + 1)
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-6
    for _ in range(STEPS):
        gradient, hessian = penalty * w, np.diag(penalty)
        for lo, hi in _pieces(len(y)):
            use = inside[lo:hi]
            x = _dense(hits, k, earlier, lo, hi)[use]
            p = _sigmoid(x @ w)
            gradient += x.T @ (p - y[lo:hi][use])
            hessian += (x * (p * (1 - p))[:, None].astype(x.dtype)).T @ x
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _predict(hits: tuple[np.ndarray, np.ndarray], k: int, earlier: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.concatenate([_sigmoid(_dense(hits, k, earlier, lo, hi) @ w) for lo, hi in _pieces(len(earlier))])


def _distance(positive: np.ndarray, total: np.ndarray, n: float, k: float) -> np.ndarray:
    """How far a word's share among ``k`` positive rows of ``n`` is from that among the others, in standard errors."""
    rate = (total + 1.0) / (n + 2.0)
    return np.abs(positive - total * k / n) / np.sqrt(np.maximum(k * rate * (1 - rate), 1e-9) + 1)


def _telling(doc: np.ndarray, word: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The words whose share among the positive ``rows`` differs most from that among the others, in standard errors."""
    use = rows[doc]
    names, which = np.unique(word[use], return_inverse=True)
    positive = np.bincount(which, weights=y[doc[use]], minlength=len(names))
    total = np.bincount(which, minlength=len(names))
    z = _distance(positive, total, rows.sum(), y[rows].sum())
    best = np.argsort(-z, kind="stable")[:MAX_WORDS]
    return np.sort(names[best[z[best] > 2]])


def _hits(doc: np.ndarray, word: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``names``) of the words that a model weighs, by row."""
    if not len(names):
        return np.zeros(0, np.int32), np.zeros(0, np.int16)
    at = np.minimum(np.searchsorted(names, word), len(names) - 1)
    hit = names[at] == word
    return doc[hit].astype(np.int32), at[hit].astype(np.int16)


def fit_chain(doc: np.ndarray, word: np.ndarray, labels: np.ndarray, folds: np.ndarray, categories: Sequence[str], chosen: dict[tuple[int, int], np.ndarray] | None = None) -> Chain:
    """Category by category: words are chosen and a model fitted on the words and the earlier categories'
    probabilities.  Those come from models that have not seen the row (out of fold), as later rows will meet them.
    ``chosen``: the words of (category, fold left out), if they have been chosen before; fold ``FOLDS`` leaves out none."""
    n = len(labels)
    earlier = np.zeros((n, 0), dtype=np.float32)
    chain = Chain()
    for j, category in enumerate(categories):
        y = labels[:, j].astype(np.float64)
        held_out = np.zeros(n, dtype=np.float32)
        for fold in range(FOLDS):
            inside = folds != fold
            if inside.all() or not inside.any():
                continue
            names = _telling(doc, word, inside, y) if chosen is None else chosen[j, fold]
            hits = _hits(doc, word, names)
            w = _fit(hits, len(names), earlier, y, inside)
            held_out[~inside] = _predict(hits, len(names), earlier, w)[~inside]
        whole = np.ones(n, dtype=bool)
        names = _telling(doc, word, whole, y) if chosen is None else chosen[j, FOLDS]
        w = _fit(_hits(doc, word, names), len(names), earlier, y, whole)
        k = len(names)
        chain.links.append(Link(category, names, w[:k], w[k:-1], float(w[-1]), _threshold(held_out, y)))
        earlier = np.c_[earlier, held_out]
    return chain


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability above which held-out rows give the best F1."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    if not len(y) or not hits[-1]:
        return 0.5
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + hits[-1])
    best = int(np.argmax(f1))
    after = float(p[order[best + 1]]) if best + 1 < len(p) else 0.0
    return max((float(p[order[best]]) + after) / 2, 0.05)


def _choose(sets: DataFrame, rows: dict[int, np.ndarray], categories: int) -> dict[tuple[int, int], np.ndarray]:
    """The words of each model, see ``_telling``: counted over all words of all rows.  ``rows``: by fold the number of
    rows, and of positive ones of each category.  A word of two rows or fewer can't lie two standard errors off."""
    y = range(categories)
    ones = [F.col("_fold") == f for f in range(FOLDS)]
    sums = [F.count_if(x).alias(f"_n{f}") for f, x in enumerate(ones)] + [F.count_if(x & (F.col(f"_y{i}") > 0)).alias(f"_p{i}_{f}") for i in y for f, x in enumerate(ones)]
    words = sets.select(F.explode("_words").alias("_word"), "_fold", *(f"_y{i}" for i in y)).groupBy("_word").agg(F.count("*").alias("_all"), *sums).filter("_all > 2")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word = b.column("_word").to_numpy()
            for i in y:
                for out in range(FOLDS + 1):
                    inside = [f for f in rows if f != out]
                    n, k = sum(rows[f][0] for f in inside), sum(rows[f][1 + i] for f in inside)
                    if not n:
                        continue
                    total, positive = (sum(b.column(f"{c}{f}").to_numpy() for f in inside) for c in ("_n", f"_p{i}_"))
                    z = np.where(total > 0, _distance(positive, total, n, k), 0)
                    top = np.flatnonzero(z > 2)
                    top = top[np.lexsort((word[top].view(np.uint64), -z[top]))][:MAX_WORDS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i)), pa.array(np.full(len(top), out)), pa.array(z[top]), pa.array(word[top])], ["_i", "_out", "_z", "_word"])

    far = map_arrow(words, best, "_i long, _out long, _z double, _word long")
    place = F.row_number().over(Window.partitionBy("_i", "_out").orderBy(F.desc("_z"), F.col("_word") < 0, "_word"))
    found = far.withColumn("_place", place).filter(F.col("_place") <= MAX_WORDS).select("_i", "_out", "_word").toArrow()
    i, out, word = (found.column(c).to_numpy() for c in ("_i", "_out", "_word"))
    return {(a, f): np.sort(word[(i == a) & (out == f)].view(np.uint64)) for a in y for f in range(FOLDS + 1)}


def train_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id: str = "doc_id", text: str = "text", max_rows: int | None = None) -> Chain:
    """Fits a chain on all labelled documents and all their words (with ``max_rows`` on so many, by the hash of the id);
    rows with a null label don't count.  Of labels that contradict each other the greater counts; of several texts of
    an id the one with the least hash.  Words are counted and chosen by Spark; the driver gathers only the chosen ones
    of each document.  Without any labelled document each category has probability one half and no row is flagged."""
    prepare_workers(docs.sparkSession)
    y = [f"_y{i}" for i in range(len(categories))]
    known = labels.select(F.col(id).alias("_id"), *(F.col(c).cast("int").alias(n) for c, n in zip(categories, y, strict=True))).dropna()
    known = known.groupBy("_id").agg(*(F.max(n).alias(n) for n in y)).withColumn("_order", F.xxhash64("_id"))
    sample = materialize(known if max_rows is None else known.orderBy("_order", "_id").limit(max_rows), "labelled")
    rows = maybe_among(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), sample, ["_id"]).filter("_maybe").select("_id", row_key("_text").alias("_row"), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            doc, word = word_sets(b, "_text")
            ends = np.searchsorted(doc, np.arange(b.num_rows + 1))
            sets = [np.unique(word[x:y]).view(np.int64) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.int64()))], ["_id", "_row", "_words"])

    sets = map_arrow(rows, run, "_id long, _row long, _words array<long>").join(sample.select("_id"), "_id").groupBy("_id").agg(F.min_by("_words", "_row").alias("_words"))
    sets = materialize(sets.join(sample, "_id").withColumn("_fold", F.pmod(F.floor(F.col("_order") / 7919), F.lit(FOLDS)).cast("int")), "sets")
    sizes = {r[0]: np.array(r[1:], dtype=np.float64) for r in sets.groupBy("_fold").agg(F.count("*"), *(F.count_if(F.col(n) > 0) for n in y)).collect()}
    if not sizes:
        none = np.zeros(0, np.uint64)
        return Chain([Link(c, none, np.zeros(0), np.zeros(i), 0.0, 1.0) for i, c in enumerate(categories)])
    chosen = _choose(sets, sizes, len(categories))
    names = np.unique(np.concatenate(list(chosen.values())))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("_words")
            word = lists.flatten().to_numpy().view(np.uint64)
            doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())
            row, at = _hits(doc, word, names)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(ends), pa.array(at, pa.int16()))], [*kept, "_at"])

    kept = ["_id", "_order", "_fold", *y]
    found = map_arrow(sets, meet, "_id long, _order long, _fold int, " + "".join(f"{n} int, " for n in y) + "_at array<smallint>").toArrow()
    found = found.sort_by([("_order", "ascending"), ("_id", "ascending")])
    at = found.column("_at").combine_chunks()
    doc = np.repeat(np.arange(found.num_rows, dtype=np.int32), pc.list_value_length(at).to_numpy())
    labelled = np.stack([found.column(n).to_numpy() for n in y], axis=1)
    return fit_chain(doc, names[at.flatten().to_numpy()] if len(names) else np.zeros(0, np.uint64), labelled, found.column("_fold").to_numpy(), categories, chosen)


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with p_<category> for each link of the chain, in its order, and is_<last category>: whether its
    probability lies above the threshold that served held-out rows best.

    Whole texts count; a null or empty text has no words, so its scores are the models' biases and it is not flagged.
    Columns with the new names are replaced; repeated rows are scored each; an empty table stays empty.
    """
    prepare_workers(docs.sparkSession)
    names = [f"p_{x.category}" for x in chain.links]
    flag = f"is_{chain.links[-1].category}"
    docs = docs.drop(*names, flag)
    columns = [*docs.columns, *names, flag]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            doc, word = word_sets(b, text)
            n = b.num_rows
            has_words = np.bincount(doc, minlength=n) > 0
            earlier: list[np.ndarray] = []
            for x in chain.links:
                z = np.full(n, x.bias)
                if len(x.words):
                    at = np.minimum(np.searchsorted(x.words, word), len(x.words) - 1)
                    hit = x.words[at] == word
                    place = np.unique(doc[hit] * len(x.words) + at[hit])
                    z += np.bincount(place // len(x.words), weights=x.weights[place % len(x.words)], minlength=n)
                for w, p in zip(x.earlier, earlier, strict=True):
                    z += w * p
                earlier.append(_sigmoid(z))
            flags = (earlier[-1] > chain.links[-1].threshold) & has_words
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, earlier), pa.array(flags)], columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, run, schema + "".join(f", `{c}` double" for c in names) + f", `{flag}` boolean")
