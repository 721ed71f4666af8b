"""Quality by perplexity: an interpolated modified Kneser-Ney model of characters, trained on trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, keep_rows, keyed_join, map_arrow, materialize, maybe_among, prepare_workers, row_key, slices

#: Length of the n-grams.  Their characters are UTF-16 units, so that an n-gram is one 64-bit number and no character
#: of any script is mistaken for another; the model grows with the text.
ORDER = 4
#: The share of a language's trusted documents above its quantile, and the factor by which documents may exceed the
#: perplexity there.
REJECTED, SLACK = 0.02, 1.02
#: Folds of the trusted documents: each is scored by the model of the other folds, all others by the model of all.
FOLDS = 2
#: Standard errors that are taken off a text's mean loss before it is held against the threshold: the perplexity of a
#: short text says little.
ERRORS = 2.0
#: Relative error of the quantiles: one part in so many.
ACCURACY = 100_000
#: Rows of a model up to which it is broadcast (12 bytes each); a larger one is joined in shards.
MODEL_ROWS = 2_000_000
#: Bytes of text of a block that asks a sharded model for its n-grams at once.
BLOCK_BYTES = 16_000_000
_FULL = FOLDS


def _mask(k: int) -> int:
    return (1 << 16 * k) - 1


def _alphabet() -> np.ndarray:
    """A symbol for each UTF-16 unit: white space is one, digits are one, any other unit is its own."""
    out = np.arange(1 << 16, dtype=np.uint16)
    for c in range(1 << 16):
        if chr(c).isspace():
            out[c] = ord(" ")
        elif chr(c).isdecimal():
            out[c] = ord("0")
    return out


ALPHABET = _alphabet()


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each unit (blanks stand before a text) as a 64-bit number, and the units before each
    text."""
    raw = [(t or "").encode("utf-16-le", "surrogatepass") for t in texts]
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 2
    units = np.frombuffer(b"".join(raw), dtype="<u2")
    pad = ORDER - 1
    symbols = np.full(len(units) + pad * len(raw), ord(" "), dtype=np.uint64)
    at = np.arange(len(units)) + np.repeat(np.arange(1, len(raw) + 1) * pad, lengths)
    symbols[at] = ALPHABET[units]
    out = np.zeros(len(units), dtype=np.uint64)
    for back in range(pad, -1, -1):
        out = out << np.uint64(16) | symbols[at - back]
    return out, np.r_[0, np.cumsum(lengths)]


def gram_counts(texts: DataFrame) -> DataFrame:
    """(_fold, _gram, _c) over all rows of ``texts`` (_text, _fold).  Tasks count blocks of text; a sharded sum joins
    the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counted() -> Iterator[pa.RecordBatch]:
            for fold in range(FOLDS):
                parts = [g[f == fold] for g, f in held]
                seen, times = np.unique(np.concatenate(parts), return_counts=True)
                for at in range(0, len(seen), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen[part]), fold, dtype=np.int32)), pa.array(seen[part].view(np.int64)), pa.array(times[part].astype(np.int64))], ["_fold", "_gram", "_c"])

        for b in slices(batches, "_text"):
            found, offsets = grams(b.column(0).to_pylist())
            held.append((found, np.repeat(b.column(1).to_numpy().astype(np.int8), np.diff(offsets))))
            if sum(len(g) for g, _ in held) > BLOCK_BYTES:
                yield from counted()
                held = []
        if held:
            yield from counted()

    return map_arrow(texts.select("_text", "_fold"), run, "_fold int, _gram long, _c long").groupBy("_fold", "_gram").agg(F.sum("_c").alias("_c"))


def _discounts(counts: DataFrame) -> dict[int, list[float]]:
    """D1, D2 and D3+ of each model, from the numbers of n-grams that occur once, twice, three and four times."""
    out = {}
    for m, n1, n2, n3, n4 in counts.groupBy("_model").agg(*(F.count(F.when(F.col("_c") == i, 1)).cast("double") for i in (1, 2, 3, 4))).collect():
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
        out[m] = [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]
    return out


def _of_model(values: dict[int, float]) -> Column:
    out = F.lit(None).cast("double")
    for m, v in values.items():
        out = F.when(F.col("_model") == m, F.lit(float(v))).otherwise(out)
    return out


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(_model, _order, _gram, _p, _back) from ``counts`` (_model, _gram, _c): for every n-gram seen its interpolated
    probability, and as a context of the next order its back-off weight.  Order 0 has the weight of a symbol never
    seen among all symbols.

    Joins of sharded count tables: n-grams with the sums of their contexts, and with the lower order's probabilities.
    Lower orders count in how many contexts an n-gram occurs.
    """
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = materialize(tables[k + 1].groupBy("_model", F.col("_gram").bitwiseAND(F.lit(_mask(k))).alias("_gram")).agg(F.count("*").alias("_c")), f"grams{k}")
    symbols = tables[1].groupBy("_model").agg((1 / (F.count("*") + 1)).alias("_p"))
    lower = materialize(symbols.select("_model", F.lit(0).cast("long").alias("_gram"), "_p"), "model0")
    out = lower.withColumn("_order", F.lit(0)).withColumn("_back", F.lit(None).cast("double"))
    for k in range(1, ORDER + 1):
        found = _discounts(tables[k])
        d1, d2, d3 = (_of_model({m: d[i] for m, d in found.items()}) for i in range(3))
        rows = tables[k].withColumn("_context", F.shiftrightunsigned("_gram", 16) if k > 1 else F.lit(0).cast("long")).withColumn("_d", F.when(F.col("_c") == 1, d1).when(F.col("_c") == 2, d2).otherwise(d3))
        contexts = materialize(rows.groupBy("_model", "_context").agg(F.sum("_c").alias("_total"), F.sum("_d").alias("_spare")), f"contexts{k}")
        below = lower.select("_model", F.col("_gram").alias("_suffix"), F.col("_p").alias("_low"))
        rows = rows.join(contexts, ["_model", "_context"]).withColumn("_suffix", F.col("_gram").bitwiseAND(F.lit(_mask(k - 1))))
        share = F.col("_spare") / F.col("_total")
        p = (F.col("_c") - F.col("_d")) / F.col("_total") + share * F.col("_low")
        lower = materialize(rows.join(below, ["_model", "_suffix"]).select("_model", "_gram", p.alias("_p")), f"model{k}")
        backs = contexts.select("_model", F.lit(k - 1).alias("_order"), F.col("_context").alias("_gram"), F.lit(None).cast("double").alias("_p"), share.alias("_back"))
        out = out.unionByName(lower.withColumn("_order", F.lit(k)).withColumn("_back", F.lit(None).cast("double"))).unionByName(backs)
    return out.select("_model", "_order", "_gram", "_p", "_back")


class Scores:
    """A model in arrays: sorted n-grams of each order with the logarithms of probabilities and back-off weights."""

    def __init__(self, model: np.ndarray, order: np.ndarray, gram: np.ndarray, p: np.ndarray, back: np.ndarray) -> None:
        self.tables = {}
        for m in np.unique(model).tolist():
            for k in range(ORDER + 1):
                for kind, values in (("p", p), ("back", back)):
                    rows = np.flatnonzero((model == m) & (order == k) & ~np.isnan(values))
                    rows = rows[np.argsort(gram[rows])]
                    self.tables[m, k, kind] = gram[rows], np.log(values[rows].astype(np.float64))

    def _find(self, key: tuple, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.tables.get(key, (np.zeros(0, np.uint64), np.zeros(0)))
        if not len(keys):
            return np.zeros(len(grams), dtype=bool), np.zeros(len(grams))
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        return keys[at] == grams, values[at]

    def __call__(self, model: int, grams: np.ndarray) -> np.ndarray:
        """The natural logarithm of the probability of each n-gram."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            hit, value = self._find((model, k, "p"), grams[left] & np.uint64(_mask(k)))
            out[left[hit]] += value[hit]
            left = left[~hit]
            if k and len(left):
                context = grams[left] >> np.uint64(16) & np.uint64(_mask(k - 1))
                seen, weight = self._find((model, k - 1, "back"), context)
                out[left[seen]] += weight[seen]
        return out


def probabilities(wanted: DataFrame, model: DataFrame) -> DataFrame:
    """(_model, _gram, _p) for ``wanted`` (_model, _gram, distinct): what ``Scores`` does, as joins with the sharded
    tables, order by order; only n-grams that an order lacks go on to the next."""
    asked, done = wanted.withColumn("_rest", F.col("_gram")).withColumn("_w", F.lit(1.0)), None
    for k in range(ORDER, -1, -1):
        table = model.filter((F.col("_order") == k) & F.col("_p").isNotNull()).select("_model", F.col("_gram").alias("_rest"), "_p")
        met = materialize(asked.join(table, ["_model", "_rest"], "left"), f"order{k}")
        if k:
            found = met.filter("_p IS NOT NULL").select("_model", "_gram", (F.col("_w") * F.col("_p")).alias("_p"))
            context = F.shiftrightunsigned("_rest", 16) if k > 1 else F.lit(0).cast("long")
            backs = model.filter((F.col("_order") == k - 1) & F.col("_back").isNotNull()).select("_model", F.col("_gram").alias("_context"), "_back")
            asked = met.filter("_p IS NULL").drop("_p").withColumn("_context", context).join(backs, ["_model", "_context"], "left")
            asked = asked.select("_model", "_gram", F.col("_rest").bitwiseAND(F.lit(_mask(k - 1))).alias("_rest"), (F.col("_w") * F.coalesce("_back", F.lit(1.0))).alias("_w"))
        else:
            found = met.select("_model", "_gram", (F.col("_w") * F.coalesce("_p", F.lit(1.0))).alias("_p"))
        done = found if done is None else done.unionByName(found)
    return done


def _scored(b: pa.RecordBatch, at: int, loss: np.ndarray, offsets: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """``b`` with the perplexity of each text and its lower bound, from the losses of all its units."""
    n = np.diff(offsets)
    mean, square = (np.diff(np.r_[0.0, np.cumsum(x)][offsets]) / np.maximum(n, 1) for x in (loss, loss * loss))
    error = np.sqrt(np.maximum(square - mean * mean, 0) / np.maximum(n, 1))
    values = (pa.array(np.exp(x), mask=n == 0) for x in (mean, mean - ERRORS * error))
    rest = [c for i, c in enumerate(b.columns) if i != at]
    return pa.RecordBatch.from_arrays([*rest, *values], names)


def perplexities(docs: DataFrame, model: DataFrame, text: str = "text", out: str = "perplexity") -> DataFrame:
    """``docs`` (with the number of a model in _model), without ``text``, with the perplexity per UTF-16 unit of each
    whole text in ``out``, and in ``out``_low its lower bound by ``ERRORS`` standard errors; null for a null or empty
    text.

    A model of up to ``MODEL_ROWS`` rows is broadcast.  Beyond, texts go into blocks, each block asks for its distinct
    n-grams, joins with the sharded model give their probabilities, and blocks and answers meet again.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    docs = docs.drop(out, f"{out}_low")
    at, names = docs.columns.index(text), [*(c for c in docs.columns if c != text), out, f"{out}_low"]
    which = docs.columns.index("_model")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text) + f", `{out}` double, `{out}_low` double"
    if model.count() > MODEL_ROWS:
        return _perplexities_by_blocks(docs, model, at, which, names, schema)
    table = model.toArrow()
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy().astype(t) for c, t in (("_model", np.int8), ("_order", np.int8), ("_gram", np.uint64), ("_p", np.float32), ("_back", np.float32))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = None
        for b in slices(batches, text):
            scores = scores or Scores(*shared.value)
            found, offsets = grams(b.column(at).to_pylist())
            models = np.repeat(b.column(which).to_numpy(), np.diff(offsets))
            loss = np.zeros(len(found))
            for m in np.unique(models).tolist():
                mine = models == m
                distinct, place = np.unique(found[mine], return_inverse=True)
                loss[mine] = -scores(m, distinct)[place]
            yield _scored(b, at, loss, offsets, names)

    return map_arrow(docs, run, schema)


def _perplexities_by_blocks(docs: DataFrame, model: DataFrame, at: int, which: int, names: list[str], schema: str) -> DataFrame:
    """The way of ``perplexities`` for a model of any size.  A block is written once, compressed, with its requests."""
    import uuid

    run_id, text = uuid.uuid4().hex, docs.columns[at]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names_, part, number = ["_block", "_model", "_gram", "_rows"], TaskContext.get().partitionId(), 0
        held: dict[int, np.ndarray] = {}
        size = 0

        def requests() -> Iterator[pa.RecordBatch]:
            for m, asked in held.items():
                for i in range(0, len(asked), 50_000):
                    g = asked[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(g), pa.string()), pa.array(np.full(len(g), m, dtype=np.int32)), pa.array(g.view(np.int64)), pa.nulls(len(g), pa.binary())], names_)

        block = f"{run_id}-{part}-{number}"
        for b in slices(batches, text):
            found, offsets = grams(b.column(at).to_pylist())
            models = np.repeat(b.column(which).to_numpy(), np.diff(offsets))
            for m in np.unique(models).tolist():
                held[m] = np.unique(np.r_[held.get(m, np.zeros(0, np.uint64)), found[models == m]])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names_)
            size += len(found)
            if size > BLOCK_BYTES:
                yield from requests()
                held, size, number = {}, 0, number + 1
                block = f"{run_id}-{part}-{number}"
        yield from requests()

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        known = {}
        model_of, gram, p = (answers.column(c).to_numpy() for c in ("_model", "_gram", "_p"))
        for m in np.unique(model_of).tolist():
            mine = np.flatnonzero(model_of == m)
            mine = mine[np.argsort(gram[mine].view(np.uint64))]
            known[m] = gram[mine].view(np.uint64), -np.log(p[mine])
        out = []
        for raw in rows.column("_rows").to_pylist():
            for b in pa.ipc.open_stream(raw):
                found, offsets = grams(b.column(at).to_pylist())
                models = np.repeat(b.column(which).to_numpy(), np.diff(offsets))
                loss = np.zeros(len(found))
                for m in np.unique(models).tolist():
                    mine = models == m
                    keys, values = known[m]
                    loss[mine] = values[np.searchsorted(keys, found[mine])]
                out.append(_scored(b, at, loss, offsets, names))
        give_back()
        return pa.Table.from_batches(out)

    asked = materialize(map_arrow(docs, ask, "_block string, _model int, _gram long, _rows binary"), "blocks")
    requests = asked.filter("_rows IS NULL").select("_block", "_model", "_gram")
    wanted = materialize(requests.select("_model", "_gram").distinct(), "wanted")
    answers = keyed_join(requests, materialize(probabilities(wanted, model), "answers"), ["_model", "_gram"], "_block")
    blocks = asked.filter("_rows IS NOT NULL").select(F.col("_block").alias("_of"), "_rows")
    return blocks.groupBy("_of").cogroup(answers.groupBy("_block")).applyInArrow(score, schema)


def train(texts: DataFrame) -> DataFrame:
    """The models of ``texts`` (_text, _fold): number ``FOLDS`` of all of them, number i of all but those of fold i."""
    prepare_workers(texts.sparkSession)
    counts = materialize(gram_counts(texts), "counts")
    models = F.array(F.lit(_FULL), *(F.when(F.col("_fold") != i, i) for i in range(FOLDS)))
    counts = counts.select(F.explode(F.filter(models, lambda m: m.isNotNull())).alias("_model"), "_gram", "_c").groupBy("_model", "_gram").agg(F.sum("_c").alias("_c"))
    return materialize(kneser_ney(materialize(counts, "grams")).coalesce(8), "model")


def scored_documents(docs: DataFrame, trusted: DataFrame, id: str, text: str, lang: str, rejected: float, slack: float) -> DataFrame:
    """(_id, _row, _given, perplexity, threshold, kept) of each row of ``docs``."""
    prepare_workers(docs.sparkSession)
    ids = materialize(trusted.select("_id").filter("_id IS NOT NULL").distinct(), "ids")
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    fold = F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int")
    known = keyed_join(maybe_among(rows, ids, ["_id"]).filter("_maybe").drop("_maybe"), ids, ["_id"], "_id", "left_semi")
    model = train(known.filter("_text IS NOT NULL").select("_text", fold.alias("_fold")))
    rows = docs.select(F.col(id).alias("_id"), row_key(text).alias("_row"), F.col(text).alias("_text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"), F.col(lang).alias("_given"))
    rows = keyed_join(rows, materialize(ids.withColumn("_trusted", F.lit(True)), "flags"), ["_id"], "_row", "left")
    rows = rows.withColumn("_model", F.when(F.col("_trusted"), fold).otherwise(_FULL)).drop("_trusted")
    scored = materialize(perplexities(rows, model, "_text"), "scored")
    seen = scored.filter((F.col("_model") < FOLDS) & F.col("perplexity").isNotNull())
    quantile = F.percentile_approx("perplexity", 1 - rejected, ACCURACY)
    limits, overall = materialize(seen.groupBy("_lang").agg(quantile.alias("_limit")), "limits"), seen.agg(quantile).first()[0]
    out = keyed_join(scored, limits, ["_lang"], "_id", "left").withColumn("threshold", F.coalesce("_limit", F.lit(overall).cast("double")) * slack)
    kept = F.coalesce(F.col("perplexity_low") <= F.col("threshold"), F.col("perplexity").isNotNull())
    return out.select("_id", "_row", "_given", "perplexity", "threshold", kept.alias("kept"))


def classify(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rejected: float = REJECTED, slack: float = SLACK) -> DataFrame:
    """One row per document: ``id``, ``lang``, perplexity, threshold, kept.

    ``trusted`` has the ids of trusted documents in the column _id; the model is trained on all their texts.  A trusted
    document is scored by the model of the other folds, any other by the model of all.  A language's threshold is the
    quantile 1 - ``rejected`` of its trusted documents' perplexities times ``slack``; a language without trusted
    documents takes that of all trusted documents.  Documents whose perplexity, less ``ERRORS`` standard errors, is up
    to their threshold are kept.  A null or empty text has no perplexity and goes; without any trusted text nothing can
    be told, so all texts stay.  A null language is a language of its own.  Repeated rows are scored each; an empty
    table gives an empty result.
    """
    out = scored_documents(docs, trusted, id, text, lang, rejected, slack)
    return out.select(F.col("_id").alias(id), F.col("_given").alias(lang), "perplexity", "threshold", "kept")


def keep_good(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rejected: float = REJECTED, slack: float = SLACK) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns."""
    bad = scored_documents(docs, trusted, id, text, lang, rejected, slack).filter("NOT kept").select(F.col("_id").cast("long").alias("_id"), "_row")
    return keep_rows(docs, bad, bad.limit(0), id, text)
