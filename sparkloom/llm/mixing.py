"""Mixing sources to target weights with a low-discrepancy schedule of equal-word blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, keyed_join, materialize, text_or_empty

#: Parts into which prefix sums and ranks are cut, so that no window holds a whole source.
PARTS = 1024
#: Source key: null and strings can't meet.
_KEY = "_s"


def source_targets(sized: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """From rows (_s, source, size) one row per source: its size and its target.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; a target stops at ``most`` times
    its source's size and the excess goes to the others by weight.  Sources are filled in the order of limit over
    weight, so each step is a prefix sum.  The windows here see one row per source, not per document.
    """
    sums = sized.groupBy(_KEY).agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = W.partitionBy().orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything, limit = W.partitionBy(), F.col("source_size") * F.lit(float(most))
    before = W.partitionBy().orderBy(F.col("_limit") / F.col("_w"), "_s").rowsBetween(W.unboundedPreceding, -1)
    left = (F.col("_all") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (F.col("_weights") - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    rows = sums.withColumn("_w", weight).withColumn("_limit", limit).withColumn("_all", F.sum("source_size").over(everything).cast("double")).withColumn("_weights", F.sum("_w").over(everything))
    rows = rows.withColumn("_full", F.col("_limit") / F.col("_w") <= left)
    spare = F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_limit")).otherwise(0.0)).over(everything)
    open_ = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(everything)
    target = F.when(F.col("_full"), F.col("_limit")).otherwise(spare * F.col("_w") / F.nullif(open_, F.lit(0.0)))
    return rows.select(_KEY, "source_size", F.least(target, F.col("_limit")).alias("target"))


def stream_positions(sized: DataFrame) -> DataFrame:
    """Adds to rows (_s, size, _key) the word at which each begins in its source's shuffled stream.  Two levels: sums
    of ``PARTS`` parts of a source, then running sums inside a part."""
    part = F.floor(F.conv(F.substring("_key", 1, 3), 16, 10).cast("int") / F.lit(4096 // PARTS)).cast("int")
    rows = sized.withColumn("_part", part)
    in_order = W.partitionBy(_KEY).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy(_KEY, "_part").agg(F.sum("size").alias("_size")).select(_KEY, "_part", F.coalesce(F.sum("_size").over(in_order), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(_KEY, "_part").orderBy("_key", "_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_inside", F.sum("size").over(inside) - F.col("size"))
    return rows.join(parts, [_KEY, "_part"]).withColumn("_start", F.col("_offset") + F.col("_inside")).drop("_part", "_offset", "_inside")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """Slots (slot, _s, epoch, block, words): which block of which source comes when.

    Slot t's van der Corput point (its binary digits mirrored) falls into the cumulative numbers of slots that the
    sources need; its rank among its source's slots names the block.  Points reach a source's share up to a few slots:
    surplus slots go, and missing ones follow at the end, so each source gets its target to the word.
    """
    spark = targets.sparkSession
    words = F.round("target").cast("long")
    rows = targets.filter("source_size > 0").withColumn("_words", words).withColumn("_blocks", F.ceil(F.col("source_size") / block))
    need = F.expr("_words div source_size") * F.col("_blocks") + F.ceil((F.col("_words") % F.col("source_size")) / block)
    upto = W.partitionBy().orderBy("_s").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = materialize(rows.withColumn("_need", need).withColumn("_hi", F.sum("_need").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_need")).filter("_need > 0"), "sources")
    n = rows.agg(F.max("_hi")).first()[0] or 0
    bits, cell = max(1, (n - 1).bit_length()), max(1, n // 4096)
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("double") / F.lit(float(1 << bits))
    points = spark.range(n).withColumnRenamed("id", "slot").withColumn("_p", F.floor(point * n).cast("long")).withColumn("_cell", F.expr(f"_p div {cell}"))
    cells = rows.select(_KEY, "_lo", "_hi", F.explode(F.sequence(F.expr(f"_lo div {cell}"), F.expr(f"(_hi - 1) div {cell}"))).alias("_cell"))
    slots = points.join(cells, "_cell").filter("_p >= _lo AND _p < _hi").select("slot", _KEY, F.expr(f"slot div {max(1, n // PARTS)}").alias("_chunk"))
    in_order = W.partitionBy(_KEY).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = slots.groupBy(_KEY, "_chunk").agg(F.count("*").alias("_n"))
    offsets = counts.select(_KEY, "_chunk", F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy(_KEY, "_chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("_inside", inside).join(offsets, [_KEY, "_chunk"]).select("slot", _KEY, (F.col("_offset") + F.col("_inside")).alias("_rank"))
    got = counts.groupBy(_KEY).agg(F.sum("_n").alias("_got"))
    short = rows.join(got, _KEY, "left").withColumn("_got", F.coalesce("_got", F.lit(0))).filter("_got < _need")
    tail = short.select(_KEY, F.explode(F.sequence("_got", F.col("_need") - 1)).alias("_rank")).select((F.lit(n) + F.col("_rank")).alias("slot"), _KEY, "_rank")
    spans = ranked.unionByName(tail).join(rows.drop("target", "_lo", "_hi"), _KEY).filter("_rank < _need")
    spans = spans.withColumn("epoch", F.expr("_rank div _blocks")).withColumn("block", F.expr("_rank % _blocks"))
    end = F.least((F.col("block") + 1) * block, F.col("source_size"), F.col("_words") - F.col("epoch") * F.col("source_size"))
    return spans.select("slot", _KEY, "epoch", "block", (end - F.col("block") * block).alias("words")).filter("words > 0")


def mix_sources(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3), most: int = 3, block: int = 4096, seed: str = "") -> tuple[DataFrame, DataFrame]:
    """The mix of all documents by words, as two tables.

    positions: a row per document - _id, _s, source, size, source_size, target, _start (its first word in the shuffled
    stream of its source).  pieces: the mix itself - slot (its order), epoch, _s, _start, _id, from_word, n_words: the
    words of a document that the block in this slot brings.

    Documents of a source are shuffled by the MD5 of ``seed`` and id, then cut into blocks of ``block`` words; a source
    that runs out begins again, ``most`` times at most.  Words are ``[^\\x20\\x09-\\x0D]+``; null text has none, and a
    document without words gets no piece.  Null sources form one source, the last.  Repeated rows are documents of
    their own.  An empty table gives empty tables.
    """
    size = F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
    sized = docs.select(F.col(id).alias("_id"), F.col(source).alias("source"), size.alias("size")).withColumn(_KEY, F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))))
    sized = materialize(sized.withColumn("_key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit(""))))), "sizes")
    targets = materialize(source_targets(sized, weights, most), "targets")
    positions = materialize(stream_positions(sized).drop("_key"), "positions")
    slots = schedule(targets, block)
    first, last = F.expr(f"_start div {block}"), F.expr(f"(_start + size - 1) div {block}")
    parts = positions.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    parts = parts.withColumn("_from", F.greatest("_start", F.col("block") * block)).withColumn("_to", F.least(F.col("_start") + F.col("size"), (F.col("block") + 1) * block))
    taken = F.least("_to", F.col("block") * block + F.col("words")) - F.col("_from")
    pieces = parts.join(slots, [_KEY, "block"]).withColumn("n_words", taken).filter("n_words > 0").select("slot", "epoch", _KEY, "_start", "_id", (F.col("_from") - F.col("_start")).alias("from_word"), "n_words")
    return positions.join(F.broadcast(targets) if targets.count() <= 10_000 else targets, _KEY), pieces


def taken_words(positions: DataFrame, pieces: DataFrame) -> DataFrame:
    """positions with ``taken``, the words of each document in the mix, repeats counted, and ``first_slot``, the slot
    that brings the first of them (null: none)."""
    sums = pieces.groupBy(_KEY, "_start").agg(F.sum("n_words").alias("_taken"), F.min("slot").alias("_slot"))
    out = positions.join(sums, [_KEY, "_start"], "left")
    some = F.col("size") > 0
    return out.withColumn("taken", F.when(some, F.coalesce("_taken", F.lit(0))).otherwise(0).cast("long")).withColumn("first_slot", F.when(some, F.col("_slot"))).drop("_taken", "_slot")


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` as the mix has them, in the order of its slots: a document is there as often as the mix takes its words,
    to the nearest whole number (only the last document that a source brings can be cut, so sources stay near their
    targets), each time at the slot of that epoch.  A document without words stays once, before all others.  Rows that
    repeat an id share what the mix takes of them."""
    positions, pieces = mix_sources(docs, id, text, source, **options)
    slots = pieces.groupBy(_KEY, "_start", "epoch").agg(F.sum("n_words").alias("_n"), F.min("slot").alias("_slot"))
    slots = slots.groupBy(_KEY, "_start").agg(F.sum("_n").alias("taken"), F.array_sort(F.collect_list(F.struct("epoch", "_slot"))).alias("_slots"))  # an epoch each
    rows = positions.join(slots, [_KEY, "_start"], "left").withColumn("_slots", F.when(F.col("size") > 0, F.col("_slots"))).withColumn("taken", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))))
    times = F.when(F.sum("size") > 0, F.round(F.sum("taken") / F.sum("size"))).otherwise(1).cast("int")
    copies = rows.filter("_id IS NOT NULL").groupBy("_id").agg(times.alias("_times"), F.max("_slots").alias("_slots"))
    copies = materialize(copies.select("_id", F.when(F.col("_slots").isNull(), F.array_repeat(F.lit(None).cast("long"), F.col("_times"))).otherwise(F.slice(F.col("_slots._slot"), F.lit(1), F.col("_times"))).alias("_slots")), "copies")
    whole = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col(id).alias("_id"))
    joined = keyed_join(whole, copies, ["_id"], "_id", "left").withColumn("_slots", F.coalesce("_slots", F.array(F.lit(None).cast("long"))))
    return joined.select("_row", F.explode("_slots").alias("_slot")).orderBy("_slot").select("_row.*")
