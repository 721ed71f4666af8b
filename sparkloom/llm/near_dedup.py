"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges, full sets compared."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import discard, flat, keep_rows, keyed_join, map_arrow, materialize, maybe_among, prepare_workers, row_key, salted_join, slices

#: Bins of the one-permutation sketch, and bins of a band.  32 bands of 5: a pair at the threshold of 0.8 shares no
#: band with probability (1 - 0.8**5)**32, about 3e-6; a pair at 0.2 shares one with probability 0.01.
BINS, ROWS = 160, 5
#: Documents and shingles up to which the sets of a bucket, or of a part of one, are compared in one place.
UNIT_DOCS, UNIT_SHINGLES = 512, 1 << 18
#: Units that one row of requests may name: a document that many units need is read several times.
UNITS_A_ROW = 1024
#: Requested sets up to which the requests are broadcast to the texts.
BROADCAST_UNITS = 1_000_000
#: Shingles that the matrix of a unit holds at a time.
COLUMNS = 8192


def _donors() -> np.ndarray:
    """For each bin the order in which it asks the others for a value if it is empty (optimal densification: a hash of
    bin and attempt, the same for all documents), then every bin in turn so that a filled one is found."""
    tries = np.arange(4 * BINS, dtype=np.uint64)
    bins = np.arange(BINS, dtype=np.uint64)
    asked = kernels.mix(bins[:, None] * np.uint64(1 << 20) + tries[None, :] + np.uint64(77)) % np.uint64(BINS)
    return np.concatenate([asked.astype(np.int64), (np.arange(BINS)[:, None] + np.arange(BINS)[None, :]) % BINS], axis=1)


DONORS = _donors()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One-permutation hashing of a sorted set of 64-bit hashes: bins are equal ranges of hashes, the least value of
    each bin stays; empty bins copy the first filled bin of their own sequence of donors."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    filled = np.zeros(BINS, dtype=bool)
    filled[bins] = True
    out = np.zeros(BINS, dtype=np.uint64)
    out[bins[first]] = hashes[first]
    empty = np.flatnonzero(~filled)
    if len(empty):
        donor = DONORS[empty]
        out[empty] = out[donor[np.arange(len(empty)), filled[donor].argmax(axis=1)]]
    return out


def bands(sketched: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; keys of different bands don't meet."""
    x = sketched.reshape(-1, ROWS)
    key = np.arange(len(x), dtype=np.uint64)
    for i in range(ROWS):
        key = kernels.mix(key + kernels.mix(x[:, i] + np.uint64(i + 1)))
    return key


def shingle_sets(batch: pa.RecordBatch, column: str, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a batch."""
    data, offsets = flat(batch.column(column))
    words, first = kernels.word_hashes(data, offsets)
    return [np.unique(kernels.shingles(words[a:b], size)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def set_name(hashes: np.ndarray) -> bytes:
    """The 128-bit name of a shingle set."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def signatures(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """(_id, _row, _n, _set, _bands): id and hash of the text, size of the shingle set, its name and band keys (no
    set: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            sets = shingle_sets(b, "_text", size)
            keys = [bands(sketch(s)).view(np.int64).tolist() if len(s) else None for s in sets]
            names = [set_name(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["_id", "_row", "_n", "_set", "_bands"])

    rows = docs.select(F.col(id).cast("long").alias("_id"), row_key(text).alias("_row"), F.col(text).alias("_text"))
    return map_arrow(rows, run, "_id long, _row long, _n long, _set binary, _bands array<long>")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sorted sets have in common: products of a matrix of ones, ``COLUMNS`` values at
    a time; values of one set only are left out."""
    m = len(sets)
    flat_, who = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat_, kind="stable")
    flat_, who = flat_[order], who[order]
    column = np.cumsum(np.r_[True, flat_[1:] != flat_[:-1]]) - 1
    often = np.bincount(column)[column] > 1
    column, who = column[often], who[often]
    out = np.diag([float(len(s)) for s in sets])
    if not len(column):
        return out
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]])
    shared = np.zeros((m, m))
    for at in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        ones = np.zeros((m, min(COLUMNS, int(column[b - 1]) - at + 1)), dtype=np.float32)
        ones[who[a:b], column[a:b] - at] = 1
        shared += ones @ ones.T
    np.fill_diagonal(shared, out.diagonal())
    return shared


def stars(sets: list[np.ndarray], share: int) -> np.ndarray:
    """For each set the first one of its component, where sets that share ``share`` percent of their union are linked:
    the centre of its star."""
    n = np.array([len(s) for s in sets], dtype=np.float64)
    if len(sets) == 2:
        small, large = sorted(sets, key=len)
        if 100 * len(small) < share * len(large):
            return np.arange(2)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        common = int((large[at] == small).sum())
        return np.array([0, 0 if 100 * common >= share * (n.sum() - common) else 1])
    common = overlaps(sets)
    near = 100 * common >= share * (n[:, None] + n[None, :] - common)
    label = np.arange(len(sets))
    while True:
        new = np.where(near, label[None, :], len(sets)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def star_edges(docs: DataFrame, units: DataFrame, text: str, id: str, size: int, share: int) -> DataFrame:
    """(_a, _b): links within each unit, as stars: the centre of a component and each other member.

    ``units`` (_band, _part, _copy, _id, _row): which documents meet where.  The sets of requested texts are made anew
    and sent to their units, where all of a unit (bounded by ``UNIT_DOCS`` and ``UNIT_SHINGLES``) are compared in full.
    """
    wanted = materialize(units.groupBy("_id", "_row", "_copy").agg(F.collect_list(F.struct("_band", "_part")).alias("_units")).drop("_copy"), "wanted")
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = maybe_among(rows, wanted.select("_id"), ["_id"]).filter("_maybe").select("_id", row_key("_text").alias("_row"), "_text")
    few = (wanted.agg(F.sum(F.size("_units"))).first()[0] or 0) <= BROADCAST_UNITS
    asked = rows.join(F.broadcast(wanted), ["_id", "_row"]) if few else salted_join(rows, wanted, ["_id", "_row"], "_row")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["_band", "_part", "_set", "_shingles"])

        for b in slices(batches, "_text"):
            for s, named in zip(shingle_sets(b, "_text", size), b.column(1).to_pylist(), strict=True):
                name, raw = set_name(s), s.tobytes()
                for u in named:
                    out.append((u["_band"], u["_part"], name, raw))
                    held += len(raw) + 64
                    if held > 1 << 22:
                        yield batch()
                        out, held = [], 0
        if out:
            yield batch()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, members = None, {}

        def edges() -> list[tuple[bytes, bytes]]:
            if len(members) < 2:
                return []
            names = sorted(members)
            centre = stars([np.frombuffer(members[x], dtype=np.uint64) for x in names], share)
            return [(names[c], x) for c, x in zip(centre.tolist(), names, strict=True) if names[c] != x]

        def batch(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["_a", "_b"])

        found: list = []
        for b in batches:
            for band, part, name, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (band, part) != unit:
                    found += edges()
                    unit, members = (band, part), {}
                    if len(found) > 10_000:
                        yield batch(found)
                        found = []
                members[name] = raw
        found += edges()
        yield batch(found)

    sent = map_arrow(asked.select("_text", "_units"), send, "_band long, _part long, _set binary, _shingles binary")
    met = sent.repartition("_band", "_part").sortWithinPartitions("_band", "_part")
    found = materialize(map_arrow(met, compare, "_a binary, _b binary").distinct(), "links")
    discard(wanted)
    return found


def parts_of(size: str, total: str):
    """Into how many units documents go, by their number and that of their shingles."""
    return F.greatest(F.ceil(F.col(size) / UNIT_DOCS), F.ceil(F.col(total) / UNIT_SHINGLES)).cast("long")


def first_units(places: DataFrame) -> DataFrame:
    """(_band, _part, _copy, _id, _row) of the first pass over ``places`` (_band, _set, _n, _id, _row, _size, _parts): a
    small bucket is one unit; a large one is dealt over several, and its star's centre - the document that shares most
    places with others - goes to each of them."""
    own = places.select("_band", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("_set", "_band"), F.col("_parts"))).otherwise(0).alias("_part"), F.lit(-1).cast("long").alias("_copy"), "_id", "_row")
    large = places.filter("_parts > 1")
    weights = large.groupBy("_set").agg(F.sum("_size").alias("_weight"))
    centres = keyed_join(large, materialize(weights, "weights"), ["_set"], "_band").groupBy("_band", "_parts").agg(F.max_by(F.struct("_id", "_row"), F.struct("_weight", "_set")).alias("_c"))
    everywhere = centres.select("_band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), F.col("_c._id").alias("_id"), F.col("_c._row").alias("_row"))
    return own.unionByName(everywhere.select("_band", "_part", F.expr(f"_part div {UNITS_A_ROW}").alias("_copy"), "_id", "_row"))


def rest_units(large: DataFrame, roots: DataFrame, share: int) -> DataFrame:
    """(_band, _part, _copy, _id, _row) of the second pass over large buckets that hold several components.

    A bucket's largest component needs no more comparing in itself.  The others are its rest: they meet each other and
    the largest one, block by block, where sizes may reach ``share``: sizes go by classes so wide that linked documents
    are in the same or in adjacent ones.
    """
    width = -math.log(share / 100) * 1.0001 if share < 100 else 1e-9
    places = keyed_join(large.select("_band", "_set", "_n", "_id", "_row"), roots, ["_set"], "_band", "left").withColumn("_root", F.coalesce("_root", "_set"))
    groups = places.groupBy("_band", "_root").agg(F.count("*").alias("_m")).groupBy("_band").agg(F.max_by("_root", F.struct("_m", "_root")).alias("_major"), F.count("*").alias("_roots"))
    still = materialize(groups.filter("_roots > 1").select("_band", "_major"), "open")
    places = keyed_join(places, still, ["_band"], "_set").select("_band", "_set", "_n", "_id", "_row", F.floor(F.log("_n") / width).alias("_class"), (F.col("_root") != F.col("_major")).alias("_rest"))
    places = materialize(places, "rest")
    cells = materialize(places.groupBy("_band", "_class", "_rest").agg(F.count("*").alias("_size"), F.sum("_n").alias("_total")).withColumn("_parts", parts_of("_size", "_total")).drop("_size", "_total"), "cells")
    other = cells.select("_band", F.col("_class").alias("_class2"), F.col("_rest").alias("_rest2"), F.col("_parts").alias("_parts2"))
    pairs = cells.join(other, "_band").filter("abs(_class - _class2) <= 1 AND (_rest OR _rest2)")
    meet = pairs.groupBy("_band", "_class", "_rest", "_parts").agg(F.collect_list(F.struct("_class2", "_rest2", "_parts2")).alias("_with"))  # six cells at most
    dealt = keyed_join(places, materialize(meet, "meet"), ["_band", "_class", "_rest"], "_set").withColumn("_block", F.pmod(F.xxhash64("_set", "_band"), F.col("_parts")))
    dealt = dealt.withColumn("_w", F.explode("_with")).withColumn("_block2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w._parts2") - 1)))
    one, two = F.struct("_class", "_rest", F.col("_block").alias("_b")), F.struct(F.col("_w._class2").alias("_class"), F.col("_w._rest2").alias("_rest"), F.col("_block2").alias("_b"))
    return dealt.select("_band", F.xxhash64(F.least(one, two), F.greatest(one, two)).alias("_part"), F.expr(f"_block2 div {UNITS_A_ROW}").alias("_copy"), "_id", "_row")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(_id, _root): the smallest id that each node of ``nodes`` (_id) reaches over ``edges`` (_a, _b).

    Rounds of: take the least root among the neighbours, hook the own root to it, then follow roots (pointer
    jumping).  Each round's labels are written to the shared folder.  Nodes without edges are their own root.
    """
    both = materialize(edges.select("_a", "_b").unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("_a").alias("_id")).agg(F.least("_id", F.min("_b")).alias("_root")), "labels")
    while True:
        # the least root among a node and its neighbours
        near = keyed_join(both, labels.select(F.col("_id").alias("_a"), F.col("_root").alias("_r")), ["_a"], "_b").groupBy(F.col("_b").alias("_id")).agg(F.min("_r").alias("_r"))
        seen = materialize(keyed_join(near, labels, ["_id"], "_id").select("_id", "_root", F.least("_root", "_r").alias("_new")), "seen")
        # hook: a root takes the least root that any member of its tree has seen
        hooks = materialize(seen.groupBy("_root").agg(F.min("_new").alias("_h")), "hooks")
        hooked = materialize(keyed_join(seen, hooks, ["_root"], "_id").select("_id", F.col("_root").alias("_old"), F.least("_new", "_h").alias("_root")), "hooked")
        # jump: the root's root
        parents = hooked.select(F.col("_id").alias("_root"), F.col("_root").alias("_up"))
        after = materialize(keyed_join(hooked, parents, ["_root"], "_id", "left").select("_id", "_old", F.least("_root", F.coalesce("_up", "_root")).alias("_root")), "labels")
        changed = after.filter("_root != _old").limit(1).count()
        discard(labels, seen, hooks, hooked)
        labels = after.select("_id", "_root")
        labels.stored_at = after.stored_at
        if not changed:
            discard(both)
            return nodes.join(labels, "_id", "left").withColumn("_root", F.coalesce("_root", "_id"))


def near_groups(docs: DataFrame, id: str, text: str, words: int, share: int) -> DataFrame:
    """(_id, _row, _n, _root) of each row: its component, named by one of the component's sets; null without a set or an
    id."""
    prepare_workers(docs.sparkSession)
    signed = materialize(signatures(docs, id, text, words), "signatures")
    heads = signed.filter("_n > 0 AND _id IS NOT NULL").groupBy("_set").agg(F.min(F.struct("_id", "_row")).alias("_rep"), F.max("_n").alias("_n"), F.first("_bands").alias("_bands"))
    heads = materialize(heads.select("_set", "_n", "_rep.*", "_bands"), "classes")
    banded = heads.select("_set", "_n", "_id", "_row", F.explode("_bands").alias("_band"))
    buckets = materialize(banded.groupBy("_band").agg(F.count("*").alias("_size")).filter("_size > 1").select("_band"), "buckets")
    places = materialize(keyed_join(maybe_among(banded, buckets, ["_band"]).filter("_maybe").drop("_maybe"), buckets, ["_band"], "_set"), "places")
    # of buckets with the same members, one; the members' hashes tell
    members = places.groupBy("_band").agg(F.count("*").alias("_size"), F.sum("_n").alias("_total"), F.bit_xor(F.xxhash64("_set")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "_set")).alias("_y"))
    distinct = members.groupBy("_size", "_total", "_x", "_y").agg(F.min("_band").alias("_band")).select("_band", "_size", parts_of("_size", "_total").alias("_parts"))
    places = materialize(keyed_join(places, materialize(distinct, "distinct"), ["_band"], "_set"), "places")
    links = star_edges(docs, first_units(places), text, id, words, share)
    ends = lambda found: found.select(F.col("_a").alias("_id")).unionByName(found.select(F.col("_b").alias("_id"))).distinct()
    named = lambda found: materialize(components(ends(found), found).select(F.col("_id").alias("_set"), "_root"), "roots")
    roots = named(links)
    large = places.filter("_parts > 1")
    if large.limit(1).count():
        more = star_edges(docs, rest_units(large, roots, share), text, id, words, share)
        if more.limit(1).count():
            roots = named(materialize(links.unionByName(more).distinct(), "links"))
    discard(buckets, places)
    out = salted_join(signed.select("_id", "_row", "_n", "_set"), roots, ["_set"], "_id", "left")
    return out.select("_id", "_row", "_n", F.when(F.col("_id").isNotNull(), F.coalesce("_root", "_set")).alias("_root"))


def near_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, share: int = 80) -> DataFrame:
    """One row per document: ``id``, n_shingles, component_id, kept.

    Documents are linked if their sets of ``words``-word shingles (A-Z lower-cased) share ``share`` percent of their
    union; component_id is the smallest id of a component, whose documents are kept.  A text of fewer words has its
    whole sequence as its one shingle; a text without words, or null, has none and is linked with nothing.

    Equal sets are one class.  Classes meet in the banded buckets of their sketches; buckets with the same members are
    one.  A bucket of up to ``UNIT_DOCS`` classes is compared in one place; a larger one is dealt over several, each
    with the bucket's centre, and where that leaves it with several components, all but the largest meet all others
    block by block.  So each two classes that share a bucket have been compared on their full sets or are in one
    component; only stars are sent on.
    Rows that repeat an id are documents of their own: each belongs to the component of its text.  A null id is linked
    with nothing and kept.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = materialize(near_groups(docs, id, text, words, share), "groups")
    least = rows.filter("_root IS NOT NULL").groupBy("_root").agg(F.min("_id").alias("_least"))
    out = salted_join(rows, least, ["_root"], "_id", "left")
    component = F.coalesce("_least", "_id")
    return out.select(F.col("_id").alias(id), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def unique_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, share: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of ``near_dedup`` one row, that of the smallest id (of rows that
    repeat it, the one with the least hash of its text).  Rows without a shingle or an id stay all."""
    rows = materialize(near_groups(docs, id, text, words, share).filter("_root IS NOT NULL"), "groups")
    best = rows.groupBy("_root").agg(F.min(F.struct("_id", "_row")).alias("_best"), F.count("*").alias("_m")).filter("_m > 1").select("_root", "_best")
    marked = materialize(salted_join(rows, best, ["_root"], "_id").select("_id", "_row", (F.struct("_id", "_row") == F.col("_best")).alias("_stays")), "marked")
    return keep_rows(docs, marked.filter("NOT _stays").select("_id", "_row"), marked.filter("_stays").select("_id", "_row"), id, text)
