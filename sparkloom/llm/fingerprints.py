"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import KERNEL_BYTES, flat, map_arrow, prepare_workers, slices
from .ordered import cut_points, input_parts, shard_of

#: A phrase ends at a word whose hash is 0 modulo this (and at the end of its paragraph), a section at a paragraph
#: whose hash is 0 modulo that: bounds depend on the content nearby, so an edit moves only those around it.
PHRASE_WORDS, SECTION_PARAGRAPHS = 8, 4
#: Hex digits of a node below the root.
NODE = 16
#: Stands for a null id, which comes before all others.
NO_ID = -(1 << 63)


class Tree:
    """sections > paragraphs > phrases, each node the hash of its children's hashes, so that every node, the root too,
    can be made again from those below it; a phrase is hashed from its bytes."""

    __slots__ = ("root", "sections")

    def __init__(self, root: str, sections: list[tuple[str, list[tuple[str, list[str]]]]]) -> None:
        self.root, self.sections = root, sections

    def __str__(self) -> str:
        """root/section(paragraph:phrases,paragraph:phrases)section(...): all a reader needs to compare and locate."""
        return self.root + "/" + "".join(f"{s}(" + ",".join(f"{p}:{''.join(phrases)}" for p, phrases in paragraphs) + ")" for s, paragraphs in self.sections)

    @classmethod
    def parse(cls, text: str) -> Tree:
        root, _, rest = text.partition("/")
        sections = []
        for part in rest.split(")")[:-1]:
            name, _, inner = part.partition("(")
            paragraphs = [(p[:NODE], [p[i : i + NODE] for i in range(NODE + 1, len(p), NODE)]) for p in inner.split(",")]
            sections.append((name, paragraphs))
        return cls(root, sections)

    def size(self) -> int:
        return sum(len(phrases) for _, paragraphs in self.sections for _, phrases in paragraphs)


def _left_over(a: list, b: list) -> tuple[list, list, int]:
    """The children of ``a`` and ``b`` without partner of the same name, and the phrases below the pairs."""
    names = Counter(x[0] for x in b)
    mine, common = [], 0
    for x in a:
        if names[x[0]] > 0:
            names[x[0]] -= 1
            common += sum(len(p[1]) for p in x[1]) if x[1] and isinstance(x[1][0], tuple) else len(x[1])
        else:
            mine.append(x)
    theirs = []
    for x in reversed(b):
        if names[x[0]] > 0:
            names[x[0]] -= 1
            theirs.append(x)
    return mine, theirs, common


def likeness(a: Tree, b: Tree) -> float:
    """Twice the phrases in common over all phrases, 0 to 1.  Equal roots settle it; sections and paragraphs of equal
    hash are taken whole, and only differing branches are followed down."""
    if a.root == b.root:
        return 1.0
    total = a.size() + b.size()
    if not total:
        return 1.0
    mine, theirs, common = _left_over(a.sections, b.sections)
    mine, theirs, more = _left_over([p for _, s in mine for p in s], [p for _, s in theirs for p in s])
    phrases = Counter(x for _, p in mine for x in p) & Counter(x for _, p in theirs for x in p)
    return 2.0 * (common + more + sum(phrases.values())) / total


def edits(a: Tree, b: Tree) -> tuple[list[int], list[int]]:
    """The paragraphs (by number) of either tree that the other has not: where the texts differ."""
    if a.root == b.root:
        return [], []
    out = []
    for x, y in ((a, b), (b, a)):
        names = Counter(p for _, s in y.sections for p, _ in s)
        missing = []
        for i, (p, _) in enumerate(p for _, s in x.sections for p in s):
            if names[p]:
                names[p] -= 1
            else:
                missing.append(i)
        out.append(missing)
    return out[0], out[1]


def _phrase(raw: bytes) -> str:
    return xxhash.xxh3_64_hexdigest(raw)


def _paragraph(phrases: list[str]) -> str:
    return xxhash.xxh3_64_hexdigest("paragraph " + "".join(phrases))


def _section(paragraphs: list[tuple[str, list[str]]]) -> str:
    return xxhash.xxh3_64_hexdigest("section " + "".join(p for p, _ in paragraphs))


def root_of(sections: list[tuple[str, list]]) -> str:
    return xxhash.xxh3_128_hexdigest("root " + "".join(s for s, _ in sections))


def trees(texts: list[bytes]) -> list[Tree]:
    """The trees of UTF-8 texts.  Every byte belongs to one phrase: white space to the phrase before it, so texts that
    differ in white space alone differ in their roots.  Paragraphs end at line ends."""
    if not texts:
        return []
    data, offsets = flat(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    starts, ends, first = kernels.words(data, offsets)
    hashes = kernels.range_hashes(kernels.BYTE, data, starts, ends)
    newline = np.r_[0, np.cumsum(data == 10)]
    following = np.r_[starts[1:], len(data)]
    last = np.zeros(len(starts), dtype=bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    paragraph_end = (newline[following] > newline[ends]) | last
    phrase_end = np.flatnonzero((hashes % np.uint64(PHRASE_WORDS) == 0) | paragraph_end)
    closes = paragraph_end[phrase_end].tolist()
    stops = following[phrase_end].tolist()
    upto = np.searchsorted(phrase_end, first).tolist()
    out = []
    raw = data.tobytes()
    for i, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        sections: list = []
        paragraphs: list = []
        phrases: list[str] = []
        at = begin
        for j in range(upto[i], upto[i + 1]):
            stop = min(stops[j], end) if j + 1 < upto[i + 1] else end
            phrases.append(_phrase(raw[at:stop]))
            at = stop
            if closes[j]:
                p = _paragraph(phrases)
                paragraphs.append((p, phrases))
                phrases = []
                if int(p, 16) % SECTION_PARAGRAPHS == 0:
                    sections.append((_section(paragraphs), paragraphs))
                    paragraphs = []
        if at < end:  # a text of white space alone is one phrase
            phrases.append(_phrase(raw[at:end]))
        if phrases:
            paragraphs.append((_paragraph(phrases), phrases))
        if paragraphs:
            sections.append((_section(paragraphs), paragraphs))
        out.append(Tree(root_of(sections), sections))
    return out


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text; null counts as empty, whose tree has no section.  A column
    named ``out`` is replaced; an empty table stays empty."""
    prepare_workers(docs.sparkSession)
    docs = docs.drop(out)
    at, names = docs.columns.index(text), [*docs.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            found = [str(t) for t in trees([(x or "").encode() for x in b.column(at).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{out}` string"
    return map_arrow(docs, run, schema)


def edited_by_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``id``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by ascending id; after the last comes the first.  near_edited and near_next compare the document's
    fingerprint with those of the edited text and of the next document.

    Texts cross one shuffle, by ranges of ids; in each part a document meets its successor, and the first document of
    each part is also sent to the part before (the very first to the last), marked as a guest.  Null texts are empty,
    null ids come first; rows that repeat an id follow one another in the order of their texts.  One document follows
    itself; an empty table gives an empty result.
    """
    import hashlib

    spark = docs.sparkSession
    prepare_workers(spark)
    parts = input_parts(docs)
    cuts = cut_points(docs, id, parts)
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    heads = rows.select("_id", shard_of("_id", cuts).alias("_part")).groupBy("_part").agg(F.min(F.coalesce("_id", F.lit(NO_ID))).alias("_head")).orderBy("_part").toPandas()
    # one entry a part: its first id, and the part of the document before it
    first, before = heads["_head"].to_numpy(dtype=np.int64), np.roll(heads["_part"].to_numpy(dtype=np.int32), 1)

    @F.pandas_udf("int")
    def part_before(x: pd.Series) -> pd.Series:
        ids = x.to_numpy(dtype=np.int64)
        at = np.minimum(np.searchsorted(first, ids), len(first) - 1)
        return pd.Series(np.where(first[at] == ids, before[at], -1).astype(np.int32)) if len(first) else pd.Series(np.full(len(ids), -1, np.int32))

    rows = rows.withColumn("_own", shard_of("_id", cuts)).withColumn("_other", part_before(F.coalesce("_id", F.lit(NO_ID))))
    copies = F.filter(F.array(F.struct(F.col("_own").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("_other").alias("part"), F.lit(True).alias("guest"))), lambda x: x["part"] >= 0)
    dealt = rows.withColumn("_to", F.explode(copies)).select("_id", "_text", F.col("_to.part").alias("_part"), F.col("_to.guest").alias("_guest"))
    dealt = dealt.repartitionById(parts, "_part").sortWithinPartitions("_guest", F.col("_id").asc_nulls_first(), "_text").drop("_part")
    names = [id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"`{id}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(group: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """Rows for all but the last of ``group``, which is only the next document of the one before."""
        own = [t for _, t in group]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(own[:-1], own[1:], strict=True)]
        found = trees([t.encode() for t in own] + [t.encode() for t in edited])
        mine, changed = found[: len(own)], found[len(own) :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in group[:-1]], pa.int64()),
                pa.array([len(t) for t in own[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([str(t) for t in mine[:-1]], pa.string()),
                pa.array([str(t) for t in changed], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(mine, changed, strict=False)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(mine[:-1], mine[1:], strict=True)], pa.float64()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int | None, str]] = []
        size, over = 0, False
        for b in batches:
            for i, t, guest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if over:  # repeated rows of the guest's id: only the first in order is the successor
                    continue
                over = guest
                group.append((i, t))
                size += len(t)
                if size > KERNEL_BYTES and len(group) > 1:
                    yield compare(group)
                    group = group[-1:]
                    size = len(t)
        if len(group) > 1:
            yield compare(group)

    return map_arrow(dealt, run, schema)
