"""Token ids in files: Re-Pair grammars per block, with random access."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Encoder, made, vocabulary
from .common import map_arrow, prepare_workers, shared_dir
from .ordered import cut_points, input_parts, shard_of

#: Ids of a block, the unit that is compressed on its own (a longer document makes a longer block).
BLOCK_IDS = 1 << 20
#: A pair becomes a rule if it occurs this often in its block.
MIN_COUNT = 48

#: The file format: a Parquet table with a row per block.  code_base: symbols below are ids, symbol code_base + i is
#: rule i; rules: left and right symbol of each rule; lengths: how many ids each rule stands for; sequence: the
#: block's symbols; places: where each document's symbols begin.  Binary columns hold little-endian unsigned integers
#: of 16 bits (rules and sequence of narrow vocabularies), 32 bits, or 64 bits (places).
FORMAT = "shard int, block int, n_docs long, n_tokens long, code_base long, wide boolean, doc_ids binary, no_id binary, rules binary, lengths binary, sequence binary, places binary"


#: Bits of a table's size that leads from a pair to its number.
SLOT_BITS = 18


def _slot(keys: np.ndarray) -> np.ndarray:
    bits = keys.dtype.itemsize * 8
    return (keys * keys.dtype.type(0x9E3779B1)) >> keys.dtype.type(bits - SLOT_BITS)


def _find(pairs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``keys`` that are among the sorted ``pairs``, and which they are.  A small table says most of
    them; a binary search is left for those that share its slot with another pair."""
    table = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
    table[_slot(pairs)] = np.arange(len(pairs))
    which = table[_slot(keys)]
    at = np.flatnonzero(which >= 0)
    which, keys = which[at], keys[at]
    other = np.flatnonzero(pairs[which] != keys)
    which[other] = np.minimum(np.searchsorted(pairs, keys[other]), len(pairs) - 1)
    true = np.ones(len(at), dtype=bool)
    true[other] = pairs[which[other]] == keys[other]
    return at[true], which[true]


class Grammar:
    """Re-Pair over documents that lie one after the other: frequent pairs of symbols give way to new symbols, round
    by round.  No pair reaches over the end of a document, so each can be read alone.  After the first round only the
    places where a frequent pair is left or a new symbol stands are counted again."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray, sequence: np.ndarray, places: np.ndarray) -> None:
        self.base, self.rules, self.lengths, self.sequence, self.places = base, rules, lengths, sequence, places
        self._flat: tuple[np.ndarray, np.ndarray] | None = None
        self._lengths: np.ndarray | None = None

    @classmethod
    def compress(cls, ids: np.ndarray, places: np.ndarray, base: int, min_count: int = MIN_COUNT) -> Grammar:
        """``places``: where documents begin in ``ids``, and the end.  A round takes the frequent pairs in the order of
        their counts; a symbol may stand only on the left or only on the right side of a round's pairs, so places
        don't overlap and all are replaced at once.  It ends when no pair is frequent, or no symbol is left."""
        wide = base > 1 << 16
        limit = (1 << 32 if wide else 1 << 16) - base
        narrow, double, shift = (np.uint32, np.uint64, 32) if wide else (np.uint16, np.uint32, 16)
        sequence, places = ids.astype(narrow), places.astype(np.int64)
        rules: list[np.ndarray] = []
        count = 0
        live = np.ones(len(sequence), dtype=bool)  # places of pairs that may be frequent
        while count < limit:
            live[-1:] = False
            live[places[(places > 0) & (places < len(sequence))] - 1] = False
            at = np.flatnonzero(live)
            keys = sequence[at].astype(double) << double(shift) | sequence[at + 1]
            ordered = np.sort(keys)
            starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else at
            counts = np.diff(np.r_[starts, len(ordered)])
            often = counts >= min_count
            if not often.any():
                break
            pairs, counts = ordered[starts[often]], counts[often]
            chosen = cls._choose(pairs[np.argsort(-counts, kind="stable")], shift, limit - count)
            chosen.sort()
            rule = np.full(len(pairs), -1)
            rule[np.searchsorted(pairs, chosen)] = np.arange(len(chosen))
            found, pair = _find(pairs, keys)
            at, pair = at[found], rule[pair]
            ruled = pair >= 0
            hits, new = at[ruled], pair[ruled]
            first = np.maximum.accumulate(np.where(np.r_[True, np.diff(hits) > 1], hits, 0))
            apart = (hits - first) % 2 == 0  # places of a doubled symbol may overlap: every other one
            hits, new = hits[apart], new[apart]
            sequence[hits] = (base + count + new).astype(narrow)
            keep = np.ones(len(sequence), dtype=bool)
            keep[hits + 1] = False
            places = places - np.searchsorted(hits + 1, places)
            # a pair of older symbols gets no new places: only frequent ones stay, and those beside a new symbol come
            live = np.zeros(len(sequence), dtype=bool)
            live[at] = True
            sequence, live = sequence[keep], live[keep]
            fresh = hits - np.arange(len(hits))
            live[fresh] = live[np.maximum(fresh - 1, 0)] = True
            rules.append(np.stack([chosen >> double(shift), chosen & double((1 << shift) - 1)], axis=1))
            count += len(chosen)
        table = np.concatenate(rules).astype(np.int64) if rules else np.zeros((0, 2), dtype=np.int64)
        lengths = np.ones(base + count, dtype=np.int64)
        done = base
        for r in rules:  # a round's rules use symbols of earlier rounds only
            lengths[done : done + len(r)] = lengths[r[:, 0].astype(np.int64)] + lengths[r[:, 1].astype(np.int64)]
            done += len(r)
        return cls(base, table, lengths[base:], sequence, places)

    @staticmethod
    def _choose(pairs: np.ndarray, shift: int, most: int) -> np.ndarray:
        side: dict[int, str] = {}
        out = []
        for key in pairs.tolist():
            a, b = key >> shift, key & ((1 << shift) - 1)
            if a == b:
                if a in side:
                    continue
                side[a] = "both"
            elif side.setdefault(a, "left") != "left" or side.setdefault(b, "right") != "right":
                continue
            out.append(key)
            if len(out) == most:
                break
        return np.array(out, dtype=pairs.dtype)

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all symbols end to end, plain ids first, and where each symbol's begin."""
        if self._flat is None:
            starts = np.r_[np.arange(self.base), self.base + np.cumsum(self.lengths) - self.lengths].astype(np.int64)
            flat = np.zeros(self.base + int(self.lengths.sum()), dtype=np.uint32)
            flat[: self.base] = np.arange(self.base)
            where, sizes = starts.tolist(), [1] * self.base + self.lengths.tolist()
            for i, (a, b) in enumerate(self.rules.tolist(), self.base):
                at, n, m = where[i], sizes[a], sizes[b]
                flat[at : at + n] = flat[where[a] : where[a] + n]
                flat[at + n : at + n + m] = flat[where[b] : where[b] + m]
            self._flat = flat, starts
        return self._flat

    def symbol_lengths(self, symbols: np.ndarray) -> np.ndarray:
        if self._lengths is None:
            self._lengths = np.r_[np.ones(self.base, dtype=np.int64), self.lengths.astype(np.int64)]
        return self._lengths[symbols]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, starts = self._expansions()
        lengths = self.symbol_lengths(symbols)
        ends = np.cumsum(lengths)
        if not len(ends):
            return np.zeros(0, dtype=np.uint32)
        return flat[np.repeat(starts[symbols] - ends + lengths, lengths) + np.arange(ends[-1])]

    def document(self, i: int) -> np.ndarray:
        """The ids of one document; the others are not touched."""
        return self.expand(self.sequence[self.places[i] : self.places[i + 1]])

    def at(self, i: int, position: int) -> int:
        """One id of a document: the lengths of its symbols lead to the rule, the rule's sides to the id."""
        symbols = self.sequence[self.places[i] : self.places[i + 1]]
        ends = np.cumsum(self.symbol_lengths(symbols))
        j = int(np.searchsorted(ends, position, side="right"))
        symbol, position = int(symbols[j]), position - (int(ends[j - 1]) if j else 0)
        while symbol >= self.base:
            left, right = self.rules[symbol - self.base].tolist()
            n = 1 if left < self.base else int(self.lengths[left - self.base])
            symbol, position = (left, position) if position < n else (right, position - n)
        return symbol

    def pack(self) -> dict:
        wide = self.base > 1 << 16
        code = "<u4" if wide else "<u2"
        return {"code_base": self.base, "wide": wide, "rules": self.rules.astype(code).tobytes(), "lengths": self.lengths.astype("<u4").tobytes(), "sequence": self.sequence.astype(code).tobytes(), "places": self.places.astype("<u8").tobytes()}

    @classmethod
    def unpack(cls, row: dict) -> Grammar:
        code = "<u4" if row["wide"] else "<u2"
        read = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        return cls(row["code_base"], read("rules", code).astype(np.int64).reshape(-1, 2), read("lengths", "<u4").astype(np.int64), read("sequence", code), read("places", "<u8").astype(np.int64))


#: Words that one call of the library's encoder takes as a text.
WORDS_A_TEXT = 200


def _library_words(spec: dict):
    """Words through the tokenizers library; they come normalized and cut already, and go as texts of many words with
    blanks between, as no word has one.  The last id of a word, and no other, has the end-of-word suffix: that tells the
    words apart.  Where the number of such ids is not that of the words, they go one by one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    last = np.zeros(1 + max(max(vocab.values()), *(x["id"] for x in spec["added_tokens"])), dtype=bool)
    together = bool(suffix) and not any(" " in x["content"] for x in spec["added_tokens"])
    if together:
        last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
    tokenizer = Tokenizer.from_str(json.dumps(spec))
    tokenizer.normalizer = normalizers.Sequence([])
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def ids_of(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if together and words:
            ids = np.concatenate(ids_of([" ".join(words[i : i + WORDS_A_TEXT]) for i in range(0, len(words), WORDS_A_TEXT)]))
            ends = np.flatnonzero(last[ids])
            if len(ends) == len(words) and ends[-1] == len(ids) - 1:
                return ids, np.diff(ends, prepend=-1)
        single = ids_of(words)
        return np.concatenate([np.zeros(0, np.uint32), *single]), np.fromiter(map(len, single), dtype=np.int64, count=len(single))

    return encode


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, id: str = "doc_id", text: str = "text", end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every whole text with the tokenizers library, word by word (a word's ids don't depend on its
    neighbours, so a worker encodes a word once while its cache has it), appends ``end_id`` to each document and writes
    Re-Pair blocks in ascending id order to the folder ``path``.

    Texts are encoded where they are read; only ids travel.  Null texts have the end id alone; null ids come first;
    rows that repeat an id lie side by side.  An empty table gives a table without rows.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    spec = vocabulary(spark, vocabulary_path)
    model = json.loads(spec.value[0])
    base = 1 + max(max(model["model"]["vocab"].values()), *(x["id"] for x in model["added_tokens"]), end_id)
    code = "<u4" if base > 1 << 16 else "<u2"
    end = np.array([end_id], dtype=code).tobytes()
    parts = input_parts(docs)
    cuts = cut_points(docs, id, parts)
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made("library", spec, lambda s, t: Encoder(s, _library_words(s), t))
        points = np.array(cuts, dtype=np.int64)
        for b in batches:
            ids = [np.frombuffer(x, dtype="<u4").astype(code).tobytes() + end for x in encoder(b.column(1).to_pylist())]
            key = b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.searchsorted(points, key, side="right").astype(np.int32)), pa.array(ids, pa.binary())], ["_id", "_shard", "_ids"])

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        def made_block() -> pa.RecordBatch:
            names = np.array([-1 if x is None else x for x, _ in held], dtype="<i8")
            texts = [np.frombuffer(x, dtype=code) for _, x in held]
            places = np.r_[0, np.cumsum([len(x) for x in texts])]
            g = Grammar.compress(np.concatenate(texts), places, base)
            row = {"shard": shard, "block": block, "n_docs": len(held), "n_tokens": int(places[-1]), "doc_ids": names.tobytes(), "no_id": np.array([x is None for x, _ in held], dtype=np.uint8).tobytes()} | g.pack()
            return pa.RecordBatch.from_pylist([row], schema=_arrow)

        for b in batches:
            for name, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((name, ids))
                size += len(ids) // np.dtype(code).itemsize
                if size >= block_ids:
                    yield made_block()
                    block, held, size = block + 1, [], 0
        if held:
            yield made_block()

    encoded = map_arrow(rows, ids_of, "_id long, _shard int, _ids binary")
    dealt = encoded.repartitionById(parts, "_shard").sortWithinPartitions(F.col("_id").asc_nulls_first(), "_ids").select("_id", "_ids")
    map_arrow(dealt, blocks_of, FORMAT).write.parquet(path)


_arrow = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("code_base", pa.int64()), ("wide", pa.bool_()), *((x, pa.binary()) for x in ("doc_ids", "no_id", "rules", "lengths", "sequence", "places"))])


def block_starts(files: DataFrame) -> DataFrame:
    """(shard, block, _start): the ids before each block.  Sums of shards first, then of the blocks in a shard; the
    windows see a row per shard, and the blocks of one."""
    blocks = files.select("shard", "block", "n_tokens")
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("_n")).select("shard", F.coalesce(F.sum("_n").over(before(W.partitionBy().orderBy("shard"))), F.lit(0)).alias("_shard_start"))
    inside = F.coalesce(F.sum("n_tokens").over(before(W.partitionBy("shard").orderBy("block"))), F.lit(0))
    return blocks.withColumn("_inside", inside).join(shards, "shard").select("shard", "block", (F.col("_shard_start") + F.col("_inside")).alias("_start"))


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, ids): every document of the files, its ids as little-endian unsigned 32-bit integers, and the
    number of ids of all documents before it."""
    prepare_workers(spark)
    files = spark.read.schema(FORMAT).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                g = Grammar.unpack(row)
                flat = g.expand(g.sequence).astype("<u4", copy=False)
                upto = np.r_[0, np.cumsum(g.symbol_lengths(g.sequence))][g.places]
                names = [None if gone else x for x, gone in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), row["no_id"], strict=True)]
                n = len(names)
                for at in range(0, n, 500):
                    to = min(n, at + 500)
                    ids = [flat[upto[i] : upto[i + 1]].tobytes() for i in range(at, to)]
                    yield pa.RecordBatch.from_arrays([pa.array(names[at:to], pa.int64()), pa.array([row["shard"]] * (to - at), pa.int32()), pa.array([row["block"]] * (to - at), pa.int32()), pa.array(upto[at:to]), pa.array(ids, pa.binary())], ["doc_id", "shard", "block", "_at", "ids"])

    return map_arrow(files, documents, "doc_id long, shard int, block int, _at long, ids binary")


def token_table(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.  Only these narrow rows meet the block starts."""
    files = spark.read.schema(FORMAT).parquet(path)
    docs = read_token_files(spark, path).select("doc_id", "shard", "block", "_at", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return docs.join(block_starts(files), ["shard", "block"]).select("doc_id", (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/sparkloom/tokens-{uuid.uuid4().hex}"
