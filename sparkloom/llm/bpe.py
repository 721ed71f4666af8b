"""BPE encoding and decoding by batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from . import kernels
from .common import KERNEL_BYTES, map_arrow, prepare_workers

#: Words whose ids a worker keeps, and their characters in all; beyond, those that came once go, so memory is bounded
#: whatever the vocabulary of the texts.
CACHED_WORDS, CACHED_POINTS = 1_000_000, 1 << 24
#: Words that are kept aside before they are merged into the cache.
RECENT_WORDS = 50_000
_SHIFT = 32
_NONE = np.int64(1 << 40)


# The ranges of bytes that stand for themselves.
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: visible Latin-1 characters stand
    for themselves, the others get the code points from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


# The pattern of the vocabulary file, whose words ``Splitter`` finds - contractions, runs of letters,
# single numbers, runs of other characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _classes() -> np.ndarray:
    """The class of each code point, as the tokenizers library's own patterns tell it."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"[\p{L}]+"), (_NUMBER, r"[\p{N}]+")):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            out[a:b] = kind
    return out


class Splitter:
    """The steps before BPE that the vocabulary file names: special tokens, NFC, one blank for white space, lower case
    by character, and the words of ``PATTERN``, all found at once over flat code points."""

    def __init__(self, spec: dict, tables: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """``tables``: class and agreement of each code point, if they are known already (they take seconds)."""

        steps, cut = spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or cut[0]["pattern"] != {"Regex": PATTERN}:
            raise ValueError("the vocabulary file asks for steps that are not supported")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.kind = tables[0] if tables else _classes()
        self.symbol = kernels.mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(1))
        self._steps: Callable[[str], str] | None = None
        self._wanted = spec["normalizer"]
        self.agreed = tables[1] if tables else self._agreed()

    def library(self, text: str) -> str:
        """The text as the library normalizes it, by a tokenizer without vocabulary that is made when first needed."""
        if self._steps is None:
            from tokenizers import Tokenizer

            bare = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": self._wanted, "pre_tokenizer": None, "post_processor": None, "decoder": None}
            self._steps = Tokenizer.from_str(json.dumps(bare | {"model": {"type": "BPE", "vocab": {}, "merges": []}})).normalizer.normalize_str
        return self._steps(text)

    def _agreed(self) -> np.ndarray:
        """Code points that Python's tables and the library's normalize alike: alone, decomposed and, if they are
        marks, among other marks.  Texts with any other go through the library."""
        known = np.zeros(0x110000, dtype=bool)
        probes: list[tuple[int, str]] = []
        for c in range(1, 0x110000):
            x = chr(c)
            kind = unicodedata.category(x)
            if kind not in ("Cn", "Cs"):
                known[c] = True
                probes.append((c, x))
                if unicodedata.decomposition(x) or 0xAC00 <= c <= 0xD7A3:
                    probes.append((c, unicodedata.normalize("NFD", x)))
                if kind[0] == "M":
                    probes.append((c, f"a\u0301{x}\u0316b{x}\u0345\u0334"))
        theirs = self.library("\0".join(x for _, x in probes)).split("\0")
        spaces = str.maketrans({chr(c): " " for c in np.flatnonzero(self.kind == _SPACE).tolist()})
        ours = self.normalize("\0".join(x for _, x in probes)).translate(spaces).split("\0")
        for (c, _), x, y in zip(probes, theirs, ours, strict=True):
            known[c] &= x == y
        return known

    @staticmethod
    def normalize(text: str) -> str:
        # the capital sigma has one lower-case form when characters are taken one by one
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def normalized(self, texts: list[str]) -> list[str]:
        points = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if self.agreed[points("".join(texts))].all():
            return [self.normalize(t) for t in texts]
        return [self.normalize(t) if self.agreed[points(t)].all() else self.library(t) for t in texts]

    def words(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts in one string, its code points, the starts and ends of its words, and the number of words before
        each text."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        n = len(points)
        if not n:
            nothing = np.zeros(0, dtype=np.int64)
            return joined, points, nothing, nothing, np.zeros(len(texts) + 1, dtype=np.int64)
        offsets = np.r_[0, np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))]
        kind = np.r_[self.kind[points], np.zeros(3, dtype=np.uint8)]
        edge = np.zeros(n + 3, dtype=bool)
        edge[offsets] = True
        new = edge[:n].copy()
        new[0] = True
        new[1:] |= kind[1:n] != kind[: n - 1]
        new |= kind[:n] == _NUMBER
        at = np.flatnonzero((points == ord("'")) & new)
        at = at[(kind[at + 1] == _LETTER) & ~edge[at + 1]]
        if len(at):
            padded = np.r_[points, np.zeros(3, dtype=points.dtype)]
            one, two = padded[at + 1], np.where(edge[at + 2], 0, padded[at + 2])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            new[at[short | long] + 1] = False
            for ends in (at[short] + 2, at[long] + 3):
                new[ends[ends < n]] = True
        bounds = np.r_[np.flatnonzero(new), n]
        solid = kind[bounds[:-1]] != _SPACE
        starts, ends = bounds[:-1][solid], bounds[1:][solid]
        return joined, points, starts, ends, np.searchsorted(starts, offsets)

    def hashes(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return kernels.range_hashes(self.symbol, points, starts, ends)


class BatchBPE:
    """Encodes many words at once: their symbols lie in one flat array; each round finds the lowest-rank pair of every
    word by binary search over the sorted pair keys and merges all its places from left to right."""

    def __init__(self, spec: dict) -> None:
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in symbols], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << _SHIFT | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and how many each word has."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[data]
        filled = lengths > 0
        symbols[ends[filled] - 1] = self.last[data[ends[filled] - 1]]
        word = np.repeat(np.arange(len(raw)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            keys = symbols[:-1] << _SHIFT | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.full(len(symbols), _NONE)
            rank[:-1] = np.where((self.keys[at] == keys) & (word[:-1] == word[1:]), self.rank[at], _NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = least == _NONE
            if over.any():
                done.append((word[over], symbols[over]))
                symbols, word, rank, least = symbols[~over], word[~over], rank[~over], least[~over]
            places = np.flatnonzero(rank == least)
            if len(places):
                run = np.r_[True, np.diff(places) > 1]
                first = np.maximum.accumulate(np.where(run, places, 0))
                places = places[(places - first) % 2 == 0]  # of overlapping places, every other one
                symbols[places] = self.merged[rank[places]]
                keep = np.ones(len(symbols), dtype=bool)
                keep[places + 1] = False
                symbols, word = symbols[keep], word[keep]
        if not done:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(raw), dtype=np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbols[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(raw))


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, end to end."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)


def _bounds(ids_from: int, ids: np.ndarray, points_from: int, points: np.ndarray) -> np.ndarray:
    """Begins and ends of words whose ids and characters lie end to end."""
    a, b = ids_from + np.cumsum(ids), points_from + np.cumsum(points)
    return np.stack([a - ids, a, b - points, b], axis=1).astype(np.int32)


class Pool:
    """Numbers end to end in an array with room at its end."""

    def __init__(self, values: np.ndarray) -> None:
        self.data, self.size = values, len(values)

    def add(self, values: np.ndarray) -> int:
        """Where they begin."""
        begin, self.size = self.size, self.size + len(values)
        if self.size > len(self.data):
            grown = np.zeros(self.size + self.size // 4, dtype=np.uint32)
            grown[:begin] = self.data[:begin]
            self.data = grown
        self.data[begin : self.size] = values
        return begin


class Words:
    """Sorted word hashes, where their ids and their characters begin and end, and which were asked for again."""

    def __init__(self, keys: np.ndarray, bounds: np.ndarray, again: np.ndarray) -> None:
        self.keys, self.bounds, self.again = keys, bounds, again

    @classmethod
    def none(cls) -> Words:
        return cls(np.zeros(0, np.uint64), np.zeros((0, 4), np.int32), np.zeros(0, bool))

    def joined(self, more: Words) -> Words:
        keys = np.concatenate([self.keys, more.keys])
        order = np.argsort(keys, kind="stable")  # of two sorted runs: a merge
        return Words(keys[order], np.concatenate([self.bounds, more.bounds])[order], np.concatenate([self.again, more.again])[order])


class Encoder:
    """Texts to ids.  Words are found by 64-bit hashes and then compared in full; those that are new are encoded
    together by ``encode_words``, the others come from a bounded cache, and ids are gathered for all texts at once."""

    def __init__(self, spec: dict, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], tables: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.split, self.encode_words = Splitter(spec, tables), encode_words
        self._forget()

    def _forget(self) -> None:
        self.cached, self.recent = Words.none(), Words.none()
        self.flat, self.points = Pool(np.zeros(0, np.uint32)), Pool(np.zeros(0, np.uint32))

    def _settle(self) -> None:
        """Merges the words learned lately into the cache.  Where it gets too large, the words that were not asked for
        again go, or all, if that leaves more than half."""
        self.cached, self.recent = self.cached.joined(self.recent), Words.none()
        if len(self.cached.keys) <= CACHED_WORDS and self.points.size <= CACHED_POINTS:
            return
        again = self.cached.again
        keys, bounds = self.cached.keys[again], self.cached.bounds[again].astype(np.int64)
        ids, points = bounds[:, 1] - bounds[:, 0], bounds[:, 3] - bounds[:, 2]
        if 2 * len(keys) > CACHED_WORDS or 2 * points.sum() > CACHED_POINTS:
            return self._forget()
        self.flat, self.points = Pool(self.flat.data[spans(bounds[:, 0], ids)]), Pool(self.points.data[spans(bounds[:, 2], points)])
        self.cached = Words(keys, _bounds(0, ids, 0, points), np.zeros(len(keys), bool))

    def _ids(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of the distinct words with the hashes ``keys``, in their order: an array that holds them, where each
        word's begin and how many they are.  ``words`` gives the words at some places of ``keys``.  None if a hash
        stands for another word in the cache."""
        bounds, known = np.zeros((len(keys), 4), dtype=np.int32), np.zeros(len(keys), dtype=bool)
        for had in (self.cached, self.recent):
            if len(had.keys):
                at = np.minimum(np.searchsorted(had.keys, keys), len(had.keys) - 1)
                hit = had.keys[at] == keys
                at = at[hit]
                bounds[hit], had.again[at] = had.bounds[at], True
                known |= hit
        of, spelled = lengths[known], bounds[known].astype(np.int64)
        if (spelled[:, 3] - spelled[:, 2] != of).any() or (self.points.data[spans(spelled[:, 2], of)] != points[spans(starts[known], of)]).any():
            return None
        rest = np.flatnonzero(~known)
        if len(rest):
            ids, sizes = self.encode_words(words(rest))
            own = lengths[rest]
            bounds[rest] = _bounds(self.flat.add(ids), sizes, self.points.add(points[spans(starts[rest], own)]), own)
            self.recent = self.recent.joined(Words(keys[rest], bounds[rest], np.zeros(len(rest), bool)))
        out = self.flat.data
        if len(self.recent.keys) > RECENT_WORDS or self.points.size > CACHED_POINTS:
            self._settle()
        begin = bounds[:, 0].astype(np.int64)
        return out, begin, bounds[:, 1] - begin

    def _plain(self, texts: list[str]) -> list[bytes]:
        joined, points, starts, ends, first = self.split.words(self.split.normalized(texts))
        if not len(starts):
            return [b""] * len(texts)
        keys, which = np.unique(self.split.hashes(points, starts, ends), return_inverse=True)
        example = np.empty(len(keys), dtype=np.int64)
        example[which] = np.arange(len(which))
        lengths, same = ends - starts, example[which]
        spell = lambda at: [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        known = None
        if (lengths == lengths[same]).all() and (points[spans(starts, lengths)] == points[spans(starts[same], lengths)]).all():
            known = self._ids(keys, points, starts[example], lengths[example], lambda new: spell(example[new]))
        if known is None:  # two words share a hash: the words themselves tell
            listed = spell(np.arange(len(starts)))
            place = {w: i for i, w in enumerate(dict.fromkeys(listed))}
            which = np.fromiter(map(place.__getitem__, listed), dtype=np.int64, count=len(listed))
            coded, sizes = self.encode_words(list(place))
            known = coded, np.cumsum(sizes) - sizes, sizes
        flat, begin, sizes = known
        of_word = sizes[which]
        ids = flat[spans(begin[which], of_word)].tobytes()
        bounds = (np.r_[0, np.cumsum(of_word)][first] * 4).tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text.  Special tokens in a text count as such; the parts between them are texts of their
        own.  Texts go in groups of about ``KERNEL_BYTES`` characters."""
        listed = [t or "" for t in texts]
        parts = [self.split.cut(t) if "<" in t and any(s in t for s in self.split.special) else [t] for t in listed]
        runs = [x for p in parts for x in p[::2]]
        ids: list[bytes] = []
        group, size = [], 0
        for run in runs:
            if group and size + len(run) > KERNEL_BYTES:
                ids += self._plain(group)
                group, size = [], 0
            group.append(run)
            size += len(run)
        ids += self._plain(group) if group else []
        it = iter(ids)
        return [b"".join(self.split.special[x].to_bytes(4, "little") if i % 2 else next(it) for i, x in enumerate(p)) for p in parts]


class Decoder:
    """Ids to text as a vocabulary without decoder has it: tokens with blanks between."""

    def __init__(self, spec: dict) -> None:
        tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        if spec["decoder"] is not None:
            raise ValueError("the vocabulary file asks for a decoder that is not supported")
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]

    def __call__(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_made: dict[tuple[str, str], object] = {}


def made(kind: str, spec: Broadcast, make: Callable[..., object]) -> object:
    """One object a worker process for each vocabulary file."""
    raw, kinds, agreed = spec.value
    key = (kind, hashlib.sha256(raw).hexdigest())
    if key not in _made:
        _made[key] = make(json.loads(raw), (np.frombuffer(kinds, dtype=np.uint8), np.unpackbits(np.frombuffer(agreed, dtype=np.uint8)).astype(bool)))
    return _made[key]


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file (a few MB, fixed) and the tables of code points that go with it (a byte and a bit each) for
    the workers; executors need no copy of the file."""
    with open(path, "rb") as f:
        raw = f.read()
    key = ("tables", hashlib.sha256(raw).hexdigest())
    if key not in _made:
        split = Splitter(json.loads(raw))
        _made[key] = (split.kind.tobytes(), np.packbits(split.agreed).tobytes())
    return spark.sparkContext.broadcast((raw, *_made[key]))


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, ids): the ids of each whole text as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; every row of the input, repeated ones too, gives one row; an empty table gives
    an empty one.  Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    spec = vocabulary(spark, path)
    rows = docs.select(id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made("bpe", spec, lambda s, t: Encoder(s, BatchBPE(s), t))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encoder(b.column(1).to_pylist()), pa.binary())], [id, "ids"])

    kind = rows.schema[id].dataType.simpleString()
    return map_arrow(rows, run, f"`{id}` {kind}, ids binary")


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``out``; null ids give null.  A column named ``out`` is replaced."""
    spark = encoded.sparkSession
    prepare_workers(spark)
    spec = vocabulary(spark, path)
    encoded = encoded.drop(out)
    at = encoded.columns.index(ids)
    names = [*encoded.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = made("text", spec, lambda s, _: Decoder(s))
        for b in batches:
            texts = [None if x is None else decoder(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", `{out}` string"
    return map_arrow(encoded, run, schema)


def round_trip(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, ids, decoded): ``decode`` of ``encode`` in one pass, so that a task needs one Python worker and the ids
    don't travel between two."""
    spark = docs.sparkSession
    prepare_workers(spark)
    spec = vocabulary(spark, path)
    rows = docs.select(id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = made("bpe", spec, lambda s, t: Encoder(s, BatchBPE(s), t)), made("text", spec, lambda s, _: Decoder(s))
        for b in batches:
            ids = encoder(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(map(decoder, ids), pa.string())], [id, "ids", "decoded"])

    return map_arrow(rows, run, f"`{id}` {rows.schema[id].dataType.simpleString()}, ids binary, decoded string")
