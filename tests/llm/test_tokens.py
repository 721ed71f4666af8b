"""BPE and token files against the tokenizers library."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import bpe, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    spec = json.load(open(PATH))
    return bpe.Encoder(spec, bpe.BatchBPE(spec)), bpe.Decoder(spec)


def ids_of(x):
    return np.frombuffer(x, dtype="<u4").tolist()


CASES = ["", " ", "a'sx 'stop ''s x'll-'ve they'RE 'd", "<|endoftext|>A<|startoftext|><|x", "x\u0085y z\x1c\x1fq", "ΑΣ ΣΑΣ", "İstanbul K Å ﬁ é", "aaaaaaaaaaaaaaaa ababababa", "\x00a﻿", "日本語 123 ½² 🎉🎉", "'", "''", "'s", "a" * 5000 + "!" * 3000]


def test_encoder_equals_library(own, library):
    got = own[0](CASES)
    for text, ids in zip(CASES, got, strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids_of(ids) == expected
        assert own[1](ids) == library.decode(expected, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x24FF, exclude_categories=("Cn", "Cs")), max_size=40), max_size=5))
def test_encoder_on_any_text(texts):
    spec = json.load(open(PATH)) if not hasattr(test_encoder_on_any_text, "e") else None
    if spec:
        test_encoder_on_any_text.e = (bpe.Encoder(spec, bpe.BatchBPE(spec)), Tokenizer.from_file(PATH))
    encoder, library = test_encoder_on_any_text.e
    assert [ids_of(x) for x in encoder(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_code_point(own, library):
    """Between letters, before a mark and after a number: every code point cuts and counts as in the library."""
    for at in range(0, 0x110000, 0x8000):
        texts = ["".join(f"a{chr(c)}b{chr(c)} {chr(c)}\u0301\u0316 1{chr(c)}' " for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(at, at + 0x8000, 64)]
        texts = [t for t in texts if t]
        expected = library.encode_batch_fast(texts, add_special_tokens=False)
        for t, x, e in zip(texts, own[0](texts), expected, strict=True):
            assert ids_of(x) == e.ids, t


def test_words_that_share_a_hash(library, monkeypatch):
    spec = json.load(open(PATH))
    encoder = bpe.Encoder(spec, bpe.BatchBPE(spec))
    real = encoder.split.hashes
    monkeypatch.setattr(bpe, "RECENT_WORDS", 4)
    monkeypatch.setattr(encoder.split, "hashes", lambda *a: real(*a) % np.uint64(5))
    texts = ["one", "two", "one three", "alpha beta gamma delta", "delta two one", "x y z", "alpha"] * 2
    for t in texts:
        assert ids_of(encoder([t])[0]) == library.encode(t, add_special_tokens=False).ids


def test_long_texts_hash_alike(monkeypatch):
    from sparkloom.llm import kernels

    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    starts = np.sort(rng.choice(5000, 300, replace=False))
    ends = np.r_[starts[1:], 5000]
    whole = kernels.range_hashes(kernels.BYTE, data, starts, ends)
    monkeypatch.setattr(kernels, "SEGMENT", 64)
    short = ends - starts <= 64
    parts = kernels.range_hashes(kernels.BYTE, data, starts, ends)
    assert (parts[short] == whole[short]).all() and len(np.unique(parts)) == len(np.unique(whole))


def test_bounded_cache(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    spec = json.load(open(PATH))
    encoder = bpe.Encoder(spec, bpe.BatchBPE(spec))
    for text in ("one two", "three four five six", "one"):
        assert ids_of(encoder([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_cache_keeps_words_that_come_again(library, monkeypatch):
    """Beyond its bound the cache loses the words that came once; those that came again are not encoded anew."""
    monkeypatch.setattr(bpe, "CACHED_WORDS", 12)
    monkeypatch.setattr(bpe, "RECENT_WORDS", 3)
    spec = json.load(open(PATH))
    encode, asked = bpe.BatchBPE(spec), []
    encoder = bpe.Encoder(spec, lambda words: (asked.extend(words), encode(words))[1])
    for i in range(60):
        text = f"often also {'xyz'[i % 3]}{'abcdefghijklmnopqrst'[i % 20] * (i + 1)} é{'q' * i}"
        assert ids_of(encoder([text])[0]) == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.cached.keys) <= 12 and len(encoder.recent.keys) <= 3
    assert asked.count("often") == asked.count("also") == 1
    monkeypatch.setattr(bpe, "CACHED_POINTS", 5)
    for text in ("one two", "three " * 4, "one two three", "two"):
        assert ids_of(encoder([text])[0]) == library.encode(text, add_special_tokens=False).ids
        assert encoder.points.size <= 5


def test_library_gets_many_words_at_once(own, library, monkeypatch):
    """A call of the library takes many words; ids that end words tell them apart, else words go one by one."""
    import tokenizers

    spec = json.load(open(PATH))
    words = sorted({w for t in CASES for w in t.lower().split() if "<" not in w} | {f"w{'ab' * (i % 7)}{'x' * i}" for i in range(700)} | {"</", "w", ">", "<", "/w>"})
    whole = [w for w in words if len(own[0].split.words([w])[2]) == 1]
    texts = []

    class Counting:
        def __init__(self, inner):
            self.__dict__["inner"] = inner

        def __setattr__(self, name, value):
            setattr(self.inner, name, value)

        def encode_batch_fast(self, given, **options):
            texts.append(len(given))
            return self.inner.encode_batch_fast(given, **options)

    class Made:
        @staticmethod
        def from_str(raw):
            return Counting(Tokenizer.from_str(raw))

    monkeypatch.setattr(tokenizers, "Tokenizer", Made)
    ids, sizes = token_files._library_words(spec)(whole)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(w, add_special_tokens=False).ids for w in whole]
    assert len(whole) > 600 and sum(texts) < len(whole) / 50
    plain = json.loads(json.dumps(spec))
    plain["added_tokens"].append(plain["added_tokens"][0] | {"id": 1 + plain["added_tokens"][-1]["id"], "content": "two words"})
    again, sizes = token_files._library_words(plain)(whole)
    assert again.tolist() == ids.tolist() and len(sizes) == len(whole)
    none, sizes = token_files._library_words(spec)([])
    assert len(none) == len(sizes) == 0


def test_grammar_counts_only_places_that_changed(monkeypatch):
    """A round sorts the pairs that may be frequent, not the whole sequence again."""
    rng = np.random.default_rng(4)
    noise, passage = rng.integers(0, 40_000, 60_000), rng.integers(0, 40_000, 300)
    ids, sorted_ = np.r_[noise, np.tile(passage, 60)], []
    real = np.sort
    monkeypatch.setattr(token_files.np, "sort", lambda x: (sorted_.append(len(x)), real(x))[1])
    g = token_files.Grammar.compress(ids, np.array([0, 60_000, len(ids)]), 49_408)
    monkeypatch.undo()
    assert g.expand(g.sequence).tolist() == ids.tolist() and g.lengths.max() >= 300
    assert sorted_[0] == len(ids) - 2 and max(sorted_[1:]) < 20_000


def test_encode_and_decode(docs, corpus, library):
    texts = {i: t for i, t, *_ in corpus}
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(got) == len(corpus)
    for r in got:
        expected = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert ids_of(r["ids"]) == expected
        assert r["decoded"] == library.decode(expected, skip_special_tokens=False)


def test_round_trip_is_both(docs):
    key = lambda r: r["doc_id"]
    assert sorted(bpe.round_trip(docs, PATH).collect(), key=key) == sorted(bpe.decode(bpe.encode(docs, PATH), PATH).collect(), key=key)


def test_bpe_edges(odd, empty):
    assert bpe.round_trip(odd, PATH).count() == odd.count() and bpe.round_trip(empty, PATH).count() == 0
    got = bpe.encode(odd, PATH)
    assert got.count() == odd.count() and got.columns == ["doc_id", "ids"]
    assert bpe.encode(empty, PATH).count() == 0
    assert bpe.decode(got, PATH, out="ids2").columns == ["doc_id", "ids", "ids2"]


@pytest.mark.parametrize("base", [300, 70_000])
def test_grammar_round_trip(base):
    rng = random.Random(base)
    phrases = [[rng.randrange(base) for _ in range(rng.randint(1, 6))] for _ in range(30)]
    documents = [[x for _ in range(rng.randint(0, 60)) for x in rng.choice(phrases)] + [2] for _ in range(80)] + [[7] * 501 + [2]]
    ids = np.array([x for d in documents for x in d], dtype=np.uint32)
    places = np.r_[0, np.cumsum([len(d) for d in documents])]
    g = token_files.Grammar.unpack(token_files.Grammar.compress(ids, places, base, min_count=4).pack())
    assert len(g.rules) > 10 and len(g.sequence) < 0.6 * len(ids)
    assert g.expand(g.sequence).tolist() == ids.tolist()
    for i, d in enumerate(documents):
        assert g.document(i).tolist() == d
        for p in {0, len(d) // 2, len(d) - 1}:
            assert g.at(i, p) == d[p]
    counts = [int(g.lengths[r]) for r in range(len(g.rules))]
    assert counts == [len(g.expand(np.array([base + r]))) for r in range(len(g.rules))]


def test_grammar_limits():
    g = token_files.Grammar.compress(np.zeros(0, dtype=np.uint32), np.array([0, 0]), 49_408)
    assert len(g.sequence) == 0 and len(g.document(0)) == 0
    one = token_files.Grammar.compress(np.array([5]), np.array([0, 1]), 49_408)
    assert one.document(0).tolist() == [5]
    noise = np.random.default_rng(0).integers(0, 65_530, 200_000)
    full = token_files.Grammar.compress(noise, np.array([0, len(noise)]), 65_530, min_count=1)
    assert len(full.rules) <= 6 and full.expand(full.sequence).tolist() == noise.tolist()


def test_files(spark, docs, corpus, library, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path, PATH, block_ids=2000)
    expected, start = {}, 0
    for i, t, *_ in sorted(corpus, key=lambda r: r[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        raw = np.array(ids, dtype="<u4").tobytes()
        expected[i] = (start, len(ids), zlib.crc32(raw), hashlib.sha256(raw).hexdigest())
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_table(spark, path).collect()}
    assert got == {i: x[:3] for i, x in expected.items()}
    read = {r["doc_id"]: hashlib.sha256(r["ids"]).hexdigest() for r in token_files.read_token_files(spark, path).collect()}
    assert read == {i: x[3] for i, x in expected.items()}
    files = spark.read.schema(token_files.FORMAT).parquet(path)
    assert files.count() > 3 and files.agg({"n_tokens": "sum"}).first()[0] == start


def test_file_edges(spark, odd, empty, tmp_path):
    token_files.write_token_files(odd, str(tmp_path / "odd"), PATH)
    got = token_files.token_table(spark, str(tmp_path / "odd")).orderBy("start").collect()
    assert len(got) == odd.count()
    assert [r["doc_id"] for r in got][:2] == [None, None] and [r["start"] for r in got] == np.r_[0, np.cumsum([r["n_tokens"] for r in got])[:-1]].tolist()
    token_files.write_token_files(empty, str(tmp_path / "none"), PATH)
    assert token_files.token_table(spark, str(tmp_path / "none")).count() == 0


def test_grammar_ends_with_no_frequent_pair():
    """Rounds go on until a long passage that many documents share is one symbol."""
    places = np.arange(61) * 2000
    ids = np.tile(np.arange(2000), 60)
    g = token_files.Grammar.compress(ids, places, 49_408)
    assert g.lengths.max() == 2000 and len(g.sequence) == 60
    assert (g.document(7) == np.arange(2000)).all()
