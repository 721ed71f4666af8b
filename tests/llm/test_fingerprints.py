"""Merkle fingerprints against a plain reading of the contract."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import prose

from sparkloom.llm import fingerprints as P


def tree(text):
    return P.trees([text.encode()])[0]


def test_next_document(spark, docs, corpus):
    rows = sorted((i, t or "") for i, t, *_ in corpus)
    texts = [t for _, t in rows]
    got = {r["doc_id"]: r for r in P.edited_by_next(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        following, half = texts[(k + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == str(tree(t)) and r["edited_fingerprint"] == str(tree(edited))
        assert r["near_edited"] == P.likeness(P.Tree.parse(r["fingerprint"]), P.Tree.parse(r["edited_fingerprint"]))
        assert r["near_next"] == P.likeness(tree(t), tree(following))


def test_edges(spark, odd, empty):
    assert P.edited_by_next(odd).count() == odd.count()
    assert P.edited_by_next(empty).count() == 0
    alone = P.edited_by_next(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest() and alone["near_next"] == 1.0
    assert P.fingerprint(odd).columns == [*odd.columns, "fingerprint"]
    assert P.fingerprint(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab \n\té."), max_size=60), st.text(st.sampled_from("ab \n\té."), max_size=60))
def test_roots_tell_texts_apart(a, b):
    x, y = P.trees([a.encode(), b.encode()])
    assert (x.root == y.root) == (a == b)
    assert str(x) == str(tree(a))
    read = P.Tree.parse(str(x))
    assert read.size() == x.size() and P.root_of(read.sections) == x.root
    assert all(s == P._section(p) and all(n == P._paragraph(h) for n, h in p) for s, p in read.sections)
    assert 0 <= P.likeness(x, y) <= 1 and P.likeness(x, x) == 1.0
    assert P.likeness(x, y) == P.likeness(y, x)


def test_an_edit_is_local():
    import random

    rng = random.Random(1)
    lines = [prose(rng, 40).replace("\n", " ") for _ in range(60)]
    changed = [*lines]
    changed[30] += " and more"
    a, b = tree("\n".join(lines)), tree("\n".join(changed))
    assert a.root != b.root and P.likeness(a, b) > 0.97
    assert P.edits(a, b) == ([30], [30])
    same = {s for s, _ in a.sections} & {s for s, _ in b.sections}
    assert len(same) >= len(a.sections) - 2
