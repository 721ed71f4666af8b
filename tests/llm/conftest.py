import random

import pytest
from llm_helpers import SCHEMA, prose



@pytest.fixture(scope="session")
def corpus():
    """Prose with exact and near copies, empty and null texts, ties, one long text."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(3, 160)) for _ in range(110)]
    for i in range(20):
        texts.append(texts[i % 4])
    for i in range(20):
        words = texts[10 + i % 5].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += ["", None, "   ", "word", "Word", "a b c", prose(rng, 9000), "ünïcode ﬁ   ok\n\n x"]
    langs, sources = ["en", "fr", None], ["s1", "s2", "s3", None, "hot", "hot", "hot"]
    return [(i * 3 + 1, t, langs[i % 3], sources[i % 7], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, corpus):
    """Null ids, repeated rows and columns whose names the operators use inside."""
    rows = corpus[:30] + corpus[:3] + [(None, "no id here", "en", "s1", 3), (None, None, None, None, None)]
    names = SCHEMA + ", kept boolean, _id long, _text string, _salt int, _row string, _n long, perplexity double, n_lines long, _lang string"
    return spark.createDataFrame([(*r, True, 1, "x", 2, "y", 3, 0.5, 7, "z") for r in rows], names)
