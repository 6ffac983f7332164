import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int, rid long, kind int, data binary, part int, score double, n_tokens long, label int, component_id long, passed_0 string"


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}x{rng.randrange(9)}" for _ in range(n))


def rows(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", "s", None if t is None else len(t), 5, 9, b"x", 1, 0.5, 3, 1, 7, "p") for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="session")
def base_texts():
    rng = random.Random(4)
    out = [words(rng, rng.randint(5, 120)) for _ in range(24)]
    out += [out[0], out[0], out[1] + " tail", "lead " + out[1], out[2][:200] + " " + out[3][:300], "", None, " \n\t ", "é" * 150 + " çà 日本 😀 " + out[4], "a" * 3000, words(rng, 9000), "one", "one two"]
    return out


@pytest.fixture(scope="session")
def documents(spark, base_texts):
    return spark.createDataFrame(rows(base_texts), DOCS).repartition(3)


@pytest.fixture(scope="session")
def odd_documents(spark, base_texts):
    """Missing and repeated ids, repeated rows."""
    own = [*base_texts[:8], base_texts[0], base_texts[0], "", None, base_texts[1] + " more"]
    return spark.createDataFrame(rows(own, [3, 3, None, None, 4, 5, 6, 7, 3, None, None, 8, 9]), DOCS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
