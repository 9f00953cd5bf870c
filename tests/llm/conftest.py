import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, norm string, fp long"


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text[, lang, source]) as documents, with extra columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or ""), "x", "y", 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def words():
    """A seeded writer of texts."""

    def write(seed, n, vocabulary=300):
        r = random.Random(seed)
        return " ".join("".join(r.choice(["the", "er", "on", "ti", "an", "re", "st", "ou"]) for _ in range(r.randrange(1, 4))) if r.random() < 0.7 else f"w{r.randrange(vocabulary)}" for _ in range(n))

    return write


ODD = [(None, "a b c d e"), (1, None), (2, ""), (3, " \t\n"), (4, "a b c d e"), (4, "a b c d e"), (5, "x" * 50_000), (6, "É é 😀 \x0b z"), (7, "one"), (8, "a  b\tc d e")]


@pytest.fixture
def odd(docs):
    """Null ids and texts, empty and blank texts, repeated rows, a very long word, ties."""
    return docs(ODD)


@pytest.fixture
def none(docs):
    return docs([])
