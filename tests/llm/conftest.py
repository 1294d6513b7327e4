import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rep string, n long"


def sentence(rng, n, words=400):
    return " ".join(f"w{int(rng.random() ** 2 * words)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, and columns whose names clash with the operators'."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    words = base.split(" ")
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [base, base, near, base.upper(), None, "", "  \t\n", "one", "one two", "é😀 zürich straße", sentence(rng, 3000), "same line. " * 400]
    texts += [sentence(rng, rng.randint(5, 80)) for _ in range(40)]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None, None if t is None else len(t), 0.5, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[20], (None, "text without an id at all", "en", "s1", 25, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
