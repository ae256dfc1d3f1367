import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text) pairs or longer rows."""

    def make(rows):
        full = [(*r, *[None] * (5 - len(r))) if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    """Seeded prose: ``words(n, seed)``."""
    stock = [a + b for a in ("th", "er", "on", "in", "st", "re", "ou", "an") for b in ("a", "e", "ing", "ly", "o", "u", "ed", "s", "al", "ic")]

    def make(n, seed=0):
        r = random.Random(seed)
        return " ".join(r.choice(stock) for _ in range(n))

    return make
