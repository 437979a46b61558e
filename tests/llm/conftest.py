from __future__ import annotations

import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that operators use inside, on tables that come from outside.
CLASHING = ["n", "id", "row", "lines", "h", "rank", "position", "value", "component", "kept", "found", "score", "text_hash", "set_key"]


@pytest.fixture
def make(spark):
    """A documents table of texts or (doc_id, text) pairs, with columns whose names clash with those inside."""

    def build(texts, langs=None):
        pairs = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts)]
        rows = [(i, t, (langs or {}).get(i), "s", None if t is None else len(t), *("x" for _ in CLASHING)) for i, t in pairs]
        return spark.createDataFrame(rows, f"{DOCUMENT}, {', '.join(f'{c} string' for c in CLASHING)}")

    return build


@pytest.fixture
def words():
    """A function that gives so many words of a fixed invented vocabulary."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(4000)]
    return lambda n: [rng.choice(vocabulary) for _ in range(n)]
