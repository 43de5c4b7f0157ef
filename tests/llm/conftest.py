from __future__ import annotations

import random

import pytest
from llm_helpers import CLASHING, DOCS, sentence


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rng = random.Random(1)
    long = sentence(rng, 60_000)
    text = sentence(rng, 80)
    rows = [(0, text, "en", "s", 1), (1, None, None, None, None), (None, text, "en", None, 3), (2, "", "de", "s", 0), (3, " \t\n", "de", "s", 0), (4, long, None, "s", 9), (5, text, "fr", "s", 1), (5, text, "fr", "s", 1), (5, "another text", "fr", "t", 1), (6, "One  two", "en", "s", 2), (7, "one two", "en", "s", 2)]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASHING:
        df = df.selectExpr("*", f"'x' AS {c}")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
