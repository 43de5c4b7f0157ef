"""What the tests of this folder share."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["label", "score", "predicted", "shard", "slot", "bucket", "component", "rep", "n", "kind", "part", "a", "b", "id", "sig", "word", "weight", "prob", "topic", "row"]


def sentence(rng: random.Random, n: int, stem: str = "w") -> str:
    """Words of letters only."""
    letters = str.maketrans("0123456789", "abcdefghij")
    return " ".join(stem + str(rng.randrange(2000)).translate(letters) for _ in range(n))


def rows_of(texts):
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
