from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, fp string, rank int, n string, label int, task int, length string, sequence_id string, media binary, slot int"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, other scripts, and columns whose names clash with the operators' own."""
    long = " ".join(f"word{i % 997} tail{i}" for i in range(30_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank"), (2, None), (3, ""), (4, long), (5, "The quick brown fox jumps over the lazy dog near the river bank"),
        (1, "The quick brown fox jumps over the lazy dog near the river bank"), (6, "one"), (7, "two words"), (8, "  \t\n "), (9, "Grüße aus Köln 日本語 🙂 é́"), (10, "a b c d"), (None, "no id at all here"),
        (11, "AAAA!! BBBB!! CCCC!!"), (12, "x" * 5000), (13, "new\nline and ▁ mark <|endoftext|>"),
    ]
    return spark.createDataFrame([(i, t, "f", 7, "n", 1, 2, "l", "s", b"m", 3) for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
