import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = "lorem ipsum dolor sit amet " * 40_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns whose names the operators use themselves."""
    rows = [
        (1, "one two three four five six seven", "en", "b"), (2, "one two  three\tfour five\nsix seven", "en", "b"), (3, "", "en", "a"),
        (4, None, None, None), (None, "a text without an id, to be kept", "en", "a"), (None, None, None, None), (5, LONG, "en", "c"), (6, LONG + " end", "de", "c"),
        (7, "same words", "en", ""), (7, "same words", "en", ""), (7, "other words here", "en", "z"), (8, "!!! ... ???", "fr", "b"),
        (9, "one two three four five six seven", "en", "b"), (10, "über naïve 😀 “quotes” token=abcdef123", "de", "a"),
    ]
    extra = [(*r, len(r[1] or ""), i, "x", 0.5, True, i, "p", [1], "s", i) for i, r in enumerate(rows)]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score double, kept boolean, "
        "block int, print string, keys array<int>, features string, l_id int"
    )
    return spark.createDataFrame(extra, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
