import pytest

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i} lies here." for i in range(20_000))
ROWS = [
    (1, "Plain words stand here. They end here.", "en", "a", 38),
    (1, "Plain words stand here. They end here.", "en", "a", 38),
    (2, None, "en", None, None),
    (3, "", None, "b", 0),
    (None, "Text without an id, mail me@example.org now.", "en", "b", 44),
    (4, " \n\t ", "de", "c", 4),
    (4, "Same id, another text: token = abcdefghijkl0123456789.", "en", "c", 54),
    (5, LONG, "en", "d", len(LONG)),
    (6, "日本語 и русский 😀 it's", "fr", "d", 20),
    (9_007_199_254_740_993, "12 34\n\n56 !?", "es", "e", 11),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named like the operators' own."""
    rows = spark.createDataFrame(ROWS, SCHEMA)
    clash = ["score", "key", "start", "position", "n_tokens", "class", "n", "fingerprint", "spans", "words", "held_out", "next_text", "toxic", "b", "g"]
    return rows.select("*", *[F.lit("other").alias(c) for c in clash])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
