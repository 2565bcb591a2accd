import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy_texts():
    rng = random.Random(5)
    bits = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "é", "1", "'s", ".", "ß", "\x1c", "<|endoftext|>", "😀", "x", "the", "\r\n", "²", "́", "дом", "“", "_", "ll", "\x00", "\x85", "\xa0", "中", "don't", " 12 "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]


@pytest.fixture(scope="session")
def messy(spark, messy_texts):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(messy_texts)]
    rows += [(None, None, None, None, None), (1000, None, "en", "s", 0), (1001, "", None, None, None), (1001, "", None, None, None), (None, "the end", "de", None, 3)]
    rows += [(1002, "word " * 60_000, "en", "s", None), (1003, "same text here", "en", "s", 1), (1004, "same text here", "en", "s", 1), (1004, "same text here", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for extra in ("start", "length", "digest", "id", "keep_id", "kept", "score", "key", "part", "fingerprint", "component_id", "held_out", "n", "h"):
        from pyspark.sql import functions as F

        df = df.withColumn(extra, F.lit(extra))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
