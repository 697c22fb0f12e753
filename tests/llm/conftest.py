import pytest
from pyspark.sql import functions as F

CLASHING = ["score", "start", "n_tokens", "sequence_id", "offset", "component_id", "kept", "_id", "_kept", "rep", "node", "label_", "print", "n", "piece", "length", "toxic", "held_out", "_task", "_rank", "a", "b"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 100003}" for k in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, copies and near-copies."""
    base = words(1, 120)
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", None, 1),
        (2, base, "en", None, 1),
        (3, base.replace("w", "W", 1) + " tail", "en", "a", 2),
        (4, "", "de", "a", 0),
        (5, None, "de", "b", None),
        (6, None, None, None, None),
        (None, base, "en", "a", 3),
        (None, None, None, None, None),
        (7, "one two", "fr", "b", 7),
        (8, "One, TWO!", "fr", "b", 7),
        (9, words(5, 60_000), "en", "b", 9),
        (10, "\x00 \n\t ... 123 £ é 日本 \U0001f600", "es", "c", 9),
        (11, words(11, 5), None, "c", 1),
        (12, words(12, 4), "es", "c", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, DOCS)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
