"""Small documents with every odd case."""

import pytest

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
TEXTS = [
    None, "", " \t\n ", "one", "two words", "The The The\nThe\nThe", "a  b   c\n\n d ", "x<|endoftext|>y", "naïve café \u4f60\u597d \U0001f600 it's we'll 123",
    LONG, "same text twice over here now", "same text twice over here now", "tab\there\x0bthere\x00end", "#$% ### |||", "a" * 5000,
]


@pytest.fixture(scope="session")
def rows():
    out = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    return [*out, out[4], (None, "no id here at all", "en", "a", 17)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name in ("_id", "_text", "_key", "key", "fp", "id", "row", "t", "at", "score", "_kept", "_d", "host", "shard", "words", "kept"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
