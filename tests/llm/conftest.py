import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows and near copies."""
    long_text = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    base = "one two three four five six seven eight nine ten " * 12
    rows = [
        (1, base + "alpha", "en", "a", 1),
        (2, base + "beta", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, long_text, "en", None, None),
        (5, long_text, "en", None, None),
        (6, "Short text", "de", "b", 3),
        (None, "no id here at all", "fr", "c", 2),
        (7, "  \t\n ", "fr", "c", 2),
        (8, base.upper() + "alpha", "es", "a", 1),
        (9, "123 456 !!", "es", "c", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(None, 1, 0), (1, 1, 0), (2, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    out = docs
    for name in ("score", "node", "text_code", "size", "part", "code", "share", "copy", "label", "held_out", "Component_id"):
        out = out.withColumn(name, F.lit("x"))
    return out
