import pytest

from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("score", T.StringType()), T.StructField("size", T.StringType()), T.StructField("n_words", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("h", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("component_id", T.StringType()), T.StructField("ids", T.StringType()),
])


def doc(i, text, source="a"):
    return (i, text, "en", source, len(text or ""), "x", "x", "x", "x", "x", "x", "x", "x", "x")


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: spark.createDataFrame([doc(*r) for r in rows], DOC)


def prose(seed, n, vocabulary=400):
    import random

    r = random.Random(seed)
    words = [f"w{k}x" for k in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, copies and shared passages."""
    base, passage = prose(1, 120), prose(2, 60)
    rows = [(k, prose(100 + k, 80 + k), f"s{k % 4}") for k in range(10, 40)]
    rows += [
        (1, base, "a"), (2, base, "a"), (3, base.replace("w5x", "W5X"), None), (4, prose(3, 50) + " " + passage + " " + prose(4, 50), "b"),
        (5, prose(5, 40) + " " + passage + " " + prose(6, 30), "b"), (6, None, "a"), (7, "", "a"), (8, " \t\n ", None), (9, "one", "a"),
        (41, "one", "b"), (42, prose(7, 30000), "a"), (43, "x" * 50000, "c"), (None, base, "a"), (None, None, None), (44, prose(8, 100), "c"),
        (44, prose(8, 100), "c"), (45, "é" * 30 + " ünï 你好 😀 «q»", "c"), (46, "same " * 200, "c"), (47, "same " * 300, "c"),
    ]
    words = base.split()
    words[60] = "changed"
    return [*rows, (48, " ".join(words), "a")]
