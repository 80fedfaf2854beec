import random

import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use for their own columns
    T.StructField("slot", T.StringType()), T.StructField("__key", T.StringType()), T.StructField("t", T.LongType()),
    T.StructField("words", T.StringType()), T.StructField("kept", T.StringType()),
])


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long = prose(1, 20_000)
    texts = [
        (1, prose(2, 120)), (2, None), (3, ""), (4, " \t\n\r "), (5, prose(2, 120)), (5, prose(2, 120)), (6, long),
        (None, prose(3, 80)), (None, None), (7, "one two"), (8, "Zażółć 🎉 gęślą jaźń " * 30), (9, "x" * 30_000),
        (10, "password: abcdefghijklmnop and AKIA" + "Q" * 16), (11, "a" * 5 + " " * 20_000 + "b"), (-4, prose(4, 300)),
        (2 ** 60 + 1, prose(5, 60)),
    ]
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 3}" if k % 4 else None, None, "clash", "k", 1, "w", None)
            for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENT).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENT)


def rows_of(df, *columns):
    """Collected tuples in an order that allows nulls."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is None, str(x)) for x in r])
