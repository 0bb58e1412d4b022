import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
GOOD = "the man and the dog went to the house of the lady in the town and it was good for them to be there with all of the people that he had seen on the road"


def prose(k, n=60):
    words = GOOD.split()
    return " ".join(words[(i * (k + 3) + i // 5 + k) % len(words)] + ("" if i % 7 else f"{k}x{i}") for i in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, tiny, very long and wide-character texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, prose(i), "en", "abc"[i % 3], 1) for i in range(12)]
    rows += [(20, None, "en", "a", 1), (21, "", "en", "b", None), (22, " \n\t ", None, "c", 1), (23, "word", "en", None, 1), (None, prose(3), "en", "a", 1), (None, None, None, None, None)]
    rows += [(24, prose(5) + " " + "é東" * 30, None, "a", 1), (25, "\n".join(["same line here again and again"] * 40), "en", "a", 1), (26, " ".join(f"w{i}" for i in range(30_000)), "en", "b", 1), (27, "x" * 50_000, "en", "c", 1)]
    rows += [(30, prose(30), "en", "a", 1)] * 3 + [(31, prose(30), "fr", "b", 1), (30, prose(31), "en", "a", 1), (32, "### $$$ %%% " * 60, "en", "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("size", "taken", "score", "kept", "n", "h", "rep", "key", "bands", "s", "comp", "target", "label", "word", "c", "row", "train", "id", "ref", "last", "own", "x", "y", "d", "q", "p", "u", "pass", "finish", "deal", "times", "cluster", "held_out", "predicted", "_s", "_d", "_q", "_u", "_h", "_p", "_id", "_copy", "_host", "_row", "_x", "_y"):
        df = df.withColumn(name, F.lit(name))
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
