import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(rng, n):
    return " ".join(rng.choice(["the", "anea", "thion", "oreat", "ingle", "wher", "ea", "st", "on", "erst"]) + rng.choice(["", "ly", "ed", "ation", "s", "er"]) for _ in range(n))


def make_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies of one text in a third of the rows."""
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(1, 120)), rng.choice(["en", "de", "fr"]), f"src{rng.randint(0, 3)}", i) for i in range(90)]
    rows += [(100 + i, "Same TEXT in many rows, " * 3, "en", "src0", None) for i in range(60)]
    rows += [(200, None, "en", "src1", 0), (201, "", None, "src1", 0), (202, "  \t\n ", "en", None, 0), (None, "no id at all here", "en", "src1", 0), (None, None, None, None, None)]
    rows += [(203, "twice the same row", "en", "src2", 1)] * 3 + [(None, "no id at all here", "de", "src1", 0)]
    rows += [(300, words(rng, 9000), "en", "src0", 0), (301, "x" * 30000, "en", "src0", 0), (302, "ÀÉ ümläut 日本語   \x1c text 🙂", "fr", "src1", 5)]
    rows += [(303, rows[5][1].upper(), "en", "src1", 1), (304, rows[6][1] + " more", "en", "src1", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
