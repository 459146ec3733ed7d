import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} and{i}" for i in range(9000))
INSULT = "you are a stupid idiot and a pathetic loser"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en"),
        (2, None, None),
        (3, "", "en"),
        (4, LONG, "en"),
        (5, LONG, None),
        (6, "same text", "de"),
        (6, "same text", "de"),
        (7, "same text", "de"),
        (None, "same text", "de"),
        (None, None, None),
        (8, "  \n\t ", ""),
        (9, INSULT, "en"),
        (10, "1234 !!! --- éè \U0001f600", "fr"),
        (11, "你好 世界", "zh"),
    ]
    clash = "kept score fp g b label contamination _content _key _slice secrets language spans".split()
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
        + [T.StructField(c, T.StringType()) for c in clash]
    )
    return spark.createDataFrame([r + ("x",) * len(clash) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.filter("false")
