import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    *[T.StructField(n, T.StringType()) for n in ("shard", "bucket", "place", "digest", "_own", "_id", "_hash", "fp", "size", "copies", "pattern", "doc", "key", "clean_text", "doc_text", "line")],
])


def row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, None if text is None else len(text), *["x"] * 16)


LINES = "alpha beta gamma\ndelta epsilon zeta\neta theta iota\nkappa lambda mu"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(f"w{i % 997}x{i}" for i in range(40_000))
    rows = [
        row(1, LINES), row(2, LINES + "\nnu xi omicron"), row(3, LINES.replace(" ", "  ")), row(4, None), row(5, ""), row(6, " \t\n "), row(None, "no id at all"), row(None, LINES), row(7, long_text, "t"), row(8, long_text + " end", None),
        row(9, "same same"), row(9, "same same"), row(9, "another text"), row(10, "Permission is hereby granted under the MIT License, or the Apache License.", None), row(11, "a\na\na\na\na\na"), row(12, "<|endoftext|> é\U0001f600 x", ""),
        row(2**60 + 1, "large id"), row(-3, "negative id"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
