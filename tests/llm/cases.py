"""Documents with the odd cases that every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept int, tokens string, component_id string"

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, names that
    clash with the operators' own."""
    rows = [
        (1, "The same little text. " * 20, "en", "src1"), (2, "The same little text. " * 20, "en", "src1"),
        (2, "The same little text. " * 20, "en", "src1"), (3, None, "en", "src1"), (4, "", None, None), (5, " \n\t ", "de", "src2"),
        (None, "a row without an id but with some words", "en", "src1"), (None, None, None, None), (6, LONG, "fr", "src11"),
        (7, "one", "en", "src1"), (8, "two words", "en", None), (9, "Ärger mit Ümlauten — und “quotes” …", "de", "src2"),
        (10, "password=abcdefgh1234 twice password=abcdefgh1234", "en", "src1"),
    ]
    return spark.createDataFrame([(*r, None, "x", 1, "t", "c") for r in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def some_documents(spark, n=None):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs if n is None else docs.limit(n)
