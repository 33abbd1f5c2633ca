"""Small tables with everything that is awkward."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} thing{i % 31}." for i in range(30_000))


def awkward(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43, 9, "x"),
        (2, "The quick brown fox jumps over the lazy dog", "en", "a", 43, 9, None),
        (2, "The quick brown fox jumps over the lazy dog", "en", "a", 43, 9, None),
        (3, None, None, None, None, None, None),
        (4, "", "de", "b", 0, 1, ""),
        (5, "   \n\t ", "de", "b", 6, 1, ""),
        (6, LONG, "en", "c", len(LONG), 2, "y"),
        (7, LONG, "en", "c", len(LONG), 2, "y"),
        (8, "Straße  größer <|endoftext|> 漢字 \U0001f600", "de", "b", 10, 3, "z"),
        (None, "without an id", "en", "a", 13, 4, "z"),
        (9, "12345 67", None, "a", 8, 5, "q"),
    ]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, name string"
    ).withColumn("key", rows_key()).withColumn("fp", rows_key()).withColumn("size", rows_key())


def rows_key():
    from pyspark.sql import functions as F

    return F.lit(1)


def empty(spark):
    return awkward(spark).limit(0)
