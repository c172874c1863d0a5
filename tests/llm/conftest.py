from __future__ import annotations

import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with columns that clash with names the operators use."""
    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None) for r in rows]
        frame = spark.createDataFrame(full, COLUMNS)
        for name in ("fp", "ids", "row", "words", "keep_id", "component_id", "place", "blob", "spans", "media", "label", "_row_sha"):
            frame = frame.withColumn(name, F.lit("clash"))
        return frame

    return build


@pytest.fixture(scope="session")
def tidy():
    """The rows that every operator has to take: nulls, blanks, one word, a very long text, repeated rows, ties."""
    long = "lorem ipsum dolor " * 20000
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, long), (6, long), (7, "same text here"), (7, "same text here"),
        (8, "same  text\there"), (None, "same text here"), (9, None, None, None), (10, "ünïcode ß 漢字 and 🙂 signs"),
    ]
