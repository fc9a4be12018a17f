"""Small documents with every awkward case."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["n_shingles", "component_id", "digest", "uid", "copies", "p", "block", "token", "words", "score"]


def rows():
    base = "the quick brown fox jumps over the lazy dog while seven wizards mix potions in the old stone tower"
    out = [
        (1, base, "en", "a", 10),
        (2, base, "en", "a", 10),
        (2, base, "en", "a", 10),
        (3, base + " today", "en", None, None),
        (4, None, None, None, None),
        (5, "", "de", "b", 0),
        (6, "  \n\t ", "de", "b", 0),
        (7, "42 !!! 17", None, "b", 3),
        (None, base + " tomorrow", "en", "b", 3),
        (None, None, None, None, None),
        (8, "ein kurzer satz über die größe der häuser und straßen", "de", "c", 5),
        (9, "word " * 60_000, "en", "c", 300_000),
        (10, "single", "en", "c", 6),
        (11, "single", "en", "c", 6),
    ]
    out += [(100 + i, f"eine straße und der häuser garten nummer {i} mit vielen blumen über dem zaun", "de", "d", 5) for i in range(12)]
    out += [(200 + i, f"another garden number {i} with many flowers over there behind the wall", "en", "d", 5) for i in range(12)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    for c in CLASHING:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
