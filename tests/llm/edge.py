"""Documents with nulls in every column, empty and very long texts, repeated rows, and columns whose names clash."""

import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

BASE = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old tree by the river"
ROWS = [
    (1, BASE, "en", "a", 10), (2, BASE, "en", "a", 10), (2, BASE, "en", "a", 10), (3, BASE + " today", "en", None, None),
    (4, None, None, None, None), (None, BASE, "en", "b", 1), (None, None, None, None, None), (5, "", "en", "a", 0), (6, " \t\n ", "en", "b", 4),
    (7, "12 34 !!", "en", "b", 8), (8, "word", "de", "c", 4), (9, "der schnelle braune Fuchs springt über den faulen Hund und schläft dann", "de", "c", 5),
    (10, ("lorem ipsum " + BASE + "\n") * 3000, "en", "hot", 7), (11, "x" * 200_000, "en", "hot", 7), (12, "日本語 のテキスト です", None, "c", 3),
]
CLASHES = ("id", "component", "component_id", "kept", "score", "band", "key", "label", "shard", "size", "copies", "slot", "block", "tokens", "ids",
           "part", "guest", "host", "license", "_q", "_l", "fine", "weight", "a", "b")


def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def clashing(spark):
    """The same rows with more columns, named like the operators' own."""
    return edge(spark).withColumns({c: F.lit("other") for c in CLASHES})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))
