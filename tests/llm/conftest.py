from __future__ import annotations

import pytest

#: Columns beside the documented ones, with names that the operators use themselves.
CLASHES = "size int, score double, fp long, label string, copies long, position double, kept boolean, n_words long, bin long, row string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
_EXTRA = (1, 0.5, 7, "x", 3, 0.1, True, 4, 9, "r")


def words(n: int, seed: int = 0) -> str:
    """Text of n words that hardly share shingles between seeds."""
    return " ".join(f"w{(i * 7919 + seed * 104729 + i * i) % 9973:x}" for i in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, other scripts."""
    base = [
        (1, "The the quick brown fox. " * 3 + words(30, 1), "en", "a"),
        (2, None, "en", "a"),
        (3, "", "de", "b"),
        (4, " \t\n\r\x0b\x0c ", "de", None),
        (5, words(60_000, 5), "en", "a"),
        (6, words(40, 6), None, "b"),
        (6, words(40, 6), None, "b"),
        (7, words(40, 6) + " ", "fr", "b"),
        (None, words(50, 8), "fr", None),
        (None, None, None, None),
        (8, "ÉÈ ça va ici 漢字かな 😀 12345\nline one\nline one\n\nİstanbul Straße ǅ", "fr", "c"),
        (9, "x" * 150_000, "en", "c"),
        (10, "# * $ % & | < > " * 10, "en", "d"),
        (11, "one", "en", "ä"),
        (12, "one two", "en", "z"),
        (13, "a b c d e f g h " * 8, "en", "a"),
        (14, "<|endoftext|> it's  two  spaces \n tabs\tand trailing ", "en", "b"),
        (-15, words(25, 9), "es", "d"),
    ]
    return [(*row, None if row[1] is None else len(row[1]), *_EXTRA) for row in base]


@pytest.fixture
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
