from __future__ import annotations

import random

import pytest

WORDS = [f"{a}{b}" for a in ("al", "be", "ci", "do", "é", "fu", "ga", "hé") for b in ("ra", "n", "st", "mo", "l", "ü", "ik", "")]


@pytest.fixture(scope="session")
def prose():
    """Texts of random words, the same for a seed."""

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and columns named as operators name theirs."""
    long = prose(1, 6000)
    base = prose(2, 120)
    data = [
        (1, base, "en", "b", 10, "x"), (2, base, "en", "a", 10, "x"), (2, base, "en", "a", 10, "x"), (3, None, None, None, None, None),
        (4, "", "en", "a", 0, ""), (5, "   \n\t", "fr", None, 5, "y"), (6, long, "en", "a", 7, "y"), (7, prose(3, 40) + " " + long, "en", "c", 7, "y"),
        (8, base.replace("al", "AL", 1), "en", "b", 10, "z"), (None, base, "de", "c", 10, "z"), (9, "a", "de", "c", 1, "z"),
        (10, "é" * 60, "de", "c", 60, "z"), (11, "x" + "é" * 60, "de", "c", 61, "z"), (-5, prose(4, 30), None, "c", 3, None), (12, base + " " + prose(9, 4), "en", "b", 9, "q"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, "
    return [spark.createDataFrame(data, schema + f"`{c}` string") for c in ("kept", "score", "Class_id")]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, kept string")
