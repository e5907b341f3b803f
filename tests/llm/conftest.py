import random

import pytest

SCHEMA = "doc_id long, text string, id long, n int, version string, component string, digest string, slice int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with more columns, whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, 7, 1, "v", "c", "d", 0) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, repeated rows and one id with two texts."""
    rng = random.Random(1)
    long_text = "\n".join(words(rng, 60, 5000) for _ in range(150))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "Six words that are all here"),
        (None, "no name but text"), (None, None), (7, long_text), (8, long_text + " more"), (9, "first text of nine"),
        (9, "second text of nine"), (10, "ünïcödé 漢字 😀 text\nwith lines\n\nand blanks"), (-3, "below zero"),
    ]
