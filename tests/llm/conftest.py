"""Documents with everything that may go wrong."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ter", "un", "é", "sh"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def nasty() -> list[tuple]:
    base, other = prose(1, 120), prose(2, 90)
    lines = "\n".join(prose(i, 12) for i in range(20, 26))
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base, "en", "a", 1), (1, base, "en", "a", 1), (2, " ".join(near), None, "b", None), (3, None, "en", None, 0), (4, "", None, "b", 0), (5, " \n\t ", "en", "é", 3),
        (6, "two words", "en", "a", 9), (7, lines, "en", "a", 5), (8, "start here\n" + lines + "\nend", "de", "b", 5), (9, other + " " + base, "en", "a", 7),
        (10, prose(3, 6000), "en", "c", 1), (11, "CC BY, the General   Public\nLicense; all rights RESERVED", "en", "a", 1), (12, "Licensed under the Apache License, Version 2.0.", "en", "a", 1),
        (13, "x<|endoftext|>it's 12,5  　漢字 😀", "en", "c", 1), (14, "a b c d", "en", "c", 1), (15, "A B C D", "en", "c", 1), (16, "two words", "en", "a", 9), (17, "ab" * 60, "en", "a", 9), (18, "ab" * 40, "en", "a", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(nasty(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def rows():
    return nasty()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """docs with columns that operators might use themselves."""
    from pyspark.sql import functions as F

    out = docs
    for c in ("size", "key", "part", "chunk", "u", "v", "rep", "score", "__row", "n", "target", "copies", "n_lines", "bucket", "blob"):
        out = out.withColumn(c, F.lit("x"))
    return out
