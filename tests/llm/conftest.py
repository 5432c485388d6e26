from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def row(doc_id, text, source="s0"):
    return (doc_id, text, "en", source, None if text is None else len(text))


@pytest.fixture(scope="session")
def words():
    rng = random.Random(11)
    return ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls, blanks, a very long text, ties, repeated rows, null ids and sources."""
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [say(rng.randint(30, 120)) for _ in range(25)]
    rows = [row(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [row(40 + i, base[i], "s0") for i in range(5)]
    rows += [row(50 + i, base[i] + " " + say(2), "s1") for i in range(5)]
    rows += [row(60, None), row(61, ""), row(62, " \n\t "), row(63, "one"), row(64, "two words", None)]
    rows += [row(65, say(30_000), "s2"), row(None, base[7], None), row(None, None, None)]
    rows += [row(2, base[2], "s2"), row(2, base[2], "s2"), row(66, "é\U0001F600 ünï " * 60, "ü")]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
