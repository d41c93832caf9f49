from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, class int, doc long, n long"


def passage(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["ba", "ko", "ri", "tu", "en", "la", "mö"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Odd rows beside plain ones: NULL, empty, blank, short, very long, repeated, copied, edited."""
    base = passage(1, 120)
    near = [*base[:60], "changed", *base[61:]]
    twice = passage(2, 80)
    texts = {
        0: " ".join(base), 1: " ".join(near), 2: "  ".join(base), 3: None, 4: "", 5: " \n\t ", 6: "One",
        7: "one", 8: " ".join(passage(3, 20000)), 9: " ".join(twice), 10: "x " + " ".join(twice) + " y " + " ".join(twice),
        11: "x" * 5000, 12: "a b c d e", 13: "A b c d e", 14: "<s> <|endoftext|> é　漢 \x00 \r\n", 15: " ".join(passage(4, 300)),
    }
    out = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", 0, 0.5, 1, 2, 3) for i, t in texts.items()]
    return [*out, out[9], (None, "an id is missing", None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(rows):
    """Text by id; NULL as empty."""
    return {r[0]: r[1] or "" for r in rows if r[0] is not None}
