from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def made(seed: int = 5, n: int = 120) -> list[tuple]:
    """Documents with nulls, empty and long texts, copies, near copies, ties and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.1 and texts:
            text = rng.choice(texts)
        elif kind < 0.35 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) + "."
            if rng.random() < 0.3:
                text = text.replace(" ", "\n", 3)
        texts.append(text)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", None]), len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \t\n", "en", "a", 3), (n + 3, "one", "en", "b", 3), (n + 4, "ONE", None, "b", 3)]
    rows += [(n + 5, " ".join(vocabulary) * 40, "en", "a", 1), (None, "no id here at all", "en", "c", 16), rows[3], rows[3]]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
