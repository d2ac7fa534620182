import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label long"


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def make_rows():
    """Odd rows of every kind: nulls, empty and very long texts, copies, near copies, shared passages, ties."""
    rng = random.Random(5)
    passage = prose(rng, 120)
    rows = [(0, None, "en"), (1, "", None), (2, "  \n\t ", "en"), (3, "one", "en"), (4, "One two three", "en"), (5, "one two  three", "de")]
    for i in range(6, 40):
        rows.append((i, prose(rng, rng.randrange(20, 400)), "en"))
    base = prose(rng, 300)
    rows += [(40 + i, base, "en") for i in range(6)]
    for i in range(8):
        words = base.split()
        for _ in range(i):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append((50 + i, " ".join(words), "en"))
    for i in range(10):
        rows.append((60 + i, f"{prose(rng, 30)} {passage} {prose(rng, 40)}", "fr"))
    rows.append((80, prose(rng, 20000), "en"))
    rows.append((81, "a" * 90000, "en"))
    rows.append((82, "line one here\n" * 60 + prose(rng, 30), "en"))
    rows.append((83, prose(rng, 90) + "\n" + "é ü 漢字 " * 40, "en"))
    rows.append((84, passage[:50] + " 😀 " + passage, "en"))
    rows += [(85, "same row", "en")] * 3
    rows.append((None, prose(rng, 60), "en"))
    rows.append((None, base, "en"))
    sources = ["a", "b", "c", None]
    return [(i, t, lang, sources[(k * 7) % 4], None if t is None else len(t), k % 2) for k, (i, t, lang) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
