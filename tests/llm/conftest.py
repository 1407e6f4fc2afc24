"""Small hand-made tables with everything odd in them, shared by the tests of this folder."""

import random

import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
CLASH = "score double, kept boolean, label int, rep long, family long, chunk long, word string, place int, n long, `range` int, tie long, high long, sha string"


def text_of(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    base = text_of(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    shared = text_of(2, 45)
    return [
        (1, base), (2, base), (3, near), (3, near), (4, None), (5, ""), (6, " \t\n "), (None, base), (None, None),
        (7, "one two"), (8, "one two"), (9, "ONE two"), (10, text_of(3, 60) + " " + shared), (11, shared + " " + text_of(4, 60)),
        (12, LONG), (13, "x" * 5000), (14, "a " * 400), (15, "Größe naïve 你好 \x1c  z\n\nz"), (16, text_of(5, 200)), (16, text_of(6, 200)),
        (17, text_of(7, 19)), (18, text_of(8, 20)), (19, "line one here\nline one here\n\n!! ## | a"), (20, text_of(9, 300)),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, copies, repeated ids and columns whose names the operators use themselves."""
    rows = [(i, t, None, None, None) + (None,) * 13 for i, t in odd_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def by_id(df) -> dict:
    """Rows by doc_id; lists, since ids repeat."""
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out
