import random

import numpy as np
import pytest

from framefold.llm import near_dedup
from framefold.llm.components import components
from tests.llm.conftest import by_id, text_of


def shingle_set(text, size):
    words = [w.lower() for w in (text or "").split()]
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    """Smallest id of each component of ids whose texts are similar."""
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingle_set(t, size)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in parent}


def test_odd_rows(odd):
    found = by_id(near_dedup.near_duplicates(odd))
    assert {r["component_id"] for i in (1, 2, 3) for r in found[i]} == {1}
    assert [r["kept"] for r in found[3]] == [False, False] and found[1][0]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in found[None]) and len(found[None]) == 2
    for i in (4, 5, 6):  # no words: linked with nothing
        assert found[i][0]["n_shingles"] == 0 and found[i][0]["component_id"] == i and found[i][0]["kept"]
    assert {found[i][0]["component_id"] for i in (7, 8, 9)} == {7} and found[7][0]["n_shingles"] == 1
    assert [r["component_id"] for r in found[16]] == [16, 16]


def test_empty(no_docs):
    assert near_dedup.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 16])
def test_against_brute_force(spark, monkeypatch, block):
    """Families of noisy copies around the threshold, whole and dealt over blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r, rows = random.Random(4), []
    for family in range(6):
        base = text_of(100 + family, 90).split()
        for _ in range(25):
            words = list(base)
            for _ in range(r.randint(0, 5)):
                words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
            rows.append((len(rows) * 3 % 150 + 1000 * (len(rows) % 2), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(df, size=4).collect()}
    assert got == brute(rows, 4, 80)


def test_least_matches_is_a_tail_bound():
    least = near_dedup.least_matches(0.8, 1e-3)
    rng = np.random.default_rng(1)
    for step, need in enumerate(least):
        n = (step + 1) * near_dedup.BATCH
        assert (rng.binomial(n, 0.8, 20_000) < need).mean() < 5e-3


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (300, 300), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(41), 100]}, 200: 200, 201: 200}


def test_unrelated_long_texts_do_not_agree():
    """Twelve texts of 60,000 words without a common shingle: next to no place of their signatures agrees, no pair is loose."""
    rng, least = np.random.default_rng(3), near_dedup.least_matches(near_dedup.LOOSE)
    signs = [near_dedup.short(near_dedup.signature(rng.integers(0, 1 << 63, 60_000).astype(np.uint64))) for _ in range(12)]
    for i in range(12):
        for j in range(i):
            same = (signs[i] == signs[j]).reshape(-1, near_dedup.BATCH).sum(1).cumsum()
            assert same[-1] <= 2 and not (same >= np.array(least)).all()
