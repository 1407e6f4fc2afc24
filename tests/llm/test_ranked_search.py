"""Ranked search against scoring every document for every query."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from framefold.llm import ranked_search
from tests.llm.conftest import odd_rows

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_force(docs, items, top=20):
    held = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for doc_id, c in held:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t, k in asked.items() if t in c)
            if score > 0:
                scored.append((-score, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, top=20):
    frame = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string") if isinstance(items, list) else items
    rows = ranked_search.search(ranked_search.build_index(frame), asked, top).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=repr)


ITEMS = [(1, "one two w1x1 w5x5"), (2, "ONE one one"), (3, ""), (4, None), (5, "nowhere"), (6, "größe 你好 a"), (None, "line one here"), (7, "a x z")]


def test_odd_rows(spark, odd, no_docs):
    assert found(spark, odd, ITEMS) == brute_force(odd_rows(), ITEMS)
    assert found(spark, no_docs, ITEMS) == []
    assert found(spark, odd, spark.createDataFrame([], "item_id long, text string, query string, score long, shard long")) == []


def test_equal_items_are_one_and_clashing_columns_are_not_read(spark, odd):
    items = spark.createDataFrame([(1, "one two", 3, "x", 9)] * 2 + [(1, "two", 3, "x", 9)], "item_id long, text string, rank int, term string, doc_id long")
    assert found(spark, odd, items) == sorted(brute_force(odd_rows(), [(1, "one two"), (1, "two")]), key=repr)


@pytest.mark.parametrize("shard_bytes, block_rows", [(2_000, 200_000), (20_000, 40), (10 ** 9, 200_000)])
def test_many_documents(spark, monkeypatch, shard_bytes, block_rows):
    """Common and rare words, equal texts (ties at every rank), repeated query terms; many shards, several blocks."""
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(ranked_search, "BLOCK_ROWS", block_rows)
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randint(1, 60)))) for i in range(600)]
    docs += [(600 + i, docs[7][1]) for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 12)) + r.choices(words, weights, k=r.randint(0, 8)))) for i in range(25)]
    items.append((99, docs[7][1]))
    want = brute_force(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, 3) == brute_force(docs, items, 3)


def test_pair_bounds_skip_more_than_single_ones():
    """Two terms that never meet: the pair can add the larger maximum only, so none of their documents is scored."""
    index = list(ranked_search._shard_rows(0, list(range(6)), [1, 1, 1, 1, 2, 2], {b"a": 0, b"b": 1, b"c": 2, b"d": 3},
                                           [np.array(x) for x in ([0], [0], [1], [1], [2, 3], [2, 3])]))
    rows = pa.Table.from_batches(index)
    shard = ranked_search.Shard(rows, {"a": 10, "b": 10, "c": 12, "d": 12}, 6, 8)
    pairs = [("a", "b"), ("c", "d"), *((t, None) for t in "abcd")]
    listed = {(a, b): (docs, most, best) for a, b, docs, most, best in shard.pair_rows(pairs, 2)}
    assert ("a", "b") not in listed and len(listed["c", "d"][2]) == 2
    most = {a: v[1] for (a, b), v in listed.items() if b is None}
    lists = {k: (np.frombuffer(v[0], np.uint16), v[1]) for k, v in listed.items() if k[1]}
    query = [(("a", 1), ("b", 1)), (("c", 1), ("d", 1))]
    least = most["a"] + 1
    assert most["a"] + most["b"] >= least  # single maxima would have to look at a and b
    touched = []
    for term in "ab":
        docs, impacts = shard.postings[term]
        shard.postings[term] = docs, type("Watched", (np.ndarray,), {"__rmul__": lambda self, k: touched.append(len(self)) or k * np.asarray(self)})(impacts.shape, impacts.dtype, impacts.tobytes())
    ids, scores = shard.answer(query, lists, most, least, 2)
    assert ids.tolist() == [4, 5] and sum(touched) == 0
