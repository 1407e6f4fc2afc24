"""Fill-in-middle against slices of the line list, and the boundary set's containers against a sorted list."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framefold.llm import fill_in_middle as fim
from tests.llm.conftest import by_id, odd_rows


@pytest.mark.parametrize("text, kind", [
    ("\n" * 70_000, fim.RunContainer),
    ("a\n" * 50_000, fim.BitmapContainer),
    (("x" * 300 + "\n") * 700, fim.ArrayContainer),
])
def test_containers(text, kind):
    bounds = fim.line_bounds(text)
    assert {type(c) for c in bounds.containers} == {kind} and len(bounds.containers) > 1
    want = np.cumsum([0] + [len(x) for x in re.findall(r"[^\n]*\n|[^\n]+", text)]).tolist()
    assert bounds.size == len(want)
    for k in {0, 1, 2, 63, 64, 65, len(want) // 2, len(want) - 2, len(want) - 1}:
        assert bounds.select(k) == want[k]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300_000), min_size=1, max_size=400, unique=True))
def test_select_of_any_set(values):
    values.sort()
    bounds = fim.BoundarySet(np.array(values))
    assert [bounds.select(i) for i in range(len(values))] == values


def plain_version(doc_id, text, rate=100, share=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    g = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or h[2] % 100 >= rate or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    pre, mid, suf = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < share:
        return len(lines), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(lines), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(st.integers(-5, 5000), st.text(st.sampled_from("ab<PSM>\n\r é你😀"), max_size=60))
def test_any_text(doc_id, text):
    assert fim.transform(doc_id, text) == plain_version(doc_id, text)


@pytest.mark.parametrize("rate", [100, 30])
def test_odd_rows(odd, no_docs, rate):
    done = fim.fill_in_middle(odd, rate=rate).withColumn("restored", fim.restore(F.col("form"), F.col("output")))
    found = by_id(done)
    assert sum(map(len, found.values())) == len(odd_rows())
    for doc_id, text in odd_rows():
        want = plain_version(doc_id, text, rate)
        assert (*want, text or "") in [(r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in found[doc_id]]
    assert fim.fill_in_middle(no_docs).collect() == []


def test_restore_next_to_markers(spark):
    texts = [f"{a}{b}\n{c}{d}\n{e}" for a in ("<", "") for b in ("P", "<P", "S>") for c in (">", "<M") for d in ("", "<") for e in ("S>", "<S", ">")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = fim.fill_in_middle(docs).withColumn("restored", fim.restore(F.col("form"), F.col("output")))
    for r in done.collect():
        assert r["restored"] == texts[r["doc_id"]]
