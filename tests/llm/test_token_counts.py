"""Token counts against the library on whole texts."""

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framefold.llm import token_counts
from tests.llm.conftest import by_id, odd_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WHOLE = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_the_model_splits_at_spaces():
    assert token_counts.splits_at_spaces(MODEL)


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("ab e▁\n\t<s>é你\U0001F600́."), max_size=80), st.integers(1, 20))
def test_parts_count_like_the_whole(text, limit):
    parts = token_counts.parts_of(text, limit)
    assert sum(len(x) for x in WHOLE.encode(parts)) == len(WHOLE.encode(text))
    assert " ".join(parts) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 100))
def test_groups(sizes, budget):
    found = token_counts.groups(np.array(sizes, np.int64), budget)
    assert [i for a, b in found for i in range(a, b)] == list(range(len(sizes)))
    assert all(sum(sizes[a:b]) <= budget + max(sizes) for a, b in found)


def test_odd_rows(odd, no_docs):
    found = by_id(token_counts.count_tokens(odd, MODEL, limit=500))
    assert sum(map(len, found.values())) == len(odd_rows())
    for doc_id, text in odd_rows():
        n = len(WHOLE.encode(text or ""))
        assert (len((text or "").encode()), n, n > 500) in [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found[doc_id]]
    assert token_counts.count_tokens(no_docs, MODEL).collect() == []


def test_small_parts_and_groups(odd):
    rows = odd.select("doc_id", "text", token_counts.token_count(F.col("text"), MODEL, 10, 200).alias("n")).collect()
    assert all(r["n"] == len(WHOLE.encode(r["text"] or "")) for r in rows)


def test_texts_without_a_boundary(spark):
    texts = ["你好" * 40_000, "x" * 100_000, " " * 70_000, "a" + " " * 70_000 + "b", "▁ " * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, MODEL).collect()} == {i: len(WHOLE.encode(t)) for i, t in enumerate(texts)}
