"""Fingerprints and byte-level BPE against one-document versions."""

import base64
import hashlib
import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from framefold.llm import byte_bpe, fingerprints
from framefold.session import work_partitions
from tests.llm.conftest import by_id, odd_rows

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_entropies():
    rng = np.random.default_rng(1)
    for n in (33, 64, 200, 3000):
        x = rng.choice(rng.integers(0, 256, rng.integers(1, 40)), n).astype(np.uint8)
        want = [-sum(c / 32 * math.log2(c / 32) for c in np.bincount(x[i:i + 32]) if c) for i in range(n - 31)]
        assert np.abs(fingerprints.entropies(x) - np.array(want) / 5 * (fingerprints.LEVELS - 1)).max() < 0.51


def test_fingerprints_odd_rows(odd, no_docs):
    found = by_id(fingerprints.fingerprints(odd))
    rows = sorted((r for r in odd_rows() if r[0] is not None), key=lambda r: r[0])
    assert sum(map(len, found.values())) == len(odd_rows())
    texts = [t or "" for _, t in rows]
    for (i, _), text, following in zip(rows, texts, texts[1:] + texts[:1]):
        if i in (3, 15, 16):  # ids that repeat, or whose next one does
            continue
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert found[i][0]["n_chars"] == len(text) and found[i][0]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
    assert found[1][0]["fingerprint"] == found[2][0]["fingerprint"] and found[1][0]["near_next"] == 1.0
    assert found[4][0]["fingerprint"] == "" and found[4][0]["near_edited"] == 1.0 and found[4][0]["near_next"] == 1.0
    assert all(r["near_next"] == 0 for r in found[None])
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for rows in found.values() for r in rows)
    assert len(base64.b64decode(found[12][0]["fingerprint"])) % 256 == 0
    assert fingerprints.fingerprints(no_docs).collect() == []


def test_single_row_is_its_own_next(spark):
    row = fingerprints.fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and row["near_next"] == 1.0


@pytest.mark.parametrize("size", [byte_bpe.CHUNK_CHARS, 300])
def test_byte_bpe(odd, no_docs, monkeypatch, size):
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", size)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(RANKS), special_tokens={})
    found = by_id(byte_bpe.encode_decode(odd, RANKS, public_tokenizers.PATTERN))
    assert sum(map(len, found.values())) == len(odd_rows())
    for i, text in odd_rows():
        ids = encoding.encode_ordinary(text or "")
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        assert want in [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found[i]]
    assert byte_bpe.encode_decode(no_docs, RANKS, public_tokenizers.PATTERN).collect() == []


def test_byte_bpe_of_chunks_that_open_alike(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 10)
    buckets = 2 * work_partitions(spark)
    first, *rest = (f" {a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh")
    other = next(w for w in rest if [*byte_bpe.by_bucket({"": [w]}, buckets)] == [*byte_bpe.by_bucket({"": [first]}, buckets)])
    texts = [f"the same opening of both the texts{w}" for w in (first, other)]
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(RANKS), special_tokens={})
    found = {r["ids_sha256"] for r in byte_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert found == {hashlib.sha256(np.array(encoding.encode_ordinary(t), "<u4").tobytes()).hexdigest() for t in texts}


def test_chunk_names_follow_whole_texts():
    def name(text):
        batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], ["doc_id", "text"])
        return next(byte_bpe.chunks(iter([batch])))[0]

    assert name("x" * 40 + "alpha") == name("x" * 40 + "alpha") != name("x" * 40 + "omega")
