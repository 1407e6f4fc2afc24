import hashlib
import random

import numpy as np
import pytest

from framefold.llm import substring_dedup
from tests.llm.conftest import by_id, text_of


def brute(rows, length=20):
    """(n_words, kept words) per id, ids in ascending order."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = (text or "").split()
        covered = set()
        for k in range(len(words) - length + 1):
            window = tuple(words[k:k + length])
            if window in seen:
                covered.update(range(k, k + length))
            seen.add(window)
        out[i] = len(words), [w for k, w in enumerate(words) if k not in covered]
    return out


def check(rows, found):
    for i, (n, kept) in brute(rows).items():
        r = found[i][0]
        assert (r["n_words"], r["n_removed"]) == (n, n - len(kept)), i
        assert r["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        if r["kept_text"] is not None:
            assert r["kept_text"] == " ".join(kept)


def test_odd_rows(odd):
    found = by_id(substring_dedup.substring_dedup(odd))
    assert found[1][0]["n_removed"] == 0 and found[2][0]["n_removed"] == 120 and found[2][0]["kept_text"] == ""
    assert found[3][0] == found[3][1] and found[3][0]["n_removed"] > 60
    assert all(r["n_removed"] == 0 for r in found[None]) and len(found[None]) == 2
    assert [found[i][0]["n_words"] for i in (4, 5, 6)] == [0, 0, 0]
    assert found[10][0]["n_removed"] == 0 and found[11][0]["n_removed"] == 45
    assert found[14][0]["n_words"] == 400 and found[14][0]["n_removed"] == 399  # the first window is no repeat, the next covers 19 of its words
    assert found[17][0]["n_removed"] == 0 and len(found[16]) == 2


def test_empty(no_docs):
    assert substring_dedup.substring_dedup(no_docs).collect() == []


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 3])
def test_against_brute_force(spark, monkeypatch, hot):
    """Shared passages, periodic and constant texts; with a low limit, frequent anchors go window by window."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    r = random.Random(7)
    passages = [text_of(50 + i, n) for i, n in enumerate((20, 21, 35, 70, 19))]
    rows = []
    for i in range(80):
        parts = [text_of(200 + i, r.randint(0, 40))] + [r.choice(passages) if r.random() < 0.6 else text_of(900 + i * 7, 15) for _ in range(3)]
        rows.append((i, " ".join(parts)))
    rows += [(80, "z " * 26), (81, "z " * 25), (82, "a b c " * 30), (83, "b c a " * 9), (84, " ".join(map(str, range(500))) + " " + " ".join(map(str, range(480)))), (85, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(rows, by_id(substring_dedup.substring_dedup(df)))


def test_index_against_scanning():
    r = random.Random(3)
    for _ in range(15):
        vocabulary = [f"w{i}" for i in range(r.choice([1, 2, 3, 50]))]
        base = [r.choice(vocabulary) for _ in range(150)]
        rows = []
        for i in range(r.randint(1, 30)):
            at, n = r.randint(0, 110), r.randint(20, 40)
            rows.append((r.randint(0, 9), 100 * i, " ".join(base[at:at + n] if r.random() < 0.6 else r.choices(vocabulary, k=n)).encode()))
        first: dict = {}
        for doc, start, text in rows:
            words = text.split()
            for k in range(len(words) - 19):
                key = tuple(words[k:k + 20])
                first[key] = min(first.get(key, (99, 0)), (doc, start + k))
        for (doc, start, text), flags in zip(rows, substring_dedup.shard_repeats(*map(list, zip(*rows)))):
            words = text.split()
            assert list(flags) == [int(first[tuple(words[k:k + 20])] < (doc, start + k)) for k in range(len(words) - 19)]


def test_word_hashes_follow_the_words():
    from framefold.llm.common import word_hashes, words

    texts = ["", " \t", "a", "ab ba ab", "x" * 5000 + " x", "größe 你好\x1cz\n a\x0bb", "a  aa aaa a", "\x00 \x00\x00"]
    seen = {}
    for text in texts:
        found, own = word_hashes(text.encode()), words(text)
        assert len(found) == len(own)
        for h, w in zip(found.tolist(), own):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sliding_and_anchor_places():
    rng = np.random.default_rng(1)
    for n in (20, 21, 50, 400):
        hashes = rng.integers(0, 1 << 63, n).astype(np.uint64)
        grams = substring_dedup.rolling(hashes, substring_dedup.GRAM)
        size = substring_dedup.LENGTH - substring_dedup.GRAM + 1
        least = np.array([grams[i:i + size].min() for i in range(len(grams) - size + 1)])
        assert (substring_dedup._sliding(grams, size, np.minimum) == least).all()
        at = sorted({i + int(grams[i:i + size].argmin()) for i in range(len(least))})
        assert substring_dedup.anchor_places(hashes).tolist() == grams[at].view(np.int64).tolist()
