import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framefold.llm import packing
from framefold.llm.pretokens import PieceCodes
from tests.llm.conftest import odd_rows

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def one_by_one(lengths, capacity):
    """Rooms left after best-fit decreasing, a piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 7, 20, 64, 100])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 120))]
    sequences: dict = {}
    for length, first, last, start, each, offset in packing.plan({n: lengths.count(n) for n in set(lengths)}, capacity):
        for k in range(first, last):
            sequences.setdefault(start + (k - first) // each, []).append((offset + (k - first) % each * length, length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    assert sorted(capacity - sum(n for _, n in p) for p in sequences.values()) == one_by_one(lengths, capacity)


def encode(texts):
    model = Tokenizer.from_file(PATH)
    return [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_pieces_of_text_are_encoded_as_the_whole():
    r = random.Random(5)
    texts = ["", " ", "  a  b ", "don't we'll  \t x\x1cy \x1c z", "<|endoftext|> hi <|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>, y  <|endoftext|>\n <|endoftext|>", "　你好 世界 ", "foo\n", "foo\n bar", "z  ", "z, z. "]
    texts += ["".join(r.choice(["a", "B", " ", "  ", "\n", "'s", "é", "1", "\t", "!", "\x1c", " ", "你", ",", "<|endoftext|>"]) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    codes = PieceCodes(packing.tokenizer_encoder(PATH, PATTERN), limit=500)
    got = []
    for low in range(0, len(texts), 100):
        got += [np.frombuffer(b"".join(x), np.uint32).tolist() for x in codes.of(texts[low:low + 100])]
    assert got == encode(texts)
    assert encode(["a <|endoftext|> b"]) == [[64, 220, 50256, 275]]


def test_latin_pieces_are_encoded_alike():
    """Every character of PLAIN next to letters, digits, signs, an apostrophe and itself."""
    latin, pieces = packing.latin_encoder(PATH, PATTERN), []
    for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]):
        pieces += [f" {c}", f" a{c}b", f" 1{c}2", f" !{c}?", f" it'{c}s", f" {c}{c}", f" x{c}1{c}-{c}", f" {c}'ll"]
    r = random.Random(9)
    chars = [chr(i) for i in [*range(0x21, 0x7F)] * 4 + [*range(0xA1, 0x250)]]
    pieces += [" " + "".join(r.choices(chars, k=r.randint(1, 30))) for _ in range(20_000)]
    pieces = [p for p in pieces if "<|endoftext|>" not in p]
    assert all(packing.PLAIN(p) for p in pieces)
    assert not any(packing.PLAIN(p) for p in ["", " ", "a", "  a", " a b", " a\n", " \u00a0", " 你", " a\u2028"])
    got = [np.frombuffer(x, np.uint32).tolist() for x in latin(pieces)]
    assert got == encode(pieces)


def test_ranks_are_those_of_the_rank_file():
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        want = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f.read().splitlines()))}
    assert packing.merge_ranks(PATH) == want


def test_pack(odd, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 3)  # frequent lengths over several salts
    rows = packing.pack(odd, PATH, PATTERN, capacity=64).collect()
    want = sorted((i if i is not None else -1, x + [0]) for (i, _), x in zip(odd_rows(), encode([t or "" for _, t in odd_rows()])))
    pieces = []
    for i, ids in want:
        start = 0
        while start < len(ids):
            size = (len(ids) - 1) % 64 + 1 if start == 0 else 64
            pieces.append((i, start, size, zlib.crc32(np.array(ids[start:start + size], "<u4").tobytes())))
            start += size
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(pieces)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        assert sum(n for _, n in places) <= 64
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
    assert len(sequences) == len(one_by_one([p[2] for p in pieces], 64))


def test_empty(no_docs):
    assert packing.pack(no_docs, PATH, PATTERN).collect() == []
