"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

Texts are cut into the pattern's matches (pre-tokens).  Documents are taken in chunks of about ``CHUNK_CHARS`` characters
as they are read.

1. Each chunk's distinct pre-tokens are dealt by their hash into buckets; a row holds one chunk's words of one bucket.
2. A bucket's rows meet in one task, which encodes every distinct word once and answers each row with its words' ids.
3. The answers meet the chunk's texts (compressed, shuffled once), whose pre-tokens, by position, are replaced by their
   ids.  Decoding looks every id up in the table of token bytes, which is as large as the vocabulary.

Documents are read twice, once for their words and once for their texts, so no row carries a position or an id of a
frequent word twice.  A chunk is named by its ids and whole texts, so chunks of one name are equal; words that a bucket's
answer lacks (if a file changed in between) are encoded where they are needed, so the result does not depend on the two
reads being cut alike.

Cases: a null or empty text has no tokens; rows with null or repeated doc_id are encoded like any other; strings of special
tokens are ordinary text; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_partitions
from .common import table, utf8
from .pretokens import ENDINGS, PieceCodes

CHUNK_CHARS = 8_000_000
CACHED = 2_000_000  # words whose ids a bucket's task holds at most


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """(chunk, doc_ids, texts): the chunk's number is a hash of its rows, whole texts included; equal chunks share it."""
    import xxhash

    ids, texts, size, name = [], [], 0, xxhash.xxh3_64()
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            text = text or ""
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            data = utf8(text)
            name.update(f"{doc_id} {len(data)} ".encode())
            name.update(data)
            if size >= CHUNK_CHARS:
                yield name.intdigest() - (1 << 63), ids, texts
                ids, texts, size, name = [], [], 0, xxhash.xxh3_64()
    if ids:
        yield name.intdigest() - (1 << 63), ids, texts


def pretokens_of(pieces: list[str], find: Callable[[str], list[str]]) -> dict[str, list[str]]:
    """The pre-tokens of each of the pieces (and of the endings that PieceCodes splits off)."""
    return {piece: find(piece) for piece in {*pieces, *ENDINGS}}


def by_bucket(pretokens: dict[str, list[str]], buckets: int) -> dict[int, list[str]]:
    import xxhash

    out: dict[int, list[str]] = {}
    for token in sorted(set(chain.from_iterable(pretokens.values()))):
        out.setdefault(xxhash.xxh3_64_intdigest(token.encode()) % buckets, []).append(token)
    return out


def packed(words: list[str]) -> bytes:
    """Words with their lengths, compressed."""
    data = [w.encode() for w in words]
    sizes = np.array([len(d) for d in data], np.uint32).tobytes()
    return len(words).to_bytes(4, "little") + pack(sizes + b"".join(data))


def pack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def parted(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def unpacked(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    body = unpack(data[4:])
    return parted(body[4 * n:], np.frombuffer(body[:4 * n], np.uint32))


ROW = "chunk long, kind int, bucket int, data binary"
KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.binary())


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], ["chunk", "kind", "bucket", "data"])


def _word_rows(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        for chunk, _, texts in chunks(batches):
            codes = PieceCodes(list)
            firsts, _ = codes.index(texts)
            dealt = by_bucket(pretokens_of(firsts + codes.fresh, find), buckets)
            yield rows_of([(chunk, 0, bucket, packed(words)) for bucket, words in dealt.items()])

    return run


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, ids, texts in chunks(batches):
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_string())], ["doc_id", "text"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        yield rows_of([(chunk, 1, 0, pack(sink.getvalue().to_pybytes()))])


def _answers(encoder: Callable[[], Callable[[str], list[int]]]):
    """Rows sorted by bucket; every distinct word of a bucket is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, now = encoder(), {}, None
        for batch in batches:
            for chunk, bucket, data in zip(*(batch[c].to_pylist() for c in ("chunk", "bucket", "data"))):
                if bucket != now or len(known) > CACHED:
                    known, now = {}, bucket
                found = []
                for word in unpacked(data):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode(word.decode()), "<u4").tobytes()
                    found.append(ids)
                sizes = np.array([len(x) // 4 for x in found], np.uint32).tobytes()
                yield rows_of([(chunk, 0, bucket, len(found).to_bytes(4, "little") + pack(sizes + b"".join(found)))])

    return run


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _assemble(pattern: str, buckets: int, encoder: Callable[[], Callable[[str], list[int]]], token_bytes: Callable[[], dict[int, bytes]]):
    """Rows sorted by (chunk, kind, bucket): the answers of a chunk, then its texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, encode, bytes_of, answers, now = regex.compile(pattern).findall, encoder(), token_bytes(), {}, None
        for batch in batches:
            for chunk, kind, bucket, data in zip(*(batch[c].to_pylist() for c in ("chunk", "kind", "bucket", "data"))):
                if chunk != now:
                    answers, now = {}, chunk
                if kind == 0:
                    answers[bucket] = data
                    continue
                rows = pa.ipc.open_stream(unpack(data)).read_all()
                doc_ids, texts = rows["doc_id"].to_pylist(), rows["text"].to_pylist()
                ids: dict[str, bytes] = {}
                parts_of: dict[str, list[str]] = {}

                def code(pieces: list[str], ids: dict[str, bytes] = ids, parts_of: dict[str, list[str]] = parts_of) -> list[bytes]:
                    return [b"".join(map(ids.__getitem__, parts_of[piece])) for piece in pieces]

                codes, table_of = PieceCodes(code), bytes_of.__getitem__
                firsts, numbers = codes.index(texts)
                parts_of.update(pretokens_of(firsts + codes.fresh, find))
                for place, words in by_bucket(parts_of, buckets).items():
                    body = answers.get(place)
                    n = int.from_bytes(body[:4], "little") if body else -1
                    if n == len(words):
                        plain = unpack(body[4:])
                        ids.update(zip(words, parted(plain[4 * n:], np.frombuffer(plain[:4 * n], np.uint32) * 4)))
                    else:
                        ids.update((w, np.array(encode(w), "<u4").tobytes()) for w in words)
                firsts, code_of = codes.resolve(firsts), codes.codes.__getitem__
                for low in range(0, len(texts), 1000):
                    out = []
                    for doc_id, first, row in zip(doc_ids[low:low + 1000], firsts[low:low + 1000], numbers[low:low + 1000]):
                        joined = b"".join([first, *map(code_of, row)])
                        decoded = b"".join(map(table_of, np.frombuffer(joined, "<u4").tolist()))
                        out.append((doc_id, len(joined) // 4, hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3])],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: RESULT."""
    def encoder() -> Callable[[str], list[int]]:
        import tiktoken

        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks_of(ranks_path), special_tokens={}).encode_ordinary

    def token_bytes() -> dict[int, bytes]:
        return {rank: token for token, rank in ranks_of(ranks_path).items()}

    parts = work_partitions(docs.sparkSession)
    buckets = 2 * parts
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = source.mapInArrow(_word_rows(pattern, buckets), ROW)
    answers = asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_answers(encoder), ROW)
    both = answers.union(source.mapInArrow(_text_rows, ROW)).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    return both.mapInArrow(_assemble(pattern, buckets, encoder, token_bytes), RESULT)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
