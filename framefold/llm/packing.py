"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed size.

Documents are encoded, an end id is added, and documents longer than ``capacity`` are cut into pieces of ``capacity``
tokens, of which the first may be shorter.  Pieces are packed by best-fit decreasing: longest first, each into
the open sequence with the least room that still takes it.  A segment tree over the possible remaining capacities, with
the number of open sequences at each, finds the tightest one in logarithmic time.

Pieces of one length are interchangeable, and so are open sequences with the same room.  Hence the whole packing follows
from the number of pieces of each length: at most ``capacity`` numbers, which Spark counts.  The packer runs over this
histogram only and its output is a plan, "pieces number a to b of length n go to sequences from s on, k in each, at
offset o".  Its size depends on ``capacity``, not on the corpus.  Spark then numbers the pieces of each length
(frequent lengths over many salts, prefix sums over the salts) and each piece looks its place up in the plan.  The result is
that of packing one piece after the other.

Cases: a null text is an empty one, which is the end id alone; rows with a null or repeated doc_id are packed like any
other; no rows give no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import table
from .pretokens import PieceCodes

CAPACITY = 2048
END_ID = 0
PLAIN = re.compile("(?: [!-~\u00a1-\u024f]+)").fullmatch  # a space and visible Latin characters
SALT_ROWS = 20_000  # pieces of one length that one salt numbers
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class RoomTree:
    """Segment tree over remaining capacities 0..capacity; a leaf counts the open sequences with that room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, least: int) -> int | None:
        """Smallest room of at least ``least`` that some open sequence has."""
        at = least + self.size
        if not self.count[at]:
            while at > 1 and (at % 2 or not self.count[at + 1]):  # up until a right sibling holds something
                at //= 2
            if at <= 1:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: (length, first, last + 1, sequence, each, offset) per run of pieces.

    Piece number r of that length, first <= r, goes to sequence + (r - first) // each, at offset + ((r - first) % each) * length.
    """
    tree, open_at, runs, fresh = RoomTree(capacity), {}, [], 0
    for length in sorted(lengths, reverse=True):
        done, n = 0, lengths[length]
        while done < n:
            room = tree.tightest(length)
            if room is None:  # open as many sequences as the rest fills
                room = capacity
                start, width = fresh, -(-(n - done) // (capacity // length))
                fresh += width
            else:
                start, width = open_at[room].popleft()
                tree.add(room, -width)
            each = room // length
            full = min(width, (n - done) // each)
            if full:
                runs.append((length, done, done + full * each, start, each, capacity - room))
                done += full * each
                put(tree, open_at, room - each * length, start, full)
            rest = min(n - done, each - 1) if full < width and done < n else 0
            if rest:  # the last sequence of this length is filled in part
                runs.append((length, done, done + rest, start + full, rest, capacity - room))
                done += rest
                put(tree, open_at, room - rest * length, start + full, 1)
            left = width - full - bool(rest)
            if left:
                put(tree, open_at, room, start + width - left, left, front=True)
    return runs


def put(tree: RoomTree, open_at: dict[int, deque], room: int, start: int, width: int, front: bool = False) -> None:
    runs = open_at.setdefault(room, deque())
    (runs.appendleft if front else runs.append)((start, width))
    tree.add(room, width)


def merge_ranks(path: str) -> dict[bytes, int]:
    """Bytes of the mergeable tokens in a byte-level tokenizer file, whose ids are their ranks.

    The file writes a byte as the character of that number if it is a visible one of Latin-1, and the others in order from 256 on.
    """
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(sorted({*range(256)} - {*visible}))}
    return {bytes(map(byte_of.__getitem__, token)): rank for token, rank in vocabulary.items()}


def latin_encoder(path: str, pattern: str):
    """Encoder of many PLAIN pieces in one call of tiktoken, by the ranks of the tokenizer's own file.

    Every such piece starts with its only space, where the pattern starts a match, so no token reaches over a piece's end.
    """
    import tiktoken

    ranks = merge_ranks(path)
    model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = list(map(len, ranks))

    def encode(pieces: list[str]) -> list[bytes]:
        ids = model.encode_to_numpy("".join(pieces), disallowed_special=())
        last = np.cumsum([len(p.encode()) for p in pieces])
        ends = [0, *(4 * np.searchsorted(np.cumsum(sizes[ids]), last, "right")).tolist()]
        data = ids.astype("<u4").tobytes()
        return [data[x:y] for x, y in zip(ends, ends[1:])]

    return encode


def tokenizer_encoder(path: str, pattern: str):
    """Encoder of text pieces as by the tokenizers library; strings of special tokens in a text become those tokens, as by its plain call.

    Pieces of visible Latin characters, most of all, are merged by tiktoken from the same file, in a fraction of the time.  The
    two libraries class these characters alike (a test goes through all of them) and merge by the same ranks.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model, plain = Tokenizer.from_file(path), []
    model.encode_special_tokens = True  # spares the library's search in pieces without special strings
    special = [t.content for t in model.get_added_tokens_decoder().values()]
    long_piece = 200
    latin = latin_encoder(path, pattern)

    def encode(pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        together = "\n".join(pieces)
        present = [s for s in special if s in together]
        marked = {i for i, p in enumerate(pieces) if any(s in p for s in present)} if present else set()
        if marked and not plain:
            plain.append(Tokenizer.from_file(path))
        easy, short = [], []
        for i, p in enumerate(pieces):
            if p and len(p) <= long_piece and i not in marked:
                (easy if PLAIN(p) else short).append(i)
        for at in range(0, len(easy), 4096):
            group = easy[at:at + 4096]
            for i, code in zip(group, latin([pieces[i] for i in group])):
                out[i] = code
        for at in range(0, len(short), 4096):
            group = short[at:at + 4096]
            found = model.encode([pieces[i] for i in group], is_pretokenized=True, add_special_tokens=False)
            ids, word = np.array(found.ids, np.uint32), np.array(found.word_ids, np.int64)
            ends = np.searchsorted(word, np.arange(len(group) + 1)) * 4
            data = ids.tobytes()
            for k, i in enumerate(group):
                out[i] = data[ends[k]:ends[k + 1]]
        for i, p in enumerate(pieces):
            if len(p) > long_piece or i in marked:
                out[i] = np.array((plain[0] if i in marked else model).encode(p, add_special_tokens=False).ids, np.uint32).tobytes()
        return out

    return encode


def piece_rows(tokenizer: str, pattern: str, capacity: int, end_id: int):
    """mapInArrow function: documents (doc_id, text) to PIECES."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = PieceCodes(tokenizer_encoder(tokenizer, pattern))
        end = np.array([end_id], "<u4").tobytes()
        for whole_batch in batches:
            for low in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(low, 256)
                rows: list[tuple] = []
                for doc_id, parts in zip(batch["doc_id"].to_pylist(), codes.of([t or "" for t in batch["text"].to_pylist()])):
                    data = b"".join(parts) + end
                    n = len(data) // 4
                    start = 0
                    while start < n:
                        size = ((n - 1) % capacity + 1) if start == 0 else capacity
                        rows.append((doc_id, len(rows), start, size, zlib.crc32(data[4 * start:4 * (start + size)])))
                        start += size
                # number pieces within each document: a document's first piece starts at 0
                piece, numbers = 0, []
                for row in rows:
                    piece = 0 if row[2] == 0 else piece + 1
                    numbers.append(piece)
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(numbers, pa.int32()), *(pa.array(columns[i], pa.int64()) for i in (2, 3, 4))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    ``pieces`` is read several times, so it should be a written table.  Which of several equal pieces gets which
    place is decided by the rows' own columns; rows equal in every column are interchangeable.
    """
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(sizes, capacity)
    keys = [length * (1 << 40) + first for length, first, *_ in sorted(runs)]
    steps = np.array([r[1:2] + r[3:] for r in sorted(runs)], np.int64).reshape(-1, 4)
    salts = {length: -(-n // SALT_ROWS) for length, n in sizes.items() if n > SALT_ROWS}
    wide = F.lit(1)
    for length, n in salts.items():
        wide = F.when(F.col("length") == length, F.lit(n)).otherwise(wide)
    dealt = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), wide).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("_own", F.row_number().over(own) - 1).join(counts, ["length", "_salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def places(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(np.array(keys, np.int64), n * (1 << 40) + r, "right") - 1
        first, start, each, offset = steps[at].T if len(at) else np.zeros((4, 0), np.int64)
        return pd.DataFrame({"sequence_id": start + (r - first) // each, "offset": offset + (r - first) % each * n})

    found = numbered.withColumn("_place", places("length", (F.col("_before") + F.col("_own")).cast("long")))
    return found.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``pattern`` is the byte-level pattern that the tokenizer file splits texts by.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return place(materialize(source.mapInArrow(piece_rows(tokenizer, pattern, capacity, end_id), PIECES)), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
