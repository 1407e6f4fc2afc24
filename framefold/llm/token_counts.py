"""Token counts by a sentencepiece model: batch encoding in Arrow functions that return lengths only.

An Arrow batch of texts becomes parts, the parts become groups of about equal numbers of bytes (at most about
``GROUP_BYTES`` plus one part), and each group is one call of the library; ids are counted and dropped at once.

Texts of more than ``PART_CHARS`` characters are split at safe boundaries: a single space after a character that is no space.
The library puts a space mark before every text it encodes, so a part that begins after such a space gets the mark
that the space would have been; and as no piece of the vocabulary has a mark after another character, no merge of a pair
program crosses the boundary.  Both are read off the model; a model without them (another normaliser, another place of
the mark, pieces over several words) has its texts encoded whole.

Cases: a null text is an empty one and has no tokens; special strings in texts are ordinary text, as the library takes them;
a very long text without a safe boundary is encoded whole; rows that repeat a doc_id, or have none, are counted like any
other; an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8

PART_CHARS = 32_768
GROUP_BYTES = 262_144
LIMIT = 4096
MARK = "▁"  # how the library writes a space
SAFE = re.compile(f"(?<=[^ {MARK}]) (?!$)", re.DOTALL)


def splits_at_spaces(model_path: str) -> bool:
    """Does the model encode what stands on the two sides of a space independently, with a mark before each text?"""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    normalizer, trainer = model.normalizer_spec, model.trainer_spec
    return (trainer.model_type == trainer.BPE and not trainer.treat_whitespace_as_suffix
            and normalizer.add_dummy_prefix and normalizer.escape_whitespaces and not normalizer.remove_extra_whitespaces
            and not normalizer.precompiled_charsmap
            and not any(re.search(f"[^{MARK}]{MARK}", piece.piece) for piece in model.pieces))


def parts_of(text: str, limit: int) -> list[str]:
    """The text in parts of at least ``limit`` characters, cut at the first safe space after these; the spaces go."""
    parts, start = [], 0
    while len(text) - start > limit:
        cut = SAFE.search(text, start + limit)
        if cut is None or cut.end() == len(text):
            break
        parts.append(text[start:cut.start()])
        start = cut.end()
    parts.append(text[start:])
    return parts


def groups(sizes: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Consecutive ranges of parts with about equal sums of sizes, as few as ``budget`` allows."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    count = max(1, -(-total // budget))
    middle = ends - sizes / 2
    number = np.minimum((middle * count / max(total, 1)).astype(np.int64), count - 1)
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def token_count(text: Column, model_path: str, part_chars: int = PART_CHARS, group_bytes: int = GROUP_BYTES) -> Column:
    """Number of tokens of a string column."""
    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=model_path).encode
        limit = part_chars if splits_at_spaces(model_path) else None
        for batch in batches:
            parts, owner = [], []
            for row, value in enumerate(batch.to_pylist()):
                value = value or ""
                own = [value] if limit is None or len(value) <= limit else parts_of(value, limit)
                parts += own
                owner += [row] * len(own)
            sizes = np.array([len(utf8(p)) for p in parts], np.int64)
            lengths = [len(ids) for a, b in groups(sizes, group_bytes) for ids in encode(parts[a:b], num_threads=1)]
            yield pa.array(np.bincount(owner, lengths, len(batch)).astype(np.int64), pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.  No shuffle."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = source.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), token_count(F.col("text"), model_path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
