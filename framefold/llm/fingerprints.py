"""Document fingerprints: digests of improbable features in chained Bloom filters.

Every run of ``WINDOW`` bytes has an entropy, rounded to one of ``LEVELS`` values.  How often each value occurs is counted
over all texts; the rarer a window's value, the better its rank.  Each stretch of ``WINDOW`` neighbouring windows votes for
its rarest (the leftmost of equals), and windows with at least ``VOTES`` votes are the features.  A feature's hash
sets ``PROBES`` bits of a filter of ``BITS`` bits; after ``PER_FILTER`` different features the next filter begins.  Two
fingerprints are compared filter by filter: the common bits, less what chance explains, as a share of the most that is
possible; each filter of the shorter chain takes its best partner and the scores are averaged.

The next document of each one is found by dealing rows into ranges of doc_id, sorted within, with each range's first
row copied behind the range before it.  Only the range bounds (one number per range) reach the driver.

Cases: a null text is an empty one; texts of up to WINDOW bytes have one feature, the whole text, and the empty text has none: two
fingerprints without features are alike (1), one without and one with are not (0); rows that repeat a doc_id follow
each other in the order of their texts' hashes; a single row is its own next; rows with null doc_id have no next, so
their edited text is the first half and near_next is 0; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_partitions
from .common import mix, seeds, table, utf8

WINDOW, LEVELS = 32, 512
VOTES = 8
BITS, PROBES, PER_FILTER = 2048, 4, 128
LEAST_ENTROPY = 0.2  # windows that say almost nothing are no features
FEATURE_SEEDS = seeds(WINDOW, 5)
TERMS = np.array([0.0] + [-(c / WINDOW) * np.log2(c / WINDOW) for c in range(1, WINDOW + 1)])


def entropies(x: np.ndarray) -> np.ndarray:
    """Entropy level of every window of at least WINDOW bytes, from the change when it moves on by one byte."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    key = (x[order].astype(np.int64) << 40) + order
    end = np.searchsorted(key, key + WINDOW)  # after the last equal byte of the window that starts here
    at = np.arange(n)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    ahead[order] = end - at
    behind[order] = np.cumsum(1 - np.bincount(end, minlength=n + 1)[:n])  # equal bytes in the window that ends here
    first = TERMS[np.bincount(x[:WINDOW], minlength=256)].sum()
    out, into = ahead[:n - WINDOW], behind[WINDOW:]
    step = TERMS[out - 1] - TERMS[out] + TERMS[into] - TERMS[into - 1]
    step[x[:n - WINDOW] == x[WINDOW:]] = 0
    values = first + np.concatenate([[0.0], np.cumsum(step)])
    return np.clip(np.rint(values / np.log2(WINDOW) * (LEVELS - 1)), 0, LEVELS - 1).astype(np.int64)


def features(data: bytes, rank: np.ndarray) -> np.ndarray:
    """Distinct hashes of the selected windows in order of appearance; ``rank`` by entropy level, small is rare."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return np.zeros(0, np.uint64)
    if len(x) <= WINDOW:
        padded = np.zeros(WINDOW, np.uint64)
        padded[:len(x)] = x.astype(np.uint64) + np.uint64(1)
        return mix((padded * FEATURE_SEEDS).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x)))
    n = len(x) - WINDOW + 1
    key = (rank[entropies(x)] << 40) + np.arange(n)
    if n < WINDOW:
        chosen = np.array([int(key.min()) & ((1 << 40) - 1)])
    else:
        size = 1
        while size < WINDOW:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        votes = np.bincount(key & ((1 << 40) - 1), minlength=n)
        least = min(VOTES, len(key))
        chosen = np.flatnonzero(votes >= least)
        if not len(chosen):
            chosen = np.array([int(votes.argmax())])
    windows = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[chosen].astype(np.uint64)
    found = mix((windows * FEATURE_SEEDS).sum(1, dtype=np.uint64))
    _, first = np.unique(found, return_index=True)
    return found[np.sort(first)]


def filters(found: np.ndarray) -> np.ndarray:
    """Chained Bloom filters: one row of BITS bits, packed, for each PER_FILTER features."""
    count = -(-len(found) // PER_FILTER)
    bits = np.zeros((count, BITS), np.uint8)
    row = np.repeat(np.arange(len(found)) // PER_FILTER, PROBES)
    shift = np.arange(PROBES, dtype=np.uint64) * np.uint64(11)
    bits[row, ((found[:, None] >> shift) & np.uint64(BITS - 1)).astype(np.int64).ravel()] = 1
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1 for two filter chains."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    total = 0.0
    for row, n in zip(a, na):
        both = np.bitwise_count(row & b).sum(1, dtype=np.int64)
        most, chance = np.minimum(n, nb), n * nb / BITS
        total += float(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / len(a)


def text_of(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level by how many windows of the corpus have it; LEVELS numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                data = utf8(text)
                if len(data) > WINDOW:
                    seen += np.bincount(entropies(np.frombuffer(data, np.uint8)), minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(seen)], ["level", "n"])

    rows = docs.select("text").mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(LEVELS, np.int64)
    for r in rows:
        seen[r["level"]] = r["n"]
    dull = np.arange(LEVELS) < LEAST_ENTROPY * (LEVELS - 1)
    order = np.lexsort((-np.arange(LEVELS), seen, dull))
    rank = np.empty(LEVELS, np.int64)
    rank[order] = np.arange(LEVELS)
    return rank


def with_ranges(source: DataFrame) -> DataFrame:
    """Rows (doc_id, text, tie) with their range, and each range's first row again behind the range before it (after = 1)."""
    spark = source.sparkSession
    ranges = 4 * max(work_partitions(spark), source.rdd.getNumPartitions())
    bounds = sorted(set(source.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)))
    bounds = np.array([int(b) for b in bounds], np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right").astype(np.int32))

    dealt = source.withColumn("range", range_of("doc_id"))
    firsts = dealt.groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("first")).orderBy("range").collect()  # one row per range
    target = {(r["first"]["doc_id"], r["first"]["tie"]): firsts[i - 1]["range"] for i, r in enumerate(firsts)}

    @F.pandas_udf("int")
    def copy_to(ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([target.get(k) for k in zip(ids.tolist(), ties.tolist())], dtype="Int32")

    dealt = dealt.withColumn("copy_to", copy_to("doc_id", "tie"))
    own = F.struct(F.col("range"), F.lit(0).alias("after"))
    again = F.struct(F.col("copy_to").alias("range"), F.lit(1).alias("after"))
    places = F.when(F.col("copy_to").isNull(), F.array(own)).otherwise(F.array(own, again))
    placed = dealt.select("doc_id", "text", "tie", F.explode(places).alias("p")).select("doc_id", "text", "tie", "p.*")
    return placed.repartition(ranges // 4, "range").sortWithinPartitions("range", "after", "doc_id", "tie")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _pairs(rank: np.ndarray):
    def chain(text: str) -> np.ndarray:
        return filters(features(utf8(text), rank))

    def row(doc_id, text, own, following, theirs):
        new = edited(text, following)
        changed = chain(new)
        return (doc_id, len(text), hashlib.sha256(utf8(new)).hexdigest(), text_of(own), text_of(changed), likeness(own, changed), 0.0 if theirs is None else likeness(own, theirs))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], [x.split()[0] for x in RESULT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = None, None
        for whole in batches:
            for low in range(0, whole.num_rows, 200):
                batch, rows = whole.slice(low, 200), []
                for doc_id, text, place, after in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "range", "after"))):
                    own = chain(text)
                    if place != now:
                        now, before = place, None
                    if before is not None:
                        rows.append(row(*before, text, own))
                    if after:
                        before = None
                    else:
                        before = doc_id, text, own
                yield out(rows)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield out([row(None, text, chain(text), "", None) for text in batch["text"].to_pylist()])

    return run, alone


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: RESULT."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    run, alone = _pairs(entropy_ranks(source))
    known = source.where("doc_id is not null").withColumn("tie", F.xxhash64("text"))
    return with_ranges(known).mapInArrow(run, RESULT).union(source.where("doc_id is null").mapInArrow(alone, RESULT))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
