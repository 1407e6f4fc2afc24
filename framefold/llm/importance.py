"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A text's features are its lower-cased words and word pairs, hashed into ``BUCKETS`` buckets.  The raw model is the share of
each bucket over all documents, the target model that over documents labelled good (at most about ``TARGET_ROWS``, chosen by
a hash of the id), both with one added to every bucket.  A document's log-weight is the sum of log(target / raw) over its
features; adding Gumbel noise and taking the k largest keys samples k documents without replacement in proportion to
their weights.  k is ``KEEP`` of all documents.  The noise follows from seed and doc_id, so a run can be repeated.

The k-th key is found by counting keys in ``BINS`` bins of a shrinking interval; no sort and no rows at the driver beyond one
bin of at most ``LAST_ROWS`` keys.

Cases: a null or empty text has no features and log-weight 0; rows with null doc_id share one noise value; rows that
repeat a doc_id have the same noise; rows whose key equals the k-th are all kept; without good labels all weights are 0 and the sample is
uniform; no rows give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import WordHashes, labelled, rolling, table, words

BUCKETS = 10_000
TARGET_ROWS = 16_384
KEEP = 0.8
SEED = 1
BINS, LAST_ROWS = 1024, 4096


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    found = hashes.of(words(text, lower=True))
    return (np.concatenate([found, rolling(found, 2)]) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of each bucket's features; BUCKETS numbers, summed by Spark."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                seen += np.bincount(features(text, hashes), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(seen)], ["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    sample, _ = labelled(docs, labels, "quality", TARGET_ROWS)
    target = bucket_counts(sample.where("label = 1"))
    if not target.any():
        return np.zeros(BUCKETS)
    raw = bucket_counts(docs)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of the column ``key`` (finite doubles, k from 1 on)."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high:
        width = (high - low) / BINS
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        rows = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        if len(rows) == 1 or r["n"] <= LAST_ROWS:
            last = keys.where((F.col("key") >= r["low"]) & (F.col("key") <= r["high"]))
            if r["n"] > LAST_ROWS:  # values too close for bins
                last = last.groupBy("key").agg(F.count("*").alias("n")).select("key", "n")
            else:
                last = last.select("key", F.lit(1).alias("n"))
            for row in sorted(last.collect(), key=lambda x: -x["key"]):
                k -= row["n"]
                if k <= 0:
                    return row["key"]
        low, high = r["low"], r["high"]
    return low


def importance_sample(docs: DataFrame, ratios: np.ndarray, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, log_weight, key, kept."""
    @F.pandas_udf("double")
    def weight(texts: pd.Series) -> pd.Series:
        hashes = WordHashes()
        return pd.Series([float(ratios[features(t, hashes)].sum()) for t in texts.tolist()], dtype=float)

    uniform = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    scored = docs.select("doc_id", weight("text").alias("log_weight"))
    scored = materialize(scored.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))))
    n = scored.count()
    if not n:
        return scored.withColumn("kept", F.lit(True))
    return scored.withColumn("kept", F.col("key") >= kth_largest(scored, max(1, math.ceil(keep * n))))


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_sample(docs, log_ratios(docs, table(spark, sf_dir, "labels")))
