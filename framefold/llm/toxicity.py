"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct character 3-, 4- and 5-grams of its lower-cased text, hashed into 2**20
buckets.  Every bucket's log-count ratio r compares its document share in the two classes; a logistic regression is
then fitted on x * r (Wang and Manning's NBSVM with the logistic loss), and w * r is what scoring adds up.  Buckets
whose share does not differ between the classes have no influence and are left out.

Training reads a sample of at most ``PER_CLASS`` labelled rows of each class, chosen by a hash of the id; bucket counts
are summed by Spark, only informative buckets (at most ``MAX_FEATURES``) and the sample's feature lists for them
reach the driver.  Both bounds are independent of the tables.  In training, rows of label 1 weigh more the rarer they
are (the classes' ratio to the power 0.75), so a score of 0.5 lies between the classes' true shares and equal shares.

Cases: a null text counts as empty; an empty text has no features and gets the prior; a row with null doc_id is
scored, its ``held_out`` is null; repeated rows give repeated results; without labels of both classes the
score is the share of class 1 (0.5 without any label).  Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import id_bucket, labelled, table

BITS = 20
SIZES = (3, 4, 5)
PER_CLASS = 6144
MAX_FEATURES = 1 << 13
LEAST_Z = 2.5
HOLD_OUT = 5


def grams(text: str | None, scratch: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of one text.  ``scratch`` has 2**BITS int32 and need not be cleared."""
    if not text:
        return np.zeros(0, np.int64)
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    parts, h = [], a
    for size in range(2, max(SIZES) + 1):
        if len(a) < size:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + a[size - 1:]
        if size in SIZES:
            x = (h + np.uint32(size)) * np.uint32(0x9E3779B1)
            parts.append((x ^ (x >> np.uint32(16))) >> np.uint32(32 - BITS))
    if not parts:
        return np.zeros(0, np.int64)
    found = np.concatenate(parts)
    order = np.arange(len(found), dtype=np.int32)
    scratch[found] = order
    return found[scratch[found] == order].astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # float32 per bucket: w * r, 0 where a bucket is not informative
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        scratch = np.zeros(1 << BITS, np.int32)
        z = np.array([self.bias + float(self.weights[grams(t, scratch)].sum(dtype=np.float64)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, decay: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on the informative features times ``ratio``: accelerated gradient descent, all rows at once."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    value = ratio[col]
    per_row = np.bincount(row, value * value, len(rows)) + 1
    weight = np.where(labels == 1, (1 / labels.mean() - 1) ** 0.75, 1.0)
    step = 1 / (0.25 * float(weight @ per_row) + decay)
    w, b, last_w, last_b, loss = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio)), 0.0, math.inf
    momentum = 0
    for _ in range(rounds):
        k = momentum / (momentum + 3)
        v, c = w + k * (w - last_w), b + k * (b - last_b)
        z = np.bincount(row, value * v[col], len(rows)) + c
        now = float(weight @ np.logaddexp(0, np.where(labels == 1, -z, z)) + decay / 2 * (v @ v))
        if now > loss:  # overshot: start the momentum anew with a smaller step
            momentum, step = 0, step / 2
        error = weight * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - labels)
        last_w, last_b, loss = w, b, now
        w = v - step * (np.bincount(col, value * error[row], len(ratio)) + decay * v)
        b = c - step * float(error.sum())
        momentum += 1
    return w, b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", where: Column | None = None, per_class: int = PER_CLASS) -> Model:
    sample, sizes = labelled(docs, labels, label, per_class, where)
    weights = np.zeros(1 << BITS, np.float32)
    if len(sizes) < 2:
        share = {frozenset(): 0.5, frozenset([0]): 1e-3, frozenset([1]): 1 - 1e-3}[frozenset(sizes)]
        return Model(weights, math.log(share / (1 - share)))
    sample = materialize(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch, seen = np.zeros(1 << BITS, np.int32), np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, y in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
                seen[y][grams(text, scratch)] += 1
        for y in (0, 1):
            at = np.flatnonzero(seen[y])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), y, np.int32)), pa.array(seen[y][at].astype(np.int64))], ["bucket", "label", "n"])

    taken = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = taken.get(0, 0), taken.get(1, 0)
    if not n0 or not n1:
        share = sizes[1] / (sizes[0] + sizes[1])
        return Model(weights, math.log(share / (1 - share)))
    with_label = lambda y: F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0))
    counts = sample.mapInArrow(count, "bucket int, label int, n long").groupBy("bucket").agg(with_label(0).alias("c0"), with_label(1).alias("c1"))
    p0, p1 = (F.col("c0") + 0.5) / (n0 + 1), (F.col("c1") + 0.5) / (n1 + 1)
    pooled = (F.col("c0") + F.col("c1") + 1) / (n0 + n1 + 2)
    z = F.abs(p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))
    best = counts.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(MAX_FEATURES).toPandas()
    at = best["bucket"].to_numpy(np.int64)
    c0, c1 = best["c0"].to_numpy(float) + 1, best["c1"].to_numpy(float) + 1
    ratio = np.log(c1 / (n1 + 2)) - np.log(c0 / (n0 + 2))
    place = np.full(1 << BITS, -1, np.int32)
    place[at] = np.arange(len(at))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            found = [place[grams(t, scratch)] for t in batch["text"].to_pylist()]
            found = [np.sort(f[f >= 0]).astype(np.int32).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(found, pa.binary())], ["doc_id", "label", "at"])

    rows = sample.mapInArrow(vectors, "doc_id long, label int, at binary").toArrow().sort_by("doc_id")
    lists = [np.frombuffer(b, np.int32).astype(np.int64) for b in rows["at"].to_pylist()]
    w, b = fit_weights(lists, np.array(rows["label"].to_pylist(), float), ratio)
    weights[at] = (w * ratio).astype(np.float32)
    return Model(weights, b)


def score_column(model: Model, text: Column) -> Column:
    """Probability of label 1 for each whole text."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return scores(text)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted (1 if the score is at least 0.5)."""
    scored = docs.select(id_col, score_column(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), "toxic", id_bucket(F.col("doc_id"), HOLD_OUT) != 0)
    return toxicity(docs, model).select("doc_id", (id_bucket(F.col("doc_id"), HOLD_OUT) == 0).alias("held_out"), "score", "predicted")
