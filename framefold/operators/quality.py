"""Consistency reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold import schemas
from framefold.functions import vectors
from framefold.functions.hashing import HASH_ALPHABET
from framefold.session import spread_join


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """(hash, side) of the hashes on one side only: a tagged union and one combined aggregate, so one shuffle."""
    tagged = left.select("hash", F.lit(1).alias("_bit")).unionByName(right.select("hash", F.lit(2).alias("_bit")))
    both = tagged.groupBy("hash").agg(F.bit_or("_bit").alias("_on"))
    return both.filter(F.col("_on") < 3).select("hash", F.when(F.col("_on") == 1, "left").otherwise("right").alias("side"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Hashes on one side only, with the side."""
    return _sides(left, right)


def _smallest(sample: int):
    """One row per side and task: how many hashes, and the ``sample`` smallest of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missing, heads = {"left": 0, "right": 0}, {"left": [], "right": []}
        for batch in batches:
            for side in missing:
                own = batch["hash"].filter(pc.equal(batch["side"], side))
                missing[side] += len(own)
                some = own if len(own) <= sample else own.take(pc.select_k_unstable(own, sample, [("", "ascending")]))
                heads[side] = sorted(heads[side] + some.to_pylist())[:sample]
        yield pa.RecordBatch.from_arrays([pa.array(list(missing)), pa.array(list(missing.values()), pa.int64()),
                                          pa.array(list(heads.values()), pa.list_(pa.string()))], names=["side", "missing", "heads"])

    return run


def reconcile(left: DataFrame, right: DataFrame, sample: int = 5) -> DataFrame:
    """Per side the number of one-sided hashes and the first few of them.

    Each task reduces its part to two rows, so after the shuffle of the hashes only ``sample`` names per task travel.
    """
    parts = _sides(left, right).filter(F.col("hash").isNotNull()).mapInArrow(_smallest(sample), "side string, missing long, heads array<string>")
    first = F.slice(F.array_sort(F.flatten(F.collect_list("heads"))), 1, sample)
    found = parts.groupBy("side").agg(F.sum("missing").alias("missing"), F.array_join(first, " ").alias("sample"))
    both = left.sparkSession.createDataFrame([("left",), ("right",)], "side string")
    return both.join(F.broadcast(found), "side", "left").select("side", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("sample", F.lit("")).alias("sample"))


def bad_vectors(catalog: DataFrame, dim: int) -> DataFrame:
    """V1: a vector of another length."""
    size = F.coalesce(F.when(F.col("vector").isNotNull(), F.size("vector")), F.lit(0))
    return catalog.filter(size != dim).select("hash", size.alias("size"))


def bad_history(rows: DataFrame) -> DataFrame:
    """V2: history text (hash, history) that is ragged or has an invalid part."""
    ragged = F.length("history") % schemas.HASH_LENGTH != 0
    clean = F.col("history").rlike(f"^[{HASH_ALPHABET}]*$") & ~F.col("history").contains("\n")
    return (rows.filter(F.col("history").isNotNull() & (ragged | ~clean))
            .select("hash", F.length("history").cast("long").alias("length"), ragged.alias("ragged")))


def dangling_edges(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """V3: edges to hashes that are not in the catalog.

    Peers are made distinct before the anti join, so a hub costs one row there; only the missing ones go back.
    """
    missing = edges.select("peer").distinct().join(catalog.select(F.col("hash").alias("peer")), "peer", "left_anti")
    return spread_join(edges.select("hash", F.col("peer").alias("peer")),
                       missing.select(F.col("peer").alias("peer")), "peer", "hash", "inner").select("hash", "peer")


def one_sided_edges(edges: DataFrame) -> DataFrame:
    """V4: edges whose reverse is absent.  The key is the pair, so a hub is spread over all tasks."""
    reverse = edges.select(F.col("peer").alias("hash"), F.col("hash").alias("peer"))
    return edges.select("hash", "peer").join(reverse, ["hash", "peer"], "left_anti")


def capacity(catalog: DataFrame, max_images: int) -> DataFrame:
    """V5: rows against the budget and its slack."""
    limit = max_images + schemas.ARENA_SLACK
    return catalog.agg(F.count("*").alias("images")).select(
        "images", F.lit(limit).cast("long").alias("capacity"), (F.col("images") > limit).alias("over"))
