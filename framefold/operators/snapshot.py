"""Catalog changes as joins between snapshots (K1-K3).  Nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns an update may set.
UPDATABLE = ("rotatemode", "flipmode", "lastview", "hist_len", "vector")


def insert_rows(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """K1: add rows whose hash is new.  Of several new rows with one hash a single one is kept (oldest view time)."""
    columns = [c for c in catalog.columns if c != "hash"]
    ordered = ["lastview"] + [c for c in columns if c != "lastview"]
    first = (rows.groupBy("hash").agg(F.min(F.struct(*ordered)).alias("_row"))
             .select("hash", "_row.*"))
    fresh = first.join(catalog.select("hash"), "hash", "left_anti")
    return catalog.unionByName(fresh)


def update_rows(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """K2: ``updates`` has ``hash`` (unique) and any of the updatable columns; NULL leaves a value as it is."""
    named = [c for c in updates.columns if c != "hash"]
    unknown = sorted(set(named) - set(UPDATABLE))
    if unknown:
        raise ValueError(f"columns that cannot be updated: {unknown}")
    renamed = updates.select("hash", *[F.col(c).alias(f"_new_{c}") for c in named])
    joined = catalog.join(renamed, "hash", "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in named else F.col(c) for c in catalog.columns])


def delete_rows(catalog: DataFrame, hashes: DataFrame) -> DataFrame:
    """K3."""
    return catalog.join(hashes.select("hash"), "hash", "left_anti")
