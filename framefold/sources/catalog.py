"""Reading the catalog: scans, point lookups and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold import schemas
from framefold.functions import clock, history, vectors


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOG).parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EDGES).parquet(path)


def from_stored_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as the original store writes them (ticks, history text, vector bytes) to (catalog, edges)."""
    parsed = rows.withColumn("_peers", history.split_history("history"))
    catalog = parsed.select(
        "hash",
        F.col("rotatemode").cast("int").alias("rotatemode"),
        F.col("flipmode").cast("int").alias("flipmode"),
        clock.ticks_to_ts(F.col("lastview")).alias("lastview"),
        F.size("_peers").cast("long").alias("hist_len"),
        vectors.bytes_to_vector("vector").alias("vector"),
    )
    edges = parsed.select("hash", F.explode("_peers").alias("peer"))
    return catalog, edges


def to_stored_rows(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """The inverse, for a user who goes back.  The stored row holds a whole history, so this one does too."""
    texts = history_text(edges)
    return (catalog.join(texts, "hash", "left")
            .select("hash",
                    F.col("rotatemode").cast("long").alias("rotatemode"),
                    F.col("flipmode").cast("long").alias("flipmode"),
                    clock.ts_to_ticks(F.col("lastview")).alias("lastview"),
                    F.coalesce("history", F.lit("")).alias("history"),
                    vectors.vector_to_bytes("vector").alias("vector")))


def history_text(edges: DataFrame) -> DataFrame:
    """One sorted text per image.

    The text itself is the row format of the original store.  Edges are made distinct first and concatenated
    in 32 slices by first character, so no task sorts a whole history: the last step only joins sorted slices.
    """
    distinct = edges.select("hash", "peer").distinct()
    slices = (distinct.groupBy("hash", F.substring("peer", 1, 1).alias("_slice"))
              .agg(F.array_join(F.sort_array(F.collect_list("peer")), "").alias("_text")))
    return (slices.groupBy("hash")
            .agg(F.sort_array(F.collect_list(F.struct("_slice", "_text"))).alias("_parts"))
            .select("hash", F.array_join(F.transform("_parts", lambda p: p["_text"]), "").alias("history")))


def load_vectors(catalog: DataFrame) -> DataFrame:
    """The pruned (hash, vector) scan."""
    return catalog.select("hash", "vector")


def lookup(catalog: DataFrame, hash_: str | Column) -> DataFrame:
    """One row by hash; a miss gives no row."""
    return catalog.filter(F.col("hash") == hash_)


def lookup_many(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """S2 for a table of keys."""
    return catalog.join(keys.select("hash").distinct(), "hash", "left_semi")


def all_hashes(catalog: DataFrame) -> DataFrame:
    """S7."""
    return catalog.select("hash")


def vectors_of(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """The vector of every asked hash, each once; an unknown one gets an empty array."""
    return (keys.select("hash").distinct().join(catalog.select("hash", "vector"), "hash", "left")
            .withColumn("vector", F.coalesce("vector", F.array().cast("array<float>"))))


def contains(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """The asked hashes, each once, with a ``known`` flag."""
    known = catalog.select("hash", F.lit(True).alias("known"))
    return (keys.select("hash").distinct().join(known, "hash", "left")
            .withColumn("known", F.coalesce("known", F.lit(False))))


def backlog(catalog: DataFrame, dim: int) -> DataFrame:
    """Rows that still need a vector."""
    return catalog.filter(vectors.needs_vector(F.col("vector"), dim))


def vector_of(catalog: DataFrame, hash_: str | Column) -> Column:
    """The vector of one image as a scalar subquery: read once, no join."""
    return lookup(catalog, hash_).select("vector").scalar()
