"""Versions of a catalog in hash buckets.

A version is a folder with the buckets that its batch wrote and a manifest, published last, that names for every bucket the
versions its rows are in.  A batch of reviews rewrites the buckets it touches, an import adds rows to them; every other
bucket is taken over by name.  What was written is never changed, so a repeated batch gives the same version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framefold import schemas

TABLES = {"catalog": schemas.CATALOG, "edges": schemas.EDGES}
MANIFEST = "table string, bucket string, version long"


def bucket_of(hash_: Column | str) -> Column:
    """The first two characters of the hash: at most 1,024 buckets."""
    return F.substring(hash_, 1, 2)


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v{version:08d}"


def _manifest(spark: SparkSession, root: str, version: int) -> list[tuple[str, str, int]]:
    rows = spark.read.schema(MANIFEST).parquet(f"{version_path(root, version)}/manifest").collect()
    return [(r["table"], r["bucket"], r["version"]) for r in rows]


def read_version(spark: SparkSession, root: str, version: int, buckets: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalog, edges) of a version; of the given ``buckets`` alone if there are any given."""
    held = _manifest(spark, root, version)

    def table(name: str) -> DataFrame:
        paths = [f"{version_path(root, v)}/{name}/bucket={b}" for t, b, v in held if t == name and (buckets is None or b in buckets)]
        return spark.read.schema(TABLES[name]).parquet(*paths) if paths else spark.createDataFrame([], TABLES[name])

    return table("catalog"), table("edges")


def write_version(catalog: DataFrame | None, edges: DataFrame | None, root: str, version: int, touched: set[str] | None = None,
                  adds: bool = False, **more: DataFrame) -> None:
    """Write a version: all rows, or with ``touched`` the rows of these buckets, or with ``adds`` rows that are new.

    None leaves a table as it was.  Skewed buckets are split over several files.  ``commit`` is written last, and a
    version without it is not complete.
    """
    spark = next(x for x in (catalog, edges) if x is not None).sparkSession
    path = version_path(root, version)
    before = _manifest(spark, root, version - 1) if touched is not None or adds else []
    rows = []
    for name, table in (("edges", edges), ("catalog", catalog)):
        kept = [(t, b, v) for t, b, v in before if t == name]
        if table is not None:
            bucketed = table.select(*TABLES[name].names, bucket_of("hash").alias("bucket")).hint("rebalance", "bucket")
            bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
            shape = T.StructType([*TABLES[name].fields, T.StructField("bucket", T.StringType())])
            written = spark.read.schema(shape).parquet(f"{path}/{name}").select("bucket").distinct().collect()
            kept = kept if adds else [(t, b, v) for t, b, v in kept if b not in touched]
            rows += [(name, r["bucket"], version) for r in written]
        rows += kept
    for name, table in more.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    spark.range(version, version + 1).write.mode("overwrite").parquet(f"{path}/commit")


def touched_buckets(events: DataFrame) -> set[str]:
    """Buckets of all images that a batch of reviews names."""
    both = events.select(F.explode(F.array("hash_x", "hash_y")).alias("hash")).filter(F.col("hash").isNotNull())
    return {r["b"] for r in both.select(bucket_of("hash").alias("b")).distinct().collect()}
