"""Folders of incoming files: scan order and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.functions import text
from framefold.operators import chunkstore
from framefold.sources import folder


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, scan, content), hidden names included.  ``scan`` sorts top-level files first, then subfolder by subfolder."""
    return scanned(folder.with_content(folder.list_files(spark, root)))


def scanned(listed: DataFrame) -> DataFrame:
    nested = F.col("name").contains("/")
    top = F.when(nested, F.substring_index("name", "/", 1)).otherwise(F.lit(""))
    return listed.select("path", F.struct(nested.alias("nested"), top.alias("folder"), "name").alias("scan"),
                         *[c for c in ("size", "content") if c in listed.columns])


def read_payloads(files: DataFrame) -> DataFrame:
    """Add ``stem``, ``ext`` and ``payload`` by the naming convention.

    No extension or ``mzx``: legacy cipher under the stem.  ``mex``: current cipher under the stem, or under the
    hash inside a recycled name.  Anything else is raw.  Fewer than 16 bytes, or a failed decryption, is NULL.
    Keys are derived for ``mex`` files only.
    """
    named = (files.withColumn("stem", text.file_stem(F.col("path")))
             .withColumn("ext", F.lower(text.file_ext(F.col("path")))))
    recycled = text.recycled_hash(F.col("stem"))
    password = F.when(recycled != "", recycled).otherwise(F.col("stem"))
    keyed = named.withColumn("_key", chunkstore.chunk_key(F.when(F.col("ext") == "mex", password)))
    plain = (F.when(F.col("ext") == "mex", chunkstore.decrypt(F.col("content"), F.col("_key")))
             .when(F.col("ext").isin("", "mzx"), chunkstore.decrypt_legacy(F.col("content"), F.col("stem")))
             .otherwise(F.col("content")))
    return (keyed.withColumn("payload", plain)
            .withColumn("payload", F.when(F.length("payload") >= chunkstore.MIN_FILE_BYTES, F.col("payload")))
            .drop("_key", "content"))
