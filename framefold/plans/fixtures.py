"""Catalog, reviews and payloads derived from the given tables, each over its whole table.

``embeddings`` are the images, ``events`` the review log, ``documents`` the payloads of incoming files and
``labels`` says which of those are catalogued already.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.functions import clock
from framefold.functions.hashing import content_hash
from framefold.operators import reviews as review_fold
from framefold.session import materialize, shared_dir, spread_work

DIM = 64
SEED = "lamp"
NOW = "2024-03-01 12:00:00"
MAX_IMAGES = 450
BLOCK_ROWS = 256  # neighbour joins of the queries: many blocks at every given size
TREE = {"block_rows": BLOCK_ROWS, "dim": DIM, "broadcast_bytes": 0}  # queries that go through the pivots at every given size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_hash(number) -> F.Column:
    return content_hash(number.cast("string"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, vector, label) of every embedding."""
    return table(spark, sf_dir, "embeddings").select(
        id_hash(F.col("vec_id")).alias("hash"), F.col("embedding").alias("vector"), "label")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review events: purchases confirm, some errors delete a side, signups turn an image."""
    n = table(spark, sf_dir, "embeddings").agg(F.count("*")).scalar()
    k = F.get_json_object("props", "$.k").cast("long")
    numbered = table(spark, sf_dir, "events").filter("event_type <> 'click'").select("event_id", "ts", "event_type", k.alias("k"), n.alias("n"))
    action = (F.when(F.col("event_type") == "purchase", "confirm")
              .when((F.col("event_type") == "error") & (F.col("k") == 7), "delete_left")
              .when((F.col("event_type") == "error") & (F.col("k") == 8), "delete_right")
              .when(F.col("event_type") == "signup", "orient")
              .when(F.col("event_type") == "view", "offer"))
    return (numbered.withColumn("action", action)
            .select("event_id", "ts", "action",
                    id_hash(F.col("event_id") % F.col("n")).alias("hash_x"),
                    id_hash((F.col("event_id") * 31 + F.col("k")) % F.col("n")).alias("hash_y"),
                    (F.col("k") % 4 * 90).cast("int").alias("rotatemode"),
                    (F.col("k") % 3).cast("int").alias("flipmode")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_fold.confirm_edges(reviews(spark, sf_dir)).select("hash", "peer")


def _catalog_from(spark: SparkSession, sf_dir: str, folded: DataFrame) -> DataFrame:
    """Every image with its folded reviews; one never reviewed was seen up to 4,095 minutes before the first event."""
    first = table(spark, sf_dir, "events").agg(F.min("ts")).scalar()
    earlier = F.conv(F.substring(F.md5("hash"), 1, 3), 16, 10).cast("int")
    return (images(spark, sf_dir).join(folded, "hash", "left").withColumn("_first", first)
            .select("hash", F.lit(0).alias("rotatemode"), F.lit(0).alias("flipmode"),
                    F.coalesce("lastview", clock.minutes_before(F.col("_first"), earlier)).alias("lastview"),
                    F.coalesce("hist_len", F.lit(0)).cast("long").alias("hist_len"), "vector", "label"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog_from(spark, sf_dir, review_fold.fold_confirms(reviews(spark, sf_dir)))


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(catalog, edges) as written tables, for operators that read them more than once."""
    confirmed = materialize(review_fold.confirm_edges(reviews(spark, sf_dir)))
    folded = confirmed.groupBy("hash").agg(F.max("ts").alias("lastview"), F.count("*").alias("hist_len"))
    return materialize(_catalog_from(spark, sf_dir, folded)), confirmed.select("hash", "peer")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct content: (hash, content) from the bytes of the documents."""
    content = F.col("text").cast("binary")
    return (table(spark, sf_dir, "documents").select(content_hash(content).alias("hash"), content.alias("content"))
            .groupBy("hash").agg(F.first("content").alias("content")))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an import, one per document in id order.  English ones are named after their content."""
    text = F.col("text").cast("binary")
    stem = F.when(F.col("lang") == "en", content_hash(text)).otherwise(F.concat(F.lit("doc-"), F.col("doc_id")))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("raw/"), F.col("doc_id"), F.lit("/"), stem, F.lit(".txt")).alias("path"),
        F.col("doc_id").alias("scan"), stem.alias("stem"),
        F.when(F.length(text) >= 16, text).alias("payload"),
        (F.trim("text") != "").alias("decodable"))


def catalogued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, chunk_ok) of documents labelled as good: already in the catalog; toxic ones lost their chunk."""
    docs = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").filter(F.col("quality") == 1), "doc_id")
    return (docs.groupBy(content_hash(F.col("text")).alias("hash"))
            .agg((F.max("toxic") == 0).alias("chunk_ok")))


def as_pictures(payload: DataFrame) -> DataFrame:
    """(hash, content) shown as square pictures: the bytes, zero-padded to 3 * side * side."""
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.length("content") / 3)).cast("int"))
    padded = F.rpad(F.col("content"), side * side * 3, F.lit(b"\x00"))
    return spread_work(payload, "hash").select("hash", side.alias("height"), side.alias("width"),
                                               F.lit(3).alias("nChannels"), padded.alias("data"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct payload as a picture."""
    return as_pictures(payloads(spark, sf_dir))


def little_endian(number: F.Column) -> F.Column:
    """Four bytes of an integer, lowest first."""
    digits = F.right(F.lpad(F.hex(number.cast("long")), F.lit(16), F.lit("0")), F.lit(8))
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))


def bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, content): each payload as a 24-bit bitmap file, rows from the top; those whose hash starts with 0 are junk."""
    side = (F.greatest(F.lit(1), F.ceil(F.sqrt(F.length("content") / 3) / 4)) * 4).cast("int")
    size = side * side * 3
    head = F.concat(F.lit(b"BM"), little_endian(size + 54), little_endian(F.lit(0)), little_endian(F.lit(54)), little_endian(F.lit(40)),
                    little_endian(side), little_endian(-side), F.unhex(F.lit("01001800")), little_endian(F.lit(0)), little_endian(size),
                    *[little_endian(F.lit(0))] * 4)
    body = F.rpad(F.col("content"), size, F.lit(b"\x00"))
    return payloads(spark, sf_dir).select(
        F.concat(F.substring("hash", 1, 1), F.lit("/"), F.col("hash"), F.lit(".bmp")).alias("name"),
        F.when(F.col("hash").startswith("0"), F.col("content")).otherwise(F.concat(head, body)).alias("content"))


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
