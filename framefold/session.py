"""Session settings and the helpers every operator shares: cutting lineage and joining around hot keys."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARES of the rows, so there are fewer than HOT_SHARES of them.
HOT_SHARES = 100


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and benchmarks; on a cluster the submitter's own settings are used instead."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")  # tasks are the parallelism, as Spark sets it on executors
    builder = (
        SparkSession.builder.master(master).appName("framefold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Only a session inside one JVM (tests, benchmarks) may leave it unset and gets a fresh temporary one; on a cluster
    every executor would see a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not f"{spark.sparkContext.master}[".startswith("local["):  # local or local[n], not local-cluster[...]
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framefold-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


_scopes: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end, unless they are ``lasting``.

    For callers that write a result inside: what is derived from such a table can't be read afterwards.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    The written table survives lost executors, and unlike a checkpointed RDD it still prunes columns.  Inside
    ``temporary_tables`` a ``lasting`` one belongs to the scope around it, if there is one.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    owner = _scopes[:-1] if lasting else _scopes
    if owner:
        owner[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialize``, and the number of rows, observed while they are written."""
    watched = Observation()
    table = materialize(df.observe(watched, F.count(F.lit(1)).alias("rows")))
    return table, watched.get.get("rows", 0)


def hot_keys(left: DataFrame, on: str) -> dict:
    """Keys with more than 1/HOT_SHARES of the rows, and over how many salts to deal each: its share of two rounds of tasks.

    One job: the total is observed while the keys are counted.  There are fewer than HOT_SHARES such keys, whatever
    the table's size.
    """
    watched = Observation()
    counts = left.groupBy(on).agg(F.count("*").alias("_n")).observe(watched, F.sum("_n").alias("total"))
    top = counts.orderBy(F.desc("_n")).limit(HOT_SHARES).collect()
    total, tasks = watched.get["total"] or 0, 2 * work_partitions(left.sparkSession)
    return {r[on]: math.ceil(tasks * r["_n"] / total) for r in top if r["_n"] > total / HOT_SHARES and r[on] is not None}


def spread_join(left: DataFrame, right: DataFrame, on: str, spread_by: str, how: str = "left", hot: dict | None = None) -> DataFrame:
    """Join where ``left`` may hold a hot key and ``right`` has at most one row per key.

    Only hot keys are salted: their left rows are dealt over as many salts as their share asks for by ``spread_by``, and
    their single right row is repeated that often.  ``hot`` has the hot keys if they are known already.
    """
    if hot is None:
        hot = hot_keys(left, on)
    if not hot:
        return left.join(right, on, how)
    salts = F.coalesce(F.create_map(*(F.lit(x) for pair in hot.items() for x in pair))[F.col(on)], F.lit(1))
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted_left.join(salted_right, [on, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds the row's position from 0 in the order of ``by`` without a one-task window.

    Rows are written in ranges of ``by``; the ranges' sizes (one number each) are summed up and added to the position
    inside the range.
    """
    ranged = df.repartitionByRange(work_partitions(df.sparkSession), *by).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1
    return ranged.withColumn("_own", own).join(starts, "_range").withColumn(name, F.col("_start") + F.col("_own")).select(*df.columns, name)


def one_thread_per_task(spark: SparkSession) -> None:
    """Matrix products of Python tasks take one thread each, from the next function on.

    Spark allows every worker as many threads as its executor has cores, so that with several tasks at a time they wait for
    each other, spinning.  Tasks are the parallelism here.
    """
    for name in ("OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        spark.sparkContext.environment[name] = "1"


def work_partitions(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_work(df: DataFrame, key: str, waves: int = 1) -> DataFrame:
    """Spread rows over all cores for CPU-bound work, in at least ``waves`` tasks a core.

    The partition count is given and the key is hashed once more, so neither AQE's coalescing nor an earlier
    grouping by the same key can undo it.  Where a row takes long, several tasks a core keep a slow core from holding
    up the others.
    """
    spark = df.sparkSession
    return df.repartition(max(work_partitions(spark), waves * spark.sparkContext.defaultParallelism), F.xxhash64(key))
