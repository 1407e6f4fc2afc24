import os

import pytest
from pyspark.sql import functions as F

from framefold.session import hot_keys, materialize, numbered, shared_dir, spread_join, spread_work, temporary_tables


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_equals_join_with_a_hot_key(spark, how):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                    .when(F.col("id") % 50 == 1, F.lit(None))
                                    .otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"))
    right = spark.range(0, 700, 2).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("v"))
    right = right.unionByName(spark.range(1).select(F.lit("hot").alias("key"), F.lit(-1).cast("long").alias("v")))
    salted = spread_join(left, right, "key", "id", how)
    plain = left.join(right, "key", how).select(*salted.columns)
    assert 1 < hot_keys(left, "key")["hot"] < 16
    assert salted.count() == plain.count()
    assert salted.exceptAll(plain).isEmpty()


def test_materialize_writes_into_the_shared_folder(spark):
    folder = shared_dir(spark).removeprefix("file:")
    assert folder == spark.conf.get("spark.checkpoint.dir", folder).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    df = materialize(spark.range(10).withColumn("s", F.lit("x")))
    assert df.count() == 10 and df.columns == ["id", "s"]
    new = set(os.listdir(folder)) - before
    assert len(new) == 1 and new.pop().startswith("table-")
    assert "ReadSchema: struct<id:bigint>" in df.select("id")._jdf.queryExecution().toString()


def test_spread_work_survives_an_earlier_grouping(spark):
    grouped = spark.range(1000).groupBy("id").count()
    assert spread_work(grouped, "id").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_numbered_is_the_global_order(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), F.lit("x").alias("s")).repartition(7)
    rows = numbered(df, ["v"], "at").collect()
    assert len(rows) == 500 and all(r["at"] == r["v"] for r in rows)
    assert numbered(df.limit(0), ["v"], "at").count() == 0


def test_temporary_tables_go_and_lasting_ones_stay(spark):
    def there():
        return {x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x.startswith("table-")}

    before = there()
    with temporary_tables(spark):
        materialize(spark.range(3))
        kept = materialize(spark.range(5), lasting=True)
        assert len(there() - before) == 2
    assert len(there() - before) == 1 and kept.count() == 5
