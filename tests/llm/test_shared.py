from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.llm.shared import discard, in_ranges, join_per_key, row_key, small, table, tune


@pytest.mark.parametrize("partitions", [1, 2, 7, 60])
@pytest.mark.parametrize("key", ["id", "case when id < 400 then 7 when id < 450 then null else id end", "cast(null as bigint)", "5L"])
def test_ranges_are_in_order(spark, partitions, key):
    df = spark.range(1000).select(F.expr(key).cast("long").alias("k"), F.xxhash64("id").alias("t"))
    out = in_ranges(df, "k", "t", partitions)
    rows = [(r["k"] is not None, r["k"] or 0, r["t"]) for r in out.collect()]
    assert rows == sorted(rows) and len(rows) == 1000
    assert out.columns == ["k", "t"]


def test_hot_key_is_spread(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("t"))
    sizes = in_ranges(df, "k", "t", 20).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 3 * 4000 / 20


def test_null_keys_are_spread(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), F.xxhash64("id").alias("t"))
    out = in_ranges(df, "k", "t", 12)
    sizes = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 2 * 4000 / 12
    rows = [(r["k"] is not None, r["k"] or 0, r["t"]) for r in out.collect()]
    assert rows == sorted(rows)


def test_join_per_key_spreads_heavy_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    per_key = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    out = join_per_key(rows, per_key, "k", "n")
    assert sorted((r["k"], r["id"], r["least"]) for r in out.collect()) == sorted((0 if i % 3 == 0 else i, i, 0 if i % 3 == 0 else i) for i in range(3000))
    assert out.count() == 3000 and join_per_key(rows.limit(0), per_key.limit(0), "k", "n").count() == 0


def test_discarded_tables_are_gone(spark):
    import glob

    kept = table(spark.range(10), "t")
    folder = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    assert glob.glob(folder)
    discard(kept)
    assert not glob.glob(folder)


def test_ranges_of_nothing(spark):
    df = spark.range(0).select(F.col("id").alias("k"), F.col("id").alias("t"))
    assert in_ranges(df, "k", "t", 4).count() == 0


def test_row_key_tells_nulls_apart(spark):
    rows = [(None, None), (0, None), (None, ""), (0, ""), (1, "a")]
    df = spark.createDataFrame(rows, "d long, t string")
    assert df.select(row_key("d", "t")).distinct().count() == len(rows)


def test_small_and_table(spark):
    tune(spark)
    df = spark.range(10)
    assert "broadcast" in small(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small(df, 9)._jdf.queryExecution().logical().toString().lower()
    assert table(df, "t").count() == 10
