"""Joins that deal hot keys, tables that pass away, spare names."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakesearch.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("counted", [False, True])
def test_spread_join_equals_the_plain_join(spark, monkeypatch, how, counted):
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    monkeypatch.setattr(common, "HOT_PARTS", 10)
    rows = [(7, i) for i in range(300)] + [(8, i) for i in range(200)] + [(i, i) for i in range(100)] + [(None, 1), (None, 2)]
    left = common.materialize(spark.createDataFrame(rows, "k long, parts long"), "left")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(5, 60)], "k long, place string")
    counts = left.groupBy("k").agg(F.count("*").alias("n")) if counted else None
    got = common.spread_join(left, right, "k", how, counts=counts)
    assert got.columns == ["k", "parts", "place"]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, "k", how).collect()))
    assert common.spread_join(left.limit(0), right, "k", how).count() == 0
    # Each row of a hot key meets its copy of the right row in a part of its own.
    plan = got._jdf.queryExecution().toString()
    assert "pmod" in plan


def test_passing_tables(spark):
    with common.passing(spark):
        gone = common.materialize(spark.range(3), "gone")
        left = common.kept(common.materialize(gone.withColumn("x", F.lit(1)), "left"))
        at = gone.lakesearch_path.removeprefix("file://")
        assert os.path.isdir(at)
    assert not os.path.isdir(at) and left.count() == 3
    common.release(left)
    assert not os.path.isdir(left.lakesearch_path.removeprefix("file://"))


def test_spare_names(spark):
    df = spark.createDataFrame([(1, 2)], "nth int, NTH_ int")
    assert common.spare(df, "nth") == "nth__" and common.spare(df, "other") == "other"


def test_smaller_batches_of_a_session_stay(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(rows), spark.conf.get(size)
    for given, want in ((("100", "1m"), ("100", "1m")), (("10000", "64MB"), (str(common.BATCH_ROWS), str(common.BATCH_BYTES)))):
        spark.conf.set(rows, given[0])
        spark.conf.set(size, given[1])
        common.small_batches(spark)
        assert (spark.conf.get(rows), spark.conf.get(size).rstrip("b")) == want
    spark.conf.set(rows, was[0])
    spark.conf.set(size, was[1])
