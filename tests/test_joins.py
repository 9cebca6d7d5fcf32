"""The lookup join in its three forms."""

import pytest
from pyspark.sql import functions as F

import laneward.operators.joins as joins


@pytest.mark.parametrize("broadcast_rows,hot_rows", [(100, 100), (1, 10_000), (1, 50)])
def test_lookup_join(spark, monkeypatch, broadcast_rows, hot_rows):
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(joins, "is_small", lambda df, limit=broadcast_rows: df.limit(limit + 1).count() <= limit)
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 > 0, F.col("id") % 40)  # the rest are null
    rows = spark.range(3000).select("id", key.cast("int").alias("k"))
    table = spark.range(30).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    got = {r.id: (r.k, r.v) for r in joins.lookup_join(rows, table, "k", F.col("id")).collect()}
    assert got == {r.id: (r.k, r.k * 10 if r.k is not None and r.k < 30 else None) for r in rows.collect()}


def test_long_table_is_never_broadcast(spark):
    """Spark takes both tables for a few MB, by an explode that it thinks adds nothing; counted they are long."""
    rows = spark.range(10).withColumn("k", F.col("id"))
    table = spark.range(1000).withColumn("k", F.explode(F.sequence(F.col("id") * 200, F.col("id") * 200 + 199))).drop("id")
    joined = joins.lookup_join(rows, table.withColumn("v", F.col("k") + 1), "k", F.col("id"))
    # only the list of hot keys, an empty one, is broadcast: to the rows and to the table
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 2, plan
    assert [(r.id, r.v) for r in joined.orderBy("id").collect()] == [(n, n + 1) for n in range(10)]
