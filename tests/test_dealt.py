"""Checked joins of large tables: as many tasks as the rows need."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from talkmill.operators import joins
from talkmill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("query", "table"), [("left_join_composite", "lineitem"), ("checked_join", "orders")])
def test_tasks_grow_with_the_rows(spark, monkeypatch, query, table):
    monkeypatch.setattr(joins, "ROWS_A_TASK", 100)
    out = catalog.QUERIES[query](spark, SF)
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert len(sizes) > 0.8 * rows / 100 and max(sizes) < 300


def test_empty_sides(spark):
    a, b = spark.createDataFrame([], "k long, x long"), spark.createDataFrame([(1, 2)], "k long, y long")
    a, b = joins.dealt(a.count(), ["k"], a, b)
    assert joins.checked_left_join(a, b, ["k"]).collect() == []
