from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from talkmill.operators import governance, observed


def table(spark):
    return spark.range(1000).select("id", F.when(F.col("id") % 7 != 0, F.col("id")).alias("a"), F.when(F.col("id") % 3 == 0, "x").alias("b"))


def test_counts_of_a_write_equal_a_second_scan(spark, tmp_path):
    rows, counts = observed.counted(table(spark), observed.missing(["a", "b"]))
    rows.write.parquet(str(tmp_path / "out"))
    want = sorted(map(tuple, governance.missing_report(spark.read.parquet(str(tmp_path / "out")), ["a", "b"]).collect()))
    assert sorted(observed.report(counts())) == want and counts()["_rows"] == 1000


def test_excluded_and_failed_rows_and_null_conditions(spark):
    df = table(spark)
    rows, counts = observed.counted(df, {"excluded": F.col("id") < 10, "null": F.col("a") > 5})
    rows.write.format("noop").mode("overwrite").save()
    assert counts() == {"_rows": 1000, "excluded": 10, "null": df.where("a > 5").count()}
    rows, counts = observed.counted(df.where("false"), {"any": F.lit(True)})
    rows.write.format("noop").mode("overwrite").save()
    assert counts() == {"_rows": 0, "any": 0} and observed.report(counts()) == [("any", 0, None)]
    with pytest.raises(ValueError, match="counts all rows"):
        observed.counted(df, {"_rows": F.lit(True)})


def test_stream_counts_over_a_restart(spark, tmp_path):
    listeners = []
    for lot in range(2):
        table(spark).where(F.col("id") % 2 == lot).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, a long, b string").parquet(str(tmp_path / "in"))
        rows, counts = observed.counted_stream(stream, observed.missing(["a", "b"]), "watched")
        spark.streams.addListener(counts)
        listeners.append(counts)
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        for _ in range(100):  # listeners hear of batches a little later
            if counts.totals():
                break
            time.sleep(0.1)
        spark.streams.removeListener(counts)
    total = {k: sum(c.totals().get(k, 0) for c in listeners) for k in ("_rows", "a", "b")}
    want = {name: n for name, n, _ in governance.missing_report(spark.read.parquet(str(tmp_path / "out")), ["a", "b"]).collect()}
    assert total == {"_rows": 1000} | want
