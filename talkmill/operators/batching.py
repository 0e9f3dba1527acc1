"""Chunk states of remote jobs: admission, recovery, dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def admit(chunks: DataFrame, ceiling: int, in_flight: int = 0) -> DataFrame:
    """Pending chunks to submit now: the longest prefix, by index, that fits under the ceiling.

    ``chunks``: index, n_tokens, status; chunk tables are small (one row for 200k tokens).
    """
    w = Window.partitionBy().orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.where(F.col("status") == "pending").withColumn("running", F.sum("n_tokens").over(w)).where(F.col("running") <= ceiling - in_flight)


def admit_one(chunks: DataFrame) -> DataFrame:
    """One chunk at a time: the first pending one, if none is on its way."""
    busy = chunks.where(F.col("status") == "submitted").select(F.lit(1).alias("x")).limit(1)
    return chunks.where(F.col("status") == "pending").orderBy("index").limit(1).join(busy, F.lit(True), "left_anti")


def advance(chunks: DataFrame, events: DataFrame, max_retries: int = 2) -> DataFrame:
    """New states from (index, outcome): completed, or failed (again pending until retries run out)."""
    out = chunks.join(events.select("index", "outcome"), "index", "left")
    failed = F.col("outcome") == "failed"
    retries = F.col("retries") + F.coalesce(failed.cast("int"), F.lit(0))
    status = F.when(F.col("outcome") == "completed", "completed").when(failed & (retries > max_retries), "failed_permanent").when(failed, "pending").when(F.col("outcome") == "submitted", "submitted").otherwise(F.col("status"))
    return out.withColumns({"status": status, "retries": retries}).drop("outcome")


def latest_batch(batches: DataFrame, key: str = "index", at: str = "created_at") -> DataFrame:
    """The newest batch of each chunk: local state reconciled with the server's list."""
    rest = [c for c in batches.columns if c != key]
    return batches.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("b")).select(key, "b.*")


def dead_letters(requested: DataFrame, answered: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Requests without an answer: listed in the error file, or lost silently."""
    missing = requested.select(key).join(answered.select(key), key, "left_anti")
    return missing.join(failed.select(key, F.lit("error_file").alias("_r")).distinct(), key, "left").select(key, F.coalesce("_r", F.lit("silently_lost")).alias("reason"))


def still_to_do(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
