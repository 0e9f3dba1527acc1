"""Labelling as a stream: new request files are answered once, with checkpoints.

Replaces a polling loop around a remote batch service. Each micro-batch asks the
provider, writes responses and errors under the batch's number (so a replayed
batch overwrites itself), and stops when all files that are there are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.operators.batching import dead_letters
from talkmill.sources.provider import Provider, label

REQUESTS = "custom_id string, prompt string, tokens int"


def run_available(spark: SparkSession, requests_folder: str, out: str, provider: Provider, files_a_batch: int = 1, parallel: int = 4) -> int:
    """Answer all request files (JSON lines) that are there; returns the number of micro-batches."""

    def one(batch: DataFrame, number: int) -> None:
        answered = label(batch, provider, parallel).withColumn("batch", F.lit(number))
        answered.write.mode("overwrite").parquet(f"{out}/responses/part={number}")

    source = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_a_batch).json(requests_folder)
    stream = source.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return stream.lastProgress["batchId"] + 1 if stream.lastProgress else 0


def responses(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/responses").drop("part")


def lost(spark: SparkSession, requests: DataFrame, out: str) -> DataFrame:
    """Requests without a response, and why."""
    got = responses(spark, out)
    return dead_letters(requests, got.where("response is not null"), got.where("response is null"), "custom_id")


def windowed_accuracy(events: DataFrame, at: str, gold: str, pred: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Accuracy by event-time window of a stream of judged predictions."""
    hit = F.coalesce(F.col(gold) == F.col(pred), F.lit(False)).cast("int")
    return events.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy")).select("window.start", "n", "accuracy")
