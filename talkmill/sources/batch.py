"""A remote batch service: submit request files, poll, read output and error files, rejoin.

Files and states are few (one a chunk) and the driver's business; requests and answers
are tables and stay on executors. An answer may be in the output file, in the error
file, or in neither: every request comes back with one of the three.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.operators.joins import reattach

#: States in which a batch doesn't change any more.
FINAL = ("completed", "failed", "expired", "cancelled")

OUTPUT = "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>, error struct<message:string>"


class BatchService(Protocol):
    """What a remote service offers. Paths are of files that executors can read; null: there is none."""

    def submit(self, requests: str) -> str: ...

    def status(self, batch: str) -> str: ...

    def output_file(self, batch: str) -> str | None: ...

    def error_file(self, batch: str) -> str | None: ...


def poll(service: BatchService, batches: list[str], wait: float = 60.0, most: int = 1440, sleep: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """State of every batch once all are final; those that aren't after ``most`` rounds keep their last state."""
    states: dict[str, str] = {}
    for turn in range(most):
        for batch in batches:
            if states.get(batch) not in FINAL:
                states[batch] = service.status(batch)
        if all(states[b] in FINAL for b in batches):
            break
        if turn + 1 < most:
            sleep(wait)
    return states


def _lines(spark: SparkSession, paths: list[tuple[int, str]]) -> DataFrame:
    """Parsed lines of a few files, each with the number of its batch."""
    raw = spark.createDataFrame([], "value string, nth int")
    for nth, path in paths:
        raw = raw.union(spark.read.text(path).withColumn("nth", F.lit(nth)))
    return raw.select("nth", F.from_json("value", OUTPUT).alias("r")).where("r.custom_id is not null")


def collect_answers(spark: SparkSession, service: BatchService, batches: list[str]) -> DataFrame:
    """(custom_id, response, error) of both files of all batches, oldest first; lines that aren't JSON are left to be found lost.

    A request that failed in one batch and was answered in another counts as answered; of several answers or
    errors that of the newest batch counts, and of one batch's the smallest text.
    """
    paths = {kind: [(nth, p) for nth, b in enumerate(batches) if (p := getattr(service, kind)(b))] for kind in ("output_file", "error_file")}
    content = F.get("r.response.body.choices", F.lit(0))["message"]["content"]
    ok = F.coalesce(F.col("r.response.status_code"), F.lit(200)) == 200
    good = _lines(spark, paths["output_file"]).select("nth", "r.custom_id", F.when(ok, content).alias("response"), F.coalesce("r.error.message", F.when(~ok, F.concat(F.lit("status "), "r.response.status_code"))).alias("error"))
    status = F.coalesce(F.concat(F.lit("status "), "r.response.status_code"), F.lit("listed in the error file"))
    bad = _lines(spark, paths["error_file"]).select("nth", "r.custom_id", F.lit(None).cast("string").alias("response"), F.coalesce("r.error.message", status).alias("error"))
    both = good.unionByName(bad).groupBy("custom_id").agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col("nth")).alias("nth"), c)))[c].alias(c) for c in ("response", "error")])
    return both.withColumn("error", F.when(F.col("response").isNull(), F.coalesce("error", F.lit("empty response"))))


def answered(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Every request with its metadata, response and error; one without either is 'silently lost'."""
    lost = F.col("response").isNull() & F.col("error").isNull()
    return reattach(answers, requests).withColumn("error", F.when(lost, F.lit("silently lost")).otherwise(F.col("error")))
