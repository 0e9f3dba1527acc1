"""The driver's star-schema tables as the logical tables of a call-centre study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ["refund_request", "exchange_return", "order_cancel", "purchase_help", "complaint", "service_use", "delivery_check"]
FOCUS = "complaint"
CONDITIONS = ("A", "B", "C", "D")
SIZES = (1, 2, 3, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, dialog_idx, speaker_type, is_customer, text, duration; the system role is on the agent's side."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("call_id"),
        F.col("turn").alias("dialog_idx"),
        F.col("role").alias("speaker_type"),
        (F.col("role") == "user").alias("is_customer"),
        "text",
        (F.length("text") / 15.0).alias("duration"),
    )


def _pick(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), i.cast("int") + 1)


def _prediction(n: Column, i: Column) -> Column:
    gold, key = F.col("o_custkey") % 7, F.col("o_orderkey")
    wrong = (key * 31 + n * 17 + i * 7) % 10 < 6 - n
    return F.when((key + i) % 97 == 0, None).otherwise(_pick(F.when(wrong, (gold + 1 + (key + n) % 6) % 7).otherwise(gold)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, gold, condition, n, pred: 16 predictions of every order, some missing."""
    cells = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, c in enumerate(CONDITIONS) for n in SIZES])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(cells).alias("cell")).select("o_orderkey", "o_custkey", "cell.*")
    return rows.select(F.col("o_orderkey").alias("call_id"), _pick(F.col("o_custkey") % 7).alias("gold"), "condition", "n", _prediction(F.col("n"), F.col("i")).alias("pred"))


def wide_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, gold, a1, a2, ... d5, tokens, segment: one row an order, no shuffle."""
    named = {f"{c.lower()}{n}": _prediction(F.lit(n), F.lit(i)) for i, c in enumerate(CONDITIONS) for n in SIZES}
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        F.col("o_orderkey").alias("call_id"), _pick(F.col("o_custkey") % 7).alias("gold"), *[v.alias(k) for k, v in named.items()], (F.col("o_custkey") % 50 + F.col("o_orderkey") % 13).alias("tokens"), F.col("o_orderpriority").alias("segment"), ((F.col("o_orderkey") * 37 % 100) / 100.0).alias("proba")
    )


def acoustic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, dialog_idx, gender, x, k: a numeric feature of every event, in order of time within its user."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("dialog_idx"), F.col("event_type").alias("gender"), F.col("value").alias("x"), k.alias("k"))
