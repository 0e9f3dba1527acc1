"""Join patterns of the pipeline, with checks where rows must not be lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of the larger side that a task groups, sorts and joins.
ROWS_A_TASK = 250_000


def dealt(rows: int, keys: list[str], *sides: DataFrame) -> list[DataFrame]:
    """``sides`` in the same partitions by ``keys``, as many as ``rows`` ask for; groupings and joins by ``keys`` then shuffle no more.

    A task's memory so stays the same however many rows there are. For keys of few rows each: nothing is added up before the shuffle.
    """
    parts = max(1, -(-rows // ROWS_A_TASK))
    return [side.repartition(parts, *keys) for side in sides]


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first by ``order`` (which must decide ties)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def lookup_with_default(rows: DataFrame, table: DataFrame, key: str, default: str) -> DataFrame:
    """Join a lookup table; keys it doesn't have get its ``default`` row."""
    values = [c for c in table.columns if c != key]
    fallback = table.where(F.col(key) == default).select(F.lit(1).alias("_one"), *[F.col(c).alias(f"_{c}") for c in values])
    out = rows.withColumn("_one", F.lit(1)).join(table, key, "left").join(F.broadcast(fallback), "_one", "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in values}).drop("_one", *[f"_{c}" for c in values])


def accumulate_outer(parts: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Full outer join of many (key, value) tables as one pivot: a single shuffle."""
    long = reduce(DataFrame.union, [df.select(key, F.lit(name).alias("_part"), F.col(value).alias("_value")) for name, df in parts.items()])
    return long.groupBy(key).pivot("_part", list(parts)).agg(F.max("_value"))


def suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_A", "_B"), how: str = "inner") -> DataFrame:
    """Join two tables of the same columns; columns beside the keys get a suffix."""
    tag = lambda df, s: df.select(*keys, *[F.col(c).alias(c + s) for c in df.columns if c not in keys])
    return tag(left, suffixes[0]).join(tag(right, suffixes[1]), keys, how)


def paired(rows: DataFrame, keys: list[str], by: str, a: str, b: str, value: str) -> DataFrame:
    """(keys, value_a, value_b) of two conditions side by side; one shuffle instead of a self-join."""
    pick = lambda name: F.max(F.when(F.col(by) == name, F.col(value)))
    here = lambda name: F.max((F.col(by) == name).cast("int"))
    out = rows.where(F.col(by).isin(a, b)).groupBy(*keys).agg(pick(a).alias(f"{value}_a"), pick(b).alias(f"{value}_b"), here(a).alias("_a"), here(b).alias("_b"))
    return out.where("_a = 1 and _b = 1").drop("_a", "_b")


def checked_left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that fails if the right side has a key twice (rows would multiply)."""
    counted = right.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    guard = F.when(F.col("_copies") > 1, F.raise_error(F.lit("right side has a key twice")).cast("boolean")).otherwise(F.lit(True))
    return left.join(counted.where(guard).drop("_copies"), keys, "left")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts of ids in both, only in a, only in b; equal sets have 0 in the last two."""
    ids = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    both, only_a, only_b = F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col("_b").isNull(), F.col("_a").isNull()
    return ids.agg(F.count_if(both).alias("n_both"), F.count_if(only_a).alias("n_only_a"), F.count_if(only_b).alias("n_only_b"))


def overlay(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``patch`` in place of those of ``base`` with the same keys; the rest stays."""
    return base.join(patch.select(*keys).distinct(), keys, "left_anti").unionByName(patch, allowMissingColumns=True)


def in_order(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the listed ids in the list's order; ``ids``: (key, pos)."""
    return rows.join(ids, key).orderBy("pos")


def reattach(answers: DataFrame, requests: DataFrame, key: str = "custom_id") -> DataFrame:
    """Every request with its answer's columns; requests without an answer stay, answers of unknown requests go."""
    extra = [c for c in answers.columns if c == key or c not in requests.columns]
    return checked_left_join(requests, answers.select(*extra), [key])


def assert_same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The counts of :func:`same_ids`; the job fails where the two id sets differ."""
    out = same_ids(a, b, key)
    equal = (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0)
    return out.withColumn("n_both", F.when(equal, F.col("n_both")).otherwise(F.raise_error(F.lit("the id sets differ")).cast("long")))


def columns_ending(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]
