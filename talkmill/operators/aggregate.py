"""Grouped statistics: distributions, crosstabs, ordered texts, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.operators.ordering import exact_quantiles


def domain_table(df: DataFrame, name: str, values: list) -> DataFrame:
    """A fixed domain as a table with its order."""
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, ord int")


def value_counts(df: DataFrame, column: str, domain: list[str] | None = None, missing: str | None = None) -> DataFrame:
    """(value, n, share); values of a fixed domain appear with 0; null counts as ``missing``, if given, else not."""
    value = F.coalesce(F.col(column), F.lit(missing)) if missing is not None else F.col(column)
    counts = df.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    if domain is not None:
        counts = domain_table(df, "value", domain).drop("ord").join(counts, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.nullif("total", F.lit(0))).alias("share"))


def distributions(tables: dict[str, DataFrame], column: str, domain: list[str]) -> DataFrame:
    """(column, n_{name}, share_{name}): how several versions spread over a fixed domain; shares of the values that are in it."""
    long = reduce(DataFrame.union, [df.select(F.lit(name).alias("_v"), F.col(column).alias(column)) for name, df in tables.items()])
    counts = long.where(F.col(column).isin(domain)).groupBy(column).agg(*[F.count_if(F.col("_v") == n).alias(f"n_{n}") for n in tables])
    out = domain_table(long, column, domain).join(F.broadcast(counts), column, "left").na.fill(0, [f"n_{n}" for n in tables])
    totals = counts.agg(*[F.sum(f"n_{n}").alias(f"_t_{n}") for n in tables])
    out = out.crossJoin(F.broadcast(totals)).orderBy("ord")
    return out.select(column, *[f"n_{n}" for n in tables], *[(F.col(f"n_{n}") / F.nullif(f"_t_{n}", F.lit(0))).alias(f"share_{n}") for n in tables])


def crosstab(df: DataFrame, row: str, column: str, columns: list[str], margins: bool = False) -> DataFrame:
    """Counts of row by column over a fixed column domain; with ``margins`` a row and a column 'ALL'."""
    counts = [F.count_if(F.col(column) == c).cast("long").alias(c) for c in columns]
    if not margins:
        return df.groupBy(row).agg(*counts)
    out = df.groupingSets([[row], []], row).agg(F.grouping(row).alias("_all"), *counts, F.count("*").alias("ALL"))
    return out.withColumn(row, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(row).cast("string"))).drop("_all")


def mean_std(df: DataFrame, keys: list[str], metrics: list[str], scope: str) -> DataFrame:
    """{scope}_{metric}_mean and _std (sample; one row or none gives 0), and {scope}_n_utt."""
    aggs = [F.count("*").alias(f"{scope}_n_utt")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{scope}_{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{scope}_{m}_std")]
    return df.groupBy(*keys).agg(*aggs)


def ordered_concat(df: DataFrame, keys: list[str], order: str, line: Column, separator: str, name: str) -> DataFrame:
    """Lines of a group joined in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["line"]), separator).alias(name))


def smallest_mode(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """The most frequent value of each group, ties to the smallest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    best = F.min_by(column, F.struct(-F.col("_n"), F.col(column)))
    return counts.groupBy(*keys).agg(best.alias(name))


def quantiles(df: DataFrame, keys: list[str], column: str, shares: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column each."""
    return exact_quantiles(df, keys, column, {f"q{round(q * 100)}": q for q in shares})


def summary(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    out = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.crossJoin(F.broadcast(exact_quantiles(df, [], column, {"median": 0.5}))).select("n", "mean", "std", "min", "median", "max")


def transitions(df: DataFrame, old: str, new: str) -> DataFrame:
    """(old, new, n) of rows that changed."""
    return df.where(F.col(old) != F.col(new)).groupBy(F.col(old).alias("old"), F.col(new).alias("new")).agg(F.count("*").alias("n"))


def distinct_across(columns: list[str]) -> Column:
    """How many different values a row has in these columns, nulls aside."""
    return F.size(F.array_distinct(F.array_compact(F.array(*columns))))


def bucket_rates(df: DataFrame, score: str, event: Column) -> DataFrame:
    return df.groupBy(score).agg(F.count("*").alias("n"), F.sum(event.cast("int")).alias("n_event"), F.avg(event.cast("int")).alias("rate"))
