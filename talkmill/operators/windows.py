"""Utterance ranks, first-N pools, the window grid, normalisation and levels."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.nulls import ratio
from talkmill.operators.aggregate import smallest_mode
from talkmill.operators.ordering import exact_quantiles
from talkmill.operators.policy import mean_of_present

SIZES = (1, 2, 3, 5)
VERSIONS = ("customer_only", "all")


def add_ranks(utterances: DataFrame, call: str = "call_id", order: str = "dialog_idx", customer: str = "is_customer", other: int | None = -1) -> DataFrame:
    """overall_rank counts all utterances of a call, customer_rank the customer's (others: ``other``)."""
    w = Window.partitionBy(call).orderBy(order)
    so_far = F.sum(F.col(customer).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return utterances.withColumns({"overall_rank": F.row_number().over(w), "customer_rank": F.when(F.col(customer), so_far).otherwise(F.lit(other).cast("int"))})


def first_n_pool(ranked: DataFrame, n: int = 5) -> DataFrame:
    return ranked.where((F.col("overall_rank") <= n) | F.col("customer_rank").between(1, n))


def expand_windows(pool: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """One row for each grid cell (window_n, window_version) that an utterance is in; one pass."""
    cells = []
    for n in sizes:
        cells.append(F.when(F.col("customer_rank").between(1, n), F.struct(F.lit(n).alias("window_n"), F.lit("customer_only").alias("window_version"))))
        cells.append(F.when(F.col("overall_rank") <= n, F.struct(F.lit(n).alias("window_n"), F.lit("all").alias("window_version"))))
    return pool.withColumn("cell", F.explode(F.array_compact(F.array(*cells)))).select("*", "cell.*").drop("cell")


def with_group_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds _n, _v (not null), _m, _s (population) of the group.

    Partial aggregates are joined back, so that a group of any size is shared by many tasks.
    """
    x = F.col(value)
    names = [f"_k{i}" for i in range(len(keys))]
    stats = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("_n"), F.count(x).alias("_v"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    return rows.join(stats, same, "left").drop(*names)


def z_within(rows: DataFrame, keys: list[str], value: str, fallback_keys: list[str], least: int = 2) -> DataFrame:
    """z-score in the group (population deviation), else against the sample deviation of ``fallback_keys``."""
    x = F.col(value)
    ok = F.coalesce((F.col("_n") >= least) & (F.col("_v") >= least) & (F.col("_s") > 0), F.lit(False))
    far = rows.groupBy(*fallback_keys).agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_std"))
    out = with_group_stats(rows, keys, value).join(far, fallback_keys, "left")
    z = F.when(ok, (x - F.col("_m")) / F.nullif("_s", F.lit(0.0))).otherwise((x - F.col("_mean")) / F.nullif("_std", F.lit(0.0)))
    return out.withColumns({"z": z, "norm_source": F.when(ok, "within_window").otherwise("global_fallback")}).drop("_n", "_v", "_m", "_s", "_mean", "_std")


def population_stats(rows: DataFrame, group: str, metrics: list[str], unknown: str = "UNKNOWN") -> DataFrame:
    """n, mean, std (population) of each metric by group, and over all as group 'ALL'."""
    long = rows.select(F.coalesce(F.col(group), F.lit(unknown)).alias(group), F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "x"))
    out = long.where("x is not null").groupingSets([["metric", group], ["metric"]], "metric", group)
    out = out.agg(F.grouping(group).alias("_all"), F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return out.withColumn(group, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(group))).drop("_all")


def z_population(rows: DataFrame, keys: list[str], value: str, group: str, stats: DataFrame, least: int = 4, shrink: bool = False) -> DataFrame:
    """z-score within a speaker of ``least`` rows at least, else against the population.

    ``stats``: one row a group (and 'ALL'): mean, std. Rows whose group is null
    or unknown use 'ALL'. With ``shrink``, groups of 2 to least - 1 rows share one z of
    their mean.
    """
    x = F.col(value)
    known = stats.where(F.col(group) != "ALL").select(group, F.col("mean").alias("_pm"), F.col("std").alias("_ps"))
    total = stats.where(F.col(group) == "ALL").select(F.lit(1).alias("_one"), F.col("mean").alias("_am"), F.col("std").alias("_as"))
    out = with_group_stats(rows, keys, value).withColumn("_one", F.lit(1))
    out = out.join(F.broadcast(known), group, "left").join(F.broadcast(total), "_one", "left")
    mean, std = F.coalesce("_pm", "_am"), F.nullif(F.coalesce("_ps", "_as"), F.lit(0.0))
    within = (F.col("_n") >= least) & (F.col("_v") >= 2) & (F.col("_s") > 0)
    z = F.when(within, (x - F.col("_m")) / F.nullif("_s", F.lit(0.0)))
    source = F.when(within, "within_speaker")
    if shrink:
        shared = (F.col("_n") >= 2) & (F.col("_n") < least) & (F.col("_v") >= 1)
        z, source = z.when(shared, (F.col("_m") - mean) / std), source.when(shared, "shrinkage_population_sd")
    source = source.when(F.col("_pm").isNull(), "population_fallback_no_gender").otherwise("population_gender")
    return out.withColumns({"z": z.otherwise((x - mean) / std), "norm_source": source}).drop("_n", "_v", "_m", "_s", "_one", "_pm", "_ps", "_am", "_as")


def quantile_cuts(rows: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Exact linear quantiles over the whole table; a handful of numbers on the driver."""
    found = exact_quantiles(rows, [], value, {f"q{i}": q for i, q in enumerate(shares)}).first()
    return [x for x in found if x is not None]


def bucket(value: Column, cuts: list[float], names: list[str], tied: str | None = None) -> Column:
    """Right-closed buckets; a null stays null. Cuts that coincide give ``tied`` everywhere."""
    if tied is not None and len(set(cuts)) < len(cuts):
        return F.lit(tied)
    out = F.when(value.isNull(), None)
    for cut, name in zip(cuts, names, strict=False):
        out = out.when(value <= cut, name)
    return out.otherwise(names[-1])


def unit_artifact_share(rows: DataFrame, z: str = "z") -> DataFrame:
    """Share of z-scores that are +1 or -1 to six digits: pairs, not measurements."""
    return rows.agg(F.avg((F.abs(F.round(z, 6)) == 1).cast("int")).alias("unit_share"))


def arousal_by_call(df: DataFrame, call: str, gender: str, metrics: list[str], population: DataFrame | None = None) -> DataFrame:
    """(call, n_rows, gender, z_{metric}, arousal): a call's plain means, standardised within its gender.

    A call's gender is its most frequent one, ties to the smallest, nulls not counted. Mean and standard deviation of each gender are those of
    the rows of ``population``, else of ``df``. A call without gender, values or spread has a null z; arousal is the mean of those z that
    aren't null.
    """
    source = df if population is None else population
    base = source.where(F.col(gender).isNotNull()).groupBy(gender).agg(*[f(m).alias(n + m) for m in metrics for n, f in (("_m_", F.avg), ("_s_", F.stddev_pop))])
    means = df.groupBy(call).agg(F.count("*").alias("n_rows"), *[F.avg(m).alias("_c_" + m) for m in metrics])
    rows = means.join(smallest_mode(df, [call], gender, gender), call, "left").join(base, gender, "left")
    z = {m: ratio(F.col("_c_" + m) - F.col("_m_" + m), F.col("_s_" + m)) for m in metrics}
    rows = rows.select(call, "n_rows", gender, *[c.alias(f"z_{m}") for m, c in z.items()])
    return rows.withColumn("arousal", mean_of_present(*[F.col(f"z_{m}") for m in metrics]))
