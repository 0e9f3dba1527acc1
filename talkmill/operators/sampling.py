"""Seeded samples and splits. Order is that of md5(seed|id): the same rows on any engine.

Small global samples use orderBy + limit (each task keeps n rows), larger ones compare rows with the n-th hash, found by
radix selection; samples per stratum use a window, or thresholds found on the stratum's counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.operators.ordering import first_in_order, number_by_hash


def hash_order(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


#: Rows of a sample that one task may hold.
SMALL_SAMPLE = 10_000


def _among_first(df: DataFrame, key: str, n: int, seed: int) -> tuple[DataFrame, Column]:
    """``df`` beside the n-th row of the hash order, and whether a row is not behind it; keys are unique."""
    cut = first_in_order(df, hash_order(key, seed), key, n)
    own = F.struct(hash_order(key, seed).alias("last"), F.col(key).alias("tie"))
    among = F.col("_cut.all") | F.coalesce(own <= F.struct("_cut.last", "_cut.tie"), F.lit(False))
    return df.crossJoin(F.broadcast(cut.select(F.struct("*").alias("_cut")))), among


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows in hash order; keys are unique. Samples beyond SMALL_SAMPLE come in no order."""
    if n <= SMALL_SAMPLE:
        return df.orderBy(hash_order(key, seed), key).limit(n)
    rows, among = _among_first(df, key, n, seed)
    return rows.where(among).drop("_cut")


def split_fixed(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Adds ``part``: 'first' for n rows, 'rest' for the others; disjoint and complete. Keys are unique.

    The n-th row is found first; rows are then compared with it, so nothing is sorted whole.
    """
    rows, among = _among_first(df, key, n, seed)
    return rows.withColumn("part", F.when(among, "first").otherwise("rest")).drop("_cut")


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(group).orderBy(hash_order(key, seed), key)
    return df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= n)


def quota_sample(df: DataFrame, group: str, key: str, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """Fixed quotas, then an order that hides the strata: ``position`` from 1."""
    table = df.sparkSession.createDataFrame(list(quotas.items()), f"`{group}` string, quota int")
    rows = df.join(F.broadcast(table), group)
    w = Window.partitionBy(group).orderBy(hash_order(key, seed), key)
    # The literal bound lets Spark drop rows before the shuffle.
    rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(quotas.values(), default=0)).where("_r <= quota").drop("_r", "quota")
    # At most the sum of the quotas is left, so one task may number them.
    return rows.withColumn("position", F.row_number().over(Window.orderBy(hash_order(key, seed + 1), key)))


def round_robin(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows that go round the groups in turn."""
    ranked = sample_per_group(df, group, key, n, seed)
    return ranked.orderBy("rank_in_group", group, key).limit(n)


def proportional_allocation(df: DataFrame, group: str, total: int, floor: int = 0) -> DataFrame:
    """(group, size, alloc): shares of ``total`` rounded half to even, the difference put on the largest group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    everything = Window.partitionBy()  # one row a stratum
    alloc = F.greatest(F.bround(F.lit(total) * F.col("size") / F.sum("size").over(everything), 0).cast("long"), F.lit(floor))
    out = sizes.withColumn("alloc", F.least(alloc, "size"))
    largest = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("size"), group)) == 1
    return out.withColumn("alloc", F.when(largest, F.col("alloc") + F.lit(total) - F.sum("alloc").over(everything)).otherwise(F.col("alloc")))


def minority_allocation(df: DataFrame, group: str, total: int, minority: str, least: int) -> DataFrame:
    """(group, size, alloc): the minority gets its share of ``total`` or ``least``, whichever is more; the others share the rest.

    Shares are rounded half to even, the difference goes to the largest of the others.
    A minority smaller than what it should give is an error.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("size"))
    everything = Window.partitionBy()  # one row a stratum
    small = F.col(group) == minority
    share = lambda n, of: F.bround(n * F.col("size") / of, 0).cast("long")
    table = sizes.withColumns({"_all": F.sum("size").over(everything), "_rest": F.sum(F.when(~small, F.col("size"))).over(everything)})
    taken = F.greatest(share(F.lit(total), F.col("_all")), F.lit(least))
    taken = F.when(taken > F.col("size"), F.raise_error(F.lit("the minority is smaller than its allocation")).cast("long")).otherwise(taken)
    table = table.withColumn("_own", F.when(small, taken))
    table = table.withColumn("_left", F.lit(total) - F.coalesce(F.max("_own").over(everything), F.lit(0)))
    table = table.withColumn("alloc", F.coalesce("_own", share(F.col("_left"), F.col("_rest"))))
    largest = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(small, F.desc("size"), group)) == 1
    rest = F.sum(F.when(~small, F.col("alloc"))).over(everything)
    return table.withColumn("alloc", F.when(largest & ~small, F.col("alloc") + F.col("_left") - rest).otherwise(F.col("alloc"))).select(group, "size", "alloc")


def proportional_sample(df: DataFrame, group: str, key: str, total: int, seed: int = 42, floor: int = 0) -> DataFrame:
    table = proportional_allocation(df, group, total, floor).select(group, "alloc")
    w = Window.partitionBy(group).orderBy(hash_order(key, seed), key)
    return df.join(F.broadcast(table), group).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= total).where("_r <= alloc").drop("_r", "alloc")


def sample_excluding(df: DataFrame, taken: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return sample_n(df.join(taken.select(key).distinct(), key, "left_anti"), key, n, seed)


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0 to k - 1: every class is dealt evenly in hash order."""
    numbered = number_by_hash(df, [label], hash_order(key, seed), key, "_nth_of_class")
    return numbered.withColumn("fold", F.pmod(F.col("_nth_of_class") - 1, F.lit(k)).cast("int")).select(*df.columns, "fold")
