"""Running totals, row numbers, ranks and quantiles that no single task has to compute alone.

A global order is cut into buckets; counts per bucket give each bucket's offset,
and windows run inside buckets only. Buckets of numbers are found as in a radix sort: the first digit is
fixed (parts of an octave), the second one cuts a bucket between its own least and largest value. All is one lazy plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First digits in an octave, and second digits in a first one.
FINE, SECOND = 64, 4096


def number_by_hash(df: DataFrame, keys: list[str], hashed: Column, tie: str, name: str, digits: int = 3) -> DataFrame:
    """Row numbers from 1 within ``keys`` in the order of a hex hash, ties by ``tie``; buckets are its first digits."""
    rows = df.withColumn("_h", hashed).withColumn("_b", F.substring("_h", 1, digits))
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", tie))
    return rows.withColumn("_nth", nth).join(offsets, [*keys, "_b"]).withColumn(name, F.col("_offset") + F.col("_nth")).drop("_h", "_b", "_nth", "_offset")


def first_digit(value: Column) -> Column:
    """A whole number that never falls where the value rises; NaN is the largest value."""
    v = value.cast("double")
    size = F.abs(v)
    octave = F.floor(F.signum(v) * F.log2(1.0 + F.least(size, F.lit(1e300))) * FINE).cast("int")
    return F.when(F.isnan(v), 1 << 21).when(size > 1e300, F.signum(v).cast("int") * (1 << 20)).otherwise(octave)


def second_digit(value: Column, low: str, high: str) -> Column:
    """The part of its bucket, from ``low`` to ``high``, that a value lies in."""
    v, low, high = value.cast("double"), F.col(low).cast("double"), F.col(high).cast("double")
    inside = (v / 2 - low / 2) / (high / 2 - low / 2) * SECOND
    return F.when((high > low) & ~F.isnan(v) & (F.abs(high) < float("inf")) & (F.abs(low) < float("inf")), F.least(F.floor(inside), F.lit(SECOND - 1))).otherwise(0).cast("int")


def _upto(keys: list[str], *order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def average_rank_table(df: DataFrame, keys: list[str], value: str, *sums: Column) -> DataFrame:
    """(keys, value, t, the sums, rank): distinct values, how often each occurs, and its average rank.

    Null values are left out. Values are numbers.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("t"), *sums).withColumns({"_k": F.struct(F.lit(0).alias("_"), *keys), "_b": first_digit(F.col(value))})
    first = counts.groupBy("_k", "_b").agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum("t").alias("_c"))
    first = first.withColumn("_before", F.sum("_c").over(_upto(["_k"], "_b")) - F.col("_c")).drop("_c")
    counts = counts.join(first, ["_k", "_b"]).withColumn("_b2", second_digit(F.col(value), "_low", "_high")).drop("_low", "_high")
    second = counts.groupBy("_k", "_b", "_b2").agg(F.sum("t").alias("_c"))
    second = second.withColumn("_offset", F.sum("_c").over(_upto(["_k", "_b"], "_b2")) - F.col("_c")).drop("_c")
    inside = F.sum("t").over(_upto(["_k", "_b", "_b2"], value))
    ranked = counts.join(second, ["_k", "_b", "_b2"]).withColumn("_inside", inside)
    return ranked.withColumn("rank", F.col("_before") + F.col("_offset") + F.col("_inside") - (F.col("t") - 1) / 2.0).drop("_k", "_b", "_b2", "_before", "_offset", "_inside")


def _holding(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of (keys, order, c, ranks) in which some of their key's ``ranks`` (from 0) fall; ``ranks`` become places within the row."""
    upto = F.sum("c").over(_upto(keys, order))
    placed = table.withColumn("_from", upto - F.col("c"))
    own = F.expr("filter(ranks, r -> r.rest >= _from and r.rest < _from + c)")
    return placed.withColumn("ranks", F.transform(own, lambda r: F.struct(r["name"].alias("name"), (r["rest"] - F.col("_from")).alias("rest")))).where(F.size("ranks") > 0).drop("_from", "c")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column a share): exact quantiles with linear interpolation; null without values.

    Radix selection: a histogram of first digits tells in which buckets the wanted ranks of all groups and shares fall; only their rows
    are counted by second digit, and only those of the buckets found then by value.
    """
    rows = df.select(*keys, F.struct(F.lit(0).alias("_"), *keys).alias("_k"), F.col(value).alias("_v")).where("_v is not null").withColumn("_b", first_digit(F.col("_v")))
    hint = (lambda t: t) if keys else F.broadcast  # two rows a share, where there is one group
    edges = lambda t, *by: t.groupBy("_k", *by).agg(F.count("*").alias("c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    first = edges(rows, "_b").withColumn("_n", F.sum("c").over(Window.partitionBy("_k")))
    place = {name: (F.col("_n") - 1) * F.lit(float(q)) for name, q in shares.items()}
    ranks = [F.struct(F.lit(f"{side}{name}").alias("name"), edge(place[name]).cast("long").alias("rest")) for name in shares for side, edge in (("l", F.floor), ("h", F.ceil))]
    first = _holding(first.withColumn("ranks", F.array(*ranks)), ["_k"], "_b")
    some = rows.join(hint(first), ["_k", "_b"]).withColumn("_b2", second_digit(F.col("_v"), "_low", "_high")).drop("_low", "_high")
    second = _holding(some.groupBy("_k", "_n", "_b", "_b2").agg(F.count("*").alias("c"), F.first("ranks").alias("ranks")), ["_k", "_b"], "_b2")
    few = some.drop("ranks", "_n").join(hint(second), ["_k", "_b", "_b2"])
    third = _holding(few.groupBy("_k", "_n", "_b", "_b2", "_v").agg(F.count("*").alias("c"), F.first("ranks").alias("ranks")), ["_k", "_b", "_b2"], "_v")
    hits = third.select("_k", "_n", F.col("_v").cast("double").alias("_v"), F.explode("ranks").alias("r"))
    named = lambda name: F.max(F.when(F.col("r.name") == name, F.col("_v")))
    found = hits.groupBy("_k", "_n").agg(*[named(f"{side}{name}").alias(f"_{side}_{name}") for name in shares for side in "lh"])

    def between(name: str) -> Column:
        low, high, p = F.col(f"_l_{name}"), F.col(f"_h_{name}"), place[name]
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    if keys:
        return found.select(*[F.col(f"_k.{k}").alias(k) for k in keys], *[between(name).alias(name) for name in shares])
    return found.groupBy().agg(*[F.max(between(name)).alias(name) for name in shares])


def first_in_order(df: DataFrame, hashed: Column, tie: str, n: int, digits: int = 4) -> DataFrame:
    """(last, tie, all): the n-th of all rows in the order of a hex hash and a unique ``tie``; ``all``: there are no more than n.

    Radix selection by ``digits`` hex digits at a time: no task holds more than a histogram, and of the rows those with the same two digits.
    """
    rows = df.select(hashed.alias("_h"), F.col(tie).alias("_t")).withColumns({"_d1": F.substring("_h", 1, digits), "_d2": F.substring("_h", 1 + digits, digits)})
    everything = F.array(F.struct(F.lit("n").alias("name"), F.lit(n - 1).cast("long").alias("rest")))
    first = rows.groupBy("_d1").agg(F.count("*").alias("c"))
    total = first.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("_all"))
    first = _holding(first.withColumn("ranks", everything), [], "_d1")
    some = rows.join(F.broadcast(first), "_d1")
    second = _holding(some.groupBy("_d1", "_d2").agg(F.count("*").alias("c"), F.first("ranks").alias("ranks")), [], "_d2")
    few = some.drop("ranks").join(F.broadcast(second), ["_d1", "_d2"])
    nth = F.row_number().over(Window.orderBy("_h", "_t")) - 1  # rows that share the first digits
    cut = few.withColumn("_nth", nth).where(F.col("_nth") == F.col("ranks")[0]["rest"]).select("_h", "_t")
    return total.join(cut, F.lit(True), "left").select(F.col("_h").alias("last"), F.col("_t").alias("tie"), (F.col("_all") <= n).alias("all"))
