"""Paired and two-sample tests. Counts come from Spark; tails are evaluated on a row or two."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.nulls import ratio, same
from talkmill.operators.ordering import average_rank_table


def chi2_tail(stat: float) -> float:
    """P(X >= stat) for one degree of freedom."""
    return math.erfc(math.sqrt(stat / 2))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided p for k successes of n at one half, by symmetry."""
    k = min(k, n - k)
    tail = sum(math.comb(n, i) for i in range(k + 1))
    return min(1.0, math.ldexp(1.0, 1 - n) * tail if n < 1000 else math.exp(math.log(2 * tail) - n * math.log(2)))


def mcnemar_p(n10: int, n01: int, exact_below: int = 25, on_total: bool = False) -> tuple[float | None, float, bool]:
    """(statistic, p, exact). The exact test is used if the smaller (or the total) count is below a limit."""
    total, low = n10 + n01, min(n10, n01)
    if not total:
        return None, 1.0, True
    if (total if on_total else low) < exact_below:
        return float(low), binomial_two_sided(low, total), True
    stat = (abs(n10 - n01) - 1) ** 2 / total
    return stat, chi2_tail(stat), False


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of all tables with the same margins that are no likelier than this one."""
    n, r, k = a + b + c + d, a + b, a + c
    weight = lambda x: math.comb(r, x) * math.comb(n - r, k - x)
    here = weight(a)
    return sum(w for x in range(max(0, r + k - n), min(r, k) + 1) if (w := weight(x)) <= here) / math.comb(n, k)


def t_tail(t: float, df: int) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    return _beta(df / 2, 0.5, x)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + num * d, 1e-300) if 1 + num * d > 0 else 1 / min(1 + num * d, -1e-300)
        c = 1 + num / c
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def mcnemar_cells(df: DataFrame, keys: list[str], gold: str, a: str, b: str) -> DataFrame:
    """n11, n10 (only a right), n01 (only b right), n00, and the continuity-corrected statistic, of rows with both predictions."""
    ok_a, ok_b = same(F.col(a), F.col(gold)), same(F.col(b), F.col(gold))
    out = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(F.count_if(ok_a & ok_b).alias("n11"), F.count_if(ok_a & ~ok_b).alias("n10"), F.count_if(~ok_a & ok_b).alias("n01"), F.count_if(~ok_a & ~ok_b).alias("n00"))
    gap = F.abs(F.col("n10") - F.col("n01")) - 1
    return out.withColumn("chi2_cc", ratio(gap * gap, (F.col("n10") + F.col("n01")).cast("double")))


def mcnemar(cells: DataFrame, keys: list[str], on_total: bool = False) -> DataFrame:
    """Adds statistic, p_value, exact to cells: one row a comparison."""
    kind = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            tests = [mcnemar_p(int(x), int(y), on_total=on_total) for x, y in zip(pdf["n10"], pdf["n01"], strict=True)]
            yield pdf[[*keys, "n10", "n01"]].assign(statistic=[t[0] for t in tests], p_value=[t[1] for t in tests], exact=[t[2] for t in tests])

    return cells.mapInPandas(run, f"{kind}{', ' if kind else ''}n10 long, n01 long, statistic double, p_value double, exact boolean")


def two_by_two(df: DataFrame, keys: list[str], group: Column, event: Column) -> DataFrame:
    """Cells of group by event and Yates' corrected chi-square."""
    out = df.groupBy(*keys).agg(F.count_if(group & event).alias("a"), F.count_if(group & ~event).alias("b"), F.count_if(~group & event).alias("c"), F.count_if(~group & ~event).alias("d"))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    least = F.least(a + b, c + d) * F.least(a + c, b + d) / n
    return out.withColumns({"chi2_yates": ratio(n * gap * gap, margins), "min_expected": least})


def two_by_two_test(cells: DataFrame) -> DataFrame:
    """p_value and test: Fisher's where an expected count is under 5, else Yates' chi-square."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                small = r.min_expected < 5
                out.append((fisher_two_sided(r.a, r.b, r.c, r.d) if small else chi2_tail(r.chi2_yates), "fisher" if small else "chi2"))
            yield pdf[["a", "b", "c", "d"]].assign(p_value=[p for p, _ in out], test=[t for _, t in out])

    return cells.select("a", "b", "c", "d", "chi2_yates", "min_expected").mapInPandas(run, "a long, b long, c long, d long, p_value double, test string")


def mann_whitney(df: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """U of the first sample, and z with tie correction and continuity; ranks from distinct values."""
    tied = average_rank_table(df, keys, value, F.sum(first.cast("long")).alias("p"))
    out = tied.groupBy(*keys).agg(F.sum("p").alias("n1"), F.sum(F.col("t") - F.col("p")).alias("n2"), F.sum(F.col("p") * F.col("rank")).alias("r1"), F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    z = ratio(F.abs(u - n1 * n2 / 2) - 0.5, sd)
    return out.select(*keys, "n1", "n2", u.alias("u"), z.alias("z"))


def normal_two_sided(z: float) -> float:
    return math.erfc(max(z, 0.0) / math.sqrt(2))


def exact_u_tail(n1: int, n2: int, u: float) -> float:
    """Two-sided p-value of U without ties, from the number of orders of n1 + n2 values with each U."""
    top = n1 * n2
    ways = [1] + [0] * top
    for i in range(1, min(n1, n2) + 1):  # one value more on the smaller side: times (1 - q^(larger + i)) / (1 - q^i)
        step = max(n1, n2) + i
        for k in range(top, step - 1, -1):
            ways[k] -= ways[k - step]
        for k in range(i, top + 1):
            ways[k] += ways[k - i]
    least = math.ceil(max(u, top - u))
    return min(1.0, 2 * sum(ways[least:]) / sum(ways))


#: The smaller sample has so many values at most where the null distribution is counted out, if there are no ties.
EXACT_UP_TO = 8


def mann_whitney_test(u: DataFrame, keys: list[str], exact_up_to: int = 0) -> DataFrame:
    """Adds the two-sided p-value to rows of :func:`mann_whitney`: that of the normal approximation.

    ``exact_up_to`` (such as EXACT_UP_TO): where one sample has no more values and no value occurs twice, the exact one. Without ties z has the plain
    variance n1 n2 (n + 1) / 12, by which they are told from others.
    """

    def p(r) -> float:
        n1, n2 = int(r["n1"]), int(r["n2"])
        if 0 < min(n1, n2) <= exact_up_to:
            plain = (abs(r["u"] - n1 * n2 / 2) - 0.5) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
            if math.isclose(r["z"], plain, rel_tol=1e-12, abs_tol=1e-12):
                return exact_u_tail(n1, n2, r["u"])
        return normal_two_sided(r["z"])

    return _with_p(u, [*keys, "n1", "n2", "u", "z"], {"p_value": p})


def _pearson(x: str, y: str) -> Column:
    """Null where a side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, Pearson and Spearman of two columns, over rows that have both.

    Both come from counts of equal (x, y) pairs; ranks are those of the distinct values.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    pairs = rows.groupBy("x", "y").agg(F.count("*").alias("t"))
    for c in "xy":
        pairs = pairs.join(average_rank_table(rows, [], c).select(c, F.col("rank").alias(f"r{c}")), c)
    n = rows.agg(F.count("*").alias("n"), _pearson("x", "y").alias("pearson"))
    middle = lambda c: F.col(c) - (F.col("n") + 1) / 2.0  # noqa: E731  ranks about their mean
    total = lambda a, b: F.sum(F.col("t") * middle(a) * middle(b))
    out = pairs.crossJoin(F.broadcast(n)).groupBy("n", "pearson").agg(total("rx", "ry").alias("xy"), total("rx", "rx").alias("xx"), total("ry", "ry").alias("yy"))
    return out.select("n", "pearson", (F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))).alias("spearman"))


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation against none, by Student's t."""
    if r is None or math.isnan(r) or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else t_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def correlation_tests(found: DataFrame) -> DataFrame:
    """n, pearson, spearman with their p-values."""
    return _with_p(found, ["n", "pearson", "spearman"], {f"{c}_p": lambda r, c=c: correlation_p(r[c], int(r["n"])) for c in ("pearson", "spearman")})


def point_biserial(df: DataFrame, keys: list[str], event: Column, value: str) -> DataFrame:
    """n, r and p of a yes/no event against a number, over rows that have both."""
    rows = df.withColumn("_e", event.cast("double")).where(F.col("_e").isNotNull() & F.col(value).isNotNull())
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), _pearson("_e", value).alias("r"))
    return _with_p(found, [*keys, "n", "r"], {"p_value": lambda row: correlation_p(row["r"], int(row["n"]))})


def _with_p(df: DataFrame, columns: list[str], tests: dict) -> DataFrame:
    """Rows of a few statistics with columns worked out in Python."""
    kind = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns) + "".join(f", {name} double" for name in tests)

    def run(batches):
        for pdf in batches:
            rows = [{k: None if pd.isna(v) else v for k, v in r.items()} for r in pdf.to_dict("records")]
            yield pdf.assign(**{name: pd.Series([None if None in r.values() else test(r) for r in rows], index=pdf.index, dtype="float64") for name, test in tests.items()})

    return df.select(*columns).mapInPandas(run, kind)


def auc_gate(aucs: DataFrame, name: str, auc: str, threshold: float = 0.6) -> DataFrame:
    """(best_name, best_auc, passed): the best of a few scores against a threshold; none passes if there is no AUC."""
    best = F.max(F.struct(F.col(auc).alias("a"), F.col(name).alias("n")))
    out = aucs.where(F.col(auc).isNotNull()).agg(best.alias("b"))
    return out.select(F.col("b.n").alias("best_name"), F.col("b.a").alias("best_auc"), F.coalesce(F.col("b.a") >= threshold, F.lit(False)).alias("passed"))


def bootstrap_difference(cells: DataFrame, keys: list[str], draws: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile interval of accuracy(b) - accuracy(a).

    A resampled difference depends on the four cells alone, so draws are
    multinomial over them: the same distribution without copies of rows.
    """
    kind = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                counts = np.array([r.n11, r.n10, r.n01, r.n00], float)
                n = int(counts.sum())
                x = np.random.default_rng(seed).multinomial(n, counts / n, draws) if n else np.zeros((draws, 4))
                diff = (x[:, 2] - x[:, 1]) / max(n, 1)
                low, high = np.quantile(diff, [(1 - level) / 2, (1 + level) / 2])
                rows.append(((r.n01 - r.n10) / max(n, 1), low, high))
            yield pdf[keys].assign(**pd.DataFrame(rows, columns=["difference", "ci_low", "ci_high"], index=pdf.index))

    return cells.mapInPandas(run, f"{kind}{', ' if kind else ''}difference double, ci_low double, ci_high double")
