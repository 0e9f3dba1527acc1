"""Published values and exact references."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from talkmill.operators import metrics as M
from talkmill.operators import requests, sampling, stats


@pytest.mark.parametrize(("n10", "n01", "stat", "p"), [(302, 413, 16.9231, 3.89e-5), (303, 409, 15.4846, None), (348, 398, 3.2185, 0.0728)])
def test_mcnemar_published(n10, n01, stat, p):
    s, q, exact = stats.mcnemar_p(n10, n01)
    assert not exact and s == pytest.approx(stat, abs=1e-4)
    assert p is None or q == pytest.approx(p, rel=5e-3)


def test_mcnemar_exact_and_switch():
    assert stats.mcnemar_p(0, 396)[1] == pytest.approx(1.24e-119, rel=1e-2)
    assert stats.mcnemar_p(0, 0) == (None, 1.0, True)
    assert stats.mcnemar_p(20, 40)[2] and not stats.mcnemar_p(20, 40, on_total=True)[2]
    assert stats.binomial_two_sided(5, 10) == 1.0


def test_yates_published():
    a, b, c, d = 82, 90, 52, 26
    n = a + b + c + d
    gap = abs(a * d - b * c) - n / 2
    assert stats.chi2_tail(n * gap * gap / ((a + b) * (c + d) * (a + c) * (b + d))) == pytest.approx(0.0080, abs=1e-4)


def test_fisher_and_t():
    assert stats.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert stats.t_tail(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.t_tail(0.5, 30) == pytest.approx(0.62073, abs=1e-4)


def test_bootstrap_interval(spark):
    n10, n01, n = 302, 413, 9658
    cells = spark.createDataFrame([("k", n - n10 - n01, n10, n01, 0)], "k string, n11 long, n10 long, n01 long, n00 long")
    row = stats.bootstrap_difference(cells, ["k"]).first()
    assert row["ci_low"] == pytest.approx(0.00611, abs=3e-4) and row["ci_high"] == pytest.approx(0.01677, abs=3e-4)


def test_auc_and_mann_whitney_against_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(6), rng.random() < 0.4) for _ in range(200)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    u = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    df = spark.createDataFrame(rows, "s int, y boolean")
    assert M.auc(df, [], "s", F.col("y")).first()["auc"] == pytest.approx(u / len(pos) / len(neg))
    assert stats.mann_whitney(df, [], "s", F.col("y")).first()["u"] == pytest.approx(u)


def test_kappa_by_hand(spark):
    rows = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15 + [("a", None)]
    df = spark.createDataFrame(rows, "gold string, pred string")
    got = M.kappa(M.confusion(df, []), [], ["a", "b"]).first()
    assert got["n_rated"] == 50 and got["kappa"] == pytest.approx(0.4)


@pytest.mark.parametrize("budget", [1, 7, 10, 30])
def test_greedy_chunks(spark, budget):
    rng = random.Random(budget)
    sizes = [rng.randrange(0, 12) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, s long")
    got = [r["chunk"] for r in requests.greedy_chunks(df, "i", "s", budget).orderBy("i").collect()]
    want, chunk, total = [], 0, 0
    for s in sizes:
        if want and total + s > budget:  # a chunk always holds the item before
            chunk, total = chunk + 1, s
        else:
            total += s
        want.append(chunk)
    assert got == want


def test_split_is_disjoint_and_complete(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    parts = {r["part"]: r["count"] for r in sampling.split_fixed(df, "k", 300).groupBy("part").count().collect()}
    assert parts == {"first": 300, "rest": 700}


def test_allocation_sums_to_total(spark):
    df = spark.createDataFrame([(g,) for g, n in (("a", 70), ("b", 25), ("c", 5)) for _ in range(n)], "g string")
    got = {r["g"]: r["alloc"] for r in sampling.proportional_allocation(df, "g", 33).collect()}
    assert sum(got.values()) == 33 and got["a"] == max(got.values())




def test_p_values_equal_published_ones(spark):
    """Values of textbook tables and of closed forms."""
    assert stats.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert stats.correlation_p(0.0, 10) == pytest.approx(1.0)
    assert stats.correlation_p(0.632, 10) == pytest.approx(0.05, abs=2e-4)  # critical value, 8 degrees of freedom
    assert stats.correlation_p(0.5, 4) == pytest.approx(0.5)  # two degrees of freedom: 1 - |r|
    assert stats.correlation_p(1.0, 9) == 0.0 and stats.correlation_p(None, 9) is None and stats.correlation_p(0.3, 2) is None
    rows = [("g", i % 2 == 0, float(i)) for i in range(10)] + [("one", True, 1.0), ("one", True, 2.0), ("one", None, 3.0)]
    found = {r["g"]: r for r in stats.point_biserial(spark.createDataFrame(rows, "g string, e boolean, x double"), ["g"], F.col("e"), "x").collect()}
    assert found["g"]["r"] == pytest.approx(-1 / 33**0.5) and found["one"]["r"] is None and found["one"]["p_value"] is None
    assert found["g"]["p_value"] == pytest.approx(stats.t_tail(found["g"]["r"] * (8 / (1 - 1 / 33)) ** 0.5, 8))
    pairs = spark.createDataFrame([(float(i), float(i * i)) for i in range(6)], "x double, y double")
    row = stats.correlation_tests(stats.correlations(pairs, "x", "y")).first()
    assert row["spearman"] == pytest.approx(1.0) and row["spearman_p"] == pytest.approx(0.0, abs=1e-6)
    u = stats.mann_whitney(spark.createDataFrame([(float(i), i < 10) for i in range(20)], "x double, f boolean"), [], "x", F.col("f"))
    assert stats.mann_whitney_test(u, []).first()["p_value"] == pytest.approx(0.000182672, rel=1e-4)
