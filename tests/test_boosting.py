from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from talkmill.operators import boosting, ml


def auc(y, score):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    for value in np.unique(score):
        at = score == value
        ranks[at] = 0
    s = np.asarray(score)[order]
    _, inverse, counts = np.unique(s, return_inverse=True, return_counts=True)
    upto = np.cumsum(counts)
    ranks[order] = (upto - (counts - 1) / 2)[inverse]
    y = np.asarray(y)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.fixture(scope="module")
def seven(spark):
    """Seven classes in the plane: sectors around the origin, one row in ten of any class."""
    draw = np.random.default_rng(3)
    x, z, noise = draw.normal(size=2100), draw.normal(size=2100), draw.normal(size=2100)
    kind = ((np.arctan2(z, x) + math.pi) / (2 * math.pi) * 7).astype(int) % 7
    kind = np.where(draw.random(2100) < 0.1, draw.integers(0, 7, 2100), kind)
    return spark.createDataFrame([(i, float(a), float(b), float(c), f"class {k}") for i, (a, b, c, k) in enumerate(zip(x, z, noise, kind, strict=True))], "id int, x double, z double, noise double, kind string").repartition(4, "id").cache()


def test_seven_classes_and_falling_loss(seven):
    model = boosting.fit_boosted(seven.where("id % 5 > 0"), ["x", "z", "noise"], "kind", rounds=7, depth=3)
    assert model.labels == [f"class {k}" for k in range(7)] and len(model.losses) == 7
    assert all(b < a for a, b in zip(model.losses, model.losses[1:], strict=False)) and abs(model.losses[0] - math.log(7)) < 0.05
    out = model.transform(seven.where("id % 5 = 0"))
    assert out.agg(F.avg((F.col("kind") == F.col("prediction")).cast("int"))).first()[0] > 0.75
    p = np.array([r["probabilities"] for r in out.select("probabilities").collect()])
    assert p.shape == (420, 7) and np.allclose(p.sum(axis=1), 1)
    shares = dict(model.importances())
    assert math.isclose(sum(shares.values()), 1) and shares["noise"] < 0.15


def test_first_tree_is_the_best_by_brute_force(spark):
    """Depth 1: the cut, its gain and both leaves against all cuts tried one by one."""
    draw = np.random.default_rng(8)
    x = draw.integers(0, 12, (90, 2)).astype(float)
    y = np.where(x[:, 1] > 6, 2, np.where(x[:, 0] > 4, 1, 0))
    df = spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(x, y, strict=True)], "a double, b double, k int").repartition(5)
    model = boosting.fit_boosted(df, ["a", "b"], "k", rounds=1, depth=1, rate=1.0, bins=64, least=0.5)
    share = np.bincount(y) / 90
    for k in range(3):
        g, h = share[k] - (y == k), np.full(90, share[k] * (1 - share[k]))
        part = lambda at, g=g, h=h: g[at].sum() ** 2 / (h[at].sum() + 1)
        tried = [(part(x[:, f] <= c) + part(x[:, f] > c) - part(x[:, 0] > -1), -f, -c) for f in range(2) for c in range(11) if min(h[x[:, f] <= c].sum(), h[x[:, f] > c].sum()) >= 0.5]
        gain, f, c = max(tried)
        tree = model.rounds[0]
        assert tree.feature[k, 0] == -f
        left = boosting.binned(x, model.edges)[:, -f] <= tree.cut[k, 0]
        assert math.isclose(part(left) + part(~left) - part(x[:, 0] > -1), gain, rel_tol=1e-9)
        assert np.allclose(tree.value[k, 1:], [-g[left].sum() / (h[left].sum() + 1), -g[~left].sum() / (h[~left].sum() + 1)])


def test_two_classes_agree_with_the_binary_trees(seven):
    df = seven.withColumn("y", (F.col("kind") < "class 3").cast("int"))
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    ours = boosting.fit_boosted(train, ["x", "z"], "y", rounds=10, depth=3).transform(test).select("y", F.col("probabilities")[1].alias("p")).collect()
    gbt = GBTClassifier(featuresCol="features", labelCol="y", maxIter=20, maxDepth=3, seed=1).fit(ml.assembled(train, ["x", "z"]))
    theirs = gbt.transform(ml.assembled(test, ["x", "z"])).select("y", vector_to_array("probability")[1].alias("p")).collect()
    assert abs(auc([r["y"] for r in ours], np.array([r["p"] for r in ours])) - auc([r["y"] for r in theirs], np.array([r["p"] for r in theirs]))) < 0.01


def test_odd_rows(spark):
    rows = [(1.0, None, "a", 1.0)] * 20 + [(2.0, float("nan"), "b", 1.0)] * 20 + [(None, 1.0, "c", 2.0)] * 20 + [(9.0, 9.0, None, 1.0), (9.0, 9.0, "d", 0.0), (9.0, 9.0, "d", None)]
    df = spark.createDataFrame(rows, "u double, v double, k string, w double")
    model = boosting.fit_boosted(df, ["u", "v"], "k", weight="w", rounds=4, depth=2)
    assert model.labels == ["a", "b", "c"]
    got = {r["k"]: r["prediction"] for r in model.transform(df).select("k", "prediction").collect()}
    assert (got["a"], got["b"], got["c"]) == ("a", "b", "c") and got[None] in "abc"
    one = boosting.fit_boosted(df.where("k = 'a'"), ["u"], "k", rounds=1, depth=1)
    assert [r["prediction"] for r in one.transform(df).select("prediction").distinct().collect()] == ["a"] and one.importances() == [("u", 0.0)]
    with pytest.raises(ValueError, match="no row"):
        boosting.fit_boosted(df.where("false"), ["u"], "k")
    with pytest.raises(ValueError, match="needs"):
        boosting.fit_boosted(df, [], "k")
