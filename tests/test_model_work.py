"""Registered models do the reference's work: 200 trees of depth 4, five folds."""

from __future__ import annotations

import inspect

import pytest

from talkmill.operators import ml
from talkmill.plans import catalog

SF = "/root/testdata/sf0.001"


class Asked(Exception):
    pass


@pytest.mark.parametrize(("query", "name", "want"), [("feature_importance", "importances", {"trees": 200, "depth": 4}), ("lr_gate", "cross_validated", {"k": 5})])
def test_registered_numbers(spark, monkeypatch, query, name, want):
    signature = inspect.signature(getattr(ml, name))

    def ask(*a, **b):
        bound = signature.bind(*a, **b)
        bound.apply_defaults()
        raise Asked({k: bound.arguments[k] for k in want})

    monkeypatch.setattr(ml, name, ask)
    with pytest.raises(Asked) as got:
        catalog.QUERIES[query](spark, SF)
    assert got.value.args[0] == want


def test_equal_rows_are_learned_from_once(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("cast(id % 7 as double) as a", "cast(id % 5 as double) as b", "cast(id * 31 % 35 % 7 in (1, 4) or (id % 5 = 3 and id % 11 < 8) as double) as y")
    plain = ml.GBTClassifier(featuresCol="features", labelCol="y", maxIter=4, maxDepth=3, seed=42).fit(ml.assembled(rows, ["a", "b"]))
    given = []

    class Watched(ml.GBTClassifier):
        def fit(self, df):
            given.extend((df.count(), df.rdd.getNumPartitions()))
            return super().fit(df)

    monkeypatch.setattr(ml, "GBTClassifier", Watched)
    found = {r["feature"]: r["importance"] for r in ml.importances(rows, ["a", "b"], "y", trees=4, depth=3).collect()}
    assert found == pytest.approx(dict(zip("ab", plain.featureImportances.toArray(), strict=True)), abs=1e-9)
    assert 0 < min(found.values()) and given == [rows.distinct().count(), 1] and given[0] < 100
