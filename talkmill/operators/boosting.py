"""Boosted trees for several classes: softmax gradients, histograms by groupBy, trees grown level by level.

Each round fits one tree a class to the gradients of the log-loss. For a level, every task sums gradients and Hessians of its rows
by (class, node, feature, bin), Spark adds those up and picks each node's best cut; only the cuts, one a node, come to
the driver. What a task holds besides a batch is one histogram, whose size the model fixes, not the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.operators.ordering import exact_quantiles
from talkmill.storage import written

CELLS = "class int, node int, feature int, bin int, g double, h double"

#: Rounds whose trees are walked anew for each level before scores are written down.
PENDING = 5


@dataclass
class Round:
    """One tree a class; node i has children 2i + 1 and 2i + 2. A node without a feature (-1) is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, classes: int, depth: int) -> Round:
        nodes = 2 ** (depth + 1) - 1
        return cls(np.full((classes, nodes), -1), np.zeros((classes, nodes), int), np.zeros((classes, nodes)))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Where rows end in each class's tree: rows x classes."""
        n, classes = len(bins), len(self.feature)
        at = np.zeros((n, classes), int)
        each, tree = np.arange(n)[:, None], np.arange(classes)[None, :]
        for _ in range(self.feature.shape[1].bit_length() - 1):
            feature = self.feature[tree, at]
            right = bins[each, np.maximum(feature, 0)] > self.cut[tree, at]
            at = np.where(feature < 0, at, 2 * at + 1 + right)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[np.arange(len(self.value))[None, :], self.nodes(bins)]


@dataclass
class BoostedTrees:
    """A fitted model: labels in ascending order, bin edges of each feature, first scores, rounds; ``losses[r]`` is the log-loss before round r."""

    labels: list
    columns: list[str]
    edges: list[np.ndarray]
    start: np.ndarray
    rounds: list[Round] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.edges)
        return softmax(self.start + sum((r.scores(bins) for r in self.rounds), np.zeros((len(bins), len(self.labels)))))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probabilities`` (in the order of ``labels``) and ``prediction``, the likeliest label, ties to the smaller."""
        model, labels = self, F.array(*[F.lit(x) for x in self.labels])

        @F.pandas_udf("array<double>")
        def scored(values: pd.Series) -> pd.Series:
            return pd.Series(list(model.probabilities(matrix(values, len(model.columns)))))

        out = df.withColumn("probabilities", scored(features(self.columns)))
        best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
        return out.withColumn("prediction", F.element_at(labels, best))

    def importances(self) -> list[tuple[str, float]]:
        """(column, share of the total gain), largest first; without any cut all shares are 0."""
        total = sum(self.gains.values()) or 1.0
        return sorted(((c, self.gains.get(c, 0.0) / total) for c in self.columns), key=lambda x: (-x[1], x[0]))


def features(columns: list[str]):
    return F.array(*[F.col(c).cast("double") for c in columns])


def matrix(values: pd.Series, width: int) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in values]).reshape(len(values), width)


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: 0 for null and NaN, then 1 + how many edges lie below it."""
    columns = [np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, side="left")) for v, e in zip(values.T, edges, strict=True)]
    return np.stack(columns, axis=1) if columns else np.zeros((len(values), 0), int)


def softmax(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _edges(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Exact quantiles of all columns, in one job; equal ones count once."""
    each = F.posexplode(features(columns)).alias("feature", "value")
    long = df.select(each).where("value is not null and not isnan(value)")
    names = {f"q{i}": i / bins for i in range(1, bins)}
    found = {r["feature"]: np.unique([r[n] for n in names]) for r in exact_quantiles(long, ["feature"], "value", names).collect()}
    return [found.get(i, np.zeros(0)) for i in range(len(columns))]


def _histogram(pending: list[Round], growing: Round, level: int, shape: tuple[int, int]):
    """A task's sums for the nodes of a level; at level 0 also its log-loss, as class -1."""
    classes, width = shape
    first, nodes = 2**level - 1, 2**level

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, weight = None, 0.0, 0.0
        for batch in batches:
            bins = matrix(batch["bins"], width).astype(int)
            scores = matrix(batch["scores"], classes) + sum((r.scores(bins) for r in pending), np.zeros((len(bins), classes)))
            p, y, w = softmax(scores), batch["y"].to_numpy(), batch["w"].to_numpy()
            g = (p - np.eye(classes)[y]) * w[:, None]
            h = p * (1 - p) * w[:, None]
            loss -= float((np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)) * w).sum())
            weight += float(w.sum())
            at = growing.nodes(bins) - first
            size = int(bins.max(initial=0)) + 1
            if total is None or size > total.shape[-1]:
                wider = np.zeros((2, classes, nodes, width, size))
                if total is not None:
                    wider[..., : total.shape[-1]] = total
                total = wider
            for k in range(classes):
                rows = np.flatnonzero((at[:, k] >= 0) & (at[:, k] < nodes))
                place = (at[rows, k][:, None] * width + np.arange(width)) * total.shape[-1] + bins[rows]
                for i, amount in enumerate((g, h)):
                    total[i, k] += np.bincount(place.ravel(), np.repeat(amount[rows, k], width), total[i, k].size).reshape(total[i, k].shape)
        if total is not None:
            k, node, feature, cell = np.nonzero(total[1])
            yield pd.DataFrame({"class": k, "node": node + first, "feature": feature, "bin": cell, "g": total[0, k, node, feature, cell], "h": total[1, k, node, feature, cell]})
            if level == 0:
                yield pd.DataFrame({"class": [-1], "node": [0], "feature": [0], "bin": [0], "g": [loss], "h": [weight]})

    return sums


def _best_cuts(cells: DataFrame, smooth: float, least: float) -> DataFrame:
    """(class, node, g, h, gain, feature, cut): the cut of each node with the largest gain; ties to the first feature and bin."""
    whole = Window.partitionBy("class", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.groupBy("class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    rows = sums.select("class", "node", "feature", "bin", *[F.sum(c).over(w).alias(n) for n, c, w in (("gl", "g", upto), ("hl", "h", upto), ("g", "g", whole), ("h", "h", whole))])
    part = lambda g, h: g * g / (h + F.lit(smooth))
    gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
    gain = part(F.col("gl"), F.col("hl")) + part(gr, hr) - part(F.col("g"), F.col("h"))
    usable = (F.col("hl") >= least) & (hr >= least) & (gain > 1e-9)
    best = F.max(F.when(usable, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))))
    out = rows.groupBy("class", "node").agg(F.max_by("g", -F.col("feature")).alias("g"), F.max_by("h", -F.col("feature")).alias("h"), best.alias("best"))
    return out.select("class", "node", "g", "h", "best.gain", (-F.col("best.f")).alias("feature"), (-F.col("best.b")).alias("cut"))


def fit_boosted(df: DataFrame, columns: list[str], label: str, weight: str | None = None, rounds: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32, smooth: float = 1.0, least: float = 1.0) -> BoostedTrees:
    """Fit on the rows with a label and, where ``weight`` is named, a positive weight.

    ``rate`` shrinks each tree's leaves, ``smooth`` is added to a leaf's Hessian, ``least`` is the Hessian that either side of a cut needs.
    Null and NaN lie below all values. One label alone is always predicted; no labelled row, no column, a depth or a number of rounds below
    one are errors. Scores start from the classes' shares.
    """
    if not columns or depth < 1 or rounds < 1 or bins < 2:
        raise ValueError("needs a column, a level, a round and two bins")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*columns, F.col(label).alias("_label"), w.alias("w")).where("_label is not null and w > 0")
    shares = rows.groupBy("_label").agg(F.sum("w").alias("w")).orderBy("_label").collect()
    if not shares:
        raise ValueError("no row has a label")
    labels = [r["_label"] for r in shares]
    start = np.log([r["w"] / sum(s["w"] for s in shares) for r in shares])
    model = BoostedTrees(labels, columns, _edges(rows, columns, bins), start)

    @F.pandas_udf("array<short>")
    def to_bins(values: pd.Series) -> pd.Series:
        return pd.Series(list(binned(matrix(values, len(columns)), model.edges).astype("int16")))

    number = (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("_label")) - 1).cast("int")
    table = rows.select(to_bins(features(columns)).alias("bins"), number.alias("y"), "w", F.array(*[F.lit(float(x)) for x in start]).alias("scores"))
    table = written(table, "boosting")
    pending: list[Round] = []
    for _ in range(rounds):
        growing = Round.empty(len(labels), depth)
        for level in range(depth + 1):
            cells = table.mapInPandas(_histogram(pending, growing, level, (len(labels), len(columns))), CELLS)
            for cell in _best_cuts(cells, smooth, least).collect():
                k, node = cell["class"], cell["node"]
                if k < 0:
                    model.losses.append(cell["g"] / cell["h"])
                    continue
                growing.value[k, node] = -rate * cell["g"] / (cell["h"] + smooth)
                if level < depth and cell["feature"] is not None:
                    growing.feature[k, node], growing.cut[k, node] = cell["feature"], cell["cut"]
                    name = columns[cell["feature"]]
                    model.gains[name] = model.gains.get(name, 0.0) + cell["gain"]
        model.rounds.append(growing)
        pending.append(growing)
        if len(pending) == PENDING:
            table, pending = written(_written_down(table, pending, (len(labels), len(columns))), "boosting"), []
    return model


def _written_down(table: DataFrame, pending: list[Round], shape: tuple[int, int]) -> DataFrame:
    """The table with the scores of the rounds since the last time."""
    classes, width = shape

    @F.pandas_udf("array<double>")
    def later(bins: pd.Series, scores: pd.Series) -> pd.Series:
        b = matrix(bins, width).astype(int)
        return pd.Series(list(matrix(scores, classes) + sum(r.scores(b) for r in pending)))

    return table.withColumn("scores", later("bins", "scores"))
