"""Small probes on pyspark.ml: scaled logistic regression, trees, TF-IDF, frozen cuts."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.text import entropy
from talkmill.operators.ordering import exact_quantiles
from talkmill.operators.sampling import stratified_folds


#: Rows that a task of a round learns from: a model has hundreds of rounds, each of several jobs.
ROWS_A_TASK = 50_000


def from_array(df: DataFrame, column: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(column).cast("array<double>")))


def assembled(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="skip").transform(df)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """weight = rows / (classes * rows of the class). Counts per class are joined back."""
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    all_rows = Window.partitionBy()  # one row a class
    table = counts.select(label, (F.sum("_c").over(all_rows) / (F.count(F.lit(1)).over(all_rows) * F.col("_c"))).alias("weight"))
    return df.join(F.broadcast(table), label)


def scaled_logistic(label: str, c: float = 1.0, rows: int = 1) -> Pipeline:
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    return Pipeline(stages=[scaler, LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", regParam=1 / (c * max(rows, 1)), maxIter=50)])


def cross_validated(df: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """Out-of-fold probabilities; scaling is fitted inside each fold. Rows: key, fold, label, proba."""
    rows = balanced_weights(stratified_folds(df, label, key, k), label)
    out = None
    for fold in range(k):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        model = scaled_logistic(label, rows=train.count()).fit(train)
        part = model.transform(test).select(key, "fold", label, vector_to_array("probability")[1].alias("proba"))
        out = part if out is None else out.unionByName(part)
    return out


def importances(df: DataFrame, columns: list[str], label: str, trees: int = 200, depth: int = 4) -> DataFrame:
    """(feature, importance) of boosted trees, largest first.

    Each round reads all that is learned from, so equal rows are learned from as one, weighted by their number.
    """
    cells = df.groupBy(*columns, label).agg(F.count("*").cast("double").alias("_weight")).persist()
    try:
        model = GBTClassifier(featuresCol="features", labelCol=label, weightCol="_weight", maxIter=trees, maxDepth=depth, seed=42).fit(assembled(cells.coalesce(max(1, -(-cells.count() // ROWS_A_TASK))), columns))
    finally:
        cells.unpersist()
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def tfidf_entropy(df: DataFrame, key: str, text: str, label: str, words: int = 3000, min_docs: int = 2) -> DataFrame:
    """Entropy of the class probabilities of a TF-IDF logistic regression."""
    stages = [
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+"),
        CountVectorizer(inputCol="_words", outputCol="_counts", vocabSize=words, minDF=min_docs),
        IDF(inputCol="_counts", outputCol="_tfidf"),
        LogisticRegression(featuresCol="_tfidf", labelCol="_y", maxIter=20, regParam=0.01),
    ]
    rows = Pipeline(stages=stages).fit(df).transform(df)
    return rows.select(key, entropy(vector_to_array("probability")).alias("entropy"))


def frozen_levels(train: DataFrame, df: DataFrame, score: str, shares: dict[str, float], lowest: str) -> DataFrame:
    """Levels by the training rows' quantiles, applied unchanged to others."""
    cuts = exact_quantiles(train, [], score, {f"_{name}": q for name, q in shares.items()})
    out = F.coalesce(*[F.when(F.col(score) >= F.col(f"_{name}"), name) for name in shares], F.lit(lowest))
    return df.crossJoin(F.broadcast(cuts)).withColumn("gate_level", out).select(*df.columns, "gate_level")


def majority(df: DataFrame, label: str) -> DataFrame:
    """The dummy's answer: the most frequent label, ties to the smallest."""
    return df.groupBy(label).count().orderBy(F.desc("count"), label).limit(1)


def stratified_guess(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """The dummy that draws each answer with the labels' shares, by a hash of the key: adds ``guess``."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_c"))
    order = Window.orderBy(label)  # one row a class
    upto = F.sum("_c").over(order) / F.sum("_c").over(Window.partitionBy())
    shares = counts.select(F.struct(upto.alias("upto"), F.col(label).alias("label")).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("_shares"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    hit = F.get(F.filter("_shares", lambda s: draw < s["upto"]), F.lit(0))["label"]
    return df.crossJoin(F.broadcast(shares)).withColumn("guess", hit).drop("_shares")


def coefficients(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, coefficient) of a scaled logistic regression, largest in size first."""
    rows = balanced_weights(assembled(df, columns), label)
    model = scaled_logistic(label, rows=rows.count()).fit(rows)
    found = [(c, float(v)) for c, v in zip(columns, model.stages[-1].coefficients.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(found, "feature string, coefficient double").orderBy(F.desc(F.abs("coefficient")))
