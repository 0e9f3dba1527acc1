"""Evaluation metrics. Most are functions of one confusion table: (keys, gold, pred, freq).

The table is small whatever the input: one shuffle of pre-aggregated counts, after
which every metric is arithmetic over the label domain.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.nulls import differs, ratio, same
from talkmill.operators.ordering import average_rank_table

PARSE_FAIL = "PARSE_FAIL"


def confusion(df: DataFrame, keys: list[str], gold: str = "gold", pred: str = "pred", missing: str = PARSE_FAIL) -> DataFrame:
    """Counts by (keys, gold, pred); a missing prediction counts as ``missing``, that is as wrong."""
    return df.groupBy(*keys, F.col(gold).alias("gold"), F.coalesce(F.col(pred), F.lit(missing)).alias("pred")).agg(F.count("*").alias("freq"))


def confusion_matrix(table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    cells = [F.coalesce(F.sum(F.when(F.col("pred") == c, F.col("freq"))), F.lit(0)).alias(c) for c in columns]
    return table.groupBy(*keys, "gold").agg(*cells)


def accuracy(df: DataFrame, keys: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """n_total, n_valid (a prediction is there), and accuracy and mismatch rate over valid rows."""
    valid = F.col(pred).isNotNull()
    hit = F.when(valid, same(F.col(gold), F.col(pred)).cast("int"))
    out = df.groupBy(*keys).agg(F.count("*").alias("n_total"), F.count_if(valid).alias("n_valid"), F.avg(hit).alias("accuracy"))
    return out.withColumn("mismatch_rate", 1 - F.col("accuracy"))


def class_scores(table: DataFrame, keys: list[str], domain: list[str], low_support: int = 30) -> DataFrame:
    """Precision, recall, F1 and support of every class of the domain, 0 where undefined."""
    each = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("freq").alias("s"), F.lit(0).alias("p"), same(F.col("gold"), F.col("pred")).cast("long").alias("h")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("s"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("h"))))
    long = table.select(*keys, "freq", each.alias("e")).select(*keys, "freq", "e.*")
    sums = long.groupBy(*keys, "label").agg(F.sum("s").alias("support"), F.sum(F.col("freq") * F.col("p")).alias("predicted"), F.sum(F.col("freq") * F.col("h")).alias("hits"))
    # A key's classes are as many as the domain's, so one row can hold them all.
    known = F.collect_list(F.when(F.col("label").isin(domain), F.struct("label", F.struct("support", "predicted", "hits"))))
    found = sums.groupBy(*keys).agg(F.map_from_entries(known).alias("_m"))
    out = found.select(*keys, "_m", F.explode(F.array(*[F.lit(x) for x in domain])).alias("label"))
    out = out.withColumn("_c", F.try_element_at("_m", F.col("label")))
    out = out.select(*keys, "label", *[F.coalesce(F.col(f"_c.{c}"), F.lit(0)).alias(c) for c in ("support", "predicted", "hits")])
    p, r = F.coalesce(ratio(F.col("hits"), F.col("predicted")), F.lit(0.0)), F.coalesce(ratio(F.col("hits"), F.col("support")), F.lit(0.0))
    out = out.withColumns({"precision": p, "recall": r})
    f1 = F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumns({"f1": f1, "low_support": F.col("support") < low_support})


def macro_scores(scores: DataFrame, keys: list[str], observed_only: bool = False) -> DataFrame:
    """Macro and support-weighted F1; over the whole domain, or labels seen in gold or predictions."""
    if observed_only:
        scores = scores.where("support + predicted > 0")
    weighted = F.coalesce(ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0))
    return scores.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"), weighted.alias("weighted_f1"), F.avg("recall").alias("macro_recall"))


def one_vs_rest(df: DataFrame, keys: list[str], label: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Precision, recall and F1 of one label against all others, and (rest_...) of all others against it."""
    g, p = same(F.col(gold), F.lit(label)), same(F.col(pred), F.lit(label))
    out = df.groupBy(*keys).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    zero = F.lit(0.0)
    out = out.withColumns({"precision": F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), zero), "recall": F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), zero)})
    rest = {"rest_precision": ("tn", "fn"), "rest_recall": ("tn", "fp")}
    out = out.withColumns({name: F.coalesce(ratio(F.col(a), F.col(a) + F.col(b)), zero) for name, (a, b) in rest.items()})
    f1 = lambda hits: F.coalesce(ratio(2 * F.col(hits), 2 * F.col(hits) + F.col("fp") + F.col("fn")), zero)
    return out.withColumns({"f1": f1("tp"), "rest_f1": f1("tn")})


def out_of_taxonomy(table: DataFrame, keys: list[str], domain: list[str], missing: str = PARSE_FAIL) -> DataFrame:
    """(keys, n_missing, n_foreign, n): predictions that aren't there, or that no class of the domain is named like."""
    foreign = (F.col("pred") != missing) & ~F.col("pred").isin(domain)
    return table.groupBy(*keys).agg(F.sum(F.when(F.col("pred") == missing, F.col("freq")).otherwise(0)).alias("n_missing"), F.sum(F.when(foreign, F.col("freq")).otherwise(0)).alias("n_foreign"), F.sum("freq").alias("n"))


def compare_metrics(before: DataFrame, after: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """metric_before, metric_after, metric_delta and changed of the keys that both tables have."""
    side = lambda df, name: df.select(*keys, *[F.col(m).alias(f"{m}_{name}") for m in metrics])
    out = side(before, "before").join(side(after, "after"), keys)
    out = out.withColumns({f"{m}_delta": F.col(f"{m}_after") - F.col(f"{m}_before") for m in metrics})
    moved = [~F.col(f"{m}_before").eqNullSafe(F.col(f"{m}_after")) for m in metrics]
    return out.withColumn("changed", reduce(or_, moved))


def absorption(df: DataFrame, keys: list[str], gold_label: str, into: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """How much of one gold label goes to each of a few predictions."""
    rows = df.where(F.col(gold) == gold_label)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_gold"), *[F.count_if(same(F.col(pred), F.lit(x))).alias(f"to_{x}") for x in into])
    return out.withColumn("absorbed_rate", sum((F.col(f"to_{x}") for x in into), F.lit(0)) / F.col("n_gold"))


def delta(scores: DataFrame, keys: list[str], by: str, a: str, b: str, metrics: list[str]) -> DataFrame:
    """metric_delta = value under b less value under a, side by side in one shuffle."""
    pick = lambda m, x: F.max(F.when(F.col(by) == x, F.col(m)))
    out = scores.where(F.col(by).isin(a, b)).groupBy(*keys).agg(*[(pick(m, b) - pick(m, a)).alias(f"{m}_delta") for m in metrics])
    return out


def kappa(table: DataFrame, keys: list[str], domain: list[str], quadratic: bool = False) -> DataFrame:
    """Cohen's kappa over rows whose both labels are in the domain; null where chance agreement is complete."""
    at = F.create_map(*[x for i, d in enumerate(domain) for x in (F.lit(d), F.lit(i))])
    t = table.where(F.col("gold").isin(domain) & F.col("pred").isin(domain)).withColumns({"i": F.element_at(at, F.col("gold")), "j": F.element_at(at, F.col("pred"))})
    weight = (lambda i, j: ((i - j) * (i - j)) / F.lit(float((len(domain) - 1) ** 2))) if quadratic else (lambda i, j: (i != j).cast("double"))
    total = t.groupBy(*keys).agg(F.sum("freq").alias("total"), F.sum(F.col("freq") * weight(F.col("i"), F.col("j"))).alias("observed"))
    rows, cols = t.groupBy(*keys, "i").agg(F.sum("freq").alias("a")), t.groupBy(*keys, "j").agg(F.sum("freq").alias("b"))
    pairs = rows.join(cols, keys) if keys else rows.crossJoin(cols)
    expected = pairs.groupBy(*keys).agg(F.sum(F.col("a") * F.col("b") * weight(F.col("i"), F.col("j"))).alias("expected"))
    out = total.join(expected, keys) if keys else total.crossJoin(expected)
    # kappa = 1 - observed disagreement / expected disagreement
    value = 1 - ratio(F.col("observed") * F.col("total"), F.col("expected"))
    return out.select(*keys, F.col("total").alias("n_rated"), (1 - F.col("observed") / F.col("total")).alias("agreement"), value.alias("kappa"))


def auc(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """ROC AUC from average ranks; ranks come from counts of distinct scores, not from a sort of all rows."""
    ranked = average_rank_table(df, keys, score, F.sum(positive.cast("long")).alias("p"))
    out = ranked.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum(F.col("t") - F.col("p")).alias("n_neg"), F.sum(F.col("p") * F.col("rank")).alias("r"))
    value = ratio(F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0, F.col("n_pos") * F.col("n_neg"))
    return out.select(*keys, "n_pos", "n_neg", value.alias("auc"))


def change_class(gold: Column, before: Column, after: Column) -> Column:
    return F.when(same(before, after), "same").when(same(after, gold), "improved").when(same(before, gold), "worsened").otherwise("changed_irrelevant")


def improvement(df: DataFrame, keys: list[str], gold: str, before: str, after: str) -> DataFrame:
    """Improved, worsened and net counts of a change of predictions."""
    kind = change_class(F.col(gold), F.col(before), F.col(after))
    out = df.withColumn("_k", kind).groupBy(*keys).agg(*[F.count_if(F.col("_k") == k).alias(k) for k in ("same", "improved", "worsened", "changed_irrelevant")])
    return out.withColumn("net", F.col("improved") - F.col("worsened"))


def rescue_harm(df: DataFrame, layer: str, gold: str, base: str, new: str, fired: Column) -> DataFrame:
    """Where a trigger fires: wrong turned right, right turned wrong; by layer and in all."""
    ok = lambda c: same(F.col(c), F.col(gold))
    rows = df.withColumns({"_f": fired, "_b": ok(base), "_n": ok(new)})
    out = rows.groupingSets([[layer], []], layer).agg(
        F.grouping(layer).alias("_all"), F.count("*").alias("n"), F.count_if("_f").alias("n_triggered"), F.count_if(F.expr("_f and not _b and _n")).alias("rescue"), F.count_if(F.expr("_f and _b and not _n")).alias("harm")
    )
    return out.withColumns({layer: F.when(F.col("_all") == 1, "ALL").otherwise(F.col(layer)), "net": F.col("rescue") - F.col("harm")}).drop("_all")


def trigger_quality(df: DataFrame, fired: dict[str, Column], mismatch: Column) -> DataFrame:
    """Rate, precision and recall of each trigger against mismatches; one pass for all triggers."""
    each = F.explode(F.create_map(*[x for name, c in fired.items() for x in (F.lit(name), F.coalesce(c, F.lit(False)))])).alias("trigger_name", "fired")
    rows = df.select(F.coalesce(mismatch, F.lit(False)).alias("_m"), each)
    out = rows.groupBy("trigger_name").agg(F.count("*").alias("n"), F.count_if("fired").alias("n_triggered"), F.count_if(F.expr("fired and _m")).alias("hits"), F.count_if("_m").alias("n_mismatch"))
    zero = F.lit(0.0)
    return out.select("trigger_name", "n_triggered", (F.col("n_triggered") / F.col("n")).alias("rate"), F.coalesce(ratio(F.col("hits"), F.col("n_triggered")), zero).alias("precision"), F.coalesce(ratio(F.col("hits"), F.col("n_mismatch")), zero).alias("recall"))


def trigger_layers(df: DataFrame, fired: dict[str, Column], layer: str, excluded: str, covered: str, layers: list[str]) -> DataFrame:
    """Where triggers fire: share_{layer} of the fired rows, exclusion_rate of one layer and coverage of another; one pass."""
    each = F.explode(F.create_map(*[x for name, c in fired.items() for x in (F.lit(name), F.coalesce(c, F.lit(False)))])).alias("trigger_name", "fired")
    rows = df.select(F.col(layer).alias("_l"), each)
    out = rows.groupBy("trigger_name").agg(F.count_if("fired").alias("n_triggered"), *[F.count_if(F.col("fired") & (F.col("_l") == x)).alias(f"_f_{x}") for x in layers], *[F.count_if(F.col("_l") == x).alias(f"_n_{x}") for x in layers])
    shares = [F.coalesce(ratio(F.col(f"_f_{x}"), F.col("n_triggered")), F.lit(0.0)).alias(f"share_{x}") for x in layers]
    return out.select("trigger_name", "n_triggered", *shares, (1 - ratio(F.col(f"_f_{excluded}"), F.col(f"_n_{excluded}"))).alias("exclusion_rate"), ratio(F.col(f"_f_{covered}"), F.col(f"_n_{covered}")).alias("coverage"))


def threshold_sweep(df: DataFrame, score: str, positive: Column, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 of ``score >= threshold``; one scan, no copy of rows per threshold."""
    rows = df.select(F.col(score).alias("_s"), F.coalesce(positive, F.lit(False)).alias("_p"))
    aggs = [F.count_if("_p").alias("_pos")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(F.expr(f"_s >= {t}D")).alias(f"k{i}"), F.count_if(F.expr(f"_s >= {t}D and _p")).alias(f"h{i}")]
    lines = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"k{i}").alias("n_flagged"), F.col(f"h{i}").alias("hits")) for i, t in enumerate(thresholds)]))
    out = rows.agg(*aggs).select("_pos", lines.alias("x")).select("_pos", "x.*")
    zero = F.lit(0.0)
    out = out.withColumns({"precision": F.coalesce(ratio(F.col("hits"), F.col("n_flagged")), zero), "recall": F.coalesce(ratio(F.col("hits"), F.col("_pos")), zero)})
    return out.withColumn("f1", F.coalesce(ratio(2 * F.col("hits"), F.col("n_flagged") + F.col("_pos")), zero)).drop("_pos")


def mismatches(df: DataFrame, gold: str, pred: str, null_differs: bool) -> DataFrame:
    return df.where(differs(F.col(gold), F.col(pred), null_differs))
