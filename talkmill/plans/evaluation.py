"""Queries over predictions: metrics, tests, triggers, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions.nulls import half_even
from talkmill.operators import aggregate as agg
from talkmill.operators import boosting, joins, ml, policy, sampling, stats
from talkmill.operators import metrics as M
from talkmill.operators.ordering import exact_quantiles
from talkmill.plans.catalog import query
from talkmill.plans.common import LAB, PRED, SCORES, WIDE, choose, correlation_tail, hash_order, normal_tail
from talkmill.shipping import ship
from talkmill.sources.adapters import FOCUS, LABELS, acoustic, predictions, table, wide_predictions

R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]
LAYERS = """ly AS (SELECT *, (SELECT quantile_cont(tokens, 0.2) FROM wide WHERE a2 IS NOT NULL) AS cut FROM wide WHERE a2 IS NOT NULL),
lf AS (SELECT *, a2 <> gold AND coalesce(a5 = gold, false) AS unlock, NOT coalesce(a2 = a5, false) AS shift, tokens <= cut AS short FROM ly),
lay AS (SELECT *, unlock OR (shift AND short) AS is_infopoor, CASE WHEN a2 = gold THEN 'already_correct' WHEN unlock OR (shift AND short) THEN 'infopoor' ELSE 'sufficient' END AS layer FROM lf)"""


@query(
    f"""WITH {PRED} SELECT condition, n, count(*) AS n_total, count(pred) AS n_valid, round(avg(CASE WHEN pred IS NOT NULL THEN (pred = gold)::INTEGER END), 6) AS accuracy,
round(1 - avg(CASE WHEN pred IS NOT NULL THEN (pred = gold)::INTEGER END), 6) AS mismatch_rate FROM pred GROUP BY condition, n"""
)
def condition_accuracy(spark, d):
    out = M.accuracy(predictions(spark, d), ["condition", "n"])
    return out.select("condition", "n", "n_total", "n_valid", *R6("accuracy", "mismatch_rate"))


@query(f"WITH {WIDE} SELECT 'drop' AS null_policy, count(*) FILTER (WHERE a1 <> gold) AS n FROM wide UNION ALL SELECT 'differs', count(*) FILTER (WHERE NOT coalesce(a1 = gold, false)) FROM wide")
def mismatch_subset(spark, d):
    w = wide_predictions(spark, d)
    one = lambda keep: M.mismatches(w, "gold", "a1", keep).agg(F.lit("differs" if keep else "drop").alias("null_policy"), F.count("*").alias("n"))
    return one(False).union(one(True))


@query(
    f"""WITH {PRED}, m AS (SELECT gold FROM pred WHERE condition = 'A' AND n = 1 AND pred <> gold), c AS (SELECT unnest({LAB}) AS value)
SELECT value, (SELECT count(*) FROM m WHERE gold = value) AS n, round_even((SELECT count(*) FROM m WHERE gold = value) / (SELECT nullif(count(*), 0) FROM m) * 100 * 100, 0) / 100 AS share_pct FROM c"""
)
def mismatch_labels(spark, d):
    """Gold labels of the mismatched calls, with shares as they are displayed."""
    rows = M.mismatches(predictions(spark, d).where("condition = 'A' AND n = 1"), "gold", "pred", False)
    return agg.value_counts(rows, "gold", LABELS).select("value", "n", half_even(F.col("share") * 100, 2).alias("share_pct"))


@query(f"WITH {PRED} SELECT condition, n, gold, " + ", ".join(f"count(*) FILTER (WHERE coalesce(pred, 'PARSE_FAIL') = '{x}') AS {x}" for x in [*LABELS, "PARSE_FAIL"]) + " FROM pred GROUP BY condition, n, gold")
def confusion_matrix(spark, d):
    return M.confusion_matrix(M.confusion(predictions(spark, d), ["condition", "n"]), ["condition", "n"], [*LABELS, M.PARSE_FAIL])


_T = "t AS (SELECT condition || n AS k, gold, pred FROM pred)"


def _scores(spark, d):
    rows = predictions(spark, d).withColumn("k", F.concat("condition", F.col("n").cast("string")))
    return M.class_scores(M.confusion(rows, ["k"]), ["k"], LABELS)


@query(f"WITH {PRED}, {_T}, {SCORES} SELECT k, label, support, predicted, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support < 30 AS low_support FROM f")
def prf_by_class(spark, d):
    return _scores(spark, d).select("k", "label", "support", "predicted", "hits", *R6("precision", "recall", "f1"), "low_support")


@query(f"WITH {PRED}, {_T}, {SCORES} SELECT k, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(recall), 6) AS macro_recall FROM f GROUP BY k")
def macro_weighted_f1(spark, d):
    return M.macro_scores(_scores(spark, d), ["k"]).select("k", *R6("macro_f1", "weighted_f1", "macro_recall"))


@query(f"WITH {PRED}, t AS (SELECT condition || n AS k, gold, pred FROM pred WHERE gold IN ('complaint', 'service_use') AND coalesce(pred, 'x') IN ('complaint', 'service_use', 'x')), {SCORES} SELECT k, round(avg(f1), 6) AS macro_f1 FROM f WHERE support + predicted > 0 GROUP BY k")
def macro_f1_observed(spark, d):
    some = ["complaint", "service_use"]
    rows = predictions(spark, d).where(F.col("gold").isin(some) & F.coalesce(F.col("pred").isin(some), F.lit(True))).withColumn("k", F.concat("condition", F.col("n").cast("string")))
    return M.macro_scores(M.class_scores(M.confusion(rows, ["k"]), ["k"], LABELS), ["k"], observed_only=True).select("k", *R6("macro_f1"))


@query(
    f"""WITH {PRED}, b AS (SELECT condition, n, gold = 'complaint' AS g, coalesce(pred = 'complaint', false) AS p FROM pred),
c AS (SELECT condition, n, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn, count(*) FILTER (WHERE NOT g AND NOT p) AS tn FROM b GROUP BY ALL)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS rest_precision, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS rest_recall, round(coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0), 6) AS rest_f1 FROM c"""
)
def binary_focus(spark, d):
    out = M.one_vs_rest(predictions(spark, d), ["condition", "n"], FOCUS)
    return out.select("condition", "n", "tp", "fp", "fn", "tn", *R6("precision", "recall", "f1", "rest_precision", "rest_recall", "rest_f1"))


@query(
    f"""WITH {PRED} SELECT condition, n, count(*) AS n_gold, count(*) FILTER (WHERE pred = 'refund_request') AS to_refund_request, count(*) FILTER (WHERE pred = 'delivery_check') AS to_delivery_check,
round(count(*) FILTER (WHERE pred IN ('refund_request', 'delivery_check')) / count(*), 6) AS absorbed_rate FROM pred WHERE gold = 'complaint' GROUP BY condition, n"""
)
def focus_absorption(spark, d):
    out = M.absorption(predictions(spark, d), ["condition", "n"], FOCUS, ["refund_request", "delivery_check"])
    return out.select("condition", "n", "n_gold", "to_refund_request", "to_delivery_check", *R6("absorbed_rate"))


@query(
    f"""WITH {PRED}, {_T}, {SCORES}, a AS (SELECT right(k, 1) AS n, left(k, 1) AS c, label, precision, recall, f1 FROM f)
SELECT x.n, x.label, round(y.precision - x.precision, 6) AS precision_delta, round(y.recall - x.recall, 6) AS recall_delta, round(y.f1 - x.f1, 6) AS f1_delta,
 y.recall > x.recall AND y.precision < x.precision AS trigger_happy FROM a x JOIN a y ON x.n = y.n AND x.label = y.label AND x.c = 'C' AND y.c = 'D'"""
)
def acoustic_delta(spark, d):
    s = _scores(spark, d).select(F.right("k", F.lit(1)).alias("n"), F.left("k", F.lit(1)).alias("c"), "label", "precision", "recall", "f1")
    out = M.delta(s, ["n", "label"], "c", "C", "D", ["precision", "recall", "f1"])
    return out.select("n", "label", *R6("precision_delta", "recall_delta", "f1_delta"), F.expr("recall_delta > 0 and precision_delta < 0").alias("trigger_happy"))


@query(f"WITH {WIDE} SELECT gold, round(avg(coalesce(a2 = gold, false)::INTEGER), 6) AS acc_text, round(avg(coalesce(b2 = gold, false)::INTEGER), 6) AS acc_acoustic, round(avg(coalesce(b2 = gold, false)::INTEGER) - avg(coalesce(a2 = gold, false)::INTEGER), 6) AS effect FROM wide GROUP BY gold")
def per_label_effect(spark, d):
    hit = lambda c: F.avg(F.coalesce(F.col(c) == F.col("gold"), F.lit(False)).cast("int"))
    out = wide_predictions(spark, d).groupBy("gold").agg(hit("a2").alias("acc_text"), hit("b2").alias("acc_acoustic"))
    return out.withColumn("effect", F.col("acc_acoustic") - F.col("acc_text")).select("gold", *R6("acc_text", "acc_acoustic", "effect"))


@query(
    f"""WITH {WIDE}, k AS (SELECT CASE WHEN coalesce(a1 = a5, false) THEN 'same' WHEN coalesce(a5 = gold, false) THEN 'improved' WHEN coalesce(a1 = gold, false) THEN 'worsened' ELSE 'changed_irrelevant' END AS k, segment FROM wide)
SELECT segment, count(*) FILTER (WHERE k = 'same') AS same, count(*) FILTER (WHERE k = 'improved') AS improved, count(*) FILTER (WHERE k = 'worsened') AS worsened, count(*) FILTER (WHERE k = 'changed_irrelevant') AS changed_irrelevant,
count(*) FILTER (WHERE k = 'improved') - count(*) FILTER (WHERE k = 'worsened') AS net FROM k GROUP BY segment"""
)
def before_after(spark, d):
    return M.improvement(wide_predictions(spark, d), ["segment"], "gold", "a1", "a5")


def _kappa_sql(weight: str) -> str:
    return f"""WITH {PRED}, t AS (SELECT condition, n, list_position({LAB}, gold) AS i, list_position({LAB}, pred) AS j FROM pred WHERE pred IS NOT NULL),
o AS (SELECT condition, n, count(*) AS m, sum({weight})::DOUBLE AS o FROM t GROUP BY ALL),
r AS (SELECT condition, n, i, count(*) AS a FROM t GROUP BY ALL), c AS (SELECT condition, n, j, count(*) AS b FROM t GROUP BY ALL),
e AS (SELECT condition, n, sum(a * b * {weight})::DOUBLE AS e FROM r JOIN c USING (condition, n) GROUP BY ALL)
SELECT condition, n, m AS rows_rated, round(1 - o / m, 6) AS agreement, round(1 - o * m / nullif(e, 0), 6) AS kappa FROM o JOIN e USING (condition, n)"""


def _kappa(spark, d, quadratic):
    out = M.kappa(M.confusion(predictions(spark, d).where("pred is not null"), ["condition", "n"]), ["condition", "n"], LABELS, quadratic)
    return out.select("condition", "n", F.col("n_rated").alias("rows_rated"), *R6("agreement", "kappa"))


@query(_kappa_sql("(i <> j)::INTEGER"))
def kappa(spark, d):
    return _kappa(spark, d, False)


@query(_kappa_sql("((i - j) * (i - j) / 36.0)"))
def kappa_quadratic(spark, d):
    return _kappa(spark, d, True)


@query(
    f"""WITH {WIDE}, t AS (SELECT a3, c3 FROM wide WHERE a3 IS NOT NULL AND c3 IS NOT NULL), o AS (SELECT count(*) AS n, count(*) FILTER (WHERE a3 = c3) AS n_same FROM t),
e AS (SELECT sum(x.n * y.n)::DOUBLE AS e FROM (SELECT a3, count(*) AS n FROM t GROUP BY 1) x JOIN (SELECT c3, count(*) AS n FROM t GROUP BY 1) y ON x.a3 = y.c3)
SELECT n, n_same, round(n_same / n, 6) AS agreement, round((n_same / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM o, e"""
)
def self_consistency(spark, d):
    pairs = joins.paired(predictions(spark, d).where("n = 3 and pred is not null"), ["call_id"], "condition", "A", "C", "pred")
    out = M.kappa(M.confusion(pairs, [], "pred_a", "pred_b"), [], LABELS)
    return out.select(F.col("n_rated").alias("n"), F.round(F.col("agreement") * F.col("n_rated")).cast("long").alias("n_same"), *R6("agreement", "kappa"))


@query(
    """WITH t AS (SELECT l.quality, d.n_chars, d.lang FROM labels l JOIN documents d USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rk FROM t)
SELECT lang, sum(quality)::BIGINT AS n_pos, sum(1 - quality)::BIGINT AS n_neg, round((sum(rk * quality) - sum(quality) * (sum(quality) + 1) / 2.0) / nullif(sum(quality) * sum(1 - quality), 0), 6) AS auc FROM r GROUP BY lang"""
)
def auc_rank(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return M.auc(rows, ["lang"], "n_chars", F.col("quality") == 1).select("lang", "n_pos", "n_neg", *R6("auc"))


_MW_EXACT = """WITH t AS (SELECT l.toxic, d.n_chars FROM labels l JOIN documents d USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM t),
k AS (SELECT sum((c * c * c - c)::DOUBLE) AS ties FROM (SELECT count(*) AS c FROM t GROUP BY n_chars)),
s AS (SELECT sum(toxic)::DOUBLE AS n1, sum(1 - toxic)::DOUBLE AS n2, sum(rk * toxic) AS r1 FROM r)
SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, r1 - n1 * (n1 + 1) / 2 AS u, (abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s, k"""


@query(f"SELECT n1, n2, round(u, 6) AS u, round(z, 6) AS z FROM ({_MW_EXACT})")
def mann_whitney_u(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return stats.mann_whitney(rows, [], "n_chars", F.col("toxic") == 1).select("n1", "n2", *R6("u", "z"))


_CORR_EXACT = """WITH t AS (SELECT value AS x, (props::JSON->>'$.k')::DOUBLE AS y FROM events), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM t)
SELECT count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM r"""


@query(f"SELECT n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM ({_CORR_EXACT})")
def pearson_spearman(spark, d):
    return stats.correlations(acoustic(spark, d), "x", "k").select("n", *R6("pearson", "spearman"))


_CELLS = f"{WIDE}, c AS (SELECT segment, count(*) FILTER (WHERE x AND y) AS n11, count(*) FILTER (WHERE x AND NOT y) AS n10, count(*) FILTER (WHERE NOT x AND y) AS n01, count(*) FILTER (WHERE NOT x AND NOT y) AS n00 FROM (SELECT segment, coalesce(c5 = gold, false) AS x, coalesce(d5 = gold, false) AS y FROM wide WHERE c5 IS NOT NULL AND d5 IS NOT NULL) GROUP BY segment)"


@query(f"WITH {_CELLS} SELECT *, round((abs(n10 - n01) - 1) * (abs(n10 - n01) - 1) / nullif(n10 + n01, 0)::DOUBLE, 6) AS chi2_cc FROM c")
def mcnemar_cells(spark, d):
    out = stats.mcnemar_cells(wide_predictions(spark, d), ["segment"], "gold", "c5", "d5")
    return out.select("segment", "n11", "n10", "n01", "n00", *R6("chi2_cc"))


_EXACT = f"least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(n10, n01) + 1), lambda i: exp({choose('(n10 + n01)', 'i')} - (n10 + n01) * ln(2.0::DOUBLE)))))"


@query(
    f"""WITH {_CELLS}, s AS (SELECT segment, n10, n01, least(n10, n01) < 25 AS exact, CASE WHEN n10 + n01 = 0 THEN NULL WHEN least(n10, n01) < 25 THEN least(n10, n01)::DOUBLE ELSE (abs(n10 - n01) - 1)::DOUBLE * (abs(n10 - n01) - 1) / (n10 + n01) END AS stat FROM c)
SELECT segment, n10, n01, round(stat, 6) AS statistic, round(CASE WHEN exact THEN {_EXACT} ELSE {normal_tail("sqrt(stat)")} END, 6) AS p_value, exact FROM s"""
)
def mcnemar_test(spark, d):
    ship(spark)
    out = stats.mcnemar(stats.mcnemar_cells(wide_predictions(spark, d), ["segment"], "gold", "c5", "d5"), ["segment"])
    return out.select("segment", "n10", "n01", *R6("statistic", "p_value"), "exact")


@query()
def bootstrap_ci(spark, d):
    ship(spark)
    return stats.bootstrap_difference(stats.mcnemar_cells(wide_predictions(spark, d), ["segment"], "gold", "c5", "d5"), ["segment"])


_YATES = """WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS a, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS d FROM labels),
x AS (SELECT *, (a + b + c + d)::DOUBLE AS n, greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0)::DOUBLE AS gap FROM c)
SELECT a, b, c, d, n * gap * gap / nullif((a + b)::DOUBLE * (c + d) * (a + c) * (b + d), 0) AS chi2_yates, least(a + b, c + d)::DOUBLE * least(a + c, b + d) / n AS min_expected FROM x"""


@query(f"SELECT a, b, c, d, round(chi2_yates, 6) AS chi2_yates, round(min_expected, 6) AS min_expected FROM ({_YATES})")
def yates_chi2(spark, d):
    cells = stats.two_by_two(table(spark, d, "labels"), [], F.col("quality") == 1, F.col("toxic") == 1)
    return cells.select("a", "b", "c", "d", *R6("chi2_yates", "min_expected"))


def _table_weight(i: str) -> str:
    """SQL: logarithm of the chance of the table whose first cell is i."""
    return f"({choose('(a + b)', i)} + {choose('(c + d)', f'(a + c - {i})')} - {choose('(a + b + c + d)', '(a + c)')})"


_FISHER = f"list_sum(list_transform(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda i: CASE WHEN {_table_weight('i')} <= {_table_weight('a')} + 1e-9 THEN exp({_table_weight('i')}) ELSE 0 END))"


@query(
    f"""WITH y AS ({_YATES})
SELECT a, b, c, d, round(CASE WHEN min_expected < 5 THEN {_FISHER} ELSE {normal_tail("sqrt(chi2_yates)")} END, 6) AS p_value, CASE WHEN min_expected < 5 THEN 'fisher' ELSE 'chi2' END AS test FROM y"""
)
def two_by_two_test(spark, d):
    ship(spark)
    out = stats.two_by_two_test(stats.two_by_two(table(spark, d, "labels"), [], F.col("quality") == 1, F.col("toxic") == 1))
    return out.select("a", "b", "c", "d", *R6("p_value"), "test")


def _layers(spark, d):
    rows = wide_predictions(spark, d).where("a2 is not null")
    cut = exact_quantiles(rows, [], "tokens", {"cut": 0.2})
    flags = policy.layer_flags(F.col("gold"), F.col("a2"), F.col("a5"), F.col("tokens"), F.col("cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumns(flags).drop("cut")


@query(f"WITH {WIDE}, {LAYERS} SELECT call_id, unlock, shift, short, is_infopoor, layer FROM lay")
def layers(spark, d):
    return _layers(spark, d).select("call_id", "unlock", "shift", "short", "is_infopoor", "layer")


@query(
    f"""WITH {WIDE}, {LAYERS}, m AS (SELECT *, len(list_distinct(list_filter([a1, a2, a3, a5], lambda v: v IS NOT NULL))) >= 2 AS moves, proba > 0.8 AS sure FROM lay),
e AS (SELECT gold <> a2 AS mm, unnest(['shift', 'trajectory', 'entropy', 'combo', 'shift_not_short', 'trajectory_not_short']) AS trigger_name, unnest([shift, moves, sure, moves AND sure, shift AND NOT short, moves AND NOT short]) AS fired FROM m)
SELECT trigger_name, count(*) FILTER (WHERE fired) AS n_triggered, round(count(*) FILTER (WHERE fired) / count(*), 6) AS rate, round(coalesce(count(*) FILTER (WHERE fired AND mm) / nullif(count(*) FILTER (WHERE fired), 0), 0), 6) AS precision,
round(coalesce(count(*) FILTER (WHERE fired AND mm) / nullif(count(*) FILTER (WHERE mm), 0), 0), 6) AS recall FROM e GROUP BY trigger_name"""
)
def trigger_quality(spark, d):
    rows = _layers(spark, d)
    fired = policy.triggers(["a1", "a2", "a3", "a5"], "a2", "a5", F.col("proba") > 0.8, F.col("short"))
    return M.trigger_quality(rows, fired, F.col("gold") != F.col("a2")).select("trigger_name", "n_triggered", *R6("rate", "precision", "recall"))


@query(
    f"""WITH {WIDE}, {LAYERS} SELECT coalesce(layer, 'ALL') AS layer, count(*) AS n, count(*) FILTER (WHERE shift) AS n_triggered, count(*) FILTER (WHERE shift AND NOT coalesce(a2 = gold, false) AND coalesce(d5 = gold, false)) AS rescue,
count(*) FILTER (WHERE shift AND coalesce(a2 = gold, false) AND NOT coalesce(d5 = gold, false)) AS harm,
count(*) FILTER (WHERE shift AND NOT coalesce(a2 = gold, false) AND coalesce(d5 = gold, false)) - count(*) FILTER (WHERE shift AND coalesce(a2 = gold, false) AND NOT coalesce(d5 = gold, false)) AS net FROM lay GROUP BY GROUPING SETS ((layer), ())"""
)
def rescue_harm(spark, d):
    return M.rescue_harm(_layers(spark, d), "layer", "gold", "a2", "d5", F.col("shift"))


@query(f"WITH {WIDE}, {LAYERS} SELECT layer, count(*) FILTER (WHERE CASE WHEN shift THEN d5 ELSE a2 END = gold) AS hybrid_hits, count(*) FILTER (WHERE CASE WHEN a2 <> gold THEN d5 ELSE a2 END = gold) AS oracle_hits, count(*) FILTER (WHERE CASE WHEN proba > 0.6 THEN 'complaint' ELSE a2 END = gold) AS override_hits FROM lay GROUP BY layer")
def hybrid_policy(spark, d):
    g = F.col("gold")
    rows = _layers(spark, d)
    return rows.groupBy("layer").agg(
        F.count_if(policy.hybrid(F.col("shift"), F.col("d5"), F.col("a2")) == g).alias("hybrid_hits"), F.count_if(policy.hybrid(F.col("a2") != g, F.col("d5"), F.col("a2")) == g).alias("oracle_hits"), F.count_if(policy.override(F.col("proba"), 0.6, FOCUS, F.col("a2")) == g).alias("override_hits")
    )


@query(f"WITH {WIDE} SELECT call_id, CASE WHEN d5 IS DISTINCT FROM 'complaint' THEN d5 WHEN c5 = 'complaint' OR c5 IS NULL OR score IS NULL OR score >= 20 THEN 'complaint' ELSE c5 END AS strong_first, CASE WHEN c5 IS NULL THEN d5 WHEN c5 = 'complaint' THEN c5 WHEN d5 = 'complaint' AND score >= 20 THEN 'complaint' ELSE c5 END AS neutral_first, CASE WHEN d5 IS DISTINCT FROM 'complaint' THEN d5 WHEN c5 = 'complaint' OR c5 IS NULL THEN 'complaint' WHEN verdict = 'REVERT' THEN c5 ELSE 'complaint' END AS verified, CASE WHEN coalesce(a5 = 'complaint', false) THEN coalesce(b5, a5) ELSE a5 END AS two_stage FROM (SELECT *, CASE WHEN call_id % 5 > 0 THEN tokens END AS score, CASE call_id % 3 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'REVERT' END AS verdict FROM wide)")
def score_gates(spark, d):
    c = F.col
    score = F.when(c("call_id") % 5 > 0, c("tokens"))
    verdict = F.when(c("call_id") % 3 == 0, "KEEP").when(c("call_id") % 3 == 1, "REVERT")
    return wide_predictions(spark, d).select(
        "call_id", policy.score_gate(c("d5"), c("c5"), score, 20, FOCUS).alias("strong_first"), policy.score_gate(c("d5"), c("c5"), score, 20, FOCUS, False).alias("neutral_first"), policy.verdict_gate(c("d5"), c("c5"), verdict, FOCUS).alias("verified"), policy.reclassify(c("a5"), c("b5"), FOCUS).alias("two_stage")
    )


_SWEEP = [round(0.1 * i, 1) for i in range(1, 10)]


@query(
    f"""WITH {WIDE}, th AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _SWEEP)}]) AS threshold), s AS (SELECT threshold, count(*) FILTER (WHERE proba >= threshold) AS n_flagged, count(*) FILTER (WHERE proba >= threshold AND gold = 'complaint') AS hits, count(*) FILTER (WHERE gold = 'complaint') AS pos FROM wide, th GROUP BY threshold)
SELECT threshold, n_flagged, hits, round(coalesce(hits / nullif(n_flagged, 0), 0), 6) AS precision, round(coalesce(hits / nullif(pos, 0), 0), 6) AS recall, round(coalesce(2 * hits / nullif(n_flagged + pos, 0), 0), 6) AS f1 FROM s"""
)
def threshold_sweep(spark, d):
    return M.threshold_sweep(wide_predictions(spark, d), "proba", F.col("gold") == FOCUS, _SWEEP).select("threshold", "n_flagged", "hits", *R6("precision", "recall", "f1"))


@query(f"WITH {WIDE} SELECT segment, count(*) FILTER (WHERE gold <> 'complaint' AND d5 = 'complaint') AS false_alarms, count(*) FILTER (WHERE gold = 'complaint' AND a5 = 'complaint' AND NOT coalesce(d5 = 'complaint', false)) AS violations, count(*) AS n FROM wide GROUP BY segment")
def safety_counts(spark, d):
    alarm = F.expr(f"gold <> '{FOCUS}' and d5 = '{FOCUS}'")
    lost = F.expr(f"gold = '{FOCUS}' and a5 = '{FOCUS}' and not coalesce(d5 = '{FOCUS}', false)")
    return wide_predictions(spark, d).groupBy("segment").agg(F.count_if(alarm).alias("false_alarms"), F.count_if(lost).alias("violations"), F.count("*").alias("n"))


@query(f"WITH {WIDE} SELECT segment, round(avg(tokens) FILTER (WHERE a5 = 'complaint'), 6) AS caught_tokens, round(avg(tokens) FILTER (WHERE NOT coalesce(a5 = 'complaint', false)), 6) AS missed_tokens, count(*) AS n FROM wide WHERE gold = 'complaint' GROUP BY segment")
def feature_profile(spark, d):
    caught = F.coalesce(F.col("a5") == FOCUS, F.lit(False))
    rows = wide_predictions(spark, d).where(F.col("gold") == FOCUS)
    return rows.groupBy("segment").agg(F.round(F.avg(F.when(caught, F.col("tokens"))), 6).alias("caught_tokens"), F.round(F.avg(F.when(~caught, F.col("tokens"))), 6).alias("missed_tokens"), F.count("*").alias("n"))


@query(f"WITH {WIDE} SELECT segment, sum(tokens)::BIGINT AS input_tokens, count(*) * 12 AS output_tokens, round((sum(tokens) * 0.15 + count(*) * 12 * 0.6) / 1000000.0 * 0.5, 9) AS cost FROM wide GROUP BY segment")
def token_cost(spark, d):
    out = wide_predictions(spark, d).groupBy("segment").agg(F.sum("tokens").alias("input_tokens"), (F.count("*") * 12).alias("output_tokens"))
    return out.withColumn("cost", F.round((F.col("input_tokens") * 0.15 + F.col("output_tokens") * 0.6) / 1e6 * 0.5, 9))


@query("SELECT o_orderpriority AS segment, round(stddev_samp(a) / avg(a), 6) AS cv FROM (SELECT o_orderpriority, o_orderkey % 5 AS fold, avg(o_totalprice) AS a FROM orders GROUP BY ALL) GROUP BY 1")
def fold_variation(spark, d):
    folds = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("segment"), (F.col("o_orderkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("a"))
    return folds.groupBy("segment").agg(F.round(F.stddev_samp("a") / F.avg("a"), 6).alias("cv"))


@query(f"WITH u AS ({_MW_EXACT}) SELECT n1, n2, round(u, 6) AS u, round(z, 6) AS z, round({normal_tail('greatest(z, 0)')}, 6) AS p_value FROM u")
def mann_whitney_test(spark, d):
    ship(spark)
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return stats.mann_whitney_test(stats.mann_whitney(rows, [], "n_chars", F.col("toxic") == 1), []).select("n1", "n2", *R6("u", "z", "p_value"))


@query(f"WITH f AS ({_CORR_EXACT}) SELECT n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round({correlation_tail('pearson', 'n')}, 6) AS pearson_p, round({correlation_tail('spearman', 'n')}, 6) AS spearman_p FROM f")
def correlation_tests(spark, d):
    ship(spark)
    return stats.correlation_tests(stats.correlations(acoustic(spark, d), "x", "k")).select("n", *R6("pearson", "spearman", "pearson_p", "spearman_p"))


@query(
    f"""WITH f AS (SELECT lang, count(*) AS n, corr((l.toxic = 1)::DOUBLE, d.n_chars) AS r FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IS NOT NULL AND d.n_chars IS NOT NULL GROUP BY lang)
SELECT lang, n, round(CASE WHEN isnan(r) THEN NULL ELSE r END, 6) AS r, round({correlation_tail('r', 'n')}, 6) AS p_value FROM f"""
)
def point_biserial(spark, d):
    ship(spark)
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return stats.point_biserial(rows, ["lang"], F.col("toxic") == 1, "n_chars").select("lang", "n", *R6("r", "p_value"))


_AUC = "(SELECT (sum(rk * quality) - sum(quality) * (sum(quality) + 1) / 2.0) / nullif(sum(quality) * sum(1 - quality), 0) FROM (SELECT quality, rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS rk FROM t))"


@query(
    f"""WITH t AS (SELECT l.quality, d.n_chars, d.doc_id % 97 AS spread FROM labels l JOIN documents d USING (doc_id)), a AS (SELECT 'n_chars' AS name, {_AUC.format('n_chars')} AS auc UNION ALL SELECT 'spread', {_AUC.format('spread')})
SELECT max_by(name, (auc, name)) AS best_name, round(max(auc), 6) AS best_auc, max(auc) >= 0.6 AS passed FROM a"""
)
def auc_gate(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("spread", F.col("doc_id") % 97)
    each = [M.auc(rows, [], c, F.col("quality") == 1).select(F.lit(c).alias("name"), "auc") for c in ("n_chars", "spread")]
    out = stats.auc_gate(each[0].union(each[1]), "name", "auc")
    return out.select("best_name", F.round("best_auc", 6).alias("best_auc"), "passed")


@query(f"WITH {PRED}, c AS (SELECT condition, n, CASE WHEN pred = 'service_use' THEN 'weather' ELSE pred END AS pred FROM pred) SELECT condition, n::INTEGER AS window_n, count(*) FILTER (WHERE pred IS NULL) AS n_missing, count(*) FILTER (WHERE pred = 'weather') AS n_foreign, count(*) AS n FROM c GROUP BY condition, n")
def out_of_taxonomy(spark, d):
    rows = predictions(spark, d).withColumn("pred", F.when(F.col("pred") == "service_use", "weather").otherwise(F.col("pred"))).withColumnRenamed("n", "window_n")
    return M.out_of_taxonomy(M.confusion(rows, ["condition", "window_n"]), ["condition", "window_n"], LABELS)


@query(
    f"""WITH {PRED}, {_T}, {SCORES}, m AS (SELECT left(k, 1) AS c, right(k, 1) AS n, avg(f1) AS macro_f1, avg(recall) AS macro_recall FROM f GROUP BY k)
SELECT x.n, round(x.macro_f1, 6) AS macro_f1_before, round(y.macro_f1, 6) AS macro_f1_after, round(y.macro_f1 - x.macro_f1, 6) AS macro_f1_delta, round(x.macro_recall, 6) AS macro_recall_before, round(y.macro_recall, 6) AS macro_recall_after, round(y.macro_recall - x.macro_recall, 6) AS macro_recall_delta,
round(x.macro_f1, 9) <> round(y.macro_f1, 9) OR round(x.macro_recall, 9) <> round(y.macro_recall, 9) AS changed FROM m x JOIN m y ON x.n = y.n AND x.c = 'B' AND y.c = 'D'"""
)
def metric_comparison(spark, d):
    scores = M.macro_scores(_scores(spark, d), ["k"]).select(F.left("k", F.lit(1)).alias("c"), F.right("k", F.lit(1)).alias("n"), *[F.round(m, 9).alias(m) for m in ("macro_f1", "macro_recall")])
    out = M.compare_metrics(scores.where("c = 'B'"), scores.where("c = 'D'"), ["n"], ["macro_f1", "macro_recall"])
    return out.select("n", *R6(*[f"{m}_{side}" for m in ("macro_f1", "macro_recall") for side in ("before", "after", "delta")]), "changed")


@query(
    f"""WITH {WIDE}, {LAYERS}, m AS (SELECT *, len(list_distinct(list_filter([a1, a2, a3, a5], lambda v: v IS NOT NULL))) >= 2 AS moves, proba > 0.8 AS sure FROM lay),
e AS (SELECT layer, unnest(['shift', 'trajectory', 'entropy', 'combo', 'shift_not_short', 'trajectory_not_short']) AS trigger_name, unnest([shift, moves, sure, moves AND sure, shift AND NOT short, moves AND NOT short]) AS fired FROM m)
SELECT trigger_name, count(*) FILTER (WHERE fired) AS n_triggered, """
    + ", ".join(f"round(coalesce(count(*) FILTER (WHERE fired AND layer = '{x}') / nullif(count(*) FILTER (WHERE fired), 0), 0), 6) AS share_{x}" for x in ("sufficient", "infopoor", "already_correct"))
    + """, round(1 - count(*) FILTER (WHERE fired AND layer = 'already_correct') / nullif(count(*) FILTER (WHERE layer = 'already_correct'), 0), 6) AS exclusion_rate,
round(count(*) FILTER (WHERE fired AND layer = 'sufficient') / nullif(count(*) FILTER (WHERE layer = 'sufficient'), 0), 6) AS coverage FROM e GROUP BY trigger_name"""
)
def trigger_layers(spark, d):
    names = ["sufficient", "infopoor", "already_correct"]
    fired = policy.triggers(["a1", "a2", "a3", "a5"], "a2", "a5", F.col("proba") > 0.8, F.col("short"))
    out = M.trigger_layers(_layers(spark, d), fired, "layer", "already_correct", "sufficient", names)
    return out.select("trigger_name", "n_triggered", *R6(*[f"share_{x}" for x in names], "exclusion_rate", "coverage"))


@query(
    """WITH s AS (SELECT o_orderstatus AS label, sum(count(*)) OVER (ORDER BY o_orderstatus) / sum(count(*)) OVER () AS upto FROM orders GROUP BY 1), w AS (SELECT list({'upto': upto, 'label': label} ORDER BY upto) AS s FROM s),
g AS (SELECT o_orderstatus, list_filter(w.s, lambda x: ('0x' || md5('42|' || o_orderkey)[1:8])::BIGINT / 4294967296.0::DOUBLE < x.upto)[1].label AS guess FROM orders, w) SELECT o_orderstatus, guess, count(*) AS n FROM g GROUP BY ALL"""
)
def stratified_dummy(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return ml.stratified_guess(rows, "o_orderstatus", "o_orderkey").groupBy("o_orderstatus", "guess").agg(F.count("*").alias("n"))


@query()
def logistic_coefficients(spark, d):
    rows = wide_predictions(spark, d).select("call_id", F.col("tokens").cast("double").alias("tokens"), "proba", (F.col("gold") == FOCUS).cast("double").alias("y"))
    return ml.coefficients(rows, ["tokens", "proba"], "y").select("feature", F.round("coefficient", 4).alias("coefficient"))


# Samples and splits.


@query(f"WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY {hash_order('c_custkey')}) AS i FROM customer) SELECT c_custkey, CASE WHEN i <= 100 THEN 'first' ELSE 'rest' END AS part FROM r")
def split_hash(spark, d):
    return sampling.split_fixed(table(spark, d, "customer").select("c_custkey"), "c_custkey", 100)


@query(f"SELECT c_custkey FROM customer ORDER BY {hash_order('c_custkey')} LIMIT 50")
def sample_n(spark, d):
    return sampling.sample_n(table(spark, d, "customer").select("c_custkey"), "c_custkey", 50)


@query(f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer ORDER BY {hash_order('c_custkey')} LIMIT 50) ORDER BY {hash_order('c_custkey', 7)} LIMIT 50")
def sample_excluding(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return sampling.sample_excluding(c, sampling.sample_n(c, "c_custkey", 50), "c_custkey", 50, seed=7)


@query(f"SELECT c_mktsegment, c_custkey, rank_in_group FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {hash_order('c_custkey')})::INTEGER AS rank_in_group FROM customer) WHERE rank_in_group <= 7")
def sample_per_group(spark, d):
    return sampling.sample_per_group(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 7)


_QUOTAS = {"AUTOMOBILE": 10, "BUILDING": 5, "MACHINERY": 10}


@query(
    f"""WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {hash_order('c_custkey')}) AS i FROM customer), k AS (SELECT * FROM r WHERE i <= CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 10 WHEN 'BUILDING' THEN 5 WHEN 'MACHINERY' THEN 10 ELSE 0 END)
SELECT c_mktsegment, c_custkey, row_number() OVER (ORDER BY {hash_order('c_custkey', 43)})::INTEGER AS position FROM k"""
)
def stratified_quota(spark, d):
    return sampling.quota_sample(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", _QUOTAS)


@query(f"SELECT c_mktsegment, c_custkey, i::INTEGER AS rank_in_group FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {hash_order('c_custkey')}) AS i FROM customer) ORDER BY i, c_mktsegment LIMIT 18")
def round_robin(spark, d):
    return sampling.round_robin(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 18)


@query(
    """WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), a AS (SELECT lang, size, least(greatest(round_even(100 * size / sum(size) OVER (), 0)::BIGINT, 5), size) AS alloc, row_number() OVER (ORDER BY size DESC, lang) AS i FROM s)
SELECT lang, size, CASE WHEN i = 1 THEN alloc + 100 - (sum(alloc) OVER ())::BIGINT ELSE alloc END AS alloc FROM a"""
)
def proportional_alloc(spark, d):
    return sampling.proportional_allocation(table(spark, d, "documents"), "lang", 100, floor=5)


@query(
    """WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), m AS (SELECT greatest(round_even(40 * size / (SELECT sum(size) FROM s), 0)::BIGINT, 12) AS own FROM s WHERE lang = 'fr'),
a AS (SELECT lang, size, round_even((40 - own) * size / (sum(size) OVER ()), 0)::BIGINT AS alloc, row_number() OVER (ORDER BY size DESC, lang) AS i, 40 - own AS rest FROM s, m WHERE lang <> 'fr')
SELECT lang, size, CASE WHEN i = 1 THEN alloc + rest - (sum(alloc) OVER ())::BIGINT ELSE alloc END AS alloc FROM a UNION ALL SELECT s.lang, s.size, m.own FROM s, m WHERE s.lang = 'fr'"""
)
def minority_alloc(spark, d):
    return sampling.minority_allocation(table(spark, d, "documents"), "lang", 40, "fr", 12)


@query(f"SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hash_order('o_orderkey')}) - 1) % 5)::INTEGER AS fold FROM orders")
def kfold_assign(spark, d):
    return sampling.stratified_folds(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey").select("o_orderkey", "fold")


@query(f"WITH {WIDE}, {LAYERS} SELECT w.call_id, coalesce(l.layer, 'sufficient') AS layer FROM wide w LEFT JOIN lay l USING (call_id) WHERE w.d5 IS NOT NULL AND NOT coalesce(l.is_infopoor, false)")
def population_filter(spark, d):
    w = wide_predictions(spark, d).select("call_id", "d5")
    lay = _layers(spark, d).select("call_id", "layer", "is_infopoor")
    return w.where("d5 is not null").join(lay, "call_id", "left").where(~F.coalesce(F.col("is_infopoor"), F.lit(False))).select("call_id", F.coalesce("layer", F.lit("sufficient")).alias("layer"))


@query("SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY label")
def label_distribution(spark, d):
    out = agg.value_counts(table(spark, d, "embeddings").withColumn("label", F.col("label").cast("string")), "label")
    return out.select(F.col("value").cast("int").alias("label"), "n", *R6("share"))


# Models.


@query()
def multiclass_trees(spark, d):
    ship(spark)
    e = table(spark, d, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).alias(f"e{i}") for i in range(64)])
    model = boosting.fit_boosted(e, [f"e{i}" for i in range(64)], "label", rounds=10, depth=3)
    return model.transform(e).select("vec_id", "label", "prediction", F.round(F.array_max("probabilities"), 4).alias("proba"))


@query()
def lr_gate(spark, d):
    e = table(spark, d, "embeddings").withColumn("y", (F.col("label") == 3).cast("double"))
    return ml.cross_validated(ml.from_array(e, "embedding"), "vec_id", "y", k=5).select("vec_id", "fold", "y", F.round("proba", 4).alias("proba"))


@query()
def tfidf_entropy(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return ml.tfidf_entropy(docs, "doc_id", "text", "lang").select("doc_id", F.round("entropy", 4).alias("entropy"))


@query()
def feature_importance(spark, d):
    rows = wide_predictions(spark, d).select("call_id", F.col("tokens").cast("double").alias("tokens"), "proba", (F.col("gold") == FOCUS).cast("double").alias("y"))
    return ml.importances(rows, ["tokens", "proba"], "y")


@query(f"WITH {WIDE} SELECT gold, round(count(*) OVER () / (7.0 * count(*) OVER (PARTITION BY gold)), 6) AS weight, call_id FROM wide")
def balanced_weights(spark, d):
    return ml.balanced_weights(wide_predictions(spark, d).select("call_id", "gold"), "gold").select("gold", *R6("weight"), "call_id")


@query(f"WITH {WIDE} SELECT call_id, CASE WHEN proba >= (SELECT quantile_cont(proba, 0.67) FROM wide WHERE call_id % 2 = 0) THEN 'strong' WHEN proba >= (SELECT quantile_cont(proba, 0.33) FROM wide WHERE call_id % 2 = 0) THEN 'mid' ELSE 'weak' END AS gate_level FROM wide WHERE call_id % 2 = 1")
def frozen_gate_levels(spark, d):
    w = wide_predictions(spark, d).select("call_id", "proba")
    return ml.frozen_levels(w.where("call_id % 2 = 0"), w.where("call_id % 2 = 1"), "proba", {"strong": 0.67, "mid": 0.33}, "weak").select("call_id", "gate_level")
