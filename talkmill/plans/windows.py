"""Queries over utterances: ranks, windows, normalisation, descriptions, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.operators import aggregate as agg
from talkmill.operators import governance, policy, requests
from talkmill.operators import windows as W
from talkmill.plans.catalog import query
from talkmill.plans.common import ACOUSTIC, GRID, POOL, RANKED, UTT
from talkmill.sources.adapters import acoustic, utterances


def _ranked(spark, d):
    return W.add_ranks(utterances(spark, d))


def _grid(spark, d):
    return W.expand_windows(W.first_n_pool(_ranked(spark, d)))


@query(f"WITH {RANKED} SELECT call_id, dialog_idx, overall_rank, customer_rank FROM ranked")
def customer_rank(spark, d):
    return _ranked(spark, d).select("call_id", "dialog_idx", "overall_rank", "customer_rank")


@query(f"WITH {POOL} SELECT call_id, dialog_idx, speaker_type, is_customer, overall_rank, customer_rank, round(duration, 6) AS duration FROM pool")
def window_pool(spark, d):
    return W.first_n_pool(_ranked(spark, d)).select("call_id", "dialog_idx", "speaker_type", "is_customer", "overall_rank", "customer_rank", F.round("duration", 6).alias("duration"))


@query(f"WITH {GRID} SELECT call_id, window_n, window_version, dialog_idx, count(*) OVER (PARTITION BY call_id, window_n, window_version) AS n_rows FROM grid")
def window_expand(spark, d):
    return _grid(spark, d).select("call_id", "window_n", "window_version", "dialog_idx", F.expr("count(*) over (partition by call_id, window_n, window_version)").alias("n_rows"))


@query(f"WITH {RANKED} SELECT call_id, dialog_idx, text FROM (SELECT *, count(*) OVER (PARTITION BY call_id) AS c FROM ranked) WHERE c >= 3 AND overall_rank <= 3")
def first_three_exact(spark, d):
    return requests.first_n_exact(utterances(spark, d), "call_id", "dialog_idx", 3).select("call_id", "dialog_idx", "text")


@query(f"WITH {UTT} SELECT call_id, string_agg('[' || speaker_type || '] ' || text, chr(10) ORDER BY dialog_idx) AS call_text, count(*) AS n_utt FROM utt GROUP BY call_id")
def ordered_concat(spark, d):
    u = utterances(spark, d)
    line = F.concat(F.lit("["), "speaker_type", F.lit("] "), "text")
    return u.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dialog_idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("call_text"), F.count("*").alias("n_utt"))


@query(f"WITH {RANKED} SELECT call_id, string_agg(text, ' ' ORDER BY dialog_idx) AS said FROM ranked WHERE customer_rank BETWEEN 1 AND 2 GROUP BY call_id")
def first_customer_text(spark, d):
    return agg.ordered_concat(_ranked(spark, d).where(F.col("customer_rank").between(1, 2)), ["call_id"], "dialog_idx", F.col("text"), " ", "said")


@query(
    f"""WITH {GRID}, numbered AS (SELECT *, row_number() OVER (PARTITION BY call_id, window_n, window_version ORDER BY dialog_idx) AS i FROM grid)
SELECT call_id, window_n, window_version, string_agg(i || '. [' || speaker_type || '] ' || CASE WHEN trim(text) = '' THEN '(no text)' ELSE text END, chr(10) ORDER BY i) AS block
FROM numbered GROUP BY call_id, window_n, window_version"""
)
def utterance_block(spark, d):
    return requests.utterance_block(_grid(spark, d), ["call_id", "window_n", "window_version"], "dialog_idx", "speaker_type", "text")


_CONDITIONS = {"A": ("customer_only", False), "B": ("customer_only", True), "C": ("all", False), "D": ("all", True)}


@query(
    f"""WITH {GRID}, w AS (SELECT call_id, window_n, window_version, count(*) AS n_utt, sum(length(text))::BIGINT AS chars FROM grid GROUP BY ALL)
SELECT call_id || '::' || c || '::N' || window_n AS custom_id, call_id, c AS condition, acoustic, n_utt, chars
FROM w JOIN (VALUES ('A', 'customer_only', false), ('B', 'customer_only', true), ('C', 'all', false), ('D', 'all', true)) k(c, v, acoustic) ON k.v = w.window_version"""
)
def request_grid(spark, d):
    w = _grid(spark, d).groupBy("call_id", "window_n", "window_version").agg(F.count("*").alias("n_utt"), F.sum(F.length("text")).alias("chars"))
    return requests.request_grid(w, _CONDITIONS).select("custom_id", "call_id", "condition", "acoustic", "n_utt", "chars")


@query(
    f"""WITH {UTT}, b AS (SELECT call_id, string_agg(text, chr(10) ORDER BY dialog_idx) AS body FROM utt GROUP BY call_id)
SELECT call_id, md5('Guide: be brief.' || chr(10) || 'Hint: complaint likely.' || chr(10) || '[CALL]' || chr(10) || body) AS prompt_md5 FROM b"""
)
def prompt_variant(spark, d):
    body = agg.ordered_concat(utterances(spark, d), ["call_id"], "dialog_idx", F.col("text"), "\n", "body")
    base = requests.fill_template("{guide}\n[CALL]\n", guide=F.lit("Guide: be brief."))
    gated = requests.insert_at(base, "[CALL]", F.lit("Hint: complaint likely.\n"))
    return body.select("call_id", F.md5(F.concat(gated, "body").cast("binary")).alias("prompt_md5"))


@query(f"WITH {UTT} SELECT call_id, dialog_idx, 'speaking_rate' AS exclusion_reason FROM utt WHERE regexp_replace(text, '[^aeiou]', '', 'g').length() / nullif(duration, 0) > 5")
def exclusion_log(spark, d):
    u = utterances(spark, d).withColumn("rate", T.syllables(F.col("text"), "[aeiou]") / F.nullif("duration", F.lit(0.0)))
    return governance.exclusion_log(u, ~F.coalesce(F.col("rate") > 5, F.lit(False)), "speaking_rate", ["call_id", "dialog_idx"])[1]


@query(
    f"""WITH {ACOUSTIC}, s AS (SELECT *, count(*) OVER w AS n, avg(x) OVER w AS m, stddev_pop(x) OVER w AS sd FROM ac WINDOW w AS (PARTITION BY call_id, gender)),
g AS (SELECT gender, avg(x) AS gm, stddev_samp(x) AS gs FROM ac GROUP BY gender)
SELECT call_id, dialog_idx, round(CASE WHEN n >= 2 AND sd > 0 THEN (x - m) / sd ELSE (x - gm) / nullif(gs, 0) END, 6) AS z,
  CASE WHEN n >= 2 AND sd > 0 THEN 'within_window' ELSE 'global_fallback' END AS norm_source FROM s JOIN g USING (gender)"""
)
def znorm_within(spark, d):
    return W.z_within(acoustic(spark, d), ["call_id", "gender"], "x", ["gender"]).select("call_id", "dialog_idx", F.round("z", 6).alias("z"), "norm_source")


_POPULATION = "p AS (SELECT coalesce(gender, 'ALL') AS gender, count(x) AS n, avg(x) AS m, stddev_pop(x) AS sd FROM ac GROUP BY GROUPING SETS ((gender), ()))"
_SPEAKER = "s AS (SELECT *, CASE WHEN gender = 'click' THEN NULL ELSE gender END AS g, count(*) OVER w AS n, avg(x) OVER w AS m, stddev_pop(x) OVER w AS sd FROM ac WINDOW w AS (PARTITION BY call_id, gender))"


def _z_population_sql(shrink: bool) -> str:
    extra = "WHEN s.n BETWEEN 2 AND 3 THEN (s.m - coalesce(q.m, a.m)) / coalesce(q.sd, a.sd)" if shrink else ""
    extra_source = "WHEN s.n BETWEEN 2 AND 3 THEN 'shrinkage_population_sd'" if shrink else ""
    return f"""WITH {ACOUSTIC}, {_POPULATION}, {_SPEAKER}
SELECT call_id, dialog_idx, round(CASE WHEN s.n >= 4 AND s.sd > 0 THEN (x - s.m) / s.sd {extra} ELSE (x - coalesce(q.m, a.m)) / coalesce(q.sd, a.sd) END, 6) AS z,
  CASE WHEN s.n >= 4 AND s.sd > 0 THEN 'within_speaker' {extra_source} WHEN q.m IS NULL THEN 'population_fallback_no_gender' ELSE 'population_gender' END AS norm_source
FROM s LEFT JOIN p q ON q.gender = s.g AND s.g <> 'ALL' CROSS JOIN (SELECT m, sd FROM p WHERE gender = 'ALL') a"""


def _z_population(spark, d, shrink):
    a = acoustic(spark, d)
    stats = W.population_stats(a, "gender", ["x"]).drop("metric", "n")
    rows = a.withColumn("own", F.col("gender")).withColumn("gender", F.when(F.col("gender") != "click", F.col("gender")))
    return W.z_population(rows, ["call_id", "own"], "x", "gender", stats, shrink=shrink).select("call_id", "dialog_idx", F.round("z", 6).alias("z"), "norm_source")


@query(_z_population_sql(False))
def znorm_population_fallback(spark, d):
    return _z_population(spark, d, False)


@query(_z_population_sql(True))
def znorm_shrinkage(spark, d):
    return _z_population(spark, d, True)


@query(
    f"""WITH {ACOUSTIC}, l AS (SELECT gender, 'x' AS metric, x AS v FROM ac UNION ALL SELECT gender, 'k', k FROM ac)
SELECT metric, CASE WHEN grouping(gender) = 1 THEN 'ALL' ELSE gender END AS gender, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM l GROUP BY GROUPING SETS ((metric, gender), (metric))"""
)
def grouped_stats_all(spark, d):
    return W.population_stats(acoustic(spark, d), "gender", ["x", "k"]).select("metric", "gender", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {ACOUSTIC} SELECT call_id, count(*) AS n2_n_utt, round(avg(x), 6) AS n2_x_mean, round(coalesce(stddev_samp(x), 0), 6) AS n2_x_std, round(avg(k), 6) AS n2_k_mean, round(coalesce(stddev_samp(k), 0), 6) AS n2_k_std FROM ac GROUP BY call_id")
def feature_mean_std(spark, d):
    out = agg.mean_std(acoustic(spark, d), ["call_id"], ["x", "k"], "n2")
    return out.select("call_id", "n2_n_utt", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


_LEVELS = "['very_low', 'low', 'mid', 'high', 'very_high']"
_CUTS = "c AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS q FROM ac)"


@query(f"WITH {ACOUSTIC}, {_CUTS} SELECT dialog_idx, CASE WHEN x <= q[1] THEN 'very_low' WHEN x <= q[2] THEN 'low' WHEN x <= q[3] THEN 'mid' WHEN x <= q[4] THEN 'high' ELSE 'very_high' END AS level FROM ac, c")
def quintile_levels(spark, d):
    a = acoustic(spark, d)
    return a.select("dialog_idx", W.bucket(F.col("x"), W.quantile_cuts(a, "x", [0.2, 0.4, 0.6, 0.8]), T.LEVELS, tied="mid").alias("level"))


_PHRASES = {"x": {v: f"pitch {v.replace('_', ' ')}" for v in T.LEVELS}, "k": {v: f"loudness {v.replace('_', ' ')}" for v in T.LEVELS}}


@query(
    f"""WITH {ACOUSTIC}, {_CUTS}, l AS (SELECT dialog_idx, CASE WHEN x <= q[1] THEN 'very low' WHEN x <= q[2] THEN 'low' WHEN x <= q[3] THEN 'mid' WHEN x <= q[4] THEN 'high' ELSE 'very high' END AS a,
CASE WHEN k < 20 THEN 'low' WHEN k < 80 THEN 'mid' END AS b FROM ac, c) SELECT dialog_idx, 'pitch ' || a || ', loudness ' || coalesce(b, 'mid') AS nl_description FROM l"""
)
def nl_description(spark, d):
    a = acoustic(spark, d)
    x = W.bucket(F.col("x"), W.quantile_cuts(a, "x", [0.2, 0.4, 0.6, 0.8]), T.LEVELS, tied="mid")
    k = F.when(F.col("k") < 20, "low").when(F.col("k") < 80, "mid")
    return a.select("dialog_idx", T.describe_levels({"x": x, "k": k}, _PHRASES).alias("nl_description"))


@query(
    f"""WITH {ACOUSTIC}, g AS (SELECT gender, avg(x) AS mx, stddev_pop(x) AS sx, avg(k) AS mk, stddev_pop(k) AS sk FROM ac GROUP BY gender),
z AS (SELECT dialog_idx, (x - mx) / nullif(sx, 0) AS zx, CASE WHEN k % 5 > 0 THEN (k - mk) / nullif(sk, 0) END AS zk FROM ac JOIN g USING (gender)),
a AS (SELECT dialog_idx, CASE WHEN zk IS NULL THEN zx ELSE (zx + zk) / 2 END AS arousal FROM z)
SELECT dialog_idx, round(arousal, 6) AS arousal, CASE WHEN arousal > 0.5 THEN 'high' ELSE 'rest' END AS arousal_group FROM a"""
)
def arousal(spark, d):
    a = acoustic(spark, d)
    g = a.groupBy("gender").agg(*[f(c).alias(n + c) for c in "xk" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: (F.col(c) - F.col("m" + c)) / F.nullif(F.col("s" + c), F.lit(0.0))
    rows = a.join(F.broadcast(g), "gender").select("dialog_idx", policy.mean_of_present(z("x"), F.when(F.col("k") % 5 > 0, z("k"))).alias("v"))
    return rows.select("dialog_idx", F.round("v", 6).alias("arousal"), F.when(F.col("v") > 0.5, "high").otherwise("rest").alias("arousal_group"))


@query(
    f"""WITH {ACOUSTIC}, v AS (SELECT call_id, gender, x, CASE WHEN k % 5 > 0 THEN k END AS k FROM ac), b AS (SELECT gender, avg(x) AS mx, stddev_pop(x) AS sx, avg(k) AS mk, stddev_pop(k) AS sk FROM v GROUP BY gender),
o AS (SELECT call_id, gender, row_number() OVER (PARTITION BY call_id ORDER BY count(*) DESC, gender) AS nth FROM v GROUP BY call_id, gender),
c AS (SELECT call_id, count(*) AS n_rows, avg(x) AS cx, avg(k) AS ck FROM v GROUP BY call_id),
z AS (SELECT c.call_id, n_rows, gender, (cx - mx) / nullif(sx, 0) AS zx, (ck - mk) / nullif(sk, 0) AS zk FROM c JOIN o ON o.call_id = c.call_id AND nth = 1 JOIN b USING (gender))
SELECT call_id, n_rows, gender, round(zx, 6) AS z_x, round(zk, 6) AS z_k, round(CASE WHEN zk IS NULL THEN zx WHEN zx IS NULL THEN zk ELSE (zx + zk) / 2 END, 6) AS arousal FROM z"""
)
def arousal_by_call(spark, d):
    rows = acoustic(spark, d).withColumn("k", F.when(F.col("k") % 5 > 0, F.col("k")))
    return W.arousal_by_call(rows, "call_id", "gender", ["x", "k"]).select("call_id", "n_rows", "gender", *[F.round(c, 6).alias(c) for c in ("z_x", "z_k", "arousal")])


@query(f"WITH {ACOUSTIC}, s AS (SELECT *, count(*) OVER w AS n, avg(x) OVER w AS m, stddev_pop(x) OVER w AS sd FROM ac WINDOW w AS (PARTITION BY call_id, gender)) SELECT round(avg((abs(round((x - m) / sd, 6)) = 1)::INTEGER), 6) AS unit_share FROM s WHERE n >= 2 AND sd > 0")
def unit_artifact(spark, d):
    z = W.z_within(acoustic(spark, d), ["call_id", "gender"], "x", ["gender"]).where("norm_source = 'within_window'")
    return W.unit_artifact_share(z).select(F.round("unit_share", 6).alias("unit_share"))


@query(
    f"""WITH {ACOUSTIC}, s AS (SELECT *, count(*) OVER w AS n, stddev_pop(x) OVER w AS sd FROM ac WINDOW w AS (PARTITION BY call_id, gender)),
t AS (SELECT gender, CASE WHEN n >= 2 AND sd > 0 THEN 'within_window' ELSE 'global_fallback' END AS norm_source FROM s) SELECT gender, norm_source, count(*) AS n FROM t GROUP BY ALL"""
)
def norm_source_counts(spark, d):
    z = W.z_within(acoustic(spark, d), ["call_id", "gender"], "x", ["gender"])
    return z.groupBy("gender", "norm_source").agg(F.count("*").alias("n"))


_SUBJECTS = ["pitch", "pitch movement", "loudness", "loudness movement", "speech rate", "share of silence"]


def _phrase_sql(i: int) -> str:
    degrees = ["very slow", "slow", "usual", "quick", "very quick"] if i == 4 else ["far below usual", "below usual", "usual", "above usual", "far above usual"]
    return f"'{_SUBJECTS[i]}: ' || {degrees}[CASE WHEN dialog_idx % {i + 2} = 0 THEN 3 ELSE (dialog_idx + {i}) % 5 + 1 END]"


@query(f"WITH {ACOUSTIC} SELECT dialog_idx, " + " || ', ' || ".join(_phrase_sql(i) for i in range(6)) + " AS described FROM ac")
def six_metric_description(spark, d):
    at = F.col("dialog_idx")
    names = F.array(*[F.lit(x) for x in T.LEVELS])
    levels = {m: F.when(at % (i + 2) != 0, F.element_at(names, ((at + i) % 5 + 1).cast("int"))) for i, m in enumerate(T.METRICS)}
    return acoustic(spark, d).select("dialog_idx", T.describe_levels(levels, T.level_phrases("en")).alias("described"))
