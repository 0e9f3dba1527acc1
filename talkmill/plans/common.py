"""SQL fragments that several oracles share."""

from talkmill.sources.adapters import LABELS

LAB = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
DOMAIN = f"domain AS (SELECT unnest({LAB}) AS label)"

UTT = "utt AS (SELECT conv_id AS call_id, turn AS dialog_idx, role AS speaker_type, role = 'user' AS is_customer, text, length(text) / 15.0 AS duration FROM conversations)"

RANKED = (
    UTT
    + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY dialog_idx)::INTEGER AS overall_rank,
  CASE WHEN is_customer THEN sum(is_customer::INTEGER) OVER (PARTITION BY call_id ORDER BY dialog_idx ROWS UNBOUNDED PRECEDING) ELSE -1 END::INTEGER AS customer_rank FROM utt)"""
)
POOL = RANKED + ",\npool AS (SELECT * FROM ranked WHERE overall_rank <= 5 OR customer_rank BETWEEN 1 AND 5)"
GRID = (
    POOL
    + """,
grid AS (SELECT p.*, n.n AS window_n, v.v AS window_version FROM pool p, (VALUES (1), (2), (3), (5)) n(n), (VALUES ('customer_only'), ('all')) v(v)
  WHERE (v.v = 'customer_only' AND customer_rank BETWEEN 1 AND n.n) OR (v.v = 'all' AND overall_rank <= n.n))"""
)
PRED = f"""pred AS (SELECT o_orderkey AS call_id, {LAB}[o_custkey % 7 + 1] AS gold, c.c AS condition, w.n AS n,
  CASE WHEN (o_orderkey + c.i) % 97 = 0 THEN NULL WHEN (o_orderkey * 31 + w.n * 17 + c.i * 7) % 10 < 6 - w.n
  THEN {LAB}[(o_custkey % 7 + 1 + (o_orderkey + w.n) % 6) % 7 + 1] ELSE {LAB}[o_custkey % 7 + 1] END AS pred
  FROM orders, (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3)) c(c, i), (VALUES (1), (2), (3), (5)) w(n))"""
WIDE = (
    PRED
    + ",\nwide AS (SELECT p.call_id, any_value(gold) AS gold, "
    + ", ".join(f"max(pred) FILTER (WHERE condition = '{c}' AND n = {n}) AS {c.lower()}{n}" for c in "ABCD" for n in (1, 2, 3, 5))
    + ", any_value(o_custkey % 50 + o_orderkey % 13) AS tokens, any_value(o_orderpriority) AS segment, any_value((o_orderkey * 37 % 100) / 100.0::DOUBLE) AS proba FROM pred p JOIN orders o ON o.o_orderkey = p.call_id GROUP BY p.call_id)"
)
ACOUSTIC = "ac AS (SELECT user_id AS call_id, event_id AS dialog_idx, event_type AS gender, value AS x, (props::JSON->>'$.k')::INTEGER AS k FROM events)"
#: Per-class precision, recall and F1 of ``t(k, gold, pred)``.
SCORES = f"""conf AS (SELECT k, gold, coalesce(pred, 'PARSE_FAIL') AS pred, count(*) AS n FROM t GROUP BY ALL),
{DOMAIN},
cls AS (SELECT keys.k, label, coalesce(s.v, 0)::BIGINT AS support, coalesce(p.v, 0)::BIGINT AS predicted, coalesce(h.v, 0)::BIGINT AS hits
  FROM (SELECT DISTINCT k FROM conf) keys CROSS JOIN domain
  LEFT JOIN (SELECT k, gold, sum(n) AS v FROM conf GROUP BY ALL) s ON s.k = keys.k AND s.gold = label
  LEFT JOIN (SELECT k, pred, sum(n) AS v FROM conf GROUP BY ALL) p ON p.k = keys.k AND p.pred = label
  LEFT JOIN (SELECT k, gold, sum(n) AS v FROM conf WHERE gold = pred GROUP BY ALL) h ON h.k = keys.k AND h.gold = label),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN hits::DOUBLE / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS recall FROM cls),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""


def hash_order(key: str, seed: int = 42) -> str:
    return f"md5('{seed}|' || {key}::VARCHAR)"


def normal_tail(z: str) -> str:
    """SQL: two-sided tail of the standard normal, by a series without cancellation; 0 beyond 10."""
    x = f"(greatest({z}, 1e-100) / sqrt(2.0::DOUBLE))"
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN {z} > 10 THEN 0.0::DOUBLE ELSE 1 - list_sum(list_transform(range(0, 400), lambda i: exp((2 * i + 1) * ln({x}) - {x} * {x} - lgamma(i + 1.5)))) END"


def choose(n: str, k: str) -> str:
    """SQL: logarithm of a binomial coefficient."""
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


def correlation_tail(r: str, n: str, steps: int = 20_000) -> str:
    """SQL: two-sided p of a correlation of n rows: the integral of cos^(n - 3) from asin |r| on, by Simpson's rule."""
    low = f"asin(least(abs({r}), 1))"
    step = f"((pi() / 2 - {low}) / {steps})"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    total = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * pow(greatest(cos({low} + i * {step}), 0), {n} - 3)))"
    scale = f"exp(lgamma(({n} - 1) / 2.0) - lgamma(({n} - 2) / 2.0) - lgamma(0.5))"
    return f"CASE WHEN {r} IS NULL OR isnan({r}) OR {n} < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0.0::DOUBLE ELSE 2 * {scale} * {total} * {step} / 3 END"
