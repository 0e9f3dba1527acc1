"""Invariants and traps of the operators, also on awkward tables."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkmill.operators import aggregate as agg
from talkmill.operators import batching, governance, joins, ordering, policy, requests, sampling, stats
from talkmill.operators import metrics as M
from talkmill.operators import windows as W


def utterances(spark, calls):
    rows = [(c, i, s, s == "user") for c, speakers in enumerate(calls) for i, s in enumerate(speakers)]
    return spark.createDataFrame(rows, "call_id int, dialog_idx int, speaker string, is_customer boolean")


def test_window_grid_by_hand(spark):
    calls = [["agent", "user", "user", "agent", "user", "agent", "user"], ["user"], ["agent", "agent"]]
    grid = W.expand_windows(W.first_n_pool(W.add_ranks(utterances(spark, calls))))
    got = {(r["call_id"], r["window_n"], r["window_version"]): r["n"] for r in grid.groupBy("call_id", "window_n", "window_version").agg(F.count("*").alias("n")).collect()}
    want = {}
    for c, speakers in enumerate(calls):
        for n in W.SIZES:
            if (k := min(n, speakers.count("user"))) > 0:
                want[c, n, "customer_only"] = k
            want[c, n, "all"] = min(n, len(speakers))
    assert got == want


def test_tied_cuts_read_as_mid(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(None,)], "x double")
    cuts = W.quantile_cuts(df, "x", [0.2, 0.4, 0.6, 0.8])
    assert {r[0] for r in df.select(W.bucket(F.col("x"), cuts, list("abcde"), tied="mid")).collect()} == {"mid"}
    right = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double").select(W.bucket(F.col("x"), [1.0, 1.5], ["low", "mid", "high"]))
    assert [r[0] for r in right.collect()] == ["low", "high", None]


def test_z_within_falls_back(spark):
    df = spark.createDataFrame([("a", "g", 1.0), ("a", "g", 3.0), ("b", "g", 5.0), ("c", "g", 4.0), ("c", "g", 4.0), ("d", "g", None)], "call string, grp string, x double")
    rows = [(r["call"], r["norm_source"]) for r in W.z_within(df, ["call"], "x", ["grp"]).orderBy("call").collect()]
    assert rows == [("a", "within_window")] * 2 + [("b", "global_fallback")] + [("c", "global_fallback")] * 2 + [("d", "global_fallback")]


def test_overlay_keeps_the_key_set(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    patch = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert {tuple(r) for r in joins.overlay(base, patch, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C")}


def test_checked_join_refuses_double_keys(spark):
    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="twice"):
        joins.checked_left_join(left, right, ["k"]).collect()


def test_class_scores_with_absent_and_foreign_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "x"), ("b", None), ("b", "a")], "gold string, pred string")
    rows = {r["label"]: r for r in M.class_scores(M.confusion(df, []), [], ["a", "b", "c"]).collect()}
    assert (rows["a"]["precision"], rows["a"]["recall"], rows["b"]["f1"], rows["c"]["support"]) == (0.5, 0.5, 0.0, 0)
    macro = M.macro_scores(M.class_scores(M.confusion(df, []), [], ["a", "b", "c"]), []).first()
    assert macro["macro_f1"] == pytest.approx(0.5 / 3)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "gold string, pred string")
    assert M.accuracy(df, ["gold"]).count() == 0
    assert agg.value_counts(df, "gold", ["a"]).collect()[0]["n"] == 0
    assert sampling.sample_n(df, "gold", 5).count() == 0
    assert governance.missing_report(df, ["gold"]).count() == 0


def test_numbers_and_ranks_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice([None, *[x / 2 for x in range(40)]])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, g string, x double")
    numbered = ordering.number_by_hash(df, ["g"], sampling.hash_order("i"), "i", "n", digits=1)
    want = df.withColumn("n", F.expr("row_number() over (partition by g order by md5('42|' || i), i)"))
    assert sorted(tuple(r) for r in numbered.select("i", "n").collect()) == sorted(tuple(r) for r in want.select("i", "n").collect())
    got = {(r["g"], r["x"]): r["rank"] for r in ordering.average_rank_table(df, ["g"], "x").collect()}
    for g in "ab":
        values = sorted(x for _, h, x in rows if h == g and x is not None)
        assert all(got[g, x] == values.index(x) + 1 + (values.count(x) - 1) / 2 for x in set(values))


def test_states_and_admission(spark):
    chunks = spark.createDataFrame([(0, 60, "completed", 0), (1, 50, "pending", 2), (2, 40, "pending", 0), (3, 30, "submitted", 1)], "index int, n_tokens int, status string, retries int")
    assert [r["index"] for r in batching.admit(chunks, 60).collect()] == [1]
    assert batching.admit_one(chunks).count() == 0
    assert [r["index"] for r in batching.admit_one(chunks.where("index < 3")).collect()] == [1]
    events = spark.createDataFrame([(1, "failed"), (3, "completed")], "index int, outcome string")
    got = {r["index"]: (r["status"], r["retries"]) for r in batching.advance(chunks, events).collect()}
    assert got == {0: ("completed", 0), 1: ("failed_permanent", 3), 2: ("pending", 0), 3: ("completed", 1)}


def test_score_gates_and_nulls(spark):
    df = spark.createDataFrame([("f", "o", 5), ("f", "o", 1), ("f", "o", None), ("f", None, 1), ("f", "f", 1), ("o", "f", 5), ("o", "p", 5), (None, "o", 1)], "s string, n string, x int")
    c = F.col
    run = lambda e: [r[0] for r in df.select(e).collect()]
    assert run(policy.score_gate(c("s"), c("n"), c("x"), 3, "f")) == ["f", "o", "f", "f", "f", "o", "o", None]
    assert run(policy.score_gate(c("s"), c("n"), c("x"), 3, "f", False)) == ["f", "o", "o", "f", "f", "f", "p", "o"]
    verdict = F.when(c("x") == 1, "REVERT").when(c("x") == 5, "KEEP")
    assert run(policy.verdict_gate(c("s"), c("n"), verdict, "f")) == ["f", "o", "f", "f", "f", "o", "o", None]


def test_mcnemar_leaves_out_rows_without_a_prediction(spark):
    df = spark.createDataFrame([("a", "a", "a"), ("a", "a", None), ("a", None, "a"), ("a", "b", "a"), (None, "a", "b")], "gold string, p string, q string")
    row = stats.mcnemar_cells(df, [], "gold", "p", "q").first()
    assert (row["n11"], row["n10"], row["n01"], row["n00"]) == (1, 0, 1, 1)


def test_fusion_has_three_sources(spark):
    base = spark.createDataFrame([(i, "b") for i in range(5)], "k int, label string")
    gate = spark.createDataFrame([(0, True, "g"), (1, False, "g"), (2, False, None), (3, None, "g")], "k int, has_focus boolean, gate_label string")
    refined = spark.createDataFrame([(1, "r"), (2, None), (3, "r"), (4, "r")], "k int, refined_label string")
    got = {r["k"]: (r["label"], r["source"]) for r in policy.fuse_labels(base, gate, refined, "k", "f").collect()}
    assert got == {0: ("f", "gate"), 1: ("r", "refined"), 2: (None, "refined"), 3: ("b", "base"), 4: ("b", "base")}


def test_greedy_chunks(spark):
    sizes = [0, 0, 12, 5, 5, 0, 1, None, 10, 25, 3]
    df = spark.createDataFrame([(i, s, g) for g in "ab" for i, s in enumerate(sizes)], "i int, s long, g string")
    got = {(r["g"], r["i"]): r["chunk"] for r in requests.greedy_chunks(df, "i", "s", 10, "g").collect()}
    want, chunk, held, total = [], 0, 0, 0
    for size in sizes:
        if held and total + (size or 0) > 10:
            chunk, held, total = chunk + 1, 0, 0
        held, total = held + 1, total + (size or 0)
        want.append(chunk)
    assert want[2] == 1 and got == {(g, i): c for g in "ab" for i, c in enumerate(want)}
    assert requests.greedy_chunks(df.limit(0), "i", "s", 10).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=30))
def test_exact_quantiles_equal_percentile(spark, rows):
    df = spark.createDataFrame(rows, "g string, x int")
    shares = {"a": 0.0, "b": 0.2, "c": 0.5, "d": 0.77, "e": 1.0}
    plain = [F.expr(f"percentile(x, {q})").alias(n) for n, q in shares.items()]
    assert tuple(ordering.exact_quantiles(df, [], "x", shares).first()) == pytest.approx(tuple(df.agg(*plain).first()))
    want = {tuple(r) for r in df.where("x is not null").groupBy("g").agg(*plain).collect()}
    assert {tuple(r) for r in ordering.exact_quantiles(df, ["g"], "x", shares).collect()} == want


def test_ids_answers_and_publishing(spark, tmp_path):
    requests_ = spark.createDataFrame([("a", 1), ("b", 2)], "custom_id string, n int")
    answers = spark.createDataFrame([("a", "yes", 9), ("z", "no", 9)], "custom_id string, response string, n int")
    assert sorted(tuple(r) for r in joins.reattach(answers, requests_).collect()) == [("a", 1, "yes"), ("b", 2, None)]
    assert joins.assert_same_ids(requests_, requests_, "custom_id").first()["n_both"] == 2
    with pytest.raises(Exception, match="differ"):
        joins.assert_same_ids(requests_, answers, "custom_id").collect()
    lines = governance.publish({"r": requests_, "x": answers}, {"r": ["n", "gone"]}, str(tmp_path))
    assert [(x["table"], x["state"], x["reason"]) for x in lines] == [("r", "published", "without n"), ("x", "held back", "not on the whitelist")]
    assert spark.read.parquet(f"{tmp_path}/r.parquet").columns == ["custom_id"]
    a = spark.createDataFrame([(1, "r\nsaid: x\nend")], "k int, t string")
    b = spark.createDataFrame([(1, "r2\nsaid: y\nend")], "k int, t string")
    assert tuple(requests.structure_diff(a, b, "k", "t", ["said"]).first()) == (1, 4, 2)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["a", "b", "c", None])), min_size=1, max_size=40))
def test_accuracy_is_the_confusion_diagonal(spark, rows):
    df = spark.createDataFrame(rows, "gold string, pred string")
    got = M.accuracy(df, []).first()
    valid = [(g, p) for g, p in rows if p is not None]
    assert (got["n_total"], got["n_valid"]) == (len(rows), len(valid))
    assert got["accuracy"] == (pytest.approx(sum(g == p for g, p in valid) / len(valid)) if valid else None)
    diagonal = M.confusion(df, []).where("gold = pred").agg(F.sum("freq")).first()[0] or 0
    assert diagonal == sum(g == p for g, p in valid)


@pytest.mark.parametrize("kind", ["mixed", "close", "few", "huge", "whole"])
def test_radix_selection_equals_percentile(spark, kind):
    rng = random.Random(kind)
    value = {
        "mixed": lambda: rng.choice([0.0, -0.0, rng.gauss(0, 1e-9), rng.gauss(0, 1), -rng.expovariate(1e-6), 5.0]),
        "close": lambda: 1000 + rng.random() * 1e-6,
        "few": lambda: float(rng.randrange(3)),
        "huge": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 308),
        "whole": lambda: float(rng.randrange(-500, 500)),
    }[kind]
    rows = [(rng.choice(["a", "b", None]), value() if rng.random() > 0.1 else None) for _ in range(700)] + [("empty", None), ("one", 3.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"low": 0.0, "q": 0.25, "half": 0.5, "p99": 0.99, "top": 1.0}
    want = {r["g"]: tuple(r)[1:] for r in df.where("v is not null").groupBy("g").agg(*[F.expr(f"percentile(v, {q})").alias(n) for n, q in shares.items()]).collect()}
    got = {r["g"]: tuple(r)[1:] for r in ordering.exact_quantiles(df, ["g"], "v", shares).collect()}
    assert got.keys() == want.keys()
    for g, values in want.items():
        assert got[g] == pytest.approx(values, rel=1e-12, abs=0), g
    whole = ordering.exact_quantiles(df, [], "v", shares).collect()
    assert tuple(whole[0]) == pytest.approx(tuple(df.agg(*[F.expr(f"percentile(v, {q})") for q in shares.values()]).first()), rel=1e-12, abs=0)
    ranks = {(r["g"], r["v"]): r["rank"] for r in ordering.average_rank_table(df, ["g"], "v").collect()}
    for g in ("a", "b", None):
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert all(ranks[g, v] == own.index(v) + (own.count(v) + 1) / 2 for v in set(own))


def test_large_samples_are_the_first_in_hash_order(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "i")
    want = [r["i"] for r in df.orderBy(sampling.hash_order("i"), "i").collect()]
    monkeypatch.setattr(sampling, "SMALL_SAMPLE", 10)
    for n in (11, 700, 2999, 3000, 4000):
        assert sorted(r["i"] for r in sampling.sample_n(df, "i", n).collect()) == sorted(want[:n])
    for n in (0, 1, 2900, 5000):
        parts = {r["i"]: r["part"] for r in sampling.split_fixed(df, "i", n).collect()}
        assert parts == {i: "first" if k < n else "rest" for k, i in enumerate(want)}
    assert sampling.sample_n(df.limit(0), "i", 20).count() == 0


def test_arousal_by_call_takes_the_most_frequent_gender(spark):
    rows = [("a", "f", 1.0, 10.0), ("a", "m", 3.0, 20.0), ("b", "m", 5.0, None), ("b", "m", 7.0, None), ("b", "f", 3.0, 40.0), ("c", None, 2.0, 1.0), ("d", "x", 4.0, 4.0), ("e", None, None, None), ("e", "m", None, None)]
    df = spark.createDataFrame(rows, "call string, g string, p double, q double")
    got = {r["call"]: r for r in W.arousal_by_call(df, "call", "g", ["p", "q"]).collect()}
    assert [got[c]["g"] for c in "abcde"] == ["f", "m", None, "x", "m"] and [got[c]["n_rows"] for c in "abcde"] == [2, 3, 1, 1, 2]
    assert got["a"]["z_p"] == 0.0 and got["a"]["z_q"] == (15 - 25) / 15 and got["a"]["arousal"] == got["a"]["z_q"] / 2
    assert got["b"]["z_p"] == 0.0 and got["b"]["z_q"] is None and got["b"]["arousal"] == 0.0  # one m has a q: no spread
    assert all(got[c]["arousal"] is None for c in "cde")
    other = W.arousal_by_call(df, "call", "g", ["p"], df.where("call = 'b'")).where("call = 'd'").first()
    assert other["z_p"] is None and W.arousal_by_call(df.where("false"), "call", "g", ["p", "q"]).count() == 0
