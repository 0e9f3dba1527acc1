from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from talkmill.functions import nulls
from talkmill.functions import text as T


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("((x o/)) hello", "hello"),
        ("o/ start", "start"),
        ("end O/", "end"),
        ("가 n/ 나", "가 나"),
        ("to/from", "to from"),
        ("T/ stays", "T stays"),
        ("(won)/(one) day", "one day"),
        ("won)/(one) day", "won day"),
        ("(won)/(one day", "one day"),
        ("(won/(one) day", "one day"),
        ("(won)/one) day", "one day"),
        ("(won/one) day", "one day"),
        ("i/ yes f/ no p/ H/", "yes no"),
        ("((a)) b ((c)))) d", "b d"),
        ("0/ (one)/(1) end)", "0 1 end"),
        ("(noise) word", "word"),
        ("a\u00a0 b\x1cc", "a b c"),
        ("0/ left", "0 left"),
        ("a    b", "a b"),
        ("", ""),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, T.clean_text(F.col("t"))) == clean


def test_counts(spark):
    assert one(spark, "o/ x n/ go/ N/", T.tag_count(F.col("t"), "n")) == 2
    assert one(spark, "o/ x n/ go/ N/", T.tag_count(F.col("t"), "o")) == 1
    assert one(spark, "안녕 hi 요", T.syllables(F.col("t"))) == 3
    assert one(spark, "(a)/(b) (c)/(d)", T.correction_count(F.col("t"))) == 2
    assert one(spark, "(a/(b) (c)/d) e)/(f) (g)/(h", T.correction_count(F.col("t"))) == 2
    assert one(spark, "o/ i/ F/ t/ xo/", T.tag_total(F.col("t"))) == 3
    assert one(spark, "(a)/(b)", T.length_ratio(T.clean_text(F.col("t")), F.col("t"))) == 1 / 7
    assert one(spark, "", T.length_ratio(F.col("t"), F.col("t"))) is None


DOMAIN = ["complaint", "refund"]


@pytest.mark.parametrize(
    ("raw", "label", "error"),
    [("<c>refund</c>", "refund", None), ("x <c>\n3. refund\n</c> <c>complaint</c>", "refund", None), ("<c>tea</c>", None, "out of domain"), ("refund", None, "tag missing"), ("  ", None, "tag missing"), (None, None, "no response")],
)
def test_parse_tagged(spark, raw, label, error):
    assert tuple(one(spark, raw, T.parse_tagged(F.col("t"), "c", DOMAIN))) == (label, error)


@pytest.mark.parametrize(
    ("raw", "flag", "label"),
    [
        ('so {"f": true, "l": "refund"} ok', True, "complaint"),
        ('{"f": false, "l": "refund"}', False, "refund"),
        ('{"f": false, "l": "2) refund"}', False, None),
        ('{"f": false, "l": 3}', False, None),
        ('{"f": true}', True, "complaint"),
        ('{"f": false, "l": "refund"} or {this}', None, None),
        ('{"f": false, "l": "refund"}, {"f": true}', None, None),
        ('{"l": "refund"}', None, None),
        ('{"f": null, "l": "refund"}', None, None),
        ('{"f": false, "l": "tea"}', False, None),
        ('{"f": "true", "l": "refund"}', None, None),
        ('{"f": 1, "l": "refund"}', None, None),
        ("{broken", None, None),
        (None, None, None),
    ],
)
def test_parse_verdict(spark, raw, flag, label):
    got = one(spark, raw, T.parse_verdict(F.col("t"), "f", "l", DOMAIN, "complaint"))
    assert (got["flag"], got["label"]) == (flag, label)


@pytest.mark.parametrize(
    ("said", "n", "cleaned"),
    [
        ("so (won)/(one) end", 1, "so one end"),
        ("so (won/(one) end", 1, "so one end"),
        ("so (won)/one) end", 1, "so one end"),
        ("so (won/one) end", 1, "so one end"),
        ("(a)/(b)/(c)", 1, "b"),
        ("()/() x", 1, "x"),
        ("(a)/(b x", 0, "b x"),
        ("won)/(one) x", 0, "won x"),
        ("(a)/(dd/c) (d/e)", 2, "dd c e"),
    ],
)
def test_forms_of_corrections(spark, said, n, cleaned):
    assert one(spark, said, T.correction_count(F.col("t"))) == n
    assert one(spark, said, T.clean_text(F.col("t"))) == cleaned


def test_verdicts_with_repeated_keys_and_numbers_that_are_none(spark):
    for raw, want in [
        ('{"f": false, "l": "tea", "l": "refund"}', (False, "refund")),
        ('{"f": true, "f": false, "l": "refund"}', (False, "refund")),
        ('{"f": "no", "f": true, "x": NaN}', (True, "complaint")),
        ('{"f": false, "x": -Infinity, "l": "refund"}', (False, "refund")),
        ('{"f": true, "f": 1}', (None, None)),
    ]:
        got = one(spark, raw, T.parse_verdict(F.col("t"), "f", "l", DOMAIN, "complaint"))
        assert (got["flag"], got["label"]) == want, raw


def test_other_parsers(spark):
    assert tuple(one(spark, "<a>3</a><b>6</b>", T.parse_scores(F.col("t"), ["a", "b"]))) == (None, None, "out of range: a=3, b=6")
    assert tuple(one(spark, "<a>3</a><b>-1</b>", T.parse_scores(F.col("t"), ["a", "b"]))) == (None, None, "missing: b")
    assert tuple(one(spark, "<a>3</a> b", T.parse_scores(F.col("t"), ["a", "b"]))) == (None, None, "missing: b")
    assert tuple(one(spark, " ", T.parse_scores(F.col("t"), ["a", "b"]))) == (None, None, "empty")
    assert tuple(one(spark, None, T.parse_scores(F.col("t"), ["a", "b"]))) == (None, None, "empty")
    assert tuple(one(spark, "<c>refund</c><x> yes </x>", T.parse_tagged(F.col("t"), "c", DOMAIN, "x"))) == ("refund", None, "yes")
    for said, label in [("answer: refund, no complaint", "refund"), ("complaint <c>refund</c>", "refund"), ("complaint <refund>", "refund"), ("a refund", "refund"), ("answer: tea", None)]:
        assert one(spark, said, T.answer_label(F.col("t"), DOMAIN)) == label
    assert tuple(one(spark, "<a>3</a><b> 5 </b>", T.parse_scores(F.col("t"), ["a", "b"]))) == (3, 5, None)
    assert tuple(one(spark, " 1. refund ", T.parse_plain(F.col("t"), DOMAIN))) == ("refund", None)
    assert tuple(one(spark, " ", T.parse_plain(F.col("t"), DOMAIN))) == (None, "empty")
    assert one(spark, "score 7, then 3", T.first_digit(F.col("t"))) == 3
    assert one(spark, "I say Revert.", T.keep_or_revert(F.col("t"))) == "REVERT"
    assert one(spark, "refund " + "x" * 160 + " complaint", T.tail_label(F.col("t"), ["refund", "complaint"])) == "complaint"


def test_null_policies(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", None), ("a", "a")], "x string, y string")
    x, y = F.col("x"), F.col("y")
    assert [r[0] for r in rows.select(nulls.differs(x, y)).collect()] == [True, True, False]
    assert [r[0] for r in rows.select(nulls.differs(x, y, False)).collect()] == [True, False, False]
    assert [r[0] for r in rows.select(nulls.not_in(y, ["b"])).collect()] == [False, True, True]


def test_level_phrases(spark):
    en, ko = T.level_phrases("en"), T.level_phrases("ko")
    assert T.template_problems(en, ko) == [] and list(en) == T.METRICS
    assert T.template_problems(en, {m: {k: v for k, v in p.items() if k != "mid"} for m, p in list(ko.items())[:2]}) != []
    said = one(spark, "no such level", T.describe_levels({"f0_mean": F.col("t"), "r_gold": F.lit(None).cast("string")}, en))
    assert said == "pitch: usual, speech rate: usual"


def test_displayed_figures_round_ties_to_even(spark):
    import numpy as np

    values = [0.125, 0.375, 2.675, -0.125, 0.5, 1.5, 2.5, 33.335, 1e-9, 0.0, None, *[i / 800 * 100 for i in range(801)]]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", nulls.half_even(F.col("v"), 2).alias("r"), nulls.half_even(F.col("v"), 0).alias("whole")).collect()
    for r in rows:
        assert (r["r"], r["whole"]) == ((None, None) if r["v"] is None else (np.round(r["v"], 2), np.round(r["v"])))
    assert [r["r"] for r in rows[:2]] == [0.12, 0.38]
