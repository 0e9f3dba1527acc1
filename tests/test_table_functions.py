from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.functions.tables import register_table_functions
from talkmill.sources import conversations
from tests.test_sources import record

ANSWERS = [None, "", " ", "yes", " 2. no \n", "<c>yes</c>", "<c>\n3) no\n</c> <c>yes</c>", "<c>maybe</c>", "<c>no", "<fit>3</fit><kind> 5 </kind>", "<fit>0</fit><kind>2</kind>", "<fit>-1</fit>", "<fit>99999999999999999999</fit><kind>1</kind>", "<fit>0003</fit><kind>1</kind>"]


@pytest.fixture(scope="module")
def answers(spark):
    register_table_functions(spark)
    return spark.createDataFrame(list(enumerate(ANSWERS)), "id int, response string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_utterances_as_flattened_by_expressions(spark, tmp_path):
    register_table_functions(spark)
    odd = {"dataSet": {"typeInfo": {"category": 7, "speakers": None}, "dialogs": [{"speaker": None, "duration": 2, "text": "안녕 \"x\""}]}}
    bodies = {"S1": json.dumps(record(3)), "S2": json.dumps(odd), "S3": '{"dataSet": {', "S4": "{}", "S5": json.dumps({"dataSet": {"dialogs": []}}), "S6": json.dumps(record(1))}
    for s, body in bodies.items():
        (tmp_path / "J1" / s).mkdir(parents=True)
        (tmp_path / "J1" / s / f"{s}.json").write_text(body)
    good, bad = conversations.read_call_json(spark, str(tmp_path))
    records = spark.createDataFrame([(f"a/J1/{s}/{s}.json", body, 1) for s, body in bodies.items()] + [("a/J1/S7/S7.json", None, 1)], "path string, value string, call_id int")
    found = spark.sql("SELECT * FROM call_utterances(TABLE({r}))", r=records)
    assert found.columns == good.columns and rows(found) == rows(good)
    problems = spark.sql("SELECT * FROM call_utterances(TABLE({r}), problems => true)", r=records)
    assert {r["path"][-7:-5]: r["problem"] for r in problems.collect()} == {"S3": bodies["S3"], "S4": "no dialogs", "S7": "no dialogs"}
    assert bad.count() == 2
    assert spark.sql("SELECT * FROM call_utterances(TABLE({r}))", r=records.limit(0)).count() == 0
    with pytest.raises(AnalysisException, match="no column value"):
        spark.sql("SELECT * FROM call_utterances(TABLE({r}))", r=records.drop("value"))


def test_answers_as_parsed_by_expressions(spark, answers):
    domain, r = ["yes", "no"], F.col("response")
    plain = spark.sql("SELECT * FROM parse_answers(TABLE({a}), kind => 'plain', domain => array('yes', 'no'))", a=answers)
    assert plain.columns == ["id", "response", "label", "error"]
    assert rows(plain) == rows(answers.withColumn("v", T.parse_plain(r, domain)).select("id", "response", "v.*"))
    tagged = spark.sql("SELECT * FROM parse_answers(TABLE({a}), kind => 'tagged', tags => array('c'), domain => array('yes', 'no'))", a=answers)
    assert rows(tagged) == rows(answers.withColumn("v", T.parse_tagged(r, "c", domain)).select("id", "response", "v.*"))
    scores = spark.sql("SELECT * FROM parse_answers(TABLE({a}), kind => 'scores', tags => array('fit', 'kind'), low => 1, high => 4)", a=answers)
    assert scores.columns == ["id", "response", "fit", "kind", "error"]
    assert rows(scores) == rows(answers.withColumn("v", T.parse_scores(r, ["fit", "kind"], 1, 4)).select("id", "response", "v.*"))


def test_newest_answer_of_a_request(spark, answers):
    many = spark.createDataFrame([("a", 1, "yes"), ("a", 2, "no"), ("b", None, "no"), ("b", 1, None), ("c", 3, "no"), ("c", 3, "yes"), ("c", 3, "yes"), (None, 1, "yes"), (None, 2, "x")], "custom_id string, nth int, label string")
    found = spark.sql("SELECT * FROM parse_answers(TABLE({a}), kind => 'plain', answer => 'label', domain => array('yes', 'no'), request => 'custom_id', batch => 'nth')", a=many.repartition(3))
    assert found.columns == ["custom_id", "nth", "label", "label_", "error"]
    assert rows(found) == sorted([("a", 2, "no", "no", None), ("b", 1, None, None, "empty"), ("c", 3, "yes", "yes", None), (None, 2, "x", None, "out of domain")], key=repr)


@pytest.mark.parametrize(("call", "says"), [("kind => 'odd'", "kind must be"), ("kind => 'tagged'", "need tags"), ("kind => 'plain', answer => 'x'", "no column x"), ("kind => 'plain', batch => 'id'", "name the request")])
def test_wrong_calls_fail_while_analysed(spark, answers, call, says):
    with pytest.raises(AnalysisException, match=says):
        spark.sql(f"SELECT * FROM parse_answers(TABLE({{a}}), {call})", a=answers)
