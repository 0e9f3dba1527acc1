"""Queries answer for every row of their table; expected rows come from DuckDB over the whole table."""

from __future__ import annotations

import duckdb
import pytest

from talkmill.plans import catalog
from talkmill.plans.common import LAB

SF = "/root/testdata/sf0.001"


def same_as(spark, folder, table, name, sql):
    df = catalog.QUERIES[name](spark, str(folder))
    got = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(sql).fetchall()
    assert len(got) == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_every_order_is_labelled(spark):
    same_as(spark, SF, "orders", "provider_labels", f"SELECT o_orderkey, {LAB}[('0x' || md5('order ' || o_orderkey)[1:8])::BIGINT % 7 + 1] AS label FROM orders")


def test_every_document_has_a_token_length(spark, tmp_path):
    sql = r"SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\f\r]'), lambda w: ceil(length(w) / 4.0)::INTEGER)), 0)::INTEGER AS n_tokens FROM documents"
    same_as(spark, SF, "documents", "token_length", sql)
    rows = [(0, None, "en"), (1, "", "en"), (2, "drei Wörter hier", "de"), (3, "안녕 a_b 🙂!", None), (4, None, None), (5, "abcde f", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["n_tokens"] for r in catalog.QUERIES["token_length"](spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 0, 2: 1 + 1 + 1 + 1 + 1, 3: 2 + 1 + 2, 4: 0, 5: 3}


def test_every_event_is_parsed(spark, tmp_path):
    """``anywhere`` is the first label in domain order, so a closing service_use comes before delivery_check."""
    same_as(spark, SF, "events", "fallback_parsers", catalog.ORACLES["fallback_parsers"])
    rows = [(0, '{"k": 6}'), (1, '{"k": 13}'), (2, '{"k": 5}'), (3, "{}"), (4, None)]
    spark.createDataFrame(rows, "event_id long, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in catalog.QUERIES["fallback_parsers"](spark, str(tmp_path)).collect())
    assert got == [
        (0, 1, "service_use", "service_use", "delivery_check", "KEEP"),
        (1, 3, "delivery_check", "delivery_check", "delivery_check", "REVERT"),
        (2, 0, "service_use", "service_use", "service_use", "REVERT"),
        (3, None, None, None, None, "REVERT"),
        (4, None, None, None, None, "REVERT"),
    ]
