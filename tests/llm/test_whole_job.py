"""Rows with null ids, repeated rows and other thresholds: nothing is lost or left over."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

import corpus_pipeline
from talkmill.llm.decontam import contamination, drop_contaminated
from talkmill.llm.near_dup import near_dup
from talkmill.llm.sql import DECONTAM


def test_windows_of_items_without_an_id_count(spark):
    said = [" ".join(f"{c}{i}" for i in range(12)) for c in "abc"]
    items = [(None, said[0]), ("x", said[1]), (None, said[1]), (None, None), (None, "")]
    texts = [f"so {said[0]} end", said[1], said[2], None, f"{said[0]} {said[1]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    rows = contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    sha = {x: hashlib.sha256(x.encode()).hexdigest() for x in ("", "x")}
    assert sorted(tuple(r) for r in rows) == [(0, 14, 12, 0, sha[""], True), (1, 12, 12, 1, sha["x"], True), (2, 12, 0, 0, sha[""], False), (3, 0, 0, 0, sha[""], False), (4, 24, 24, 1, sha["x"], True)]
    assert sorted(r["doc_id"] for r in drop_contaminated(docs, benchmark).collect()) == [2, 3]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)").executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.execute("CREATE TABLE benchmark (item_id VARCHAR, text VARCHAR)").executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = con.execute(f"SELECT doc_id, n_hit, contaminated FROM ({DECONTAM}) ORDER BY 1").fetchall()
    assert want == sorted((r["doc_id"], r["n_hit"], r["contaminated"]) for r in rows)


def test_one_row_of_each_group_stays(spark):
    near = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(near), " ".join([*near[:-1], "end"]), " ".join(f"x{i}" for i in range(60))
    rows = [(5, a), (5, a), (4, b), (None, a), (None, c), (None, c), (9, "alone and else nothing here"), (7, None), (8, ""), (6, a), (6, c)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(4, b), (6, c), (9, "alone and else nothing here"), (7, None), (8, "")], key=repr)
    nameless = corpus_pipeline.near_duplicates(spark, docs.where("doc_id is null"), "").collect()
    assert sorted(r["text"] for r in nameless) == sorted([a, c])


@pytest.mark.parametrize("percent", [50, 79])
def test_thresholds_that_would_lose_links_are_refused(percent):
    with pytest.raises(ValueError, match="80"):
        near_dup(None, 5, percent)


def test_stages_take_any_rows_and_columns(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([("x", " ".join(f"b{i}" for i in range(12)))], "item_id string, text string")
    long = " ".join(f"w{i % 997} and" for i in range(60_000))
    texts = [None, "", " \t", "one", long, long, "said " + " ".join(f"b{i}" for i in range(12)), " ".join(f"c{i}" for i in range(50))]
    rows = [(i % 9 if i % 5 else None, t, i, f"r{i}", "k", 1.5, [i]) for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ROW long, _row_ string, kept string, component_id double, _items array<int>")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage_rows = {
            "quality classifier": lambda: corpus_pipeline.drop_bad(docs, labels),
            "MinHash near-dedup": lambda: corpus_pipeline.near_duplicates(spark, docs, ""),
            "benchmark decontamination": lambda: corpus_pipeline.drop_contaminated(docs, benchmark),
        }[name]()
        assert stage_rows.columns == docs.columns
        got = sorted(r["_ROW"] for r in stage_rows.collect())
        assert [(r["_ROW"], r["_row_"]) for r in stage_rows.orderBy("_ROW").collect()] == [(i, f"r{i}") for i in got]
        if name == "MinHash near-dedup":
            linked = {t: [i for i, u in enumerate(texts * 2) if u == t] for t in texts[3:]}
            assert len(got) == 6 + len(linked) and all(sum(i in got for i in ids) == 1 for ids in linked.values())
        elif name == "benchmark decontamination":
            assert got == [i for i in range(16) if i % 8 != 6]
        else:
            assert len({t for i, t in enumerate(texts * 2) if i in got} & {t for i, t in enumerate(texts * 2) if i not in got}) == 0
    encoded = corpus_pipeline.tokenize(spark, docs, "").collect()
    assert len(encoded) == 16 and sum(r["doc_id"] is None for r in encoded) == sum(r[0] is None for r in rows)
    assert sorted(r["n_tokens"] for r in encoded)[:4] == [0, 0, 0, 0] and all(r["lossless"] for r in encoded)
