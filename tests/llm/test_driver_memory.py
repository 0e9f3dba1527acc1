"""Tables that grow with the input are never broadcast, however small they are on disk."""

from __future__ import annotations

from talkmill.llm import components, near_dup, shared


def surplus(df) -> int:
    """Broadcast joins of a plan beyond those that the code asks for."""
    q = df._jdf.queryExecution()
    return q.sparkPlan().toString().count("BroadcastHashJoin") - q.analyzed().toString().count("strategy=broadcast")


def test_near_dup_broadcasts_only_counted_tables(spark, monkeypatch):
    found, keep = {}, shared.materialise

    def watched(df, name):
        found[name] = max(found.get(name, 0), surplus(df))
        return keep(df, name)

    for module in (components, near_dup, shared):
        monkeypatch.setattr(module, "materialise", watched)
    said = [" ".join(f"w{i // 2 * 12 + k}" for k in range(i % 2, 12)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    out = near_dup.near_dup(docs, width=2)
    found["out"] = surplus(out)
    assert {k: v for k, v in found.items() if v > 0} == {}
    assert sorted((r["doc_id"], r["component_id"]) for r in out.collect()) == [(i, i // 2 * 2) for i in range(40)]


def test_many_narrow_rows_are_dealt_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shared, "MOST_BROADCAST_ROWS", 10)
    small = shared.materialise(spark.range(100).selectExpr("id as k", "id * 2 as y"), "small")
    big = spark.range(1000).selectExpr("id % 100 as k", "id as x")
    out = shared.join_hot(big, small, "k", "x")
    assert surplus(out) == 0
    assert sorted(map(tuple, out.select("k", "x", "y").collect())) == sorted((i % 100, i, i % 100 * 2) for i in range(1000))
