"""Chunk states from streams that are replayed, reordered and restarted; published versions; exact tests."""

from __future__ import annotations

import itertools
import json
import random
import time

import pytest

from talkmill.operators import stats
from talkmill.sources import published
from talkmill.streaming import chunks


def some_events(rng):
    events = []
    for index in range(12):
        for attempt in range(rng.randrange(1, 6)):
            batch = f"b{index}-{attempt}"
            events.append((index, batch, "submitted"))
            outcome = rng.choice(["failed", "failed", "completed", "running", None])
            if outcome:
                events.append((index, batch, outcome))
            if outcome == "completed":
                break
    return events


def run(spark, folder):
    stream = chunks.chunk_states(spark.readStream.schema(chunks.EVENTS).option("maxFilesPerTrigger", 1).json(f"{folder}/in"), 2)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return chunks.latest_states(spark.read.parquet(f"{folder}/out"))


@pytest.mark.parametrize("seed", [1])
def test_the_stream_ends_with_the_state_of_all_events(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = some_events(rng)
    shown = events + rng.choices(events, k=10)
    rng.shuffle(shown)
    (tmp_path / "in").mkdir()
    half = len(shown) // 2
    for part, rows in enumerate((shown[:half], shown[half:], events[:7])):  # at last some that were seen before
        (tmp_path / "in" / f"{part}.json").write_text("".join(json.dumps(dict(zip(("index", "batch", "outcome"), r, strict=True))) + "\n" for r in rows))
        got = run(spark, tmp_path)  # a restart from the checkpoint for each file
    want = chunks.settled(spark.createDataFrame(events, chunks.EVENTS), 2)
    plain = lambda df: sorted(tuple(r) for r in df.select("index", "status", "retries").collect())
    assert plain(got) == plain(want)
    failures = {i: len({b for j, b, o in events if (j, o) == (i, "failed")}) for i, *_ in events}
    assert all(r["retries"] == failures[r["index"]] for r in got.collect())
    plan = spark.createDataFrame([(i, 100) for i in range(14)], "index long, n_tokens long")
    submitted = {r["index"]: r["status"] for r in got.collect()}
    room = 500 - 100 * list(submitted.values()).count("submitted")
    due = [i for i in range(14) if submitted.get(i, "pending") == "pending"]
    assert sorted(r["index"] for r in chunks.to_submit(plan, spark.read.parquet(f"{tmp_path}/out"), 500).collect()) == due[: max(0, room // 100)]


def test_a_failed_chunk_is_due_after_a_pause(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"index": 1, "batch": "b", "outcome": "failed"}\n')
    stream = chunks.chunk_states(spark.readStream.schema(chunks.EVENTS).json(f"{tmp_path}/in"), 2, 500)
    query = stream.writeStream.format("memory").queryName("paused").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            rows = [tuple(r) for r in spark.table("paused").orderBy("version").collect()]
            if len(rows) == 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert rows == [(1, "pending", 1, False, 1), (1, "pending", 1, True, 2)]


def test_the_new_version_counts_only_once_it_is_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    table = lambda n: spark.createDataFrame([(i, f"v{n}") for i in range(n)], "i int, v string")
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, path)
    published.publish(table(3), path)
    for step in ("fingerprint", "_write_text", "_put_in_place"):
        with monkeypatch.context() as m:
            m.setattr(published, step, lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError, match="killed"):
                published.publish(table(4), path)
        assert published.read_published(spark, path, verify=True).count() == 3
    for n in (5, 6, 7):
        published.publish(table(n), path, keep=1)
    assert published.read_published(spark, path, verify=True).count() == 7
    assert published.read_published(spark, path, back=1).count() == 6
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, path, back=2)
    name = json.loads((tmp_path / "table" / published.POINTER).read_text())["versions"][-1]["name"]
    table(2).write.mode("overwrite").parquet(f"{path}/versions/{name}")
    with pytest.raises(ValueError, match="not as it was published"):
        published.read_published(spark, path, verify=True)


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (1, 4), (3, 2), (4, 4), (5, 3), (2, 7)])
def test_exact_u_equals_enumeration(n1, n2):
    every = [sum(sum(x > y for y in set(range(n1 + n2)) - set(a)) for x in a) for a in itertools.combinations(range(n1 + n2), n1)]
    for u in set(every):
        tail = sum(x >= max(u, n1 * n2 - u) for x in every) / len(every)
        assert stats.exact_u_tail(n1, n2, u) == pytest.approx(min(1.0, 2 * tail))


def test_small_samples_without_ties_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [("a", float(v), v in (1, 2, 4)) for v in range(7)] + [("tied", float(v // 2), v in (1, 2, 4)) for v in range(7)]
    u = stats.mann_whitney(spark.createDataFrame(rows, "g string, v double, x boolean"), ["g"], "v", F.col("x"))
    plain = {r["g"]: r["p_value"] for r in stats.mann_whitney_test(u, ["g"]).collect()}
    exact = {r["g"]: r["p_value"] for r in stats.mann_whitney_test(u, ["g"], stats.EXACT_UP_TO).collect()}
    u_a = next(r["u"] for r in u.collect() if r["g"] == "a")
    assert exact["a"] == stats.exact_u_tail(3, 4, u_a) != plain["a"]
    assert exact["tied"] == plain["tied"]
