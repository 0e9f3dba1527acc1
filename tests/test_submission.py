from __future__ import annotations

import hashlib
import json
import os
import sys

import pytest
from pyspark import cloudpickle

from talkmill.sources import submission

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module


class FolderService:
    """Batches are files named by key. ``kill`` names a file: while it exists, the first submission ends its worker after it was taken."""

    def __init__(self, root, kill=None):
        self.root, self.kill = str(root), kill and str(kill)

    def submit_once(self, requests, key):
        with open(requests, "rb") as file:
            content = file.read()
        assert hashlib.sha256(content).hexdigest() == key
        try:
            with open(os.path.join(self.root, key), "xb") as out:  # one of two at once wins
                out.write(content)
        except FileExistsError:
            pass
        if self.kill and os.path.exists(self.kill):
            os.remove(self.kill)
            os._exit(1)
        return f"batch-{key[:8]}"


def requests_of(spark, chunks=6, each=25):
    return spark.createDataFrame([(c, f"r{c}-{i}", f"text {i}") for c in range(chunks) for i in range(each)], "chunk int, custom_id string, body string").repartition(7)


def sent(root):
    return sorted(json.loads(line)["custom_id"] for name in os.listdir(root) for line in open(root / name, encoding="utf-8"))


@pytest.fixture
def service(tmp_path):
    (tmp_path / "service").mkdir()
    return FolderService(tmp_path / "service", tmp_path / "kill")


def test_chunks_are_sent_and_listed(spark, tmp_path, service):
    rows = submission.submit_chunks(requests_of(spark), service, str(tmp_path / "out")).orderBy("chunk").collect()
    assert [(r["chunk"], r["requests"]) for r in rows] == [(c, 25) for c in range(6)]
    assert all(r["batch"] == f"batch-{r['key'][:8]}" for r in rows)
    assert sent(tmp_path / "service") == sorted(f"r{c}-{i}" for c in range(6) for i in range(25))


def test_killed_task_sends_nothing_twice_and_loses_nothing(spark, tmp_path, service):
    (tmp_path / "kill").touch()
    with pytest.raises(Exception):  # noqa: B017
        submission.submit_chunks(requests_of(spark), service, str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "service")) >= 1 and not (tmp_path / "out" / "manifest.jsonl").exists()
    again = submission.submit_chunks(requests_of(spark).repartition(3), service, str(tmp_path / "out"))
    assert again.count() == 6 and len(os.listdir(tmp_path / "service")) == 6
    assert sent(tmp_path / "service") == sorted(f"r{c}-{i}" for c in range(6) for i in range(25))


def test_repeating_a_job_changes_nothing(spark, tmp_path, service):
    first = sorted(map(tuple, submission.submit_chunks(requests_of(spark), service, str(tmp_path / "out")).collect()))
    second = sorted(map(tuple, submission.submit_chunks(requests_of(spark), service, str(tmp_path / "out")).collect()))
    assert first == second and len(os.listdir(tmp_path / "service")) == 6


def test_odd_rows(spark, tmp_path, service):
    none = spark.createDataFrame([], "chunk int, custom_id string, body string")
    assert submission.submit_chunks(none, service, str(tmp_path / "none")).count() == 0
    odd = spark.createDataFrame([(1, None, None), (1, "a", "x"), (1, "a", "x"), (2, "é", "y" * 100_000)], "chunk int, custom_id string, body string")
    assert [r["requests"] for r in submission.submit_chunks(odd, service, str(tmp_path / "odd")).orderBy("chunk").collect()] == [3, 1]
    with pytest.raises(Exception, match="no chunk"):
        submission.submit_chunks(spark.createDataFrame([(None, "a", "x")], "chunk int, custom_id string, body string"), service, str(tmp_path / "bad"))
