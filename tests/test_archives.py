from __future__ import annotations

import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from talkmill.sources import archives, conversations
from tests.test_sources import record


@pytest.fixture
def folder(tmp_path):
    """Forty calls in two archives, stored without compression, and the same calls as files."""
    draw = random.Random(5)
    for part in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{part}.zip", "w") as out:
            for i in range(20):
                text = json.dumps(record(draw.randint(1, 40)))
                name = f"J{part}/S{i}/S{i}.json"
                out.writestr("top/" + name, text)
                out.writestr(f"top/J{part}/S{i}/notes.txt", "x" * 500)
                (tmp_path / "files" / name).parent.mkdir(parents=True)
                (tmp_path / "files" / name).write_text(text)
    return tmp_path


@pytest.mark.parametrize("split", [700, 4_000, 10**9])
def test_every_member_once_at_any_split(spark, folder, split):
    rows = archives.read_members(spark, str(folder), r"\.json$", split)
    size = sum(os.path.getsize(folder / f"{p}.zip") for p in "ab")
    assert rows.rdd.getNumPartitions() >= max(2, size // split)
    found = [r["path"] for r in rows.collect()]
    assert sorted(found) == sorted(f"top/J{p}/S{i}/S{i}.json" for p in "ab" for i in range(20))


def test_work_is_spread_over_tasks(spark, folder):
    rows = archives.read_members(spark, str(folder / "a.zip"), "", 4_000).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) > 5 and max(r["count"] for r in rows) < 40 / 2


def test_archives_equal_files(spark, folder, monkeypatch):
    monkeypatch.setattr(archives.read_members, "__defaults__", ("", 3_000))
    from_zip, broken = conversations.read_call_zips(spark, str(folder))
    from_files, _ = conversations.read_call_json(spark, str(folder / "files"))
    assert broken.count() == 0 and sorted(map(repr, from_zip.collect())) == sorted(map(repr, from_files.collect()))


def test_broken_archives_and_members_stop_no_others(spark, folder):
    whole = (folder / "a.zip").read_bytes()
    at = whole.index(b'"text": "line 0"')  # inside the first member: its checksum no longer fits
    (folder / "a.zip").write_bytes(whole[:at] + b"X" + whole[at + 1 :])
    (folder / "cut.zip").write_bytes(whole[: len(whole) // 2])
    (folder / "empty.zip").write_bytes(b"")
    rows = archives.read_members(spark, str(folder), r"\.json$", 2_000).collect()
    bad = {r["path"].split("/")[-1]: r["problem"] for r in rows if r["problem"]}
    assert set(bad) == {"S0.json", "cut.zip", "empty.zip"} and bad["S0.json"].startswith("BadZipFile") and bad["empty.zip"].startswith("not an archive")
    assert len(rows) == 42 and all((r["value"] is None) == (r["problem"] is not None) for r in rows)


def test_large_members_empty_folders_and_uris(spark, folder, tmp_path_factory, monkeypatch):
    assert archives.read_members(spark, str(tmp_path_factory.mktemp("none"))).count() == 0
    assert archives.read_members(spark, f"file://{folder}", r"\.json$").count() == 40
    monkeypatch.setattr(archives, "MOST_MEMBER_BYTES", 400)
    reader = archives.MemberReader(str(folder), r"notes\.txt$", 10**9)
    rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert len(rows) == 40 and {r["problem"] for r in rows} == {"unpacks to 500 bytes"}
    with pytest.raises(ValueError, match="at least one"):
        archives.ArchiveMembers({"path": str(folder), "split": "0"}).reader(None)
