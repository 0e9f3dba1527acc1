from __future__ import annotations

import io
import json
import math
import struct
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from talkmill.sources import batch, conversations, provider, sinks
from talkmill.streaming import labelling


def record(n=2):
    speakers = [{"id": "s1", "type": "agent1", "gender": "f", "age": "30", "telephone_network": "x"}, {"id": "s2", "type": "customer", "gender": "m", "age": "40", "telephone_network": "y"}, {"id": "s2", "type": "customer2", "gender": "f", "age": "41", "telephone_network": "z"}]
    dialogs = [{"speaker": ["s1", "s2", "s9"][i % 3], "audioPath": f"a{i}.wav", "duration": 1.5 * i, "text": f"line {i}"} for i in range(n)]
    return {"dataSet": {"typeInfo": {"category": "c", "subcategory": "d", "speakers": speakers}, "dialogs": dialogs}}


def test_json_folder_and_zip_agree(spark, tmp_path):
    for j, s in (("J1", "S1"), ("J1", "S2")):
        (tmp_path / "json" / j / s).mkdir(parents=True)
        (tmp_path / "json" / j / s / f"{s}.json").write_text(json.dumps(record(3)))
    (tmp_path / "json" / "J2" / "S3").mkdir(parents=True)
    (tmp_path / "json" / "J2" / "S3" / "S3.json").write_text('{"dataSet": {')
    (tmp_path / "zip").mkdir()
    with zipfile.ZipFile(tmp_path / "zip" / "all.zip", "w") as z:
        for s in ("S1", "S2"):
            z.writestr(f"x/J1/{s}/{s}.json", json.dumps(record(3)))
        z.writestr("x/J1/S1/other.json", "{}")
    good, bad = conversations.read_call_json(spark, str(tmp_path / "json"))
    rows = sorted(map(tuple, good.collect()), key=repr)
    assert len(rows) == 6 and bad.count() == 1
    from_zip, broken = conversations.read_call_zips(spark, str(tmp_path / "zip"))
    assert rows == sorted(map(tuple, from_zip.collect()), key=repr) and broken.count() == 0
    with zipfile.ZipFile(tmp_path / "zip" / "more.zip", "w") as z:
        z.writestr("x/J9/S9/S9.json", '{"dataSet": {')
        z.writestr("x/J9/S8/S8.json", "{}")
    (tmp_path / "zip" / "no.zip").write_bytes(b"not an archive")
    from_zip, broken = conversations.read_call_zips(spark, str(tmp_path / "zip"))
    assert from_zip.count() == 6 and sorted(r["path"].split("/")[-1] for r in broken.collect()) == ["S8.json", "S9.json", "no.zip"]
    by_index = {r["dialog_idx"]: r for r in good.where("s_code = 'S1'").collect()}
    assert by_index[0]["call_id"] == "J1_S1" and by_index[1]["speaker_gender"] == "f" and by_index[2]["speaker_type"] is None


def test_csv_with_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc'), (2, None)], "id int, text string")
    assert sinks.write_spreadsheet_csv(df.orderBy("id"), str(tmp_path / "r.csv")) == 2
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    back = conversations.read_csv(spark, str(tmp_path / "r.csv"))
    assert back.columns == ["id", "text"] and back.first()["text"] == 'a "q", b\nc'
    assert conversations.read_csv(spark, str(tmp_path / "r.csv"), preview=1).count() == 1
    with pytest.raises(ValueError, match="more than 1"):
        sinks.write_spreadsheet_csv(df, str(tmp_path / "s.csv"), most=1)


def tone(hertz=200.0, seconds=0.5, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", int(12000 * math.sin(2 * math.pi * hertz * i / rate))) for i in range(int(seconds * rate))))
    return out.getvalue()


def test_waves(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(tone())
    (tmp_path / "b.wav").write_bytes(b"not a wave")
    rows = {r["path"][-5:]: r for r in conversations.read_waves(spark, str(tmp_path)).collect()}
    assert rows["a.wav"]["f0_mean"] == pytest.approx(200, rel=0.02) and rows["a.wav"]["wav_duration"] == pytest.approx(0.5)
    assert rows["b.wav"]["error"] and rows["b.wav"]["f0_mean"] is None


def test_silence_is_measured_in_samples(tmp_path):
    quiet = io.BytesIO()
    with wave.open(quiet, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        with wave.open(io.BytesIO(tone(seconds=4))) as t:
            w.writeframes(t.readframes(32000) + bytes(2 * 32000))
    got = conversations.acoustic_features(quiet.getvalue())
    # Frames of 2,048 samples that touch the tone count as sound.
    assert 0.46 < got["s_top_db30"] <= got["s_top_db20"] < 0.5 and got["wav_duration"] == 8
    assert conversations.silence(conversations.np.array([0.0, -50.0]), 1000, 30) == pytest.approx(0.488)


class FolderService:
    """Batches of a folder: each answers some requests, refuses some and loses the rest."""

    def __init__(self, folder):
        self.folder, self.turns = folder, {}

    def submit(self, requests):
        batch = f"b{len(self.turns)}"
        self.turns[batch] = 0
        ids = [json.loads(line)["custom_id"] for line in open(requests)]
        answer = lambda i: {"custom_id": i, "response": {"status_code": 200, "body": {"choices": [{"message": {"content": f"re {i}"}}]}}, "error": None}
        (self.folder / f"{batch}.out").write_text("\n".join([json.dumps(answer(i)) for i in ids[:-2]] + ["not json"]))
        (self.folder / f"{batch}.err").write_text(json.dumps({"custom_id": ids[-2], "error": {"message": "too long"}}))
        return batch

    def status(self, batch):
        self.turns[batch] += 1
        return "completed" if self.turns[batch] > 2 else "in_progress"

    def output_file(self, batch):
        return str(self.folder / f"{batch}.out")

    def error_file(self, batch):
        return str(self.folder / f"{batch}.err")


def test_batch_answers_errors_and_losses(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps({"custom_id": f"c{i}"}) for i in range(5)))
    service, waits = FolderService(tmp_path), []
    ours = [service.submit(str(tmp_path / "r.jsonl"))]
    assert batch.poll(service, ours, 7, sleep=waits.append) == {"b0": "completed"} and waits == [7, 7]
    assert batch.poll(FolderService(tmp_path), [], 7, sleep=waits.append) == {}
    requests = spark.createDataFrame([(f"c{i}", i) for i in range(5)], "custom_id string, n int")
    got = {r["custom_id"]: (r["n"], r["response"], r["error"]) for r in batch.answered(requests, batch.collect_answers(spark, service, ours)).collect()}
    assert got == {"c0": (0, "re c0", None), "c1": (1, "re c1", None), "c2": (2, "re c2", None), "c3": (3, None, "too long"), "c4": (4, None, "silently lost")}
    none = batch.answered(requests, batch.collect_answers(spark, service, []))
    assert none.where("error = 'silently lost'").count() == 5


def test_listing_and_report(spark):
    df = spark.createDataFrame([("a.wav", 1), ("b.wav", None)], "file string, n int")
    assert [r["file"] for r in sinks.exists_in(spark.createDataFrame([("a.wav",), ("z.wav",)], "path string"), df, "file").collect()] == ["a.wav"]
    assert sinks.markdown_table(df.orderBy("file")) == "| file | n |\n| --- | --- |\n| a.wav | 1 |\n| b.wav |  |"
    with pytest.raises(ValueError, match="more than 1"):
        sinks.markdown_table(df, most=1)


def test_lines_and_copies(spark, tmp_path):
    df = spark.createDataFrame([("c::A::N1", "hello")], "custom_id string, prompt string")
    line = json.loads(sinks.request_lines(df, "m", "/v1").first()[0])
    assert line["custom_id"] == "c::A::N1" and line["body"]["messages"] == [{"role": "user", "content": "hello"}]
    chat = spark.createDataFrame([(1, 2, "assistant", "b", None), (1, 1, "user", "a", "x.wav")], "c int, o int, r string, t string, w string")
    assert json.loads(sinks.chat_lines(chat, ["c"], "o", "r", "t", "w").first()[0]) == {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "audios": ["x.wav"]}
    (tmp_path / "in.bin").write_bytes(b"123")
    wanted = spark.createDataFrame([(str(tmp_path / "in.bin"), "out.bin"), (str(tmp_path / "no.bin"), "no.bin")], "source string, name string")
    got = {r["name"]: (r["n_bytes"], r["error"]) for r in sinks.copy_files(spark, wanted, str(tmp_path / "copies")).collect()}
    assert got == {"out.bin": (3, None), "no.bin": (0, "missing")}


def test_write_once(spark, tmp_path):
    df = spark.range(3)
    sinks.write_once(df, str(tmp_path / "t"))
    sinks.write_once(spark.range(9), str(tmp_path / "t"), "ignore")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_once(df, str(tmp_path / "t"))


def test_provider_retries(spark):
    df = spark.createDataFrame([(f"i{i}", f"p{i}") for i in range(40)], "custom_id string, prompt string")
    rows = provider.label(df, provider.OfflineProvider(["x", "y"], fail_every=3), parallel=2).collect()
    assert len(rows) == 40 and all(r["error"] is None for r in rows) and {r["n_attempts"] for r in rows} == {1, 2}


def test_stream_answers_each_file_once(spark, tmp_path):
    folder, out = tmp_path / "requests", str(tmp_path / "out")
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"custom_id": f"{k}-{i}", "prompt": f"{i}", "tokens": i}) for i in range(5)))
    run = lambda: labelling.run_available(spark, str(folder), out, provider.OfflineProvider(["x", "y"]))
    run()
    run()
    assert labelling.responses(spark, out).count() == 10
    (folder / "2.json").write_text(json.dumps({"custom_id": "new", "prompt": "n", "tokens": 1}))
    run()
    got = labelling.responses(spark, out)
    assert got.count() == 11 and got.select("custom_id").distinct().count() == 11
    asked = got.select("custom_id").union(spark.createDataFrame([("gone",)], "custom_id string"))
    assert [tuple(r) for r in labelling.lost(spark, asked, out).collect()] == [("gone", "silently_lost")]


def test_windowed_accuracy_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", "a"), ("2024-01-01 00:20:00", "a", "b"), ("2024-01-01 05:00:00", "a", "a")], "ts string, gold string, pred string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = labelling.windowed_accuracy(stream, "ts", "gold", "pred").writeStream.format("memory").queryName("acc").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["n"], r["accuracy"]) for r in spark.table("acc").collect()] == [(2, 0.5)]
