"""Readers: nested call JSON (folders or archives), CSV with a byte-order mark, WAV files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.sources.archives import read_members

SPEAKER = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "type", "gender", "age", "telephone_network")])
DIALOG = T.StructType([T.StructField("speaker", T.StringType()), T.StructField("audioPath", T.StringType()), T.StructField("duration", T.DoubleType()), T.StructField("text", T.StringType())])
TYPE_INFO = T.StructType([T.StructField("category", T.StringType()), T.StructField("subcategory", T.StringType()), T.StructField("speakers", T.ArrayType(SPEAKER))])
CALL = T.StructType([T.StructField("dataSet", T.StructType([T.StructField("typeInfo", TYPE_INFO), T.StructField("dialogs", T.ArrayType(DIALOG))])), T.StructField("_corrupt_record", T.StringType())])

#: Paths end in {J}/{S}/{S}.json: the file is named like its folder.
CODES = r"([^/]+)/([^/]+)/\2\.json$"


def flatten_calls(records: DataFrame) -> DataFrame:
    """(path, dataSet) to one row a dialog; speaker attributes by id, the last of equal ids, null if unknown."""
    codes = F.regexp_extract("path", CODES, 1), F.regexp_extract("path", CODES, 2)
    rows = records.select(codes[0].alias("j_code"), codes[1].alias("s_code"), "dataSet.typeInfo.*", F.posexplode("dataSet.dialogs").alias("dialog_idx", "dialog"))
    known = F.filter(F.coalesce("speakers", F.array().cast(T.ArrayType(SPEAKER))), lambda s: s["id"] == F.col("dialog.speaker"))
    rows = rows.withColumn("s", F.get(known, F.size(known) - 1))
    return rows.select(
        F.concat_ws("_", "j_code", "s_code").alias("call_id"), "j_code", "s_code", "category", "subcategory", F.col("dialog.speaker").alias("speaker_id"),
        *[F.col(f"s.{a}").alias(b) for a, b in (("type", "speaker_type"), ("gender", "speaker_gender"), ("age", "speaker_age"), ("telephone_network", "telephone_network"))],
        "dialog_idx", "dialog.audioPath", "dialog.duration", "dialog.text",
    )


def read_call_json(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(utterances, quarantined): records that can't be read don't stop the others."""
    raw = spark.read.schema(CALL).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    raw = raw.withColumn("path", F.col("_metadata.file_path"))
    bad = F.col("_corrupt_record").isNotNull() | F.col("dataSet.dialogs").isNull()
    return flatten_calls(raw.where(~bad)), raw.where(bad).select("path", F.coalesce("_corrupt_record", F.lit("no dialogs")).alias("problem"))


def read_call_zips(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same two tables from archives of any size; a task reads a range of an archive's bytes.

    A broken archive or member is quarantined under its name, as is a member too large for a text column.
    """
    parsed = read_members(spark, path, CODES).withColumn("r", F.from_json("value", CALL, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("problem").isNotNull() | F.col("r._corrupt_record").isNotNull() | F.col("r.dataSet.dialogs").isNull()
    why = F.coalesce("problem", "r._corrupt_record", F.lit("no dialogs")).alias("problem")
    return flatten_calls(parsed.where(~bad).select("path", F.col("r.dataSet").alias("dataSet"))), parsed.where(bad).select("path", why)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, preview: int | None = None) -> DataFrame:
    """CSV with a header; a byte-order mark is not part of the first name. Without a schema all columns are strings."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.limit(preview) if preview is not None else df


WAVE_SCHEMA = "path string, wav_duration double, sample_rate int, n_channels int, f0_mean double, f0_std double, f0_voiced_ratio double, e_mean_amp double, e_std_amp double, e_mean_db double, e_std_db double, s_top_db20 double, s_top_db30 double, error string"


# Samples a frame and between centred frames, least amplitude, range of decibels.
FRAME, HOP, FAINTEST, LOWEST_DB = 2048, 512, 1e-5, 80


def decode_wave(data: bytes) -> tuple[np.ndarray, int, int]:
    """(mono samples in -1 to 1, rate, channels) of PCM with one to four bytes a sample; other widths raise."""
    with wave.open(io.BytesIO(data)) as source:
        rate, channels, width = source.getframerate(), source.getnchannels(), source.getsampwidth()
        raw = source.readframes(source.getnframes())
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:  # the only unsigned kind
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / 2.0 ** (8 * width - 1)
    elif width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = wide.view("<i4")[:, 0].astype(np.float64) / 2.0**31
    else:
        raise ValueError(f"{width} bytes a sample")
    return x.reshape(-1, channels).mean(axis=1), rate, channels


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def pitch(x: np.ndarray, rate: int, low: float = 75, high: float = 500, voiced: float = 0.45) -> np.ndarray:
    """F0 of each 40 ms frame by autocorrelation, 0 where unvoiced: an approximation of a pitch tracker."""
    f = frames(x, int(0.04 * rate), int(0.01 * rate))
    f = f - f.mean(axis=1, keepdims=True)
    spectrum = np.abs(np.fft.rfft(f, 2 * f.shape[1])) ** 2
    r = np.fft.irfft(spectrum)[:, : f.shape[1]]
    first, last = int(rate / high), min(int(rate / low), r.shape[1] - 1)
    lag = first + np.argmax(r[:, first : last + 1], axis=1)
    strength = r[np.arange(len(r)), lag] / np.maximum(r[:, 0], 1e-12)
    return np.where((strength > voiced) & (r[:, 0] > 1e-8), rate / lag, 0.0)


def silence(db: np.ndarray, n: int, top_db: float) -> float | None:
    """Share of n samples outside frames louder than ``top_db`` below the loudest; a frame stands for HOP samples."""
    edges = np.minimum(np.arange(len(db) + 1) * HOP, n)
    return float(1 - np.diff(edges)[db > -top_db].sum() / n) if n else None


def acoustic_features(data: bytes) -> dict:
    """Duration, pitch, energy and silence of a WAV file; ``error`` says why there are none."""
    try:
        x, rate, channels = decode_wave(data)
        f0 = pitch(x, rate)
        spoken = f0[f0 > 0]
        rms = np.sqrt((frames(np.pad(x, FRAME // 2), FRAME, HOP) ** 2).mean(axis=1))
        full = 20 * np.log10(np.maximum(rms, FAINTEST) / max(rms.max(), FAINTEST))
        db = np.maximum(full, -LOWEST_DB)
        out = {
            "wav_duration": len(x) / rate, "sample_rate": rate, "n_channels": channels, "f0_mean": float(spoken.mean()) if len(spoken) else None, "f0_std": float(spoken.std()) if len(spoken) else None, "f0_voiced_ratio": float((f0 > 0).mean()),
            "e_mean_amp": float(rms.mean()), "e_std_amp": float(rms.std()), "e_mean_db": float(db.mean()), "e_std_db": float(db.std()), "s_top_db20": silence(full, len(x), 20), "s_top_db30": silence(full, len(x), 30), "error": None,
        }
    except Exception as problem:  # one bad file must not stop the rest; the row says what happened
        out = {"error": f"{type(problem).__name__}: {problem}"}
    return out


def read_waves(spark: SparkSession, folder: str) -> DataFrame:
    """One row of features a WAV file."""
    schema = T._parse_datatype_string(WAVE_SCHEMA)
    names = schema.fieldNames()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [{"path": p, **acoustic_features(c)} for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInPandas(run, schema)


