"""Sinks: Parquet with guards, CSV for spreadsheets, request and chat JSON lines, file copies."""

from __future__ import annotations

import csv
import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str, if_exists: str = "error") -> None:
    """Write Parquet; ``if_exists``: error (never re-shuffle), ignore (keep what is there), overwrite."""
    df.write.mode({"error": "errorifexists"}.get(if_exists, if_exists)).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, for any size."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_spreadsheet_csv(df: DataFrame, path: str, most: int = 100_000) -> int:
    """One UTF-8 file with a byte-order mark. For reports: fails beyond ``most`` rows rather than cutting them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write_csv has no such limit")
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        writer.writerows(rows)
    return len(rows)


def request_lines(df: DataFrame, model: str, url: str, prompt: str = "prompt", custom_id: str = "custom_id") -> DataFrame:
    """One JSON request a row, for a batch API."""
    message = F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.lit(0).alias("temperature"), F.array(message).alias("messages"))
    return df.select(F.to_json(F.struct(F.col(custom_id).alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body"))).alias("value"))


def chat_lines(df: DataFrame, keys: list[str], order: str, role: str, content: str, audio: str | None = None) -> DataFrame:
    """One fine-tuning example a group: its messages in order, and its audio paths."""
    message = F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content"), (F.col(audio) if audio else F.lit(None).cast("string")).alias("audio"))
    items = F.array_sort(F.collect_list(message))
    messages = F.transform("items", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    audios = F.filter(F.transform("items", lambda m: m["audio"]), lambda a: a.isNotNull())
    return df.groupBy(*keys).agg(items.alias("items")).select(F.to_json(F.struct(messages.alias("messages"), audios.alias("audios"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def copy_files(spark: SparkSession, wanted: DataFrame, target: str) -> DataFrame:
    """Copy files of (source, name) to a shared folder; a manifest says how each fared.

    Returns source, name, n_bytes, error ('missing', 'unreadable: ...' or null). Both
    paths must be mounted on all executors. A file is copied by the megabyte; the copy is verified by size and put in place by a rename, so a repeated task does no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(target, exist_ok=True)
        for pdf in batches:
            rows = []
            for source, name in zip(pdf["source"], pdf["name"], strict=True):
                try:
                    final = os.path.join(target, name)
                    own = f"{final}.{os.getpid()}.part"
                    with open(source, "rb") as f, open(own, "wb") as g:
                        shutil.copyfileobj(f, g, 1 << 20)
                    whole = os.path.getsize(own) == os.path.getsize(source)
                    if whole:
                        os.replace(own, final)
                    else:
                        os.remove(own)
                    rows.append((source, name, os.path.getsize(final) if whole else 0, None if whole else "unreadable: short copy"))
                except FileNotFoundError:
                    rows.append((source, name, 0, "missing"))
                except OSError as problem:
                    rows.append((source, name, 0, f"unreadable: {problem}"))
            yield pd.DataFrame(rows, columns=["source", "name", "n_bytes", "error"])

    return wanted.select("source", "name").mapInPandas(run, "source string, name string, n_bytes long, error string")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report table; fails beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a report")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def exists_in(listing: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Rows whose file is in a listing (path)."""
    return df.join(listing.select(F.col("path").alias(column)), column, "left_semi")


