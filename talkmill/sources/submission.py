"""Request chunks as a sink: tasks stage and submit, the driver records what was committed.

A chunk's file is named by the hash of its bytes, and that hash is the key under which the service takes it:
asked again with a key it knows, it names the batch it already has. A task that dies between submitting and
committing, a copy of a task that runs beside it and a job that is started again thus send nothing twice; and nothing
is lost, as a job's manifest appears only once all of its tasks have committed.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


class KeyedService(Protocol):
    """A service with idempotency keys; it is pickled and called on executors."""

    def submit_once(self, requests: str, key: str) -> str:
        """The batch of a request file; the same key, even twice at once, gives the same batch."""
        ...


@dataclass
class Submitted(WriterCommitMessage):
    """(chunk, key, batch, requests) of one task."""

    chunks: list[tuple[int, str, str, int]] = field(default_factory=list)


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, service: str):
        self.folder, self.service = folder, service

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Submitted:
        """Rows come sorted by (chunk, custom_id): a chunk at a time is staged, named and submitted."""
        service: KeyedService = cloudpickle.loads(bytes.fromhex(self.service))
        done = Submitted()
        chunk, staged = None, None
        for batch in iterator:
            columns = (batch.column(c).to_pylist() for c in ("chunk", "line"))
            for number, line in zip(*columns, strict=True):
                if staged is None or number != chunk:
                    if staged is not None:
                        done.chunks.append(staged.send_to(service, chunk))
                    chunk, staged = number, Staged(self.folder)
                staged.add(line)
        if staged is not None:
            done.chunks.append(staged.send_to(service, chunk))
        return done

    def commit(self, messages: list[Submitted | None]) -> None:
        """The manifest: one line a chunk, published by one rename."""
        lines = sorted(c for m in messages if m is not None for c in m.chunks)
        rows = [dict(zip(("chunk", "key", "batch", "requests"), c, strict=True)) for c in lines]
        passing = os.path.join(self.folder, f".manifest-{uuid.uuid4().hex}")
        with open(passing, "w", encoding="utf-8") as out:
            out.writelines(json.dumps(r) + "\n" for r in rows)
        os.replace(passing, os.path.join(self.folder, "manifest.jsonl"))

    def abort(self, messages: list[Submitted | None]) -> None:
        """Nothing is called back: what was submitted is found again by its key when the job is repeated."""


class Staged:
    """One chunk's file in the making."""

    def __init__(self, folder: str):
        self.folder, self.hash, self.rows = folder, hashlib.sha256(), 0
        self.passing = os.path.join(folder, f".staged-{uuid.uuid4().hex}")
        self.out = open(self.passing, "wb")  # noqa: SIM115

    def add(self, line: str) -> None:
        data = line.encode() + b"\n"
        self.hash.update(data)
        self.out.write(data)
        self.rows += 1

    def send_to(self, service: KeyedService, chunk: int) -> tuple[int, str, str, int]:
        self.out.close()
        key = self.hash.hexdigest()
        path = os.path.join(self.folder, f"{key}.jsonl")
        os.replace(self.passing, path)
        return chunk, key, service.submit_once(path, key), self.rows


class RequestChunks(DataSource):
    """``df.write.format("request_chunks")``; options: path, service (pickled, as hexadecimal digits)."""

    @classmethod
    def name(cls) -> str:
        return "request_chunks"

    def schema(self) -> str:
        return "chunk long, line string"

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        os.makedirs(self.options["path"], exist_ok=True)
        return ChunkWriter(self.options["path"], self.options["service"])


def submit_chunks(requests: DataFrame, service: KeyedService, folder: str) -> DataFrame:
    """Send (chunk, custom_id, body) chunk by chunk; returns the manifest (chunk, key, batch, requests).

    ``folder`` is shared by driver and executors. A chunk is one file with one JSON line a request, in the order of custom_id and
    body, so that its bytes don't depend on how rows are spread; chunk sizes are the packer's business (``greedy_chunks``).
    A null chunk is an error, found before anything is sent; requests that occur twice are sent twice; two chunks of the same
    bytes are one batch. Without requests the manifest is empty.
    """
    spark: SparkSession = requests.sparkSession
    line = F.to_json(F.struct("custom_id", "body"))
    number = F.coalesce(F.col("chunk").cast("long"), F.raise_error(F.lit("a request has no chunk")).cast("long"))
    rows = requests.select(number.alias("chunk"), "custom_id", "body", line.alias("line")).repartition("chunk").sortWithinPartitions("chunk", "custom_id", "body").select("chunk", "line")
    spark.dataSource.register(RequestChunks)
    rows.write.format("request_chunks").option("service", cloudpickle.dumps(service).hex()).mode("append").save(folder)
    return spark.read.schema("chunk long, key string, batch string, requests long").json(f"{folder}/manifest.jsonl")
