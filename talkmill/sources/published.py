"""Tables published version by version: readers see the old one or the new one, whole, whenever a writer is killed.

A version is written to a folder of its own and read back for its row count and content hash. Then a small file, put in place by one
rename, names it. Versions before it stay as backups until ``keep`` newer ones are there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_CURRENT.json"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    with_lines = spark._jvm.java.util.Scanner(fs.open(at), "UTF-8").useDelimiter("\\A")
    try:
        return with_lines.next()
    finally:
        with_lines.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _put_in_place(spark: SparkSession, source: str, target: str) -> None:
    """One rename that replaces what is there."""
    jvm = spark._jvm
    _, a = _fs(spark, source)
    _, b = _fs(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(a, b, options)


def fingerprint(df: DataFrame) -> dict:
    """Rows and a hash of their contents that doesn't depend on their order."""
    row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(df.columns)])
    n, total = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first()
    return {"rows": n, "hash": str(total or 0)}


def _pointer(spark: SparkSession, path: str) -> dict:
    text = _read_text(spark, f"{path}/{POINTER}")
    return json.loads(text) if text else {"versions": []}


def publish(df: DataFrame, path: str, keep: int = 2) -> str:
    """Write ``df`` as the next version of the table at ``path`` and make it the current one; returns its name. ``keep``: versions kept before it."""
    spark = df.sparkSession
    name = uuid.uuid4().hex[:12]
    df.write.parquet(f"{path}/versions/{name}")
    entry = {"name": name} | fingerprint(spark.read.parquet(f"{path}/versions/{name}"))
    versions = [*_pointer(spark, path)["versions"], entry]
    staged = f"{path}/{POINTER}.{name}"
    _write_text(spark, staged, json.dumps({"versions": versions[-1 - keep :]}))
    _put_in_place(spark, staged, f"{path}/{POINTER}")
    for old in versions[: -1 - keep]:
        fs, at = _fs(spark, f"{path}/versions/{old['name']}")
        fs.delete(at, True)
    return name


def read_published(spark: SparkSession, path: str, back: int = 0, verify: bool = False) -> DataFrame:
    """The current version, or the one ``back`` versions before it; ``verify``: fail unless rows and hash are those published."""
    versions = _pointer(spark, path)["versions"]
    if len(versions) <= back:
        raise FileNotFoundError(f"{path} has {len(versions)} versions")
    entry = versions[-1 - back]
    df = spark.read.parquet(f"{path}/versions/{entry['name']}")
    if verify and fingerprint(df) != {k: entry[k] for k in ("rows", "hash")}:
        raise ValueError(f"{path}: version {entry['name']} is not as it was published")
    return df
