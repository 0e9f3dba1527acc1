"""Shared storage and small helpers for the training-data operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
the driver and all executors see; they cut lineage and survive lost executors.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.shipping import ship


ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors; unless the user chose otherwise, send texts to Python in small batches."""
    ship(spark)
    if spark.conf.get(ROWS_A_BATCH) == "10000":
        spark.conf.set(ROWS_A_BATCH, "2000")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="talkmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/talkmill/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    # Small row groups: a writing task buffers one in memory.
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


#: Rows of a narrow table that are broadcast at most, and the shares a key's rows are dealt to beyond.
MOST_BROADCAST_ROWS, SALTS = 300_000, 32


def shuffled(table: DataFrame) -> DataFrame:
    """``table`` as a side of a join that Spark must not broadcast.

    Spark goes by a table's bytes on disk, and of stored ids 10 MB are some hundred MB in the driver.
    Only counted tables are broadcast here.
    """
    return table.hint("merge")


def join_hot(big: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join where many rows of ``big`` have the same key; ``small``: one narrow row a key, cheap to count.

    A counted, small table is broadcast. A larger one is copied SALTS times, and the
    rows of a key are dealt over the copies by a hash of ``by``.
    """
    if small.count() <= MOST_BROADCAST_ROWS:
        return big.join(F.broadcast(small), key)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(shuffled(salted), [key, "_salt"]).drop("_salt")


#: Rows of a key that one task joins; keys of more rows are split. Keys to split, at most.
HOT_ROWS, MOST_HOT_KEYS = 1_000, 50_000


def hot_keys(counts: DataFrame, total: int) -> DataFrame:
    """(key, shares) of the keys of (key, n) to split, n of ``total`` rows each: MOST_HOT_KEYS keys at most."""
    each = max(HOT_ROWS, total // MOST_HOT_KEYS + 1)
    return materialise(counts.where(F.col("n") > each).select("key", F.ceil(F.col("n") / each).cast("int").alias("shares")), "hot")


def join_split(big: DataFrame, small: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """Inner join where some keys have many rows of ``big``; ``small``: one row a key, of any size and number.

    The rows of a key in ``hot`` (see :func:`hot_keys`) are dealt over its shares by a hash
    of ``by``; only those keys' rows of ``small`` are copied.
    """
    hot = F.broadcast(hot.withColumnRenamed("key", key))
    shares = F.coalesce("shares", F.lit(1))
    copied = small.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
    dealt = big.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), shares).cast("int")).drop("shares")
    return dealt.join(shuffled(copied), [key, "_salt"]).drop("_salt")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this module through the file system it lives on."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            drop_path(table.sparkSession, folder)


def drop_all(spark: SparkSession) -> None:
    """Delete every intermediate table; call when no result is read any more."""
    drop_path(spark, f"{shared_folder(spark)}/talkmill")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as ``df`` has a column named so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def fold_of(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; null ids: fold of ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has about ``max_bytes`` of text; rows stay whole."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > begin and total + n > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)
    pa.default_memory_pool().release_unused()  # workers outlive their task


def set_quiet_threads() -> None:
    """One thread per Python worker: the executor's cores are already counted by Spark."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
