"""Sharding by rendezvous hashing, in DataFrame functions only.

Every (record key, shard) pair gets a pseudo-random value; a record goes to the
shard with the best value, ``-ln(u) / weight`` being smallest. Adding a shard
adds one more value, so records only ever move into the new shard.

The values come from two 28-bit pieces of the key's MD5 and integer arithmetic
below 2**62, the same in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.shared import MOST_BROADCAST_ROWS, materialise

PRIME = 2147483647
#: Rows of one shard that are numbered by one task.
ROWS_A_BUCKET = 20_000


def _hex(column: Column, start: int) -> Column:
    return F.conv(F.substring(column, start, 7), 16, 10).cast("long")


def scores(k1: Column, k2: Column, weights: Sequence[float]) -> Column:
    """An array with the value of each shard; the smallest wins."""
    def step(x: Column, shift: int, factor: int, plus: Column) -> Column:
        return (x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor) + plus) % F.lit(PRIME)

    x = F.transform(F.sequence(F.lit(1), F.lit(len(weights))), lambda s: (((k1 + s.cast("long") * F.lit(1640531527)) % F.lit(PRIME)) * F.lit(48271) + k2) % F.lit(PRIME))
    x = F.transform(x, lambda v: step(v, 15, 69621, k1))
    x = F.transform(x, lambda v: step(v, 13, 39373, k2))
    x = F.transform(x, lambda v: step(v, 16, 48271, k1))
    if len(set(weights)) == 1:  # the order of -ln(u) is that of -u
        return F.transform(x, lambda v: -v)
    given = F.array(*[F.lit(float(w)) for w in weights])
    return F.transform(x, lambda v, i: -F.log((v + 1) / F.lit(PRIME + 1.0)) / given[i])


def best(values: Column) -> Column:
    """Position of the smallest value, ties to the first."""
    return F.array_min(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))["i"]


def rendezvous_shards(docs: DataFrame, weights: Sequence[float], next_weight: float | None = None) -> DataFrame:
    """Assign the rows of (doc_id, text) to ``len(weights)`` shards by doc_id.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32 (unsigned),
    law 'key', shard, slot (0, 1, ... within the shard, without gaps), grown_shard
    (the shard once one more, of ``next_weight``, is added). Weights are positive;
    a shard's expected share is in proportion to its weight.

    A null text counts as empty: size 16, crc 0. A null doc_id is hashed as the
    empty key. Rows with equal doc_id land in the same shard and get different
    slots. Other columns are ignored. An empty table gives an empty result.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    n = len(weights)
    buckets = max(1, docs.count() // (n * ROWS_A_BUCKET) + 1)
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("octets"), F.crc32(text.cast("binary")).alias("text_crc32"), digest.alias("digest"))
    rows = rows.withColumns({"k1": _hex(F.col("digest"), 1), "k2": _hex(F.col("digest"), 8)})
    rows = rows.withColumn("v", scores(F.col("k1"), F.col("k2"), [*weights, next_weight or weights[-1]]))
    rows = rows.select(
        "doc_id", (F.col("octets") + 16).alias("size"), "text_crc32", F.lit("key").alias("law"), best(F.slice("v", 1, n)).cast("int").alias("shard"), best(F.col("v")).cast("int").alias("grown_shard"), (F.col("k1") % buckets).alias("bucket")
    )
    # Hashed once: the narrow rows are written, counted and numbered from there.
    rows = materialise(rows, "shards")
    # Rows of a shard are numbered bucket by bucket; buckets are small and even.
    counts = rows.groupBy("shard", "bucket").count()
    before = "coalesce(sum(count) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding), 0)"
    offsets = counts.select("shard", "bucket", F.expr(before).alias("offset"))
    rows = rows.withColumn("nth", F.expr("row_number() over (partition by shard, bucket order by doc_id, text_crc32, size)"))
    return rows.join(F.broadcast(offsets) if buckets * n <= MOST_BROADCAST_ROWS else offsets, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"), "grown_shard")
