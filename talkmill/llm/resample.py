"""Target-distribution importance resampling over hashed n-grams.

Every task puts the words of its texts, as ids, into a suffix array ordered by the first ``longest`` words. Suffixes with a
common prefix of m words stand side by side there: each such run of the array is one n-gram of m words, whose
bucket is worked out once (from the hash of its first m - 1 words and that of its last) and scattered back
to all its occurrences. Buckets are kept with each text; counting and scoring read them from there.

A bucket's gain compares how often it occurs in the target texts and in all texts. A text's weight is the mean of
its gains, and a draw without replacement takes the highest sums of weight and a Gumbel number of the row's id.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.bytewords import ALNUM, Words, find_words
from talkmill.llm.shared import materialise, slices

BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Texts of a suffix array have so many bytes, or one text has more.
ARRAY_BYTES = 3_000_000


def _crc_tables() -> list[np.ndarray]:
    """For each k, what CRC-32 registers become after 2**k zero bytes: four tables, one for each byte of the register."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    values = np.arange(256, dtype=np.uint32)
    first = np.stack([values << np.uint32(8 * i) for i in range(4)])
    tables = [one[first & 255] ^ (first >> np.uint32(8))]
    while len(tables) < 40:
        tables.append(_shifted(tables[-1], tables[-1]))
    return tables


def _shifted(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = tables[0][x & 255]
    for i in range(1, 4):
        out = out ^ tables[i][(x >> np.uint32(8 * i)) & 255]
    return out


_TABLES = _crc_tables()


def crc_joined(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings in a row from the CRC-32 of each, and the sizes of the second ones."""
    out = a.astype(np.uint32)
    k = 0
    while len(sizes) and int(sizes.max()) >> k:
        use = np.flatnonzero((sizes >> k) & 1)
        out[use] = _shifted(_TABLES[k], out[use])
        k += 1
    return out ^ b


class SuffixArray:
    """Suffixes of word ids, ordered by their first ``longest`` words; none reaches beyond its text."""

    def __init__(self, words: Words, longest: int) -> None:
        _, first, self.ids = np.unique(words.hashes(), return_index=True, return_inverse=True)
        n = len(self.ids)
        self.left = np.repeat(words.first[1:].astype(np.int64), np.diff(words.first)) - np.arange(n)  # words to the text's end
        self.word_crcs = np.array([zlib.crc32(words.data[s:e]) for s, e in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)], np.uint32)
        self.word_sizes = (words.end - words.start)[first]
        rank, depth = self.ids + 1, 1
        while depth < longest:
            behind = np.where(self.left > depth, np.append(rank[depth:], np.zeros(min(depth, n), np.int64)), 0)
            rank = np.unique(rank * (n + 2) + behind, return_inverse=True)[1] + 1
            depth *= 2
        self.order = np.argsort(rank, kind="stable")
        self.common = np.zeros(n, np.int64)  # words that a suffix shares with the one before it, ``longest`` at most
        at, before = self.order[1:], self.order[:-1]
        same = np.ones(max(0, n - 1), bool)
        for m in range(longest):
            same &= (self.left[at] > m) & (self.left[before] > m)
            i = np.flatnonzero(same)
            same[i] = self.ids[at[i] + m] == self.ids[before[i] + m]
            self.common[1:] += same

    def crcs(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each m: where n-grams of m words begin, in array order, and the CRC-32 of each, worked out once a run."""
        at, crc = self.order, None
        common = self.common
        for m in range(1, longest + 1):
            has = self.left[at] >= m  # suffixes too short for m words stand before those that go on
            new = np.flatnonzero((common < m) & has)
            last = self.ids[at[new] + m - 1]
            one = self.word_crcs[last]
            if crc is not None:
                blank = crc_joined(crc[new], np.full(len(new), zlib.crc32(b" "), np.uint32), np.ones(len(new), np.int64))
                one = crc_joined(blank, one, self.word_sizes[last])
            run = np.cumsum((common < m) & has) - 1
            crc = np.where(has, one[np.maximum(run, 0)] if len(one) else 0, 0).astype(np.uint32)
            yield at[has], crc[has]


def _features(longest: int, buckets: int):
    """(doc_id, text) to (doc_id, n_words, buckets): the bucket of each n-gram of 1 to ``longest`` words, as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=ARRAY_BYTES):
            words = find_words(batch.column("text"), ALNUM)
            array = SuffixArray(words, longest)
            n = len(array.ids)
            table = np.full((n, longest), -1, np.int32)
            for m, (at, crc) in enumerate(array.crcs(longest)):
                table[at, m] = crc % np.uint32(buckets)
            flat = table.ravel()
            flat = flat[flat >= 0]
            upto = np.concatenate(([0], np.cumsum(np.minimum(array.left, longest))))[words.first]
            kind = np.uint16 if buckets <= 1 << 16 else np.uint32
            found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((upto * np.dtype(kind).itemsize).astype(np.int64)), pa.py_buffer(flat.astype(kind).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.per_text, pa.int64()), pa.array(np.diff(upto), pa.int64()), found.cast(pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])

    return run


_FEATURES = "doc_id long, n_words long, n_features long, buckets binary"


def _numbers(batch: pa.RecordBatch, buckets: int) -> np.ndarray:
    column = batch.column("buckets")
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    raw = column.buffers()[2] or b""
    return np.frombuffer(raw, np.uint16 if buckets <= 1 << 16 else np.uint32)[ends[0] // (2 if buckets <= 1 << 16 else 4) : ends[-1] // (2 if buckets <= 1 << 16 else 4)]


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_numbers(batch, buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return run


def _bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; the driver gets ``buckets`` numbers at most."""
    rows = features.select("buckets").mapInArrow(_counts(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, object)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(target share / source share)) of each bucket, with one added to every count."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_features").to_numpy(zero_copy_only=False)
            upto = np.concatenate(([0], np.cumsum(n)))
            sums = np.concatenate(([0], np.cumsum(gains[_numbers(batch, len(gains))] if batch.num_rows else np.zeros(0, np.int64))))[upto]
            weight = np.diff(sums) // np.maximum(n, 1)  # whole numbers: floored
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def ranked(rows: DataFrame, order: list, column: str) -> DataFrame:
    """``rows`` with their place, from 1, in an order of all rows. No task holds more than a range of them."""
    at = "_at"
    dealt = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.expr(f"{at} >> 33")
    sizes = dealt.groupBy(part.alias("_part")).count()
    # A row for each task of the sort.
    before = sizes.selectExpr("_part", "sum(count) over (order by _part rows between unbounded preceding and current row) - count as _before")
    return dealt.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(column, F.expr(f"_before + ({at} & {(1 << 33) - 1}) + 1")).drop(at, "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Draw ``percent`` % of the texts with ``least_words`` words at least, those like ``target`` with more chance.

    ``docs``: doc_id, text; ``target``: text; other columns are ignored. Words: A-Z lower-cased, runs of 0-9, a-z and
    anything beyond ASCII. Features are all runs of 1 to ``longest`` words, repeats counted. Returns for each input row
    doc_id, n_features, weight (floored mean of its features' gains; 0 without features), score (weight and the
    floored thousandfold of a Gumbel number made from seed and doc_id) and rank (1, 2, ... for drawn rows, else null).
    Ties in score go to the smaller doc_id, nulls last.

    Null, empty and blank texts have no features and, with ``least_words`` above 0, aren't drawn. A null doc_id is
    hashed as the empty text. Repeated rows count and are drawn as often as they occur. Without target texts the
    gains only favour rare buckets; an empty table gives an empty result. Texts and words of any length are read whole.
    """
    of = lambda rows: rows.mapInArrow(_features(longest, buckets), _FEATURES)
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = materialise(of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))), "features")
    gains = bucket_gains(_bucket_counts(features, buckets), _bucket_counts(of(wanted), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = features.mapInArrow(_weigh(gains), "doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + gumbel)
    rows = materialise(rows.withColumn("fits", F.col("n_words") >= least_words).drop("n_words"), "scores")
    n = rows.where("fits").count() * percent // 100
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = ranked(rows, order, "place")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("fits") & (F.col("place") <= n), F.col("place")).alias("rank"))
