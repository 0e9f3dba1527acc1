"""Vectors as codes of a product codebook, found by partial-distance search.

Vectors of whole numbers are cut into equal parts. Each part position has a codebook that rounds of
assignment and averaging improve; a round is one pass over the vectors, from which each task returns a sum and a
count for each entry. The nearest entry is found dimension by dimension, those in which the codebook's entries differ
most first; a vector drops an entry as soon as its sum of squares exceeds the smallest whole distance so
far. Distances are exact whole numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.shared import free_name, join_hot, materialise

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
MOST_LONG = (1 << 63) - 1
#: Entries' sums meet in so many groups each before the last one.
SHARES = 64

Codebooks = list[list[list[int]]]


def quantised(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit numbers, or Python's whole numbers where some are too large for exact sums of squares."""
    if np.abs(flat).max(initial=0) * scale < 1 << 24:
        return np.floor(flat * scale).astype(np.int64)
    whole = lambda c: math.floor(c * scale) if abs(c) < 1e300 else math.floor(c) * scale
    return np.array([whole(c) for c in flat.tolist()], object)


def _vectors(batch: pa.RecordBatch, width: int, scale: int) -> np.ndarray:
    """Vertical layout, (dimension, row); shorter vectors end in zeros."""
    x = batch.column("x")
    lengths = np.diff(x.offsets.to_numpy())
    flat = quantised(x.flatten().to_numpy(zero_copy_only=False), scale)
    out = np.zeros((width, batch.num_rows), flat.dtype)
    row = np.repeat(np.arange(batch.num_rows), lengths)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = flat
    return out


def nearest(x: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the entry nearest to each column of ``x``, the lower one of equals, and its squared distance."""
    n = x.shape[1]
    small = x.dtype != object and max((abs(c) for e in entries for c in e), default=0) < 1 << 24
    x = x if small or x.dtype == object else x.astype(object)
    kind = np.int64 if small else object
    mean = [sum(column) / len(entries) for column in zip(*entries, strict=True)]
    spread = [sum((c - m) ** 2 for c in column) for column, m in zip(zip(*entries, strict=True), mean, strict=True)] if small else [0] * x.shape[0]
    order = sorted(range(x.shape[0]), key=lambda d: -spread[d])
    code = np.zeros(n, np.int64)
    best = np.zeros(n, kind)
    for d in order:
        step = x[d] - entries[0][d]
        best = best + step * step
    for e, entry in enumerate(entries[1:], 1):
        alive, total = None, np.zeros(n, kind)
        for d in order:
            step = (x[d] if alive is None else x[d, alive]) - entry[d]
            total = total + step * step
            stay = np.flatnonzero(total <= (best if alive is None else best[alive]))
            if len(stay) < len(total):
                alive, total = (stay if alive is None else alive[stay]), total[stay]
        better = np.flatnonzero(total < (best if alive is None else best[alive]))
        at = better if alive is None else alive[better]
        best[at], code[at] = total[better], e
    return code, best


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts)


def _sums(codebooks: Codebooks, width: int, scale: int):
    """A row for each entry that a task's vectors were assigned to: how many, and their sums as decimal numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            for p, x in enumerate(_parts(_vectors(batch, width, scale), len(codebooks))):
                code, _ = nearest(x, codebooks[p])
                order = np.argsort(code, kind="stable")
                used, begin = np.unique(code[order], return_index=True)
                sums = np.add.reduceat(x[:, order], begin, axis=1) if len(begin) else x[:, :0]
                for i, (e, n) in enumerate(zip(used.tolist(), np.diff(np.append(begin, len(order))).tolist(), strict=True)):
                    have = totals.setdefault((p, e), [0, [0] * len(x)])
                    have[0] += n
                    have[1] = [a + int(b) for a, b in zip(have[1], sums[:, i].tolist(), strict=True)]
        keys = sorted(totals)
        columns = [[p for p, _ in keys], [e for _, e in keys], [totals[k][0] for k in keys], [[str(c) for c in totals[k][1]] for k in keys]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "n", "sums"])

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = [str(sum(map(int, column))) for column in zip(*rows["sums"], strict=True)]
    return pd.DataFrame({"part": rows["part"].iloc[:1], "entry": rows["entry"].iloc[:1], "n": [rows["n"].sum()], "sums": [total]})


def improved(rows: DataFrame, codebooks: Codebooks, width: int, scale: int) -> Codebooks:
    """Codebooks after one round: each entry the floored mean of its parts, unused ones as they were."""
    kind = "part int, entry int, n long, sums array<string>"
    sums = rows.mapInArrow(_sums(codebooks, width, scale), kind)
    sums = sums.withColumn("share", F.pmod(F.xxhash64("sums"), F.lit(SHARES))).groupBy("part", "entry", "share").applyInPandas(_added, kind)
    found = sums.groupBy("part", "entry").applyInPandas(_added, kind).collect()
    out = [[list(e) for e in book] for book in codebooks]
    for r in found:
        out[r["part"]][r["entry"]] = [int(c) // r["n"] for c in r["sums"]]
    return out


def _encode(codebooks: Codebooks, width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            codes, error = np.zeros((n, len(codebooks)), np.uint8), np.zeros(n, object)
            for p, x in enumerate(_parts(_vectors(batch, width, scale), len(codebooks))):
                if codebooks[p]:
                    codes[:, p], distance = nearest(x, codebooks[p])
                    error = error + distance.astype(object)
            text = [row.tobytes().hex() if codebooks[0] else "" for row in codes]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("vec_id", "label")], pa.array(text, pa.string()), pa.array([min(int(e), MOST_LONG) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def fit_codebooks(rows: DataFrame, width: int, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    """Codebooks of (vec_id, x), begun with the vectors of the smallest ids."""
    ids = [r[0] for r in rows.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    first = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()
    whole = [[*quantised(np.array(r["x"], np.float64), scale).tolist(), *[0] * (width - len(r["x"]))] for r in first]
    step = width // parts
    codebooks = [[[int(c) for c in v[p * step : (p + 1) * step]] for v in whole] for p in range(parts)]
    for _ in range(rounds if whole else 0):
        codebooks = improved(rows, codebooks, width, scale)
    return codebooks


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Code every vector of (vec_id, embedding, label) by the nearest entry of each part's codebook.

    Components become floor(scale * x). Returns vec_id, code (an entry's index for each part, two hex digits), error (squared
    distances of all parts), label_error (errors of the rows with the same label, nulls together), codebooks_sha256 (of
    the codebooks' numbers by part, entry and position, joined by commas). Other columns are ignored.

    Rows whose vector is null or holds a null or non-finite component are left out. Vectors shorter than the longest,
    or than a multiple of ``parts``, count as ending in zeros. A null vec_id is coded but begins no
    codebook; of rows with the same vec_id the smallest vector may. With fewer vec_ids codebooks have fewer entries, with none all codes are
    empty and errors 0. Components of any finite size are taken exactly; errors beyond a long are held at its largest value.
    An empty table gives an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError(f"a code of two hex digits has 1 to 256 entries, not {entries}")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda c: c.cast("double")).alias("x"))
    rows = materialise(rows.where(F.col("x").isNotNull() & finite), "vectors")
    longest = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    width = max(1, -(-longest // parts)) * parts
    codebooks = fit_codebooks(rows, width, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(str(c) for book in codebooks for entry in book for c in entry).encode()).hexdigest()
    coded = materialise(rows.mapInArrow(_encode(codebooks, width, scale), "vec_id long, label string, code string, error long"), "codes")
    label = free_name(coded, "_label")
    coded = coded.withColumn(label, F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("label")))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long")
    by_label = materialise(coded.groupBy(label).agg(total.alias("label_error")), "labels")
    return join_hot(coded, by_label, label, "vec_id").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
