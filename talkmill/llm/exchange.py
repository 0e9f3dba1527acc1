"""Blocks of texts ask for what all blocks together know of their keys.

A block sends its distinct keys, sorted and cut by range, one packed row for each range that it
has keys of. A range's task learns of every key the smallest and the largest document, and answers each
block in the order it asked, so answers carry no keys. A key is sent once a block, however often it occurs.
Rows never grow with the number of copies of a text, and nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.bytewords import U64

KEYS_A_RANGE = 600_000
ASK_SCHEMA = "range long, keys binary, checks binary, lo binary, hi binary"


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as their span needs, like bytes together, compressed."""
    x = np.asarray(x)
    if not len(x):
        return b""
    least = int(x.min())
    span = int(x.max()) - least
    width = max(1, (span.bit_length() + 7) // 8)
    rest = (x.astype(U64) - U64(least & (2**64 - 1))).view(np.uint8).reshape(-1, 8)[:, :width]
    return (least & (2**64 - 1)).to_bytes(8, "little") + bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(rest.T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    """The numbers of :func:`pack` as 64-bit whole numbers."""
    if not data:
        return np.zeros(0, np.int64)
    least, width = int.from_bytes(data[:8], "little"), data[8]
    columns = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:]), np.uint8).reshape(width, -1)
    out = np.zeros((columns.shape[1], 8), np.uint8)
    out[:, :width] = columns.T
    return (out.view(U64).ravel() + U64(least)).view(np.int64)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned numbers by their steps."""
    return pack(np.diff(x, prepend=x[:1] * 0)) if len(x) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).view(U64), dtype=U64)


def range_bits(keys: int) -> int:
    """Ranges, as a power of two, so that a task can hold one at any size of the corpus."""
    return max(0, int(np.ceil(np.log2(max(1, keys / KEYS_A_RANGE)))))


def ask(keys: np.ndarray, checks: np.ndarray | None, lo: np.ndarray, hi: np.ndarray | None, key_bits: int, ranges: int, first_range: int = 0) -> list[dict]:
    """Rows of ASK_SCHEMA for distinct keys in order; ``checks``: what tells apart documents' contents with the same key, ``lo``/``hi``: least and largest document."""
    if not len(keys):
        return []
    of = (keys >> U64(key_bits - ranges)).astype(np.int64) if ranges else np.zeros(len(keys), np.int64)
    cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(keys))  # only ranges that have keys
    part = lambda x, a, b, f: None if x is None else f(x[a:b])
    return [
        {"range": first_range + int(of[a]), "keys": pack_sorted(keys[a:b]), "checks": part(checks, a, b, lambda c: c.tobytes()), "lo": pack(lo[a:b]), "hi": part(hi, a, b, pack)}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
    ]


def distinct(keys: np.ndarray, checks: np.ndarray | None, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, check) in order, the least and largest document of each, and the place of every row among them."""
    order = np.argsort(keys, kind="stable") if checks is None else np.lexsort((checks, keys))
    k, d = keys[order], docs[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if checks is not None:
        new[1:] |= checks[order][1:] != checks[order][:-1]
    at = np.flatnonzero(new)
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    lo, hi = (f.reduceat(d, at) if len(at) else d[:0] for f in (np.minimum, np.maximum))
    return k[at], None if checks is None else checks[order][at], lo, hi, place


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Bits for each asked key: is it in several documents, is it in one before all of the block's?"""
    keys = [unpack_sorted(x) for x in rows["keys"]]
    with_checks = [np.zeros(len(k), U64) if c is None else np.frombuffer(c, U64) for k, c in zip(keys, rows["checks"], strict=True)]
    lo = [unpack(x) for x in rows["lo"]]
    hi = [a if x is None else unpack(x) for a, x in zip(lo, rows["hi"], strict=True)]
    _, _, first, _, place = distinct(np.concatenate(keys), np.concatenate(with_checks), np.concatenate(lo))
    last = np.full(len(first), np.iinfo(np.int64).min)
    np.maximum.at(last, place, np.concatenate(hi))
    cuts = np.cumsum([0, *map(len, keys)])
    bits = []
    for a, b, own in zip(cuts[:-1], cuts[1:], lo, strict=True):
        p = place[a:b]
        bits.append(np.packbits(np.concatenate((first[p] < last[p], first[p] < own))).tobytes())
    return pd.DataFrame({"block": rows["block"], "range": rows["range"], "n": np.diff(cuts), "bits": bits})


def answers(asked: DataFrame) -> DataFrame:
    """(block, answers) of rows (block, ASK_SCHEMA)."""
    told = asked.groupBy("range").applyInPandas(_answer, "block long, range long, n long, bits binary")
    return told.groupBy("block").agg(F.collect_list(F.struct("range", "n", "bits")).alias("answers"))


def told(found: list[dict] | None, ranges: Callable[[int], bool] = lambda r: True) -> tuple[np.ndarray, np.ndarray]:
    """A block's answers to its keys in order: (in several documents, in one before)."""
    several, before = [np.zeros(0, bool)], [np.zeros(0, bool)]
    for a in sorted((a for a in found or () if ranges(a["range"])), key=lambda a: a["range"]):
        bits = np.unpackbits(np.frombuffer(a["bits"], np.uint8))[: 2 * a["n"]].astype(bool)
        several.append(bits[: a["n"]])
        before.append(bits[a["n"] :])
    return np.concatenate(several), np.concatenate(before)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}
    pa.default_memory_pool().release_unused()
