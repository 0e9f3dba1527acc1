"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words: a pattern is ``window`` consecutive words of a benchmark
item (a whole item, if it has fewer). For each pattern length, blocks of two
words index a shift table; a position whose block ends no pattern is skipped by
its shift. Where the shift is zero, the block's hash and that of the whole window select the patterns to
test, and a direct comparison of the words confirms an occurrence. Many
texts are searched side by side with NumPy; long texts are cut into stretches of
window ends, so that no text is slower per word than another.

A window costs about 40 bytes: its words lie once in one buffer, and patterns are places in it. Items are cut into pieces of
``PIECE_WORDS`` words that overlap by a window, and the pieces dealt into blocks of at most ``BLOCK_BYTES``, measured
as compiled. Each block is sent to the executors in a pass of its own; a pass writes only the keys, hit words and
items of the texts it found something in. Texts aren't shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.bytewords import ALNUM, U64, Words, find_words, mix
from talkmill.llm.shared import forget, free_name, materialise, slices

WINDOW = 10
#: Compiled bytes of a block at most: an executor's workers hold one each.
BLOCK_BYTES = 64_000_000
#: Compiled bytes of a word beside its own, at most.
WORD_BYTES = 36
PIECE_WORDS = 20_000
STRETCH = 512


class WuManber:
    """Patterns of one length: the words from each of some places of a buffer of words."""

    def __init__(self, length: int, words: Words, h: np.ndarray, begins: np.ndarray) -> None:
        self.length, self.block = length, min(2, length)
        self.mask = U64((1 << max(12, int(2 * len(begins)).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, min(255, length - self.block + 1), np.uint8)
        for end in range(self.block - 1, length):
            at = begins + end
            np.minimum.at(self.shift, (self._blocks(h, at) & self.mask).astype(np.int64), min(255, length - 1 - end))
        keys = self._keys(h, begins + length - 1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.begins = keys[order], begins[order].astype(np.int32)
        #: Whether a pattern's words are those of the one before it.
        self.same = np.zeros(len(order), bool)
        for i in np.flatnonzero(self.keys[1:] == self.keys[:-1]).tolist():
            self.same[i + 1] = words.bytes_of(*self._span(i)) == words.bytes_of(*self._span(i + 1))

    def _span(self, i: int) -> tuple[int, int]:
        return int(self.begins[i]), int(self.begins[i]) + self.length

    def _blocks(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        return mix(h[at] if self.block == 1 else h[at - 1] * U64(0x9E3779B97F4A7C15) + h[at])

    def _keys(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the windows that end at some words: their last block's hash, then the whole window's."""
        whole = np.zeros(len(at), U64)
        for j in range(self.length - 1, -1, -1):
            whole = mix(whole + h[at - j])
        return (self._blocks(h, at) >> U64(32) << U64(32)) | (whole >> U64(32))

    def search(self, words: Words, h: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first word, patterns from and to) of every occurrence inside one text; ``data``, ``start``, ``end``: the patterns' words."""
        m, ends = self.length, words.first[1:]
        begins = words.first[:-1] + m - 1
        pieces = np.maximum(0, -(-(ends - begins) // STRETCH))
        which = np.repeat(np.arange(len(begins)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = begins[which] + nth * STRETCH
        stop = np.minimum(at + STRETCH, ends[which])
        while len(at):
            step = self.shift[(self._blocks(h, at) & self.mask).astype(np.int64)].astype(np.int64)
            stopped = np.flatnonzero(step == 0)
            keys = self._keys(h, at[stopped])
            low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
            for i in np.flatnonzero(low < high).tolist():
                begin, p, last = int(at[stopped[i]]) - m + 1, int(low[i]), int(high[i])
                said = words.bytes_of(begin, begin + m)
                while p < last:
                    upto = p + 1
                    while upto < last and self.same[upto]:
                        upto += 1
                    a, b = self._span(p)
                    if data[start[a] : end[b - 1]] == said:
                        yield begin, p, upto
                    p = upto
            step[stopped] = 1
            at += step
            alive = at < stop
            at, stop = at[alive], stop[alive]


class Benchmark:
    """Compiled pieces of items, and the item that each one comes from."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int) -> None:
        words = find_words(pa.array([text for _, text in rows], pa.string()), ALNUM)
        h = words.hashes()
        self.data, self.start, self.end = words.data.tobytes(), words.start.astype(np.int32), words.end.astype(np.int32)
        self.first = words.first.astype(np.int32)
        self.names = sorted({item for item, _ in rows if item is not None})
        number = {item: i for i, item in enumerate(self.names)}
        self.item = np.array([-1 if item is None else number[item] for item, _ in rows], np.int32)  # a window of a null id has no item
        size = words.per_text
        length = np.minimum(size, window)
        piece = np.repeat(np.arange(len(rows)), np.maximum(size - length + 1, 0) * (size > 0))
        nth = np.arange(len(piece)) - np.repeat(np.flatnonzero(np.diff(piece, prepend=-1)), np.bincount(piece)[np.unique(piece)]) if len(piece) else piece
        begins = words.first[piece] + nth
        self.machines = [WuManber(int(m), words, h, begins[length[piece] == m]) for m in np.unique(length[piece])]

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[set[int]], Words, np.ndarray]:
        """Words per text, items (by number) per text, the words, and which words are hit."""
        words = find_words(texts, ALNUM)
        h = words.hashes()
        hit = np.zeros(len(h) + 1, np.int64)
        found: list[set[int]] = [set() for _ in range(len(texts))]
        for machine in self.machines:
            for begin, p, upto in machine.search(words, h, self.data, self.start, self.end):
                hit[begin] += 1
                hit[begin + machine.length] -= 1
                pieces = np.searchsorted(self.first, machine.begins[p:upto], "right") - 1
                found[int(np.searchsorted(words.first, begin, "right")) - 1].update(self.item[pieces].tolist())
        for x in found:
            x.discard(-1)
        return words.per_text, found, words, np.cumsum(hit[:-1]) > 0


def _pieces(window: int):
    """(item_id, text) to (item_id, text, size): pieces of PIECE_WORDS words at most, each window in one of them, and their compiled bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = find_words(batch.column("text"), ALNUM)
            for item, a, b in zip(batch.column("item_id").to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                spans = [(x, min(b, x + PIECE_WORDS)) for x in range(a, max(a + 1, b - window + 1), max(1, PIECE_WORDS - window + 1))] if a < b else []
                texts = [words.bytes_of(x, y).decode() for x, y in spans]
                sizes = [len(t.encode()) + WORD_BYTES * (y - x) for t, (x, y) in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(spans), pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["item_id", "text", "size"])

    return run


def benchmark_blocks(benchmark: DataFrame, window: int) -> tuple[DataFrame, int]:
    """Pieces of items with their block, none of more than BLOCK_BYTES unless it is one piece, and the number of blocks."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    pieces = rows.mapInArrow(_pieces(window), "item_id string, text string, size long")
    pieces = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")  # repeated items are dealt like others
    total = pieces.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
        if blocks == 1 or not dealt.groupBy("block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where((F.col("size") > BLOCK_BYTES) & (F.col("n") > 1)).head(1):
            return dealt, blocks
        blocks += max(1, blocks // 4)


def compiled(pieces: DataFrame, i: int, window: int):
    """A broadcast of one compiled block. Windows of a null id count, the id does not."""
    rows = pieces.where(F.col("block") == i).select("item_id", "text").collect()
    return pieces.sparkSession.sparkContext.broadcast(Benchmark([tuple(r) for r in rows], window))


def _runs(hit: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each text's hit words as runs (begin, end) within it."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        edges = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
        out.append(np.column_stack((np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))).astype("<i8").tobytes())
    return out


def _covered(hit: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(hit)))[first])


def _found_in(block, key: str):
    """Rows with a text to (key, n_words, runs, items), one for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = block.value.names
        for batch in slices(batches):
            per, found, words, hit = block.value.scan(batch.column("text"))
            items = [sorted(names[i] for i in x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(per, pa.int64()), pa.array(_runs(hit, words.first), pa.binary()), pa.array(items, pa.list_(pa.string()))], names=[key, "n_words", "runs", "items"])

    return run


def _judged(key: str):
    """(key, n_words, runs of each pass, items of each pass) to results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items = [], []
            for n, runs, own in zip(batch.column("n_words").to_pylist(), batch.column("runs").to_pylist(), batch.column("items").to_pylist(), strict=True):
                hit = np.zeros(n, bool)
                for raw in runs or ():
                    for begin, end in np.frombuffer(raw, "<i8").reshape(-1, 2).tolist():
                        hit[begin:end] = True
                hits.append(int(hit.sum()))
                items.append(sorted({x for part in own or () for x in part}))
            n_hit = pa.array(hits, pa.int64())
            shas = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_words"), n_hit, pa.array([len(x) for x in items], pa.int64()), pa.array(shas, pa.string()), pc.greater(n_hit, 0)], names=[key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def _searched(docs: DataFrame, key: str, pieces: DataFrame, blocks: int, window: int) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of (key, text), for each row."""
    kind = docs.schema[key].dataType.simpleString()
    result = f"{key} {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    one = f"{key} {kind}, n_words long, runs binary, items array<string>"
    if blocks == 1:
        found = docs.mapInArrow(_found_in(compiled(pieces, 0, window), key), one)
        return found.select(key, "n_words", F.array("runs").alias("runs"), F.array("items").alias("items")).mapInArrow(_judged(key), result)
    per_pass = []
    for i in range(blocks):
        block = compiled(pieces, i, window)
        found = docs.mapInArrow(_found_in(block, key), one)
        # The first pass tells the words of every text, the others only of what they found something in.
        per_pass.append(materialise(found if i == 0 else found.where(F.octet_length("runs") > 0), "found"))
        block.destroy()
    merged = per_pass[0]
    for more in per_pass[1:]:
        merged = merged.union(more)
    merged = materialise(merged.groupBy(key).agg(F.max("n_words").alias("n_words"), F.collect_list("runs").alias("runs"), F.collect_list("items").alias("items")), "merged")
    forget(*per_pass)
    return merged.mapInArrow(_judged(key), result)


def _keyed(docs: DataFrame, blocks: int) -> tuple[DataFrame, str]:
    """Rows with a key of their own, written once where several passes read them."""
    key = free_name(docs, "_row")
    rows = docs.withColumn(key, F.monotonically_increasing_id())
    return (materialise(rows, "rows") if blocks > 1 else rows), key


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words of each document that lie inside an occurrence of a benchmark window.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; other columns are ignored.
    Words: A-Z lower-cased, runs of 0-9, a-z and anything beyond ASCII. Returns, for each
    input row, doc_id, n_words, n_hit, n_items, items_sha256 (hex SHA-256 of the
    ids of the items that occur, sorted as strings and joined by commas),
    contaminated (n_hit > 0).

    A null or empty text has no words and no hit. Items of fewer than ``window`` words
    are one window; items without words occur nowhere. Overlapping occurrences
    count a word once; a window of several items counts for all. Repeated rows
    are judged alike. An item with a null id is searched for like others, but is left out of
    n_items and items_sha256. Empty tables give no hits.
    """
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    pieces, blocks = benchmark_blocks(benchmark, window)
    if blocks == 1:
        return _searched(kept, "doc_id", pieces, blocks, window)
    rows, key = _keyed(kept, blocks)
    found = _searched(rows.select(key, "text"), key, pieces, blocks, window)
    return rows.select(key, "doc_id").join(found, key).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs. Nulls, empty and repeated rows as above."""
    pieces, blocks = benchmark_blocks(benchmark, window)
    if blocks > 1:
        rows, key = _keyed(docs, blocks)
        found = _searched(rows.select(key, F.col("text").cast("string").alias("text")), key, pieces, blocks, window)
        return rows.join(found.where("contaminated").select(key), key, "left_anti").select(docs.columns)
    block = compiled(pieces, 0, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, _, words, hit = block.value.scan(batch.column("text"))
            yield batch.filter(pa.array(_covered(hit, words.first) == 0))

    return docs.mapInArrow(run, docs.schema)
