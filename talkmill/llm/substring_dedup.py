"""Removal of long word sequences that an earlier document holds, by recompression.

1. Texts are written once as blocks of about ``BLOCK_BYTES``; everything later works on blocks.
2. Texts are recompressed (see :mod:`recompress`). A first Spark round gathers, from all blocks, pairs of
   low symbols and pairs of high ones. A window can repeat only if all low pairs that rest on its own
   words alone are in several documents; most windows are ruled out by that. High pairs stand for
   whole stretches: where an earlier document has the same, every window inside goes at once.
3. What is left of repeats, mainly their first occurrences and their ends, is asked for window by window in a second
   round, under 128-bit names of the words. A window that an earlier document has is removed.

A window with no symbol that rests on it alone (inside long runs of one word, say) is always asked for, so
nothing is lost. Low names are cut to as many bits as the corpus needs; a chance match there only
asks for a window in vain. Copies of a passage are sent once a block and round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.bytewords import NOT_SPACE, U64, Words, find_words, layout, mix
from talkmill.llm.exchange import ASK_SCHEMA, answers, ask, distinct, pack, pack_sorted, range_bits, rows_of, told, unpack
from talkmill.llm.recompress import Level, levels
from talkmill.llm.shared import forget, materialise, slices

WINDOW = 13
BLOCK_BYTES = 3_000_000
#: Blocks are numbered by partition and, inside, in order.
BLOCKS_A_PARTITION = 1 << 32
#: Of the low pairs, those whose names end in so many zero bits ask. Which do depends on their words alone.
THIN = 1
#: Low names have so many bits more than the corpus has bytes in bits.
SPARE_BITS = 6

BLOCK_SCHEMA = "block long, ids binary, nulls binary, lengths binary, texts binary, n_bytes long"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_FOUND = f"block long, done array<struct<{_RESULT}>>, ids binary, lengths binary, texts binary, gone binary, windows binary, places binary, asks array<struct<{ASK_SCHEMA}>>"
_DONE = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
_ASKED = [("range", pa.int64()), *[(c, pa.binary()) for c in ("keys", "checks", "lo", "hi")]]


def _block(number: int, ids: pa.Array, texts: pa.Array) -> dict:
    data, offsets = layout(texts)
    return {
        "block": number,
        "ids": pack(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)),
        "nulls": pack(ids.is_null().to_numpy(zero_copy_only=False)),
        "lengths": pack(np.diff(offsets)),
        "texts": zstandard.ZstdCompressor(level=3).compress(data.tobytes()),
        "n_bytes": len(data),
    }


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, partition, text) to rows of BLOCK_SCHEMA."""
    schema = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("ids", "nulls", "lengths", "texts")], ("n_bytes", pa.int64())])
    held: list[pa.RecordBatch] = []
    size = number = 0

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        column = lambda c: pa.concat_arrays(table.column(c).chunks)
        return pa.RecordBatch.from_pylist([_block(number, column("doc_id"), pc.fill_null(column("text").cast(pa.large_string()), "").cast(pa.large_binary()))], schema)

    for batch in slices(batches):
        number = number or batch.column("partition")[0].as_py() * BLOCKS_A_PARTITION
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= BLOCK_BYTES:
            yield block()
            held, size, number = [], 0, number + 1
    if held:
        yield block()


class Texts:
    """The words of a block's texts. ``doc``: the doc_id of each text; texts without one take no part."""

    def __init__(self, row: dict, window: int) -> None:
        lengths = unpack(row["lengths"])
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(offsets[-1])))
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(self.raw)])
        self.offsets, self.window = offsets, window
        self.words: Words = find_words(texts, NOT_SPACE, lower=False)
        self.first = self.words.first.astype(np.int64)
        self.doc = unpack(row["ids"])
        self.null = unpack(row["nulls"]).astype(bool) if row.get("nulls") else np.zeros(len(self.doc), bool)
        self.text_of = np.repeat(np.arange(len(self.doc)), np.diff(self.first))
        #: Where a window may begin.
        self.begins = np.arange(len(self.text_of)) + window <= self.first[1:][self.text_of]
        self.begins &= ~self.null[self.text_of]

    def low_pairs(self, x: Level, key_bits: int) -> tuple[np.ndarray, ...]:
        """Pairs of low symbols that rest on at most a window's words: keys, first and last window that holds them, text."""
        at, name, _ = x.pairs()
        text, a, b = x.text[at], x.a[at], x.b[at + 1]
        use = (a >= self.first[text]) & (b <= self.first[text + 1]) & (b - a <= self.window) & ~self.null[text]
        use &= (name & U64((1 << THIN) - 1)) == 0
        return name[use] >> U64(64 - key_bits), np.maximum(b[use] - self.window, self.first[text[use]]), a[use], text[use]

    def high_pairs(self, x: Level) -> tuple[np.ndarray, ...]:
        """Pairs of high symbols of a window's words at least, and single ones that are a whole text: both lanes, first word and end, text."""
        at, name, check = x.pairs()
        end = np.append(x.start[1:], len(self.text_of))
        alone = np.flatnonzero(np.bincount(x.text, minlength=len(self.doc))[x.text] == 1)
        name, check = np.concatenate((name, x.name[alone])), np.concatenate((check, x.check[alone]))
        start, stop, text = (np.concatenate((p, q)) for p, q in ((x.start[at], x.start[alone]), (end[at + 1], end[alone]), (x.text[at], x.text[alone])))
        use = (stop - start >= self.window) & ~self.null[text]
        return name[use], check[use], start[use], stop[use], text[use]

    def names(self, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both lanes' names of the windows that begin at some words."""
        out = []
        for lane in (0, 1):
            h = self.words.hashes(lane)
            x = np.zeros(len(begins), U64)
            for j in range(self.window):
                x = mix(x * U64(0xD6E8FEB86659FD93) + h[begins + j])
            out.append(x)
        return out[0], out[1]

    def spread(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which words lie in one of the ranges."""
        edges = np.bincount(begin, minlength=len(self.text_of) + 1) - np.bincount(end, minlength=len(self.text_of) + 1)
        return np.cumsum(edges[:-1]) > 0

    def rows(self, gone: np.ndarray, which: np.ndarray) -> list[dict]:
        """Results of some texts when the words ``gone`` are taken out."""
        w = self.words
        kept = ~gone
        size = w.end - w.start
        take = np.zeros(len(w.data) + 1, bool)
        take[:-1] = self.spread_bytes(kept)
        removed = np.concatenate(([0], np.cumsum(gone)))
        # A blank before each kept word but a text's first one.
        before = np.concatenate(([0], np.cumsum(kept)))
        not_first = np.flatnonzero(kept & (before[:-1] > before[self.first[self.text_of]]))
        data = np.append(w.data, np.uint8(0))
        data[w.start[not_first] - 1] = 0x20
        take[w.start[not_first] - 1] = True
        flat = data[take].tobytes()
        bytes_before = np.concatenate(([0], np.cumsum(np.where(kept, size, 0))))
        blanks = np.zeros(len(kept) + 1, np.int64)
        blanks[not_first + 1] = 1
        upto = (bytes_before + np.cumsum(blanks))[self.first]
        n, cut = np.diff(self.first), np.diff(removed[self.first])
        return [
            {"doc_id": None if self.null[i] else int(self.doc[i]), "n_words": int(n[i]), "n_removed": int(cut[i]), "kept_sha256": hashlib.sha256(flat[upto[i] : upto[i + 1]]).hexdigest()}
            for i in which.tolist()
        ]

    def spread_bytes(self, words: np.ndarray) -> np.ndarray:
        """Which bytes belong to the words marked."""
        w = self.words
        edges = np.zeros(len(w.data) + 1, np.int8)
        edges[w.start[words]] += 1
        edges[w.end[words]] -= 1
        return np.cumsum(edges[:-1], dtype=np.int8) > 0

    def kept_texts(self, gone: np.ndarray) -> pa.Array:
        """Each text with its kept words joined by single blanks."""
        blank, out = b" ", []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            out.append(blank.join(self.words.data[self.words.start[k] : self.words.end[k]].tobytes() for k in range(a, b) if not gone[k]))
        return pa.array(out, pa.binary())


def _earlier(place: np.ndarray, lo: np.ndarray, docs: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which rows have a document before their own: before all of the block's, or in the block."""
    return before[place] | (docs > lo[place])


class Tasks:
    """What tasks do with blocks, for one window and one size of the corpus."""

    def __init__(self, window: int, n_bytes: int) -> None:
        self.window = window
        steps = lambda words: max(1, ceil(log(max(2.0, words)) / log(4 / 3)))  # noqa: E731  a level leaves about three quarters of the symbols
        self.low, self.high = max(1, steps(window) - 8), steps(1.3 * window)
        # At most a key for every six bytes of text, of each kind.
        ranges = range_bits(n_bytes // 6)
        self.low_ranges, self.high_ranges, self.window_ranges = max(0, ranges - 1), max(0, ranges - 3), max(0, ranges - 2)
        self.key_bits = min(64 - THIN, max(20, n_bytes.bit_length() + SPARE_BITS))

    def ask_first(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks to their questions about low and high pairs."""
        schema = pa.schema([("block", pa.int64()), *_ASKED])
        for row in rows_of(batches):
            texts = Texts(row, self.window)
            low, high = levels(texts.words, self.low, self.high)
            keys, _, _, text = texts.low_pairs(low, self.key_bits)
            k, _, lo, hi, _ = distinct(keys, None, texts.doc[text])
            asks = ask(k, None, lo, hi, self.key_bits, self.low_ranges)
            keys, checks, _, _, text = texts.high_pairs(high)
            k, c, lo, _, _ = distinct(keys, checks, texts.doc[text])
            asks += ask(k, c, lo, None, 64, self.high_ranges, 1 << self.low_ranges)
            yield pa.RecordBatch.from_pylist([{"block": row["block"], **a} for a in asks], schema)

    def find(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with the first answers to the texts that are finished, and of the others to questions about windows."""
        schema = pa.schema([("block", pa.int64()), ("done", pa.list_(pa.struct(_DONE))), *[(c, pa.binary()) for c in ("ids", "lengths", "texts", "gone", "windows", "places")], ("asks", pa.list_(pa.struct(_ASKED)))])
        for row in rows_of(batches):
            texts = Texts(row, self.window)
            low, high = levels(texts.words, self.low, self.high)
            keys, begin, last, text = texts.low_pairs(low, self.key_bits)
            _, _, _, _, place = distinct(keys, None, texts.doc[text])
            several, _ = told(row["answers"], lambda r: r < 1 << self.low_ranges)
            lone = ~several[place]
            open_ = texts.begins & ~texts.spread(begin[lone], last[lone] + 1)
            keys, checks, start, stop, text = texts.high_pairs(high)
            _, _, lo, _, place = distinct(keys, checks, texts.doc[text])
            _, before = told(row["answers"], lambda r: r >= 1 << self.low_ranges)
            whole = _earlier(place, lo, texts.doc[text], before)
            gone = texts.spread(start[whole], stop[whole])
            open_ &= ~texts.spread(start[whole], stop[whole] - self.window + 1)
            at = np.flatnonzero(open_)
            asks, place = [], at
            if len(at):
                keys, checks = texts.names(at)
                k, c, lo, _, place = distinct(keys, checks, texts.doc[texts.text_of[at]])
                asks = ask(k, c, lo, None, 64, self.window_ranges)
            yield pa.RecordBatch.from_pylist([_suspects(row["block"], texts, gone, at, place, asks)], schema)

    def finish(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of suspects with their answers to results."""
        for row in rows_of(batches):
            texts, gone = self._removed(row)
            yield pa.RecordBatch.from_pylist(texts.rows(gone, np.arange(len(texts.doc))), pa.schema(_DONE))

    def _removed(self, row: dict) -> tuple[Texts, np.ndarray]:
        """A block's suspects and which of their words go."""
        texts = Texts(row, self.window)
        gone = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(row["gone"]), np.uint8))[: len(texts.text_of)].astype(bool)
        at, place = np.cumsum(unpack(row["windows"])), unpack(row["places"])
        if len(at):
            docs = texts.doc[texts.text_of[at]]
            lo = np.full(int(place.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(lo, place, docs)
            at = at[_earlier(place, lo, docs, told(row["answers"])[1])]
            gone |= texts.spread(at, at + self.window)
        return texts, gone


def _suspects(number: int, texts: Texts, gone: np.ndarray, at: np.ndarray, place: np.ndarray, asks: list[dict]) -> dict:
    """A block's row: results of texts that hold no open window, and what is needed of the others."""
    open_ = np.zeros(len(texts.doc), bool)
    open_[texts.text_of[at]] = True
    row = {"block": number, "done": texts.rows(gone, np.flatnonzero(~open_)), "asks": asks}
    if not open_.any():
        return row
    own = open_[texts.text_of]
    shifted = np.cumsum(own) - 1  # a word's number among those of open texts
    lengths = np.diff(texts.offsets)
    data = np.frombuffer(texts.raw, np.uint8)[np.repeat(open_, lengths)] if len(texts.raw) else b""
    return row | {
        "ids": pack(texts.doc[open_]),
        "lengths": pack(lengths[open_]),
        "texts": zstandard.ZstdCompressor(level=3).compress(bytes(data)),
        "gone": zstandard.ZstdCompressor(level=1).compress(np.packbits(gone[own]).tobytes()),
        "windows": pack_sorted(shifted[at].astype(U64)),
        "places": pack(place),
    }


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Take out every word covered by ``window`` consecutive words that also begin in a document of smaller doc_id.

    ``docs``: doc_id, text; other columns are ignored. Words are runs of anything but ASCII white space, unchanged.
    Windows lie within one document and are judged on the input, not on what is left. Returns one row for each input
    row: doc_id, n_words, n_removed, kept_sha256 (hex SHA-256 of the kept words, joined by one space).

    Null, empty and blank texts have no words; texts of fewer than ``window`` words lose none. A row with a null doc_id
    has no smaller or larger one: it is left whole and takes nothing from others. Rows with the same
    doc_id take nothing from each other. Texts and words of any length are read whole. An empty table gives an empty result.
    """
    if window < 2:
        raise ValueError(f"a window has two words at least, not {window}")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().cast("long").alias("partition"), F.col("text").cast("string").alias("text"))
    blocks = materialise(rows.mapInArrow(_blocks, BLOCK_SCHEMA), "blocks")
    tasks = Tasks(window, blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    first = materialise(answers(blocks.mapInArrow(tasks.ask_first, f"block long, {ASK_SCHEMA}")), "answers")
    found = materialise(blocks.join(first, "block", "left").mapInArrow(tasks.find, _FOUND), "found")
    forget(blocks, first)
    second = materialise(answers(found.select("block", F.explode("asks").alias("a")).select("block", "a.*")), "answers")
    suspects = found.where("texts is not null").select("block", "ids", "lengths", "texts", "gone", "windows", "places").join(second, "block", "left")
    return found.select(F.explode("done").alias("d")).select("d.*").union(suspects.mapInArrow(tasks.finish, _RESULT))
