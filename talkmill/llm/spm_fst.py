"""SentencePiece encoding and decoding by weighted finite-state transducers.

Four machines are compiled from a model file, as tables of arcs:

* the normaliser, characters to characters: blanks become SPACE, one is put in
  front of a text, runs are squeezed if the model says so;
* the pieces, characters to piece ids (:class:`PieceMachine`): a state for each beginning of
  a piece, failure arcs between them, and the pieces that end at each, with their weights;
* byte fallback: an arc for each character that isn't a piece, which writes its UTF-8
  bytes' ids (the unknown id, if the model has no bytes);
* the pair acceptor over ids, whose weight is 0 or infinite (:class:`PairMachine`):
  merge-based models allow one sequence only, others allow all.

An input is composed with the four lazily, from left to right, and the path of least
weight in the tropical semiring (weights add along a path, the least counts among paths)
is read from back pointers. The composition needs no more than one state a position:
in a merge-based model only one path to each position is finite, and in others the
acceptor has a single state. Weights are minus the scores of a unigram model; a
merge-based model's pieces weigh nothing, its acceptor decides alone.

Inputs are composed chunk by chunk, cut where no piece holds both neighbours. New
chunks are taken in sorted order, so that common prefixes are composed once. Each worker
remembers at most MOST_CHUNKS encoded chunks. Memory grows with the longest chunk beside that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.chunks import Remembered
from talkmill.llm.pieces import INFINITE, MARK, SPACE, START, SYMBOLS, Normaliser, PairMachine, PieceMachine, Pieces, in_order, load_pieces, marked
from talkmill.llm.shared import slices

MOST_CHUNKS = 500_000
SLICE_BYTES = 6_000_000

_coders: dict[str, Transducer] = {}


class Transducer:
    """The compiled machines of one model, and their composition with inputs."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.normaliser, self.machine, self.pairs = Normaliser(pieces), PieceMachine(pieces), PairMachine(pieces)
        self.fallback_weight = -pieces.unknown_score()
        self.chunks = Remembered(self._learn, "<u4", MOST_CHUNKS)
        decoded = self._decoded()
        self.size_of = np.array([len(x) for x in decoded], np.int64)
        self.begin_of = np.cumsum(self.size_of) - self.size_of
        self.bytes_of = np.frombuffer(b"".join(decoded), np.uint8)

    def shortest_paths(self, texts: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(place, symbols of the path of least weight) of normalised texts; characters outside the vocabulary are -ord - 1.

        Texts are composed in sorted order; what a text has in common with the one before isn't composed again.
        """
        step, failure, ending = self.machine.step, self.machine.failure, self.machine.ending
        allowed, known, fallback = self.pairs.weight, self.pairs.known, self.fallback_weight
        # By position: the piece machine's state; weight, last symbol of the best path and where that begins.
        states, weight, last, start = [0], [0.0], [START], [0]
        for place, text, same in in_order(texts):
            del states[same + 1 :], weight[same + 1 :], last[same + 1 :], start[same + 1 :]
            state = states[same]
            for i in range(same, len(text)):
                char = text[i]
                while state and char not in step[state]:
                    state = failure[state]
                state = step[state].get(char, 0)
                least, symbol, begin = INFINITE, START, i
                arcs = ending[state]
                for piece, length, own in arcs:
                    at = i + 1 - length
                    total = weight[at] + own
                    if total < least:
                        pair = known.get(last[at] * SYMBOLS + piece)
                        total += allowed(last[at], piece) if pair is None else pair
                        if total < least:
                            least, symbol, begin = total, piece, at
                if not arcs or arcs[-1][1] > 1:  # not a piece by itself: byte fallback
                    total = weight[i] + fallback + allowed(last[i], -ord(char) - 1)
                    if total < least:
                        least, symbol, begin = total, -ord(char) - 1, i
                states.append(state)
                weight.append(least)
                last.append(symbol)
                start.append(begin)
            path, at = [], len(text)
            while at:
                path.append(last[at])
                at = start[at]
            yield place, path[::-1]

    def _ids(self, path: list[int]) -> list[int]:
        """What the machines write along a path."""
        out: list[int] = []
        for symbol in path:
            if symbol >= 0:
                out.append(symbol)
            elif self.pieces.byte_ids:
                out += [self.pieces.byte_ids[b] for b in chr(-symbol - 1).encode()]
            elif not out or out[-1] != self.pieces.unknown:
                out.append(self.pieces.unknown)
        return out

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list[list[int]] = [[]] * len(new)
        for place, path in self.shortest_paths(list(map(self.normaliser.chunk, new))):
            found[place] = path if min(path, default=0) >= 0 else self._ids(path)
        return np.array(list(chain.from_iterable(found)), "<u4"), np.array(list(map(len, found)), np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of whole texts in a row, where each text's begin (and the last ends), and whether decoding gives it back."""
        data, offsets = marked(texts)
        cuts = self.pieces.cuts(data, offsets)
        ids, at = self.chunks.gather(data, cuts)
        first = at[np.searchsorted(cuts, offsets)]
        return ids, first, self._given_back(data, offsets, ids, first)

    def _given_back(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether the ids of each marked text decode to it."""
        size = self.size_of[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(self.begin_of[ids] - ends[:-1], size)
        source += np.arange(len(source))
        decoded, at = self.bytes_of[source], ends[first]
        wanted = np.where(data == MARK[0], 0x20, data).astype(np.uint8)
        if not self.pieces.dummy_prefix:
            wanted, offsets = wanted[data != MARK[0]], offsets - np.searchsorted(np.flatnonzero(data == MARK[0]), offsets)
        if len(decoded) == len(wanted) and np.array_equal(at, offsets) and np.array_equal(decoded, wanted):
            return np.ones(len(offsets) - 1, bool)
        return np.array([np.array_equal(decoded[a:b], wanted[c:d]) for a, b, c, d in zip(at, at[1:], offsets, offsets[1:], strict=False)], bool)

    def decode(self, ids: np.ndarray) -> str:
        """The inverse: bytes joined, SPACE to blank, the blank in front removed."""
        raw = b"".join(self.bytes_of[self.begin_of[i] : self.begin_of[i] + self.size_of[i]].tobytes() for i in ids)
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.pieces.dummy_prefix and text.startswith(" ") else text

    def _decoded(self) -> list[bytes]:
        table = [b""] * len(self.pieces.names)
        for p, i in self.pieces.ids.items():
            table[i] = p.replace(SPACE, " ").encode()
        for b, i in self.pieces.byte_ids.items():
            table[i] = bytes([b])
        table[self.pieces.unknown] = " ⁇ ".encode()
        return table


def coder(path: str) -> Transducer:
    """One transducer a Python worker."""
    if path not in _coders:
        _coders[path] = Transducer(load_pieces(path))
    return _coders[path]


def encode(docs: DataFrame, model_path: str, digest: bool = False) -> DataFrame:
    """Encode every whole text of (doc_id, text) and decode it again.

    Returns doc_id, n_tokens, ids (or, with ``digest``, ids_crc32 of the ids as
    little-endian 32-bit integers) and lossless: whether decoding gives the text
    back. A text with the character SPACE in it decodes to a blank in its place
    and is not lossless. Null and empty texts have no ids and are lossless. A null doc_id stays null.
    Repeated rows are encoded alike. Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = coder(model_path)
        for batch in slices(batches, max_bytes=SLICE_BYTES):
            ids, first, lossless = fst.encode(batch.column("text"))
            if digest:
                values = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first, first[1:], strict=False)], pa.int64())
            else:
                values = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), values, pa.array(lossless)], names=["doc_id", "n_tokens", name, "lossless"])

    name = "ids_crc32" if digest else "ids"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, {name} {'long' if digest else 'array<int>'}, lossless boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Texts of (doc_id, ids): doc_id, text. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = coder(model_path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                texts = [fst.decode(np.array(x or [], np.int64)) for x in some.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string")
