"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A text is cut into pre-tokens wherever no piece of the vocabulary holds both neighbours
(before a word's blanks, between most letters and marks), so its segmentation is that of
its pre-tokens. The distinct pre-tokens are inserted, in sorted order,
into a trie that a worker keeps for all its batches. A node stands for a prefix;
when it is made, its forward score, the best sum of the pieces' unigram scores
over the prefix's segmentations, is worked out from the nodes above it, once for all pre-tokens
that share it, and the number of tokens on that path and its last piece are kept beside it.
A pre-token's count is that of its terminal node, and a text adds up stored counts.

In a merge-based model, whose scores are merge ranks, only neighbours that
are the encoding of their concatenation may follow each other (:class:`PairMachine`); other segmentations score
minus infinity. So counts are those of the tokenizer itself, which unigram scores alone would miss.

No shuffle, and no pre-token is too long. A worker's trie has at most MOST_NODES nodes. Beyond them, new
prefixes are kept only on the path of the pre-token at hand, as deep as the next one shares it, so sorted
order still has each shared prefix of a batch scored once; before the next batch, nodes that no pre-token has passed since
the last such time give way. The path takes memory in proportion to two neighbours' common prefix,
not to their length. The counts of at most MOST_CHUNKS pre-tokens are remembered.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.chunks import Remembered
from talkmill.llm.pieces import INFINITE, START, SYMBOLS, Normaliser, PairMachine, PieceMachine, Pieces, in_order, load_pieces, marked
from talkmill.llm.shared import slices

MOST_NODES, MOST_CHUNKS = 800_000, 500_000
#: Entries of a path that are dropped together once no later pre-token needs them.
DROPPED = 4096
SLICE_BYTES = 6_000_000
_CHARACTERS = 1 << 21

_tries: dict[str, Trie] = {}


class Trie:
    """Nodes of all prefixes seen: children, forward score, tokens on the best path, its last piece, state of the endings."""

    def __init__(self, pieces: Pieces, most_nodes: int = MOST_NODES, most_chunks: int = MOST_CHUNKS) -> None:
        self.pieces, self.normaliser = pieces, Normaliser(pieces)
        self.machine, self.pairs = PieceMachine(pieces), PairMachine(pieces)
        self.scores = [pieces.scores.get(name, 0.0) for name in pieces.names]
        self.unknown_score = min(pieces.scores.values(), default=0.0) - 10.0
        self.most = most_nodes
        self.reach = max(map(len, pieces.ids), default=1) + 1
        self.counts = Remembered(self._learn, "<i8", most_chunks)
        self.children: dict[int, int] = {}
        self.score, self.tokens, self.last, self.state = array("d", [0.0]), array("i", [0]), array("i", [START]), array("i", [0])
        #: When each node was passed last, in times that room was made.
        self.passed, self.now = array("i", [0]), 0

    def _make_room(self) -> None:
        """In a full trie, nodes that no pre-token has passed since the last time give way; a node passed has all above it passed."""
        if len(self.state) < self.most:
            return
        kept = np.array(self.passed) == self.now
        kept[0] = True
        place = np.cumsum(kept) - 1
        for name in ("score", "tokens", "last", "state", "passed"):
            column = getattr(self, name)
            setattr(self, name, array(column.typecode, np.array(column)[kept].tobytes()))
        keys, nodes = (np.fromiter(x, np.int64, len(self.children)) for x in (self.children.keys(), self.children.values()))
        keys, nodes = keys[kept[nodes]], nodes[kept[nodes]]
        above, char = np.divmod(keys, _CHARACTERS)
        self.children = dict(zip((place[above] * _CHARACTERS + char).tolist(), place[nodes].tolist(), strict=True))
        self.now += 1

    def insert(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Make the nodes that normalised pre-tokens lack; (place, count of the terminal node) of each."""
        self._make_room()
        ordered = list(in_order(words))
        children = self.children
        # The path of the word at hand, a node without a place in the trie being -1.
        path, score, tokens, last, state = columns = array("i", [0]), array("d", [0.0]), array("i", [0]), array("i", [START]), array("i", [0])
        for (place, word, same), (_, _, shared) in zip(ordered, [*ordered[1:], (0, "", 0)], strict=True):
            for column in columns:
                del column[same + 1 :]
            node = path[-1]
            for char in word[same:]:
                key = node * _CHARACTERS + ord(char)
                node = -1 if node < 0 else children.get(key, -1)
                if node < 0:
                    at = self.machine.next(state[-1], char)
                    values = self._best(at, char, score, tokens, last)
                    if key >= 0 and len(self.state) < self.most:
                        node = children[key] = len(self.state)
                        for column, value in zip((self.score, self.tokens, self.last, self.state, self.passed), (*values, at, self.now), strict=True):
                            column.append(value)
                else:
                    values, at = (self.score[node], self.tokens[node], self.last[node]), self.state[node]
                    self.passed[node] = self.now
                path.append(node)
                score.append(values[0])
                tokens.append(values[1])
                last.append(values[2])
                state.append(at)
                if len(path) > shared + 1 + self.reach + DROPPED:
                    for column in columns:
                        del column[shared + 1 : -self.reach]
            yield place, tokens[-1]

    def _best(self, state: int, char: str, score: array, tokens: array, last: array) -> tuple[float, int, int]:
        """(score, tokens, last piece) of a prefix that ends in ``char``; the n-th last entries: those of the prefix n characters shorter.

        Equal scores: the fewer tokens, then the longer last piece.
        """
        best, count, piece = -INFINITE, 0, START
        known, merging = self.pairs.known, self.pieces.merging
        arcs = self.machine.ending[state]
        for symbol, length, _ in arcs:
            total = score[-length] + self.scores[symbol]
            if merging or total > best or total == best and tokens[-length] + 1 < count:
                pair = known.get(last[-length] * SYMBOLS + symbol)
                if (self.pairs.weight(last[-length], symbol) if pair is None else pair) == 0.0:
                    if merging:
                        return total, tokens[-length] + 1, symbol  # no other segmentation is finite
                    best, count, piece = total, tokens[-length] + 1, symbol
        if not arcs or arcs[-1][1] > 1:  # the character isn't a piece
            symbol = -ord(char) - 1
            total = score[-1] + self.unknown_score
            # Without byte pieces, neighbouring unknown characters are one token.
            more = len(char.encode()) if self.pieces.byte_ids else int(last[-1] >= 0)
            if total > best and self.pairs.weight(last[-1], symbol) == 0.0:
                best, count, piece = total, tokens[-1] + more, symbol
        return best, count, piece

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = np.zeros(len(new), np.int64)
        for place, count in self.insert(list(map(self.normaliser.chunk, new))):
            found[place] = count
        return found, np.ones(len(new), np.int64)

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each text."""
        data, offsets = marked(texts)
        cuts = self.pieces.cuts(data, offsets)
        tokens, _ = self.counts.gather(data, cuts)
        first = np.searchsorted(cuts, offsets)
        return np.diff(first), np.diff(np.concatenate(([0], np.cumsum(tokens)))[first])


def trie_for(path: str) -> Trie:
    """One trie a Python worker."""
    if path not in _tries:
        _tries[path] = Trie(load_pieces(path))
    return _tries[path]


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """Tokens of every whole text of (doc_id, text): doc_id, n_pretokens, n_tokens.

    Null and empty texts have none. A null doc_id stays null. Repeated rows are counted alike. Other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_for(model_path)
        for batch in slices(batches, max_bytes=SLICE_BYTES):
            words, tokens = trie.count(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(tokens)], names=["doc_id", "n_pretokens", "n_tokens"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
