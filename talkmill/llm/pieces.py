"""The piece vocabulary of a SentencePiece model file, read with the library."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from talkmill.llm.bytewords import layout

SPACE = "▁"
#: Above any symbol number; pairs are kept under one number.
SYMBOLS = 1 << 22
MOST_PAIRS = 1_000_000
START = SYMBOLS - 1
INFINITE = float("inf")
#: Marks a text's beginning in the bytes of a batch; no UTF-8 text holds it.
MARK = b"\xff"


@dataclass
class Pieces:
    """Ids and scores of normal pieces, the byte pieces, and the normaliser's switches."""

    ids: dict[str, int] = field(default_factory=dict)
    scores: dict[str, float] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    byte_ids: dict[int, int] = field(default_factory=dict)
    unknown: int = 0
    merging: bool = True
    dummy_prefix: bool = True
    squeeze: bool = False
    _joined: np.ndarray | None = None

    def text(self, symbol: int) -> str:
        """What a symbol stands for: a piece, or a character outside the vocabulary (-ord - 1)."""
        return self.names[symbol] if symbol >= 0 else chr(-symbol - 1)

    def score(self, piece: str) -> float:
        """The unigram score of a piece; none of its own in a merge-based model, whose file holds merge ranks."""
        return 0.0 if self.merging else self.scores[piece]

    def unknown_score(self) -> float:
        """The score of a character outside the vocabulary."""
        return 0.0 if self.merging else min(self.scores.values(), default=0.0) - 10.0

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the chunks of texts begin: at their own beginning and wherever no piece holds both neighbours."""
        if self._joined is None:
            self._joined = self.joined().ravel()
        cut = np.zeros(len(data), bool)
        if len(data) > 1:
            cut[1:] = ~self._joined[(data[:-1].astype(np.uint16) << 8) | data[1:]] & (data[1:] & 0xC0 != 0x80)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.flatnonzero(cut)

    def joined(self) -> np.ndarray:
        """Pairs of bytes, the last of a character and the first of the next, that some piece holds.

        Between other characters no piece can lie, so a text may be cut there. The blank stands for SPACE too.
        """
        out = np.zeros((256, 256), bool)
        forms = lambda c: (c.encode(), b" ") if c == SPACE else (c.encode(),)
        for piece in self.ids:
            for c, d in zip(piece, piece[1:], strict=False):
                for x in forms(c):
                    for y in forms(d):
                        out[x[-1], y[0]] = True
        if not self.byte_ids:  # neighbouring unknown characters are one symbol, so only blanks may be cut off
            out[:] = True
            for b in (0x20, SPACE.encode()[0]):
                out[:, b] = False
        if self.squeeze or not self.byte_ids:
            ends = (0x20, SPACE.encode()[-1])
            for b in (0x20, SPACE.encode()[0]):
                out[ends, b] = True
        out[MARK[0]] = True
        return out


def load_pieces(path: str) -> Pieces:
    """Read a model whose normaliser is the identity (besides blanks)."""
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(path, "rb") as source:
        proto.ParseFromString(source.read())
    if proto.normalizer_spec.precompiled_charsmap:
        raise ValueError("models with a character map are not supported")
    out = Pieces(merging=proto.trainer_spec.model_type == proto.trainer_spec.BPE, dummy_prefix=proto.normalizer_spec.add_dummy_prefix, squeeze=proto.normalizer_spec.remove_extra_whitespaces)
    for i, piece in enumerate(proto.pieces):
        out.names.append(piece.piece)
        if piece.type == piece.NORMAL or piece.type == piece.USER_DEFINED:
            out.ids[piece.piece], out.scores[piece.piece] = i, piece.score
        elif piece.type == piece.BYTE:
            out.byte_ids[int(piece.piece[3:-1], 16)] = i
        elif piece.type == piece.UNKNOWN:
            out.unknown = i
    return out


class PieceMachine:
    """The pieces as a machine with failure arcs, which reads any text from left to right.

    A state stands for the longest end of the text read that begins a piece.
    ``step[state]`` has the arcs of characters, ``failure[state]`` the arc taken, without reading,
    where there is none. ``ending[state]`` lists the pieces that end here, longest first:
    (symbol, length, weight).
    """

    def __init__(self, pieces: Pieces) -> None:
        self.step: list[dict[str, int]] = [{}]
        own: list[tuple] = [()]
        for piece, symbol in pieces.ids.items():
            state = 0
            for char in piece:
                following = self.step[state].get(char)
                if following is None:
                    following = self.step[state][char] = len(self.step)
                    self.step.append({})
                    own.append(())
                state = following
            own[state] = ((symbol, len(piece), -pieces.score(piece)),)
        self.failure, self.ending = [0] * len(own), [()] * len(own)
        queue = list(self.step[0].values())
        for state in queue:
            self.ending[state] = own[state] + self.ending[self.failure[state]]
            for char, following in self.step[state].items():
                self.failure[following] = self.next(self.failure[state], char)
                queue.append(following)

    def next(self, state: int, char: str) -> int:
        while state and char not in self.step[state]:
            state = self.failure[state]
        return self.step[state].get(char, 0)


def in_order(words: list[str]) -> Iterator[tuple[int, str, int]]:
    """(place, word, characters shared with the one before) of words in sorted order."""
    previous = ""
    for place in sorted(range(len(words)), key=words.__getitem__):
        word = words[place]
        same, n = 0, min(len(previous), len(word))
        while same < n and previous[same] == word[same]:
            same += 1
        yield place, word, same
        previous = word


class PairMachine:
    """Weights of two neighbouring symbols, 0 or infinite: the acceptor that makes paths those of the merge order.

    An encoding by merges is the only sequence of pieces in which every two neighbours
    are the encoding of their concatenation. Its states are the last symbol
    read (START before the first), its arcs are made when first asked for. Models that aren't
    merge-based have one state: any symbol may follow any.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.known: dict[int, float] = {}

    def merges(self, text: str) -> list[str]:
        """The merge order's own segmentation: best score first, leftmost among equals."""
        parts, scores = list(text), self.pieces.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, left: int, right: int) -> float:
        key = left * SYMBOLS + right
        found = self.known.get(key)
        if found is None:
            if len(self.known) > MOST_PAIRS:
                self.known.clear()
            parts = [self.pieces.text(s) for s in (left, right) if s != START]
            allowed = not self.pieces.merging or self.merges("".join(parts)) == parts
            found = self.known[key] = 0.0 if allowed else INFINITE
        return found


class Normaliser:
    """A deterministic transducer: ``arcs[state, character]`` is (next state, text written).

    Characters without an arc of their own take the state's OTHER arc and are written behind its text.
    """

    BEGIN, INSIDE, AFTER_BLANK = range(3)
    OTHER = ""

    def __init__(self, pieces: Pieces) -> None:
        front = SPACE if pieces.dummy_prefix else ""
        begin, inside, after = self.BEGIN, self.INSIDE, self.AFTER_BLANK
        if pieces.squeeze:
            self.arcs = {(begin, " "): (begin, ""), (begin, self.OTHER): (inside, front), (inside, " "): (after, ""), (inside, self.OTHER): (inside, ""), (after, " "): (after, ""), (after, self.OTHER): (inside, SPACE)}
        else:
            self.arcs = {(begin, " "): (inside, front + SPACE), (begin, self.OTHER): (inside, front), (inside, " "): (inside, SPACE), (inside, self.OTHER): (inside, "")}
        #: Of states that no arc leaves: what each character is written as.
        self.loops = {}
        for state in (begin, inside, after):
            arcs = {label: arc for (own, label), arc in self.arcs.items() if own == state}
            if arcs and all(to == state for to, _ in arcs.values()) and arcs[self.OTHER][1] == "":
                self.loops[state] = {ord(label): written for label, (_, written) in arcs.items() if label}

    def compose(self, text: str, state: int) -> str:
        """The one output of a text read from ``state`` on."""
        out = []
        for i, char in enumerate(text):
            if state in self.loops:
                out.append(text[i:].translate(self.loops[state]))
                break
            arc = self.arcs.get((state, char))
            if arc is None:
                state, written = self.arcs[state, self.OTHER]
                written += char
            else:
                state, written = arc
            out.append(written)
        return "".join(out)

    def chunk(self, chunk: bytes) -> str:
        """The output of a chunk of a text, which holds MARK if it is the text's first."""
        begins = chunk[:1] == MARK
        return self.compose(chunk[begins:].decode(), self.BEGIN if begins else self.INSIDE)


def marked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts, with MARK in front of each that isn't empty; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    front = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar(b"", pa.large_binary()), pa.scalar(MARK, pa.large_binary()))
    return layout(pc.binary_join_element_wise(front, texts, pa.scalar(b"", pa.large_binary())))
