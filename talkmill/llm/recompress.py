"""Recompression of word sequences: runs and pairs of symbols become symbols, level by level.

At every level runs of one symbol become one, then a pair becomes one where its left symbol is of
the level's left half and its right one of the right half. Halves come from the bits of names, so that
equal stretches of words get the same symbols inside, wherever they stand. A symbol's name is a
128-bit hash of what it stands for, so all tasks of a cluster name alike without asking.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from talkmill.llm.bytewords import U64, Words, mix

_LEFT, _RIGHT, _RUN = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0xD6E8FEB86659FD93)
_SEED = 0x9E3779B97F4A7C15


@dataclass
class Level:
    """Symbols in order: two lanes of names, first word and text. ``a`` and ``b``: the words that the symbol's being there rests on.

    What rests on a text's edge has a bound outside the text.
    """

    name: np.ndarray
    check: np.ndarray
    start: np.ndarray
    text: np.ndarray
    a: np.ndarray | None
    b: np.ndarray | None

    def pairs(self) -> tuple[np.ndarray, ...]:
        """Neighbouring symbols of a text: where the first of each pair is, and the names of both lanes."""
        at = np.flatnonzero(self.text[1:] == self.text[:-1])
        return at, joined(self.name, at, 0), joined(self.check, at, 1)


def joined(name: np.ndarray, at: np.ndarray, lane: int) -> np.ndarray:
    """Names of the pairs that begin at ``at``. The second hash of a lane mixes the first, so no two pairs cancel out."""
    return mix(mix(name[at] * _LEFT + U64(lane)) + name[at + 1] * _RIGHT)


def _runs(x: Level, first: np.ndarray) -> Level:
    m = len(x.name)
    new = np.ones(m, bool)
    new[1:] = (x.name[1:] != x.name[:-1]) | (x.text[1:] != x.text[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], m)
    name, check, text = x.name[s], x.check[s], x.text[s]
    long = np.flatnonzero(e - s > 1)
    times = (e - s)[long].astype(U64)
    name[long], check[long] = mix(mix(name[long] + _RUN) + times), mix(mix(check[long] ^ _RUN) + times)
    if x.a is None:
        return Level(name, check, x.start[s], text, None, None)
    # A run ends where a neighbour differs, so it rests on both neighbours.
    a, b = first[text] - 1, first[text + 1] + 1
    inner = np.flatnonzero(text[1:] == text[:-1])
    a[inner + 1], b[inner] = x.a[s[inner + 1] - 1], x.b[e[inner]]
    return Level(name, check, x.start[s], text, np.minimum(a, x.a[s]), np.maximum(b, x.b[e - 1]))


def _pairs(x: Level, first: np.ndarray, seed: U64) -> Level:
    left = (mix(x.name ^ seed) >> U64(63)) == 0
    inner = x.text[1:] == x.text[:-1]
    at = np.flatnonzero(inner & left[:-1] & ~left[1:])
    name, check = x.name.copy(), x.check.copy()
    name[at], check[at] = joined(x.name, at, 0), joined(x.check, at, 1)
    keep = np.ones(len(name), bool)
    keep[at + 1] = False
    if x.a is None:
        return Level(name[keep], check[keep], x.start[keep], x.text[keep], None, None)
    # A left symbol rests on the one behind it, a right one on the one before.
    a, b = x.a.copy(), x.b.copy()
    a[~left], b[left] = first[x.text[~left]] - 1, first[x.text[left] + 1] + 1
    i = np.flatnonzero(inner)
    a[i + 1] = np.where(left[i + 1], a[i + 1], x.a[i])
    b[i] = np.where(left[i], x.b[i + 1], b[i])
    return Level(name[keep], check[keep], x.start[keep], x.text[keep], np.minimum(a, x.a)[keep], np.maximum(b, x.b)[keep])


def levels(words: Words, local: int, top: int) -> tuple[Level, Level]:
    """Level ``local``, with what each symbol rests on, and level ``top``."""
    first = words.first.astype(np.int64)
    n = len(words.start)
    at = np.arange(n)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    x = Level(words.hashes(0), words.hashes(1), at, text, at, at + 1)
    low = x
    for level in range(1, max(local, top) + 1):
        x = _pairs(_runs(x, first), first, U64(_SEED * (2 * level + 1) & (2**64 - 1)))
        if level == local:
            low = x
            x = Level(x.name, x.check, x.start, x.text, None, None)
    return low, x
