"""Words of UTF-8 texts found and hashed with NumPy, a batch of texts at a time.

All word classes used here are made of ASCII separators, so they can be found
byte by byte: no byte of a multi-byte character is below 0x80.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the 64 bits."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of some texts; ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``lane``: which of several independent ones.

        Eight bytes at a time go through the whole mixer, so no pattern of bytes cancels out.
        """
        at, left = self.start, self.end - self.start
        out = mix(left.astype(U64) * U64(2 * lane + 1) + U64(0x9E3779B97F4A7C15))
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[:-8] = self.data
        eights = np.ndarray(len(self.data) + 1, "<u8", padded, 0, (1,))  # those that begin at each byte
        long = np.flatnonzero(left > LONG_WORD)
        todo = np.flatnonzero(left <= LONG_WORD)
        while len(todo):
            at_, left_ = at[todo], left[todo]
            out[todo] = mix(out[todo] * U64(0xD6E8FEB86659FD93) + (eights[at_] & _MASKS[np.minimum(left_, 8)]))
            at, left = at + 8, left - 8
            todo = todo[left_ > 8]
        for i in long.tolist():
            digest = hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8, salt=b"%d" % lane).digest()
            out[i] = int.from_bytes(digest, "little")
        return out

    def bytes_of(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by single blanks."""
        data, start, end = self.data, self.start, self.end
        return b" ".join(data[start[k] : end[k]].tobytes() for k in range(i, j))


def layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as the empty text."""
    texts = texts if texts.type == pa.large_binary() else pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    if not n or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def find_words(texts: pa.Array, member: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of ``member`` bytes inside each text."""
    data, offsets = layout(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = member[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``width`` consecutive words.

    Texts with fewer words, but not none, have their whole sequence as one.
    """
    h, first = words.hashes(), words.first
    factors = mix(np.arange(1, width + 1, dtype=U64)) | U64(1)
    n = max(0, len(h) - width + 1)
    joined = np.zeros(n, U64)
    for j in range(width):
        joined += h[j : j + n] * factors[j]
    joined = mix(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            whole = np.cumsum(h[a:b] * factors[: b - a])[-1:] + factors[:1] * U64(b - a)
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, U64))
    return out
