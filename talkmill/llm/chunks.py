"""Short byte strings looked up many at a time.

Texts of a batch are cut into chunks that tile their bytes. The distinct chunks are
found by Arrow, only those never seen before are worked out in Python, and the
values of all chunks are gathered by NumPy. Chunks are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Remembered:
    """A run of numbers for each distinct chunk, worked out once by ``learn``.

    ``learn`` gets the new chunks and returns all their numbers in a row and how many
    each has. Beyond ``most`` chunks, only those of the latest batch are kept.
    """

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kind: str, most: int) -> None:
        self.learn, self.kind, self.most = learn, kind, most
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, self.kind)

    def gather(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all chunks of ``data``, which begin at ``cuts``, in order; and where each chunk's begin, and the last ends."""
        if not len(cuts):
            return np.zeros(0, self.kind), np.zeros(1, np.int64)
        ends = np.append(cuts, len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        of = self._numbers(chunks.dictionary)[chunks.indices.to_numpy()]
        size = self.size[of]
        at = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(self.begin[of] - at[:-1], size)
        source += np.arange(len(source))
        return self.store[source], at

    def _numbers(self, distinct: pa.Array) -> np.ndarray:
        """Places of distinct chunks among the known ones; new ones are learned."""
        found = np.full(len(distinct), -1, np.int64)
        if len(self.known):
            found[:] = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        if len(self.known) > self.most:
            found = self._keep(found)
        new = pa.array(np.flatnonzero(found < 0))
        if len(new):
            fresh = distinct.take(new)
            values, size = self.learn(fresh.to_pylist())
            found[found < 0] = len(self.size) + np.arange(len(new))
            self.begin = np.concatenate((self.begin, len(self.store) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.store = np.concatenate((self.store, values.astype(self.kind)))
            self.known = pa.concat_arrays([self.known, fresh])
        return found

    def _keep(self, found: np.ndarray) -> np.ndarray:
        """Forget all but the chunks at ``found``; their new places."""
        kept = found[found >= 0]
        size, begin = self.size[kept], self.begin[kept]
        at = np.cumsum(size) - size
        source = np.repeat(begin - at, size) + np.arange(size.sum())
        self.known, self.store, self.begin, self.size = self.known.take(pa.array(kept)), self.store[source], at, size
        out = np.full(len(found), -1, np.int64)
        out[found >= 0] = np.arange(len(kept))
        return out
