"""Exact top-k inner-product search by columnar branch and bound.

Vectors are quantised to whole numbers. Candidates stay where they are: queries are sent to
them, in blocks of at most ``QUERY_BYTES`` that are taken in turn. A task holds a block's
k best so far and meets its candidates a piece at a time, in vertical layout
(dimension by row). Scores are accumulated one block of dimensions at a time; after each, a
candidate survives for a query only if its partial score plus the product of the
norms of what remains (Cauchy-Schwarz) can still reach the query's k-th best
known score. Survivors are compacted before the next block. Each task returns at most k
rows a query, which a window then merges.

The first k-th best scores come from ``PILOT`` candidates, those of the largest norms, before
the search; they decide how much is pruned, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.shared import materialise

SCALE = 64
QUERIES_A_CELL, CANDIDATES_A_CELL = 512, 8192
QUERY_BYTES = 32_000_000
PILOT = 2048
DIMENSIONS_A_STEP = 16


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) with doubles; rows without an id or a vector, or with null or non-finite components, go."""
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)


class Vectors:
    """Quantised vectors in vertical layout, short ones padded with zeros; those too large for exact sums of doubles aside, as Python's whole numbers."""

    def __init__(self, ids: np.ndarray, x: pa.Array, scale: int = SCALE) -> None:
        lengths = x.value_lengths().to_numpy(zero_copy_only=False)
        width = max(1, int(lengths.max(initial=0)))
        flat = x.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(ids)), lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        whole = np.zeros((width, len(ids)))
        with np.errstate(over="ignore"):
            whole[place, row] = np.floor(flat * scale)
        limit = np.sqrt(2.0**53 / width) / 2
        large = np.flatnonzero(np.abs(whole).max(axis=0, initial=0) >= limit)
        exact = lambda c: int(np.floor(c * scale)) if abs(c) < 1e300 else int(c) * scale
        self.large = {i: [exact(c) for c in x[i].as_py()] for i in large.tolist()}
        self.ids, self.width = np.asarray(ids, np.int64), width
        whole[:, large] = 0
        self.whole = whole

    def widened(self, width: int) -> np.ndarray:
        return self.whole if width == self.width else np.pad(self.whole, ((0, width - self.width), (0, 0)))

    def exact(self, i: int) -> list[int]:
        return self.large[i] if i in self.large else [int(c) for c in self.whole[:, i]]


class Best:
    """The k best candidates met so far of each of some queries."""

    def __init__(self, queries: Vectors, floor: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.floor = floor.copy()  # a known k-th best score, or minus infinity
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries.ids)
        self.large: list[list[tuple[int, int]]] = [[] for _ in queries.ids]  # (score, id) with a large vector on either side

    def meet(self, candidates: Vectors) -> None:
        width = max(self.queries.width, candidates.width)
        q, c = self.queries.widened(width), candidates.widened(width)
        bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * width
        kind = np.float32 if bound < 1 << 24 else np.float64  # exact in both cases
        c = c.astype(kind)
        steps = range(0, width, DIMENSIONS_A_STEP)
        rest = lambda m, at: np.sqrt((m[at:].astype(np.float64) ** 2).sum(axis=0)) * (1 + 1e-9)
        c_rest = [rest(c, s + DIMENSIONS_A_STEP) for s in steps]
        usual = np.ones(len(candidates.ids), bool)
        usual[list(candidates.large)] = False
        for a in range(0, len(self.queries.ids), QUERIES_A_CELL):
            self._cell(a, q[:, a : a + QUERIES_A_CELL].astype(kind), c, c_rest, rest, steps, candidates.ids, usual)
        if candidates.large or self.queries.large:
            self._meet_large(candidates)

    def _cell(self, a: int, q: np.ndarray, c: np.ndarray, c_rest: list[np.ndarray], rest, steps: range, ids: np.ndarray, usual: np.ndarray) -> None:
        q_rest = [rest(q, s + DIMENSIONS_A_STEP) for s in steps]
        # One block of dimensions for all pairs, then query by query for those that survive.
        first = q[:DIMENSIONS_A_STEP].T @ c[:DIMENSIONS_A_STEP]
        for i in range(q.shape[1]):
            n = a + i
            if n in self.queries.large:
                continue
            alive = np.flatnonzero((first[i] + q_rest[0][i] * c_rest[0] >= self.floor[n]) & (ids != self.queries.ids[n]) & usual)
            score = first[i, alive].astype(np.float64)
            for step, at in enumerate(steps[1:], 1):
                dims = slice(at, at + DIMENSIONS_A_STEP)
                score = score + q[dims, i] @ c[dims][:, alive]
                stay = score + q_rest[step][i] * c_rest[step][alive] >= self.floor[n]
                alive, score = alive[stay], score[stay]
            if len(alive):
                names, scores = np.concatenate((self.found[n][0], ids[alive])), np.concatenate((self.found[n][1], score))
                top = np.lexsort((names, -scores))[: self.k]
                self.found[n] = names[top], scores[top]
                if len(top) == self.k:
                    self.floor[n] = max(self.floor[n], scores[top[-1]])

    def _meet_large(self, candidates: Vectors) -> None:
        large = list(candidates.large)
        for n, name in enumerate(self.queries.ids.tolist()):
            places = range(len(candidates.ids)) if n in self.queries.large else large
            v = self.queries.exact(n) if places else []
            own = self.large[n]
            own += [(sum(x * y for x, y in zip(v, candidates.exact(i), strict=False)), int(candidates.ids[i])) for i in places if candidates.ids[i] != name]
            own.sort(key=lambda pair: (-pair[0], pair[1]))
            del own[self.k :]

    def rows(self) -> pa.RecordBatch:
        """(query_id, vec_id, score, far) of the best; far: the sign of a score beyond a long, whose place is held by 0."""
        out: list[tuple[int, int, int, int]] = []
        for name, (ids, scores), large in zip(self.queries.ids.tolist(), self.found, self.large, strict=True):
            own = sorted([*zip(map(int, scores), ids.tolist(), strict=True), *large], key=lambda pair: (-pair[0], pair[1]))[: self.k]
            out += [(name, i, score, 0) if abs(score) < 1 << 63 else (name, i, 0, 1 if score > 0 else -1) for score, i in own]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score", "far"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Vectors]:
    for batch in batches:
        for a in range(0, batch.num_rows, CANDIDATES_A_CELL):
            some = batch.slice(a, CANDIDATES_A_CELL)
            yield Vectors(some.column("vec_id").to_numpy(zero_copy_only=False), some.column("x"))


def _floors(pilot, k: int):
    """(vec_id, x) with a score that the k-th best is not below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vectors(*pilot.value)
        for batch in batches:
            queries = Vectors(batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("x"))
            best = Best(queries, np.full(len(queries.ids), -np.inf), k)
            best.meet(known)
            yield batch.append_column("floor", pa.array(best.floor))

    return run


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, floor = block.value
        best = Best(Vectors(ids, x), floor, k)
        for piece in _pieces(batches):
            best.meet(piece)
        yield best.rows()

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` nearest rows of every row whose vec_id is divisible by ``every``.

    Score: inner product of the vectors, each component floor(SCALE * x); a row is no candidate of
    itself (of its vec_id). Ties go to the smaller vec_id. Returns query_id, rank (from 1), vec_id,
    score. Vectors that are null or hold null or non-finite components take no
    part, neither do null vec_ids; vectors of different lengths compare as if
    padded with zeros. Finite components of any size are scored exactly; a score beyond a long
    keeps its rank and is null. Repeated rows are candidates as often as they occur; a vec_id that occurs more than once asks
    once, with the smallest of its vectors. Fewer than k candidates give fewer
    rows; an empty table none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = materialise(sound_vectors(vectors), "vectors")
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    pilot = rows.orderBy(norm.desc(), "vec_id").limit(PILOT).toArrow().combine_chunks()
    share = lambda *columns: spark.sparkContext.broadcast(columns)
    plain = lambda table, name: table.column(name).combine_chunks()
    asking = asking.mapInArrow(_floors(share(plain(pilot, "vec_id").to_numpy(), plain(pilot, "x")), k), "vec_id long, x array<double>, floor double")
    asking = materialise(asking, "queries")
    bytes_, n = asking.agg(F.coalesce(F.sum(8 * F.size("x") + 24 + 16 * k), F.lit(0)), F.count("*")).first()
    blocks = -(-bytes_ // QUERY_BYTES)
    # As many tasks as the cluster has cores, whatever the number of files: what they return has a row for each task, query and rank.
    few = rows.coalesce(max(1, spark.sparkContext.defaultParallelism))
    found = []
    for i in range(blocks):
        block = (asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i) if blocks > 1 else asking).toArrow().combine_chunks()
        if block.num_rows:
            sent = share(plain(block, "vec_id").to_numpy(), plain(block, "x"), plain(block, "floor").to_numpy())
            found.append(materialise(few.mapInArrow(_search(sent, k), "query_id long, vec_id long, score long, far long"), "best"))
            sent.destroy()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.expr("row_number() over (partition by query_id order by far desc, score desc, vec_id)")
    score = F.when(F.col("far") == 0, F.col("score"))
    return reduce(DataFrame.union, found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
