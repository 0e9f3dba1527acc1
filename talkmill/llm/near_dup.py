"""MinHash near-dedup with bottom-k sketches of a single hash function.

1. Each text becomes the set of hashes of its word shingles. Equal sets are
   collapsed to their smallest doc_id, so exact copies cost one row.
2. A set keeps its ``K`` smallest hashes. Inverted lists of retained values
   generate overlaps; a list's key is a run of two neighbouring retained values,
   so that a common shingle alone brings nothing together.
3. In each list every set first meets a few leaders (the smallest under several
   hash orders), which costs linear work however long a list is. Then lists that
   still hold several components are grouped by a pivot, and the documents outside a group's main
   component meet all its members, in blocks of bounded size. No pair inside a component is kept.
4. Pairs are filtered by the overlap in the sketch of their union and then
   verified on whole sets.

Two linked sets share ``SHARED_LISTS`` lists at least (fewer if they are tiny), so
documents and pairs with fewer are out. A pair at the threshold 0.8 has fewer with
probability under 1e-10 (runs of two among 48 draws), and one with fewer than
``MIN_OVERLAP`` shared values in its union sketch 1.1e-9 (binomial tail). For sets that fit
into the sketch whole neither can happen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.bytewords import NOT_SPACE, U64, find_words, mix, shingle_sets
from talkmill.llm.components import connected_components
from talkmill.llm.shared import MOST_HOT_KEYS, hot_keys, join_split, materialise, shuffled, slices

K = 48
MIN_OVERLAP = 20
SHARED_LISTS = 4
LEADERS = 4
#: Bytes of the sets that a block holds on either side, and those that a document counts for besides its set.
BLOCK_BYTES, ROW_BYTES = 2_000_000, 1024
#: Pairs of two blocks whose union sketches are taken at a time: blocks may hold millions of pairs.
PAIRS_AT_ONCE = 1 << 14
MOST_BITS = 1 << 24


def _sets(width: int, whole: bool):
    """(doc_id, text) to sets: signature and sketch, or the whole sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(find_words(batch.column("text"), NOT_SPACE), width)
            ids = batch.column("doc_id")
            if whole:
                yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "hashes"])
            else:
                sig = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array([s[:K].tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "sig", "sketch"],
                )

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, sketch) to a row for each run of two retained values."""
    for batch in batches:
        sketches = batch.column("sketch").to_pylist()
        s = np.frombuffer(b"".join(sketches), U64)
        size = np.array([len(x) // 8 for x in sketches], np.int64)
        runs = np.maximum(size - 1, 0)
        row = np.repeat(np.arange(len(size)), runs)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
        at = np.repeat(np.cumsum(size) - size, runs) + nth
        key = mix(s[at] * U64(3) + s[at + 1])
        ids, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n_shingles"))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row]), pa.array(n[row])], names=["v", "doc", "n"])


def _shared(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many values each set of xs has in common with each of ys.

    Values of few sets are counted pair by pair, the others by matrix products.
    """
    shared = np.zeros((len(xs), len(ys)), np.float32)
    if not len(xs) or not len(ys):
        return shared
    known = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    sides = []
    for side in (xs, ys):
        own = [np.searchsorted(known, s[np.isin(s, known, assume_unique=True)]) for s in side]
        row, column = np.repeat(np.arange(len(own)), [len(c) for c in own]), np.concatenate(own)
        order = np.argsort(column, kind="stable")
        sides.append((row[order], column[order], np.bincount(column, minlength=len(known))))
    (row_x, column_x, often_x), (row_y, _, often_y) = sides
    rare = often_x * often_y <= 64
    one = rare[column_x]
    times = often_y[column_x[one]]
    first = (np.cumsum(often_y) - often_y)[column_x[one]]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    pairs = np.repeat(row_x[one], times) * len(ys) + row_y[np.repeat(first, times) + nth]
    shared += np.bincount(pairs, minlength=shared.size).reshape(shared.shape)
    place = np.cumsum(~rare) - 1
    for begin in range(0, int((~rare).sum()), 4096):
        dense = []
        for (row, column, _), n in zip(sides, shared.shape, strict=True):
            at = place[column]
            use = ~rare[column] & (at >= begin) & (at < begin + 4096)
            m = np.zeros((n, 4096), np.float32)
            m[row[use], at[use] - begin] = 1
            dense.append(m)
        shared += dense[0] @ dense[1].T
    return shared


def _union_sketch(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs of full sketches (rows of K values): how many of the K smallest of both together are in both."""
    out = np.zeros(len(x), np.int64)
    for a in range(0, len(x), 20_000):
        both = np.sort(np.concatenate((x[a : a + 20_000], y[a : a + 20_000]), axis=1), axis=1)
        twice = both[:, 1:] == both[:, :-1]
        nth = np.cumsum(np.concatenate((np.ones((len(both), 1), np.int64), ~twice), axis=1), axis=1)  # number of each value among the distinct ones
        out[a : a + 20_000] = (twice & (nth[:, 1:] <= K)).sum(axis=1)
    return out


def _likely(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> np.ndarray:
    """Which pairs of two blocks may be linked, by their sketches alone; sets that fit into one whole are decided. Pairs inside a component are not wanted."""
    xs, ys = ([np.frombuffer(h, U64)[:K] for h in side] for side in (left["hashes"], right["hashes2"]))
    n, m = left["n"].to_numpy(np.float64), right["n2"].to_numpy(np.float64)
    fits = left["component"].to_numpy()[:, None] != right["component2"].to_numpy()[None, :]
    fits &= 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
    shared = _shared(xs, ys)
    whole = (n < K)[:, None] & (m < K)[None, :]
    # A set that is whole in its sketch against one that isn't: what they share there is all that counts.
    fits &= np.where(whole, 100.0 * shared >= percent * (n[:, None] + m[None, :] - shared), shared >= MIN_OVERLAP)
    i, j = np.nonzero(fits & (n >= K)[:, None] & (m >= K)[None, :])
    if len(i):
        left_full, right_full = (np.stack([s if len(s) == K else np.zeros(K, U64) for s in side]) for side in (xs, ys))
        for at in range(0, len(i), PAIRS_AT_ONCE):
            some = slice(at, at + PAIRS_AT_ONCE)
            bad = _union_sketch(left_full[i[some]], right_full[j[some]]) < MIN_OVERLAP
            fits[i[some][bad], j[some][bad]] = False
    return fits


def _promising(percent: int):
    """Members of two blocks that may be linked to some of the other."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        fits = _likely(left, right, percent) if len(left) and len(right) else np.zeros((len(left), len(right)), bool)
        rows = left[["pivot", "doc", "component"]][fits.any(axis=1)]
        columns = right[["pivot2", "doc2", "component2"]][fits.any(axis=0)]
        return pd.concat((rows, columns.set_axis(rows.columns, axis=1)))

    return run


def _compare(percent: int):
    """Links between two blocks of whole sets, across components."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        fits = _likely(left, right, percent) if len(left) and len(right) else np.zeros((len(left), len(right)), bool)
        rows, columns = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
        xs, ys = [np.frombuffer(left["hashes"].iloc[i], U64) for i in rows], [np.frombuffer(right["hashes2"].iloc[j], U64) for j in columns]
        shared = _shared(xs, ys)
        n, m = np.array([len(x) for x in xs], np.float64), np.array([len(y) for y in ys], np.float64)
        i, j = np.nonzero((100.0 * shared >= percent * (n[:, None] + m[None, :] - shared)) & fits[np.ix_(rows, columns)])
        return pd.DataFrame({"a": left["doc"].to_numpy()[rows[i]], "b": right["doc2"].to_numpy()[columns[j]]})

    return run


def _estimate(threshold: float):
    """Keep pairs whose union sketch shares enough; small sets are decided here exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()
            keep = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = np.sort(np.concatenate((x, y)))
                twice = both[1:] == both[:-1]
                union = len(both) - int(twice.sum())
                if max(len(x), len(y)) < K:  # whole sets
                    keep.append((len(both) - union) >= threshold * union - 1e-9)
                else:
                    distinct = np.concatenate(([True], ~twice))
                    bound = both[distinct][min(K, union) - 1]
                    shared = int(twice[both[1:] <= bound].sum())
                    keep.append(shared >= MIN_OVERLAP)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    return run


class NearDup:
    """Near-duplicate groups of a (doc_id, text) table. See :func:`near_dup`."""

    def __init__(self, docs: DataFrame, width: int, percent: int) -> None:
        self.docs, self.width, self.percent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), width, percent
        self.threshold = percent / 100

    def groups(self) -> DataFrame:
        docs, width = self.docs, self.width
        rows = materialise(docs.mapInArrow(_sets(width, False), "doc_id long, n_shingles long, sig binary, sketch binary"), "sketches")
        some = rows.where("n_shingles > 0 and doc_id is not null")
        first = F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("m")
        self.classes = materialise(some.groupBy("sig").agg(first).select("sig", "m.*"), "classes")
        lists = self._lists()
        tried = materialise(self._meet_leaders(lists), "pairs")
        edges = materialise(self._linked(tried), "links")
        found = connected_components(edges)
        more = self._meet_others(lists, found)
        found = connected_components(edges.union(more))
        names = self.classes.select("sig", F.col("doc_id").alias("node")).join(shuffled(found), "node", "left").select("sig", F.coalesce("component", "node").alias("component_id"))
        linked = some.select("doc_id", "n_shingles", "sig").join(shuffled(names), "sig").select("doc_id", "n_shingles", "component_id")
        alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return linked.union(alone).withColumn("kept", F.expr("doc_id <=> component_id"))

    def _lists(self) -> DataFrame:
        """Inverted lists that had two members at least, of sets that are in enough of them: (v, doc, n).

        A list may hold a large part of all documents: ``hot`` are the keys that all joins on v split.
        """
        postings = self.classes.select("doc_id", "n_shingles", "sketch").mapInArrow(_postings, "v long, doc long, n long")
        several = materialise(postings.groupBy(F.col("v").alias("key")).agg(F.count("*").alias("n")).where("n > 1"), "several")
        self.hot = hot_keys(several, several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        lists = join_split(postings, several.select(F.col("key").alias("v")), "v", "doc", self.hot)
        return materialise(self._busy(materialise(lists, "lists")), "lists")

    def _least_lists(self, n: str) -> str:
        """Lists that a set of n shingles shares with any set it is linked to.

        Of a linked pair in whole, at most a quarter as many shingles differ as
        are shared, and each separates one run of shared ones.
        """
        shared = f"ceil({self.percent} * {n} / 100)"
        return f"least({SHARED_LISTS}, greatest(1, {shared} - floor({shared} * {100 - self.percent} / {self.percent}) - 1))"

    def _busy(self, lists: DataFrame) -> DataFrame:
        enough = lists.groupBy("doc", "n").count().where(F.expr(f"count >= {self._least_lists('n')}"))
        return lists.join(shuffled(enough.select("doc")), "doc", "left_semi")

    def _near_in_size(self, n: str, m: str):
        return F.expr(f"100 * least({n}, {m}) >= {self.percent} * greatest({n}, {m})")

    def _meet_leaders(self, lists: DataFrame) -> DataFrame:
        me = F.struct("doc", "n")
        picks = [F.min_by(me, F.xxhash64("doc", F.lit(j))).alias(f"l{j}") for j in range(LEADERS)]
        leaders = lists.groupBy("v").agg(*picks).select("v", F.array_distinct(F.array(*[f"l{j}" for j in range(LEADERS)])).alias("leaders"))
        met = join_split(lists, leaders, "v", "doc", self.hot).select("doc", "n", F.explode("leaders").alias("other"))
        met = met.select("doc", "n", F.col("other.doc").alias("doc2"), F.col("other.n").alias("n2"))
        return self._pairs(met.where("doc <> doc2").where(self._near_in_size("n", "n2")))

    def _meet_others(self, lists: DataFrame, found: DataFrame) -> DataFrame:
        """Links across components, of lists that hold more than one."""
        lists = lists.join(shuffled(found.withColumnRenamed("node", "doc")), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        lists = materialise(lists, "lists")
        mixed = lists.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("v")
        mixed_rows = materialise(self._busy(materialise(join_split(lists, mixed, "v", "doc", self.hot), "lists")), "lists")
        # Lists get a pivot: the doc in as many lists as can be, so that lists of one group have the same.
        lists = mixed_rows.join(shuffled(mixed_rows.groupBy("doc").agg(F.count("*").alias("seen"))), "doc")
        about = lists.groupBy("v").agg(F.max_by("doc", F.struct("seen", "doc")).alias("pivot"))
        members = materialise(join_split(lists.drop("seen"), about, "v", "doc", self.hot).select("pivot", "doc", "component").distinct(), "members")
        sketches = self.classes.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.col("sketch").alias("hashes"))
        members = self._blocks(sketches, members, _promising(self.percent), "pivot long, doc long, component long")
        members = materialise(members.distinct(), "members")
        whole = self._whole(members.select(F.col("doc").alias("doc_id"))).select(F.col("doc_id").alias("doc"), (F.octet_length("hashes") / 8).cast("long").alias("n"), "hashes")
        return self._blocks(whole, members, _compare(self.percent), "a long, b long")

    def _blocks(self, sets: DataFrame, members: DataFrame, compare, kind: str) -> DataFrame:
        """What ``compare`` finds among each pivot's members (pivot, doc, component), those outside its main component against all.

        ``sets``: (doc, n, hashes). A large group is dealt into blocks, each side of which meets all of the other; small ones share a block.
        """
        sizes = members.groupBy("pivot", "component").count()
        main = sizes.groupBy("pivot").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("n"))
        main = materialise(main, "mains")
        # A pivot's members may be a large part of all rows, and pivots many.
        hot = hot_keys(main.select(F.col("pivot").alias("key"), "n"), members.count())
        rows = join_split(members, main.drop("n"), "pivot", "doc", hot).join(shuffled(sets), "doc").withColumn("aside", F.expr("component <> main"))
        rows = materialise(rows.select("pivot", "doc", "component", "aside", "n", "hashes"), "members")
        mass = F.octet_length("hashes") + ROW_BYTES
        blocks = lambda x: F.ceil(F.sum(x) / F.lit(BLOCK_BYTES)).cast("int")
        deal = rows.groupBy("pivot").agg(blocks(mass).alias("rights"), blocks(F.when(F.col("aside"), mass).otherwise(0)).alias("lefts"), F.sum(mass).alias("mass")).where("lefts > 0")
        deal = materialise(deal.withColumn("small", F.expr("rights = 1")), "deal")
        shared = max(1, -(-(deal.where("small").agg(F.sum("mass")).first()[0] or 0) // BLOCK_BYTES))
        deal = deal.select("pivot", "lefts", "rights", "small", F.when(F.col("small"), F.pmod(F.xxhash64("pivot"), F.lit(shared))).otherwise(F.col("pivot")).alias("p"))
        rows = join_split(rows, deal, "pivot", "doc", hot)
        own = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.where("aside").withColumn("l", own("lefts")).withColumn("r", every("rights"))
        right = rows.withColumn("r", own("rights")).withColumn("l", every("lefts"))
        keep = ["small", "p", "l", "r", "pivot", "doc", "component", "n", "hashes"]
        right = right.select(keep).toDF(*[f"{c}2" for c in keep])
        return left.select(keep).groupBy("small", "p", "l", "r").cogroup(right.groupBy("small2", "p2", "l2", "r2")).applyInPandas(compare, kind)

    def _whole(self, ids: DataFrame) -> DataFrame:
        """(doc_id, hashes): the whole sets of some documents.

        A bit set of the ids, of at most MOST_BITS bits, is broadcast first, so
        that texts of other documents are hardly shuffled.
        """
        ids = materialise(ids.distinct(), "ids")
        n = ids.count()
        bits = 1 << min(MOST_BITS.bit_length() - 1, max(12, (16 * n).bit_length()))
        bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
        words = ids.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))
        docs = self.docs.withColumn("bit", bit).withColumn("word", F.expr("bit div 64")).join(F.broadcast(words), "word")
        docs = docs.where("(shiftrightunsigned(mask, cast(bit % 64 as int)) & 1) = 1").select("doc_id", "text")
        return docs.join(F.broadcast(ids) if n <= MOST_HOT_KEYS else shuffled(ids), "doc_id", "left_semi").mapInArrow(_sets(self.width, True), "doc_id long, hashes binary").dropDuplicates(["doc_id"])

    def _pairs(self, met: DataFrame) -> DataFrame:
        """Distinct pairs that met."""
        return met.select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()

    def _linked(self, pairs: DataFrame) -> DataFrame:
        """Pairs of (a, b) that are linked. A leader of a large group may be in a large part of all pairs."""
        pairs = materialise(pairs, "met")
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b"))
        hot = hot_keys(ends.groupBy("key").agg(F.count("*").alias("n")), 2 * pairs.count())

        def with_both(rows: DataFrame, table: DataFrame, value: str) -> DataFrame:
            a, b = (table.select(F.col("doc_id").alias(end), F.col(value).alias(f"{value}_{end}")) for end in "ab")
            return join_split(join_split(rows, a, "a", "b", hot), b, "b", "a", hot).select("a", "b", f"{value}_a", f"{value}_b")

        likely = materialise(with_both(pairs, self.classes, "sketch").mapInArrow(_estimate(self.threshold), "a long, b long"), "likely")
        whole = materialise(self._whole(likely.select(F.col("a").alias("doc_id")).union(likely.select("b"))).withColumnRenamed("hashes", "set"), "sets")
        return with_both(likely, whole, "set").mapInArrow(_verify(self.percent), "a long, b long")


def near_dup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Link texts whose word-shingle sets have a Jaccard similarity of ``percent``/100 at least.

    ``docs`` needs doc_id and text; other columns are ignored. A-Z is lower-cased;
    words are runs of anything but ASCII white space. Returns one row per input row:
    doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept
    (doc_id = component_id).

    Null or empty texts and texts of white space have no shingles, link with
    nothing and are kept. Texts of fewer than ``width`` words are one shingle.
    Rows with equal doc_id and text are all returned alike; a doc_id with several
    texts is outside the contract. A null doc_id links with nothing. An empty
    table gives an empty result. ``percent`` below 80 is refused: the sketches and lists
    are sized for 80 and would lose links.
    """
    if percent < 80:
        raise ValueError(f"percent must be 80 at least, not {percent}: sketches would lose links")
    return NearDup(docs, width, percent).groups()
