"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents marked good; everything else counts as
unlabelled web text. A small network minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with logistic loss. Negatives are never used as such, also not for the class prior: that is
estimated from positives and unlabelled rows alone (:func:`estimate_prior`).

Features are computed on executors from whole texts with NumPy: shares of hashed words
and of hashed runs of three bytes, and counts of characters, words and lines. The fit, on the
driver, uses at most ``POSITIVES`` + ``UNLABELLED`` documents, the first by a hash of
their id; every document is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.bytewords import LOWER, NOT_SPACE, U64, find_words, layout
from talkmill.llm.shared import fold_of, slices

POSITIVES = UNLABELLED = 12_000
HELD_OUT = 5
CUT = 0.3
HIDDEN, STEPS, BATCH, RATE, SEED = 24, 600, 1024, 0.01, 7
#: Bins that words and runs of three bytes are hashed to.
BINS = 128
#: How much less the many hashed features weigh than the counts at the start.
HASHED_SCALE = 20.0

#: Byte classes whose share of a text is a feature.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\r", b"!", b"#", b"$", b"%", b"&", b"*", b"|", b".", b",", b"\"'`", b"()[]{}<>", b"-_=+~^", b"/\\:;@?", bytes(range(128, 256))]


#: Counts come first among the features.
PLAIN = len(CLASSES) + 1 + 12


def _hashed(of: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Square roots of the shares of each row's keys that fall in each bin."""
    bins = (keys * U64(0x9E3779B97F4A7C15) >> U64(64 - (BINS - 1).bit_length())).astype(np.int64)
    counts = np.bincount(of * BINS + bins, minlength=n * BINS).reshape(n, BINS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def _runs_of_three(data: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    low = LOWER[data].astype(np.uint32)
    inside = row[2:] == row[:-2]
    return _hashed(row[2:][inside], (low[:-2] << 16 | low[1:-1] << 8 | low[2:])[inside].astype(U64), n)


def features(texts: pa.Array) -> np.ndarray:
    """One row a text; a null or empty text has all zeros but the constant scale ones."""
    data, offsets = layout(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    at_least = np.maximum(size, 1)
    row = np.repeat(np.arange(n), size)
    kind = np.zeros(256, np.int64)
    for i, members in enumerate(CLASSES, 1):
        kind[list(members)] = i
    shares = np.bincount(row * (len(CLASSES) + 1) + kind[data], minlength=n * (len(CLASSES) + 1)).reshape(n, -1) / at_least[:, None]
    words = find_words(texts, NOT_SPACE)
    per = words.per_text
    h = words.hashes()
    of = np.repeat(np.arange(n), per)
    length = words.end - words.start
    sum_of = lambda x: np.bincount(of, weights=x, minlength=n)
    some = np.maximum(per, 1)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    cased = np.concatenate(([0], np.cumsum((layout(texts)[0] != LOWER[data]).astype(np.int64))))
    upper = cased[words.end] - cased[words.start]
    last = data[words.end - 1] if len(h) else np.zeros(0, np.uint8)
    odd_end = ~(((last >= 48) & (last <= 57)) | ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128) | (last == 46) | (last == 44))
    distinct = np.zeros(n)
    pairs = np.zeros(n)
    lines = np.zeros((n, 2))
    raw = layout(texts)[0].tobytes()
    for i in range(n):
        a, b = words.first[i], words.first[i + 1]
        own = h[a:b]
        distinct[i] = len(np.unique(own)) / max(1, b - a)
        pairs[i] = len(np.unique(own[1:] * np.uint64(3) + own[:-1])) / max(1, b - a - 1) if b - a > 1 else 1.0
        each = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x]
        lines[i] = len(set(each)) / max(1, len(each)), np.log1p(len(each))
    mean = sum_of(length) / some
    spread = np.sqrt(np.maximum(0, sum_of(length.astype(float) ** 2) / some - mean**2))
    return np.column_stack(
        [np.sqrt(shares), distinct, pairs, lines, sum_of(same) / some, sum_of(upper > 1) / some, sum_of(upper == length) / some, sum_of(odd_end) / some, np.log1p(mean), np.log1p(spread), np.log1p(per), np.log1p(sum_of(length >= 30) / some * 100), _hashed(of, h, n), _runs_of_three(data, row, n)]
    )


@dataclass
class Model:
    """A network with one hidden layer over scaled features; without data it answers the prior."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2
        return np.round(_sigmoid(f), 9)  # alike whatever batch a text is in


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def risk(f_p: np.ndarray, f_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of outputs on positives and unlabelled rows, and the direction to follow for each.

    That is the gradient of the risk; where its inner part is negative, the gradient that makes it less so.
    """
    inner = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
    value = prior * np.logaddexp(0, -f_p).mean() + max(0.0, inner)
    s_p, s_u = _sigmoid(f_p) / len(f_p), _sigmoid(f_u) / len(f_u)
    if inner >= 0:
        return value, prior * (s_p - 1 / len(f_p)) - prior * s_p, s_u
    return value, prior * s_p, -s_u


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """Minimise the non-negative risk by Adam."""
    both = np.concatenate((positive, unlabelled)) if len(positive) + len(unlabelled) else np.zeros((1, 1))
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    scale[PLAIN:] *= HASHED_SCALE
    rng = np.random.default_rng(SEED)
    width = both.shape[1]
    theta = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(prior / (1 - prior))])]
    if not len(positive) or not len(unlabelled):
        return Model(mean, scale, *theta[:3], float(theta[3][0]))
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        x = np.concatenate((p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]))
        hidden = np.tanh(x @ theta[0] + theta[1])
        f = hidden @ theta[2] + theta[3]
        g = np.concatenate(risk(f[:BATCH], f[BATCH:], prior)[1:])
        back = np.outer(g, theta[2]) * (1 - hidden**2)
        grads = [x.T @ back + 1e-4 * theta[0], back.sum(axis=0), hidden.T @ g + 1e-4 * theta[2], np.array([g.sum()])]
        rate = RATE * (1 - step / (steps + 1)) + 1e-4
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad**2
            theta[i] = theta[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, *theta[:3], float(theta[3][0]))


def prior_bound(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from scores: the least share of unlabelled rows above a threshold, in shares of the positives above it.

    At a threshold that no negative passes the two shares stand as the prior to one; at others
    negatives only add. Thresholds keep three fifths of the positives at least. Each ratio is
    lowered by its standard error: too high a prior makes the risk's inner part negative
    before negatives are told apart, too low a one only lowers scores a little.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    ratios = []
    for kept in np.arange(0.6, 1.0, 0.05):
        at = np.quantile(positive, 1 - kept)
        over_p, over_u = (positive >= at).mean(), (unlabelled >= at).mean()
        error = np.sqrt(over_u * (1 - over_u) / len(unlabelled) / over_p**2 + over_u**2 * (1 - over_p) / over_p**3 / len(positive))
        ratios.append(over_u / over_p - error)
    return float(np.clip(min(ratios), 0.02, 0.98))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The bound of scores that a first fit gives to rows it did not see: each half is scored by the other's fit."""
    scores: tuple[list, list] = ([], [])
    for half in (0, 1):
        model = fit(positive[half::2], unlabelled[half::2], 0.5, STEPS // 3)
        for kept, rows in zip(scores, (positive, unlabelled), strict=True):
            kept.append(model.score(rows[1 - half :: 2]) if len(rows[1 - half :: 2]) else np.zeros(0))
    return prior_bound(*(np.concatenate(x) for x in scores))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = features(batch.column("text")).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(list(x), pa.list_(pa.float32()))], names=["positive", "x"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the learning folds of (doc_id, text) and (doc_id, quality).

    A document is a positive if all its marks are good. Where a doc_id has several texts, the
    smallest is its text here.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(fold_of("doc_id", HELD_OUT) != 0)
    marks = labels.where(fold_of("doc_id", HELD_OUT) != 0).where("quality is not null and doc_id is not null")
    good = marks.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    # Both samples are bounded, and so is what is broadcast.
    positives = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES).withColumn("positive", F.lit(True))
    others = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(UNLABELLED).withColumn("positive", F.lit(False))
    chosen = docs.join(F.broadcast(positives.union(others)), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    x = chosen.select("positive", "text").mapInArrow(_featurise, "positive boolean, x array<float>").toArrow()
    flags = np.array(x.column("positive").to_pylist(), bool)
    width = features(pa.array([""])).shape[1]
    flat = x.column("x").combine_chunks().flatten().to_numpy() if len(flags) else np.zeros(0)
    values = flat.astype(float).reshape(len(flags), width)
    order = np.lexsort(values.T[::-1]) if len(flags) else np.zeros(0, int)  # the fit doesn't depend on the order of rows
    flags, values = flags[order], values[order]
    positive, unlabelled = values[flags], values[~flags]
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def _scorer(docs: DataFrame, labels: DataFrame) -> Callable[[pa.Array], np.ndarray]:
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    return lambda texts: model.value.score(features(texts)) if len(texts) else np.zeros(0)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0
    (held_out marks the others). score lies in 0 to 1, higher: good likelier;
    predicted is 1 from 0.3 on. No input but the text is used. A null text is
    scored as the empty one, a null doc_id stays null and is not learned from. Repeated rows are scored alike. Without positives
    or documents the score is one half. An empty table gives an empty result. Other columns are ignored.
    """
    score = _scorer(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (fold_of("doc_id", HELD_OUT) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_bad(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted good. Nulls, empty and repeated rows as above."""
    score = _scorer(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(score(batch.column("text")) >= CUT))

    return docs.mapInArrow(run, docs.schema)
