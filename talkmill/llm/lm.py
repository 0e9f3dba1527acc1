"""Bigram language model by deleted interpolation.

    P(w | u) = a * c(u, w) / c(u) + b * c(w) / N + (1 - a - b) / (V + 1)

The weights a, b depend on the bucket of the context's frequency c(u) and are
learned by expectation-maximisation on counts of a held-out part of the training
documents (``DEV_FOLD``), with the estimates taken from the rest. The final model
counts all training documents.

Data flow. Texts are packed once into blocks of about ``BLOCK_TOKENS`` tokens (distinct word
hashes and token numbers). Every block asks for the counts of its distinct words
and bigrams, with its own counts added: sorted hashes, cut by range, one row for
each block and range. A range's task adds up and answers each block in the order
it asked, so answers carry no keys. Hot words and bigrams appear once a block,
whatever their frequency. Blocks then score their documents. Nothing of the size of
the vocabulary is broadcast or collected; the driver sees totals and a histogram
of at most ``CELLS`` cells for the weights.

Keys are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.bytewords import NOT_SPACE, U64, find_words, mix
from talkmill.llm.exchange import pack_sorted, unpack_sorted
from talkmill.llm.shared import fold_of, materialise, slices

FOLDS, TEST_FOLD, DEV_FOLD = 7, 2, 3
BLOCK_TOKENS = 1 << 19
KEYS_A_RANGE = 1_500_000
END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
BUCKETS, BINS = 16, 40
CELLS = BUCKETS * (BINS + 1) * (BINS + 1)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


#: Blocks are numbered by partition and, inside, in order.
BLOCKS_A_PARTITION = 1 << 32
BLOCK_SCHEMA = "block long, dev boolean, ids binary, folds binary, lengths binary, words binary, tokens binary, n_words long, n_tokens long"


class _Pile:
    """Documents waiting to become a block."""

    def __init__(self, dev: bool) -> None:
        self.dev = dev
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, ids: np.ndarray, folds: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
        if len(ids):
            self.parts.append((ids, folds, lengths, hashes))
            self.held += len(hashes)

    def block(self, number: int) -> pa.RecordBatch:
        ids, folds, lengths, hashes = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.clear()
        words, tokens = np.unique(hashes, return_inverse=True)
        values = [number, self.dev, _pack(ids), _pack(folds), _pack(lengths), words.tobytes(), _pack(tokens.astype("<u4")), len(words), len(tokens)]
        kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 5, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["block", "dev", "ids", "folds", "lengths", "words", "tokens", "n_words", "n_tokens"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, fold, partition, text) to one row a block; documents of DEV_FOLD have blocks of their own."""
    piles, number = (_Pile(False), _Pile(True)), 0
    for batch in slices(batches):
        number = number or batch.column("partition")[0].as_py() * BLOCKS_A_PARTITION
        words = find_words(batch.column("text"), NOT_SPACE)
        per = words.per_text
        h = np.full(len(words.start) + len(per), END, U64)
        h[np.arange(len(words.start)) + np.repeat(np.arange(len(per)), per)] = words.hashes()
        named = batch.column("doc_id")
        ids = np.column_stack((pc.fill_null(named, 0).to_numpy(zero_copy_only=False), named.is_null().to_numpy(zero_copy_only=False))).astype("<i8")
        folds = batch.column("fold").to_numpy(zero_copy_only=False).astype("<i4")
        lengths = (per + 1).astype("<i8")
        for pile in piles:
            own = (folds == DEV_FOLD) == pile.dev
            pile.add(ids[own], folds[own], lengths[own], h[np.repeat(own, lengths)])
            if pile.held >= BLOCK_TOKENS:
                yield pile.block(number)
                number += 1
    for pile in piles:
        if pile.held:
            yield pile.block(number)
            number += 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


class Block:
    """Tokens of a block's documents, and its distinct words and bigrams in hash order."""

    def __init__(self, row: dict) -> None:
        self.ids, self.folds, self.lengths = _unpack(row["ids"], "<i8").reshape(-1, 2), _unpack(row["folds"], "<i4"), _unpack(row["lengths"], "<i8")
        self.words, self.tokens = np.frombuffer(row["words"], U64), _unpack(row["tokens"], "<u4").astype(np.int64)
        n = len(self.words)
        self.start = np.cumsum(self.lengths) - self.lengths
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[self.start] = n
        codes, pair = np.unique(context * (n + 1) + self.tokens, return_inverse=True)
        known = np.append(self.words, BEGIN)
        self.of_context, of_word = codes // (n + 1), codes % (n + 1)
        keys = mix(known[self.of_context] * U64(0x9E3779B97F4A7C15) + known[of_word])
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pairs, self.pair = keys[order], place[pair]
        self.context = context
        self.fold_of_token = np.repeat(self.folds, self.lengths)

    def counts(self, numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each of n keys occurs in training documents, and in those of DEV_FOLD."""
        train, dev = self.fold_of_token != TEST_FOLD, self.fold_of_token == DEV_FOLD
        return np.bincount(numbers[train], minlength=n), np.bincount(numbers[dev], minlength=n)


def _spans(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(part, begin, end) of those of ``ranges`` (a power of two) equal parts of the hash range in which sorted keys lie."""
    bits = int(ranges).bit_length() - 1
    part = (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    begins = np.flatnonzero(np.diff(part, prepend=-1))
    return list(zip(part[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(keys)], strict=True))


def _ask(word_ranges: int, pair_ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            for kind, keys, numbers, ranges in ((0, block.words, block.tokens, word_ranges), (1, block.pairs, block.pair, pair_ranges)):
                train, dev = block.counts(numbers, len(keys))
                spans = _spans(keys, ranges)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind * word_ranges + p for p, _, _ in spans], pa.int64()),
                        pa.array([row["block"]] * len(spans), pa.int64()),
                        pa.array([row["dev"]] * len(spans), pa.bool_()),
                        pa.array([pack_sorted(keys[a:b]) for _, a, b in spans], pa.binary()),
                        pa.array([_pack(train[a:b].astype("<u4")) for _, a, b in spans], pa.binary()),
                        pa.array([_pack(dev[a:b].astype("<u4")) for _, a, b in spans], pa.binary()),
                    ],
                    names=["range", "block", "is_dev", "keys", "train", "dev"],
                )

    return run


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Add up a range's counts and give every block those of its own keys, in its order."""
    keys = [unpack_sorted(k) for k in rows["keys"]]
    known, place = np.unique(np.concatenate(keys), return_inverse=True)
    train, dev = (np.bincount(place, np.concatenate([_unpack(x, "<u4") for x in rows[c]]), len(known)).astype("<u8") for c in ("train", "dev"))
    cuts = np.cumsum([0, *map(len, keys)])
    spans = [place[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    rest = train - dev
    first = [1] + [0] * (len(rows) - 1)
    total = lambda x: [int(x) * f for f in first]  # noqa: E731  the range's totals, in one of its rows
    # Only blocks of DEV_FOLD ever look at its counts.
    devs = [_pack(dev[s]) if own else b"" for s, own in zip(spans, rows["is_dev"], strict=True)]
    return pd.DataFrame(
        {"block": rows["block"], "is_dev": rows["is_dev"], "range": rows["range"], "train": [_pack(train[s]) for s in spans], "dev": devs, "n": total(train.sum()), "v": total((train > 0).sum()), "n_rest": total(rest.sum()), "v_rest": total((rest > 0).sum())}
    )


def _answered(row: dict, block: Block, word_ranges: int, columns: tuple[str, ...] = ("train", "dev")) -> list[np.ndarray]:
    """Counts of the block's words, and of its bigrams: in training, and of DEV_FOLD if asked for."""
    answers = sorted(row["answers"], key=lambda a: a["range"])
    out = []
    for words in (True, False):
        own = [a for a in answers if (a["range"] < word_ranges) == words]
        out += [np.concatenate([_unpack(a[c], "<u8") for a in own]).astype(np.float64) for c in columns]
    assert len(out[0]) == len(block.words) and len(out[-1]) == len(block.pairs)
    return out


def bucket_of(count: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: the number of binary digits of the count."""
    return np.minimum(np.frexp(np.maximum(count, 0))[1], BUCKETS - 1)


def _bin(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.clip(1 - np.log2(np.maximum(p, 1e-300)), 1, BINS), 0).astype(np.int64)


def _histogram(word_ranges: int, n_rest: int, docs_rest: int):
    """What expectation-maximisation needs of the held-out part, in cells of like cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, CELLS))
        for row in _rows(batches):
            block = Block(row)
            w, w_dev, p, p_dev = _answered(row, block, word_ranges)
            at = np.flatnonzero(block.fold_of_token == DEV_FOLD)
            of_context = np.append(w - w_dev, docs_rest)[block.context[at]]
            p2 = (p - p_dev)[block.pair[at]] / np.maximum(of_context, 1)
            p1 = (w - w_dev)[block.tokens[at]] / max(n_rest, 1)
            cell = (bucket_of(of_context) * (BINS + 1) + _bin(p2)) * (BINS + 1) + _bin(p1)
            for i, x in enumerate((None, p2, p1)):
                sums[i] += np.bincount(cell, x, CELLS)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(s[used]) for s in sums]], names=["cell", "n", "p2", "p1"])

    return run


def learn_weights(cells: np.ndarray, n: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, even) of each bucket from cell counts and mean probabilities."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)  # contexts never seen say nothing
    bucket = cells // (BINS + 1) ** 2
    parts = np.column_stack((p2, p1, np.full(len(n), p0)))
    for _ in range(rounds):
        share = weights[bucket] * parts
        share *= (n / share.sum(axis=1))[:, None]
        for b in np.unique(bucket):
            total = share[bucket == b].sum(axis=0)
            # One pseudo-count keeps every weight positive.
            weights[b] = (total + (1 / 3 if b else np.array([0, 0.5, 0.5]))) / (total.sum() + 1)
    return weights


def _score(word_ranges: int, n: int, v: int, docs: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            w, p = _answered(row, block, word_ranges, ("train",))
            sums = lambda x: np.add.reduceat(x, block.start)
            of_word = w[block.tokens]
            of_context = np.append(w, docs)[block.context]
            mix3 = weights[bucket_of(of_context)]
            chance = mix3[:, 0] * p[block.pair] / np.maximum(of_context, 1) + mix3[:, 1] * of_word / max(n, 1) + mix3[:, 2] / (v + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.ids[:, 0], mask=block.ids[:, 1] > 0),
                    pa.array(block.folds == TEST_FOLD),
                    pa.array(block.lengths),
                    pa.array(sums((of_word > 0).astype(np.int64))),
                    pa.array(np.full(len(block.ids), n, np.int64)),
                    pa.array(sums(np.log10((of_word + 1) / (n + v + 1)))),
                    pa.array(sums(np.log10(chance))),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """Score every whole text of (doc_id, text), learning from those outside TEST_FOLD.

    A-Z is lower-cased; tokens are runs of anything but ASCII white space, and one end. Returns
    doc_id, held_out, n_tokens (with the end), n_known (tokens that training
    has), train_tokens, base_score (add-one unigram log10), score (log10 of the
    model's probability of the text). The fold is crc32(doc_id as text) mod 7.

    Null and empty texts have only the end token. A null doc_id stays null; its fold is
    that of the empty text. Repeated rows are learned from as often as they occur. Without training
    documents every token has probability 1 / (V + 1) = 1. An empty table gives an empty
    result. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold_of("doc_id", FOLDS).alias("fold"), F.spark_partition_id().cast("long").alias("partition"), F.col("text").cast("string").alias("text"))
    blocks = materialise(rows.mapInArrow(_blocks, BLOCK_SCHEMA), "blocks")
    sizes = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    in_train = docs.select(fold_of("doc_id", FOLDS).alias("fold")).agg(F.sum(F.expr(f"cast(fold <> {TEST_FOLD} as long)")), F.sum(F.expr(f"cast(fold = {DEV_FOLD} as long)"))).first()
    n_docs, n_dev_docs = in_train[0] or 0, in_train[1] or 0
    word_ranges, pair_ranges = map(_ranges, sizes)
    asked = blocks.mapInArrow(_ask(word_ranges, pair_ranges), "range long, block long, is_dev boolean, keys binary, train binary, dev binary")
    answers = asked.groupBy("range").applyInPandas(_answer, "block long, is_dev boolean, range long, train binary, dev binary, n long, v long, n_rest long, v_rest long")
    answers = materialise(answers, "answers")
    n, v, n_rest, v_rest = (x or 0 for x in answers.where(F.col("range") < word_ranges).agg(*[F.sum(c) for c in ("n", "v", "n_rest", "v_rest")]).first())
    joined = lambda b, a, *c: b.join(a.groupBy("block").agg(F.collect_list(F.struct("range", *c)).alias("answers")), "block")
    cells = joined(blocks.where("dev"), answers.where("is_dev"), "train", "dev").mapInArrow(_histogram(word_ranges, n_rest, n_docs - n_dev_docs), "cell long, n double, p2 double, p1 double")
    cells = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "p2", "p1")]).orderBy("cell").toPandas()
    weights = learn_weights(cells["cell"].to_numpy(), cells["n"].to_numpy(), (cells["p2"] / cells["n"]).to_numpy(), (cells["p1"] / cells["n"]).to_numpy(), 1 / (v_rest + 1)) if len(cells) else np.tile([1 / 3] * 3, (BUCKETS, 1))
    if not n:
        weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    return joined(blocks, answers, "train").mapInArrow(_score(word_ranges, n, v, n_docs, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _ranges(keys: int) -> int:
    """A power of two: enough ranges for a task to hold one, whatever the size of the corpus."""
    return 1 << max(0, int(np.ceil(np.log2(max(1, keys / KEYS_A_RANGE)))))
