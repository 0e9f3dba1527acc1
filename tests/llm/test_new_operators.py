"""Substring dedup, importance resampling and vector codes against brute force, with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from talkmill.llm import exchange, recompress, resample, substring_dedup, vector_codes
from talkmill.llm.bytewords import ALNUM, NOT_SPACE, find_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \t\n", "one", "One two", "a  b\tc\nd\x0be", "日本語 テキスト é x", "x" * 5000, "the " * 40, "| " * 30 + "a b c d e f g", "\x00\x01 z"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, [i or 0]) for i, t in rows], "doc_id long, text string, block string, _at int, n_words array<long>")


# --- substring dedup


def brute_removed(rows, window):
    first = {}
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in texts:
        for j in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[j : j + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def passages(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["a", "b"] * 40
    shared = [rng.choices(vocabulary, k=rng.choice([12, 13, 14, 40, 200])) for _ in range(12)] + [["a"] * 30, ["a", "b"] * 20, ["a"] * 7 + ["b"] * 9]
    texts = []
    for _ in range(n):
        parts = [rng.choices(vocabulary, k=rng.choice([0, 3, 20, 90])) for _ in range(3)] + [rng.choice(shared) for _ in range(rng.choice([0, 1, 2]))]
        rng.shuffle(parts)
        texts.append(rng.choice([" ", "\n", "  \t"]).join(x for part in parts for x in part))
    texts += rng.choices(texts, k=30)
    rows = [(rng.randrange(400), t) for t in texts] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, texts[0]), (None, texts[0]), (7, texts[1]), (7, texts[1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "window", "block", "a_range"), [(1, 13, 3_000_000, 600_000), (2, 13, 900, 40), (3, 5, 5000, 100), (4, 2, 700, 300), (5, 50, 20_000, 1000)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, window, block, a_range):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(exchange, "KEYS_A_RANGE", a_range)
    rows = passages(seed)
    got = substring_dedup.remove_repeats(docs(spark, rows).repartition(5), window).collect()
    assert sorted(map(tuple, got), key=repr) == brute_removed(rows, window)


def test_very_long_texts_and_words_repeat(spark):
    long = " ".join(f"Word{i % 4001}, é{i // 7}" for i in range(60_000))
    words = " ".join("ab" * (2000 + i) for i in range(20))
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = thue.translate(str.maketrans("ab", "ba"))
    rows = [(5, long), (3, long[100:]), (1, "x " + words), (2, words + " y"), (8, " ".join([thue, other] * 8)), (9, " ".join([other, thue, thue] * 6))]
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs(spark, rows)).collect()), key=repr) == brute_removed(rows, 13)


def test_no_documents_and_narrow_windows(spark):
    assert substring_dedup.remove_repeats(docs(spark, [])).collect() == []
    with pytest.raises(ValueError, match="two words"):
        substring_dedup.remove_repeats(docs(spark, []), 1)


def test_equal_stretches_have_equal_symbols_inside():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(50)]
    inside = rng.choices(vocabulary, k=200)
    texts = [" ".join(rng.choices(vocabulary, k=30) + inside + rng.choices(vocabulary, k=17)) for _ in range(2)] + [" ".join(inside)]
    words = find_words(pa.array(texts), NOT_SPACE, lower=False)
    low, high = recompress.levels(words, 2, 6)
    seen = []
    for t, at in ((0, 30), (1, 30), (2, 0)):
        own = low.text == t
        a, b = low.a[own] - words.first[t] - at, low.b[own] - words.first[t] - at
        inner = (a >= 0) & (b <= 200)
        seen.append({(int(x), int(y), int(n)) for x, y, n in zip(a[inner], b[inner], low.name[own][inner], strict=True)})
        assert len(seen[-1]) > 60
    # What rests on the stretch alone is the same wherever the stretch stands.
    assert seen[0] == seen[1]
    assert {x for x in seen[2] if x[0] >= 0} <= seen[0]
    assert len(high.name) < len(low.name) < len(words.start)
    names = collections.defaultdict(set)
    ends = np.append(high.start[1:], len(words.start))
    for n, c, s, e in zip(high.name.tolist(), high.check.tolist(), high.start.tolist(), ends.tolist(), strict=True):
        names[n, c].add(words.bytes_of(s, e))
    assert all(len(x) == 1 for x in names.values())


def test_numbers_survive_packing():
    for x in ([], [0], [5, 5, 5], [-(2**63), 2**63 - 1, 0], [2**40, -3], list(range(1000))):
        assert exchange.unpack(exchange.pack(np.array(x, np.int64))).tolist() == x
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (exchange.unpack_sorted(exchange.pack_sorted(keys)) == keys).all()


# --- importance resampling


def brute_resampled(rows, target, percent, least, longest, buckets, seed):
    def features(t):
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + m]).encode()) % buckets for i in range(len(w)) for m in range(1, longest + 1) if i + m <= len(w)]

    found = [(i, *features(t)) for i, t in rows]
    s, t = collections.Counter(b for *_, f in found for b in f), collections.Counter(b for x in target for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fits = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    drawn = collections.defaultdict(list)
    for r, x in enumerate(fits[: len(fits) * percent // 100], 1):
        drawn[x].append(r)
    return sorted(((x[0], *x[2:], drawn[x].pop(0) if drawn[x] else None) for x in out), key=repr)


@pytest.mark.parametrize(("percent", "least", "longest", "buckets", "size"), [(25, 20, 2, 10_000, 3_000_000), (60, 1, 3, 97, 500), (100, 0, 1, 70_000, 4000), (40, 5, 4, 1000, 100)])
def test_resampling_equals_brute_force(spark, monkeypatch, percent, least, longest, buckets, size):
    monkeypatch.setattr(resample, "ARRAY_BYTES", size)
    rows = passages(percent) + [(77, " ".join(f"Word{i % 301} x{i}" for i in range(30_000)))]
    target = [t for _, t in rows[:20]] + ["w1 w2 w3 " * 30, None, ""]
    table = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resample.resample(docs(spark, rows).repartition(4), table, percent, least, longest, buckets)
    assert [k for _, k in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resampled(rows, target, percent, least, longest, buckets, 7)


def test_resampling_of_nothing(spark):
    none = docs(spark, [])
    assert resample.resample(none, none).collect() == []
    rows = [(i, "a b c d " * 6) for i in range(8)]
    got = resample.resample(docs(spark, rows), none).collect()
    assert sorted(map(tuple, got), key=repr) == brute_resampled(rows, [], 25, 20, 2, 10_000, 7)


def test_hashes_of_joined_strings():
    rng = random.Random(1)
    a, b = ([bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 300]))) for _ in range(200)] for _ in range(2))
    crcs = [np.array([zlib.crc32(x) for x in side], np.uint32) for side in (a, b)]
    assert resample.crc_joined(*crcs, np.array([len(x) for x in b])).tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


def test_runs_of_the_suffix_array_are_ngrams():
    texts = ["a b a b c", "b a b", "", "a"]
    array = resample.SuffixArray(find_words(pa.array(texts), ALNUM), 3)
    words = [w for t in texts for w in t.split()]
    for m, (at, crc) in enumerate(array.crcs(3), 1):
        grams = {int(i): " ".join(words[i : i + m]) for i in at}
        assert {i: zlib.crc32(g.encode()) for i, g in grams.items()} == dict(zip(at.tolist(), crc.tolist(), strict=True))
        assert len(grams) == sum(max(0, len(t.split()) - m + 1) for t in texts)


# --- vector codes


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, label, v) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(1, -(-max((len(v) for *_, v in kept), default=0) // parts)) * parts
    step = width // parts
    whole = [[*[math.floor(c * 4096) if abs(c) < 1e300 else math.floor(c) * 4096 for c in v], *[0] * (width - len(v))] for *_, v in kept]
    cut = lambda v: [v[p * step : (p + 1) * step] for p in range(parts)]
    begin = {}
    for (i, _, v), w in zip(kept, whole, strict=True):
        if i is not None and (i not in begin or v < begin[i][0]):
            begin[i] = (v, w)
    books = [[cut(begin[i][1])[p] for i in sorted(begin)[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds if begin else 0):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for v in whole:
                groups[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, sums = [], collections.Counter()
    for (i, label, _), v in zip(kept, whole, strict=True):
        best = [near(x, books[p]) for p, x in enumerate(cut(v))] if begin else []
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), min(sum(d for d, _ in best), 2**63 - 1)))
        sums[label] += out[-1][3]
    return sorted(((i, code, e, min(sums[label], 2**63 - 1), sha) for i, label, code, e in out), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "c") for i, v, label in rows], "vec_id long, embedding array<double>, label int, code string")


def some_vectors(seed, n, width, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(width)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.1 * scale) for c in rng.choice(centres)], rng.choice([None, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize(("n", "width", "parts", "entries", "scale"), [(200, 16, 8, 16, 1.0), (60, 10, 4, 5, 1e-3), (40, 8, 8, 1, 1.0), (50, 8, 2, 7, 1e5), (30, 8, 2, 4, 1e200)])
def test_codes_equal_brute_force(spark, n, width, parts, entries, scale):
    rows = some_vectors(n, n, width, scale)
    rows += [(3, rows[0][1], 1), (3, rows[0][1], 1), (5000, None, 1), (5001, [1.0, None], 1), (5002, [float("nan")] * width, 0), (5003, [float("inf")], 0), (None, rows[1][1], 0), (5004, [], None), (5005, [0.5], 2)]
    random.Random(1).shuffle(rows)
    got = vector_codes.vector_codes(vectors(spark, rows).repartition(3), parts, entries, 3).collect()
    assert sorted(map(tuple, got), key=repr) == brute_codes(rows, parts, entries, 3)


def test_ties_go_to_the_lower_entry():
    x = np.array([[0, 5, 10, 7], [0, 0, 0, 0]])
    code, distance = vector_codes.nearest(x, [[0, 0], [10, 0], [10, 0], [0, 0]])
    assert code.tolist() == [0, 0, 1, 1]
    assert distance.tolist() == [0, 25, 0, 9]


def test_codes_of_nothing(spark):
    assert vector_codes.vector_codes(vectors(spark, [])).collect() == []
    rows = [(None, [1.0] * 8, None), (None, [2.0] * 8, 3)]
    got = vector_codes.vector_codes(vectors(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_codes(rows, 8, 16, 6)
    with pytest.raises(ValueError, match="256"):
        vector_codes.vector_codes(vectors(spark, []), entries=300)
