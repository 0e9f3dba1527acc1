"""Operators against brute force, libraries and round trips, with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkmill.llm import components, lm, near_dup, pu_quality, sharding, spm_fst, token_counts, token_files, topk, url_filter
from talkmill.llm.bytewords import ALNUM, NOT_SPACE, find_words
from talkmill.llm.decontam import Benchmark, contamination, drop_contaminated
from talkmill.llm.pieces import Normaliser, Pieces, load_pieces
from talkmill.llm.registry import tokenizer_file

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Null, empty, blank, one word, odd blanks, not ASCII, long words, special strings.
AWKWARD = [None, "", " \t\n", "one", "One two", "a  b\tc\nd\x0be", "日本語 テキスト é x", "x" * 5000, "<|endoftext|> a <s>", "▁ a▁b", "it's 3 o'clock!!  \n\n ok", "the the the the", "\x00\x01 z"]

#: Beyond one slice of a batch, of many words and of one, with a benchmark-like repetition.
LONG = [" ".join(f"Word{i % 977} and, é{i}" for i in range(90_000)), "ab1" * 70_000]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "extra", 1) for i, t in enumerate(texts)], "doc_id long, text string, sig string, block int")


def words(text, pattern=WORD):
    return pattern.findall((text or "").translate(LOWER))


def near_copies(seed=3, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120, 300]))
        for _ in range(rng.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 12) + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        texts += [" ".join(base)] * (g % 4)
    rng.shuffle(texts)
    return AWKWARD + texts


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(i, len(s), root(i), root(i) == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "block"), [(2, 20_000), (2, 2_000_000), (5, 5_000)])
def test_near_dup_equals_all_pairs(spark, monkeypatch, width, block):
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", block)
    texts = near_copies(seed=width)
    got = sorted(tuple(r) for r in near_dup.near_dup(docs(spark, texts), width, 80).collect())
    assert got == brute_components(texts, width, 80)


def test_words_with_structured_bytes_are_told_apart(spark):
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = thue.translate(str.maketrans("ab", "ba"))
    texts = [f"p {thue} p {other}", f"p {thue} p {thue}", f"{other[:200]} {thue[:200]} {other[:256]} {thue[:257]}", LONG[1] + " x " + LONG[1] + "a x", LONG[0][:3000]]
    got = sorted(tuple(r) for r in near_dup.near_dup(docs(spark, texts), 2, 80).collect())
    assert got == brute_components(texts, 2, 80)
    assert [r[1] for r in got[:3]] == [3, 2, 3]


def test_near_dup_repeated_rows_nulls_and_nothing(spark):
    df = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (7, "a b c")], "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in near_dup.near_dup(df, 2).collect())
    assert got == {(5, 2, 5, True): 2, (7, 2, 5, False): 1, (None, 2, None, True): 1}
    assert near_dup.near_dup(df.limit(0), 2).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(3, 900), (900, 7), (5, 5), (7, 3)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 161)} | {3: 3, 900: 3, 7: 3}


@pytest.mark.parametrize("member", [NOT_SPACE, ALNUM])
def test_words_equal_the_pattern(member):
    pattern = WORD if member is NOT_SPACE else ITEM_WORD
    found = find_words(pa.array(AWKWARD), member)
    for i, t in enumerate(AWKWARD):
        a, b = found.first[i], found.first[i + 1]
        assert [found.bytes_of(k, k + 1).decode() for k in range(a, b)] == words(t, pattern)


def test_url_filter_rules_and_models(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.ORG/es/x?q", "http://a.org", "http://a.org/", "http://xorg/a", "http://example.org/en/12", "http://example.org/en/2", "http://b.com/fr/1#x", "http://b.com/de/", "http://b.net/fr/9"]
    urls += [f"http://good{i}.org/page/{i}" for i in range(60)] + [f"http://bad{i}.com/de/{i}" for i in range(60)] + [f"http://good{i}.net/page/{i}" for i in range(20)] + [f"http://bad{i}.net/de/{i}" for i in range(20)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, gram string")
    rows = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    assert len(rows) == len(urls)
    want = [("", "", None), ("", "", None), ("", "", None), ("www.example.org", "/es/x", "example.org/es/"), ("a.org", "", None), ("a.org", "/", "org/"), ("xorg", "/a", None), ("example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"), ("b.com", "/fr/1", "com/fr/"), ("b.com", "/de/", "com/de/")]
    assert [(rows[i]["host"], rows[i]["path"], rows[i]["rule"]) for i in range(len(want))] == want
    assert [rows[i]["verdict"] for i in (3, 5, 7, 8, 9, 10)] == ["block", "allow", "block", "allow", "allow", "block"]
    right = sum(rows[i]["verdict"] == ("allow" if "good" in u else "block") for i, u in enumerate(urls) if u and ".net" in u and i > 12)
    assert right >= 38
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df.where("page_id < 3")).collect()} <= {"allow", "block"}


def test_sharding_moves_only_into_the_new_shard(spark):
    df = docs(spark, AWKWARD * 60)
    rows = sharding.rendezvous_shards(df, [1.0] * 7, 1.0).collect()
    assert len(rows) == len(AWKWARD) * 60
    assert all(r["grown_shard"] in (r["shard"], 7) for r in rows) and any(r["grown_shard"] == 7 for r in rows)
    for shard in range(7):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots))) and slots
    texts = {i: t or "" for i, t in enumerate(AWKWARD * 60)}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    grown = {r["doc_id"]: r["shard"] for r in sharding.rendezvous_shards(df, [1.0] * 8).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in rows)


def test_sharding_weights_and_bad_keys(spark):
    shares = collections.Counter(r["shard"] for r in sharding.rendezvous_shards(docs(spark, ["x"] * 6000), [1.0, 2.0, 3.0]).collect())
    assert [round(shares[i] / 6000, 1) for i in range(3)] == [0.2, 0.3, 0.5]
    df = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    rows = sharding.rendezvous_shards(df, [1.0, 1.0]).collect()
    assert len(rows) == 3 and len({(r["shard"], r["slot"]) for r in rows}) == 3
    assert sharding.rendezvous_shards(df.limit(0), [1.0]).count() == 0
    with pytest.raises(ValueError, match="positive"):
        sharding.rendezvous_shards(df, [0.0])


MODEL = tokenizer_file("piece_bpe_32k.model")


def small_pieces(merging):
    """Ten pieces and the bytes of one character, by hand."""
    names = ["<unk>", "<0xC3>", "<0xA9>", "a", "b", "c", "ab", "bc", "abc", "▁", "▁a", "ca", "▁ab"]
    out = Pieces(names=names, byte_ids={0xC3: 1, 0xA9: 2}, merging=merging)
    for i, name in enumerate(names[3:], 3):
        out.ids[name], out.scores[name] = i, -float(i) if merging else [-2.0, -2.5, -2.0, -3.0, -2.2, -7.0, -1.0, -3.5, -3.1, -3.9][i - 3]
    return out


def all_paths(pieces, text):
    if not text:
        yield 0.0, []
    for p, i in pieces.ids.items():
        if text.startswith(p):
            for weight, rest in all_paths(pieces, text[len(p) :]):
                yield weight - pieces.scores[p], [i, *rest]
    if text and text[0] not in pieces.ids:
        for weight, rest in all_paths(pieces, text[1:]):
            yield weight - pieces.unknown_score(), [*[pieces.byte_ids[b] for b in text[0].encode()], *rest]


def test_shortest_paths_by_hand():
    rng = random.Random(3)
    texts = ["", "a", "abc", "é", "▁abca", "▁▁abébc"] + ["".join(rng.choices("abc▁é", weights=[3, 3, 3, 1, 1], k=rng.randrange(9))) for _ in range(150)]
    unigram, merging = spm_fst.Transducer(small_pieces(False)), spm_fst.Transducer(small_pieces(True))
    for place, path in unigram.shortest_paths(texts):
        weight, _ = min(all_paths(unigram.pieces, texts[place]), key=lambda x: x[0])
        assert sum(-unigram.pieces.scores[unigram.pieces.names[s]] if s >= 0 else -unigram.pieces.unknown_score() for s in path) == pytest.approx(weight)
        assert "".join(map(unigram.pieces.text, path)) == texts[place]
    for place, path in merging.shortest_paths(texts):
        assert list(map(merging.pieces.text, path)) == merging.pairs.merges(texts[place])
    assert unigram._ids(dict(unigram.shortest_paths(["aé"]))[0]) == [3, 1, 2]
    trie = token_counts.Trie(small_pieces(False))
    for place, tokens in trie.insert(texts):
        best = min(w for w, _ in all_paths(trie.pieces, texts[place]))
        assert tokens == min(len(p) for w, p in all_paths(trie.pieces, texts[place]) if w == pytest.approx(best))


def test_the_normaliser_is_a_transducer():
    pieces = small_pieces(True)
    plain, begin = Normaliser(pieces), Normaliser.BEGIN
    assert [plain.compose(t, begin) for t in ("", "a b", " a", "▁a  ")] == ["", "▁a▁b", "▁▁a", "▁▁a▁▁"]
    pieces.squeeze = True
    assert [Normaliser(pieces).compose(t, begin) for t in ("  ", " a  b ", "a")] == ["", "▁a▁b", "▁a"]


def test_token_counts_against_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = AWKWARD + LONG
    rows = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs(spark, texts), MODEL).collect()}
    assert rows == {i: len(library.encode(t or "")) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(docs(spark, AWKWARD).limit(0), MODEL).count() == 0
    same = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in token_counts.count_tokens(same.na.fill(-1), MODEL).collect()) == [(-1, 0, 0), (-1, 2, 2), (1, 2, 2), (1, 2, 2)]
    assert token_counts.count_tokens(same, MODEL).where("doc_id is null").count() == 2


def test_the_trie_is_shared_and_bounded():
    pieces = load_pieces(MODEL)
    trie, small = token_counts.Trie(pieces), token_counts.Trie(pieces, most_nodes=4, most_chunks=2)
    texts = [pa.array([t]) for t in ["hello world", "hello word", "other words are here now", "hello again"] * 3]
    first = [tuple(map(list, trie.count(t))) for t in texts]
    nodes = len(trie.score)
    assert first == [tuple(map(list, small.count(t))) for t in texts]
    list(trie.insert(["▁hello", "▁hell", "▁wor"]))
    assert len(trie.score) == nodes  # prefixes of earlier batches
    assert len(small.score) <= 4


def test_long_pre_tokens_share_prefixes_in_a_full_trie(monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = load_pieces(MODEL)
    monkeypatch.setattr(token_counts, "DROPPED", 3)
    rng = random.Random(4)
    front = "".join(rng.choices("abcdeé", k=900))
    words = ["▁" + front + "".join(rng.choices("abcdeé", k=rng.randrange(300))) for _ in range(12)] + ["▁" + "ab" * n for n in range(40)] + ["▁", "▁" + front]
    right = [len(library.encode(w[1:])) if len(w) > 1 else 1 for w in words]
    for most in (1, 30, 1_000, token_counts.MOST_NODES):
        trie = token_counts.Trie(pieces, most_nodes=most)
        scored = []
        best = trie._best
        trie._best = lambda *a, best=best, scored=scored: scored.append(1) or best(*a)
        found = dict(trie.insert(words))
        assert [found[i] for i in range(len(words))] == right
        # Each distinct prefix once, whatever is kept, and nothing again where all is kept.
        assert len(scored) == len({w[:n] for w in words for n in range(1, len(w) + 1)}) and len(trie.score) <= most
        again = dict(trie.insert(words[::-1]))
        assert [again[i] for i in range(len(words))] == right[::-1]
        assert len(scored) == len({w[:n] for w in words for n in range(1, len(w) + 1)}) or most <= 1_000


def test_nodes_passed_lately_stay():
    trie = token_counts.Trie(load_pieces(MODEL), most_nodes=12)
    list(trie.insert(["▁hello", "▁word"]))  # 11 nodes and the root
    assert len(trie.score) == 11 or len(trie.score) == 12
    list(trie.insert(["▁zebra"]))
    list(trie.insert(["▁hello"]))
    for n in range(4):  # prefixes that come again outlive those that don't
        list(trie.insert(["▁hello", "▁" + "bcdef"[n] * 9]))
        assert len(trie.score) <= 12
    before = len(trie.score)
    calls = []
    best = trie._best
    trie._best = lambda *a: calls.append(1) or best(*a)
    list(trie.insert(["▁hello"]))
    assert not calls and len(trie.score) <= before


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    texts = AWKWARD + LONG + ["".join(rng.choices("abcdeth  nsé\n1▁", k=rng.randrange(60))) for _ in range(150)]
    rows = {r["doc_id"]: r for r in spm_fst.encode(docs(spark, texts), MODEL).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["ids"] == library.encode(t or ""), t
        assert rows[i]["lossless"] == ("▁" not in (t or "")), t
        assert rows[i]["n_tokens"] == len(rows[i]["ids"])
    back = {r["doc_id"]: r["text"] for r in spm_fst.decode(spm_fst.encode(docs(spark, texts), MODEL), MODEL).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") or "▁" in (t or "") for i, t in enumerate(texts))
    digest = {r["doc_id"]: r["ids_crc32"] for r in spm_fst.encode(docs(spark, texts), MODEL, digest=True).collect()}
    assert all(digest[i] == zlib.crc32(np.array(rows[i]["ids"], "<u4").tobytes()) for i in digest)
    same = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["lossless"]) for r in spm_fst.encode(same, MODEL).collect())
    assert got == {(None, 1, True): 1, (1, 1, True): 2, (2, 0, True): 1}
    assert spm_fst.encode(same.limit(0), MODEL).count() == 0


def brute_hits(text, items, window=10):
    w = words(text, ITEM_WORD)
    hit, found = set(), set()
    for item, t in items:
        v = words(t, ITEM_WORD)
        m = min(window, len(v))
        for i in range(len(v) - m + 1) if m else ():
            for j in range(len(w) - m + 1):
                if w[j : j + m] == v[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([25, 10, 9, 3, 1, 40])] + [(10, None), (11, " .,! "), (12, "Short One"), (2, "short one")]
    texts = list(AWKWARD)
    for _ in range(60):
        _, source = rng.choice(items[:6])
        w = source.split()
        a = rng.randrange(len(w))
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(30)) + w[a : a + rng.randrange(20)] + rng.choices(vocabulary, k=5)).upper())
    texts += [" ".join(rng.choices(vocabulary, k=700)) + " " + items[0][1], "x-short,one"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in contamination(docs(spark, texts), bench).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    kept = {r["doc_id"] for r in drop_contaminated(docs(spark, texts), bench).collect()}
    assert kept == {i for i, v in got.items() if not v[4]}
    assert contamination(docs(spark, texts).limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in contamination(docs(spark, texts), bench.limit(0)).collect())


def test_decontamination_in_blocks(spark, monkeypatch):
    from talkmill.llm import decontam

    items = [(i, f"alpha{i} beta{i} gamma{i}") for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [items[3][1] + " " + items[17][1], "nothing"]
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    texts += ["x " + " ".join(t for _, t in items[2:9]) + " y", None, items[4][1] * 2]
    assert decontam.benchmark_blocks(bench, 10)[1] > 3
    got = {r["doc_id"]: tuple(r)[1:] for r in contamination(docs(spark, texts), bench).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    kept = drop_contaminated(docs(spark, texts), bench)
    assert kept.columns == docs(spark, texts).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in got.items() if not v[4])


def test_items_of_any_size_are_cut_and_dealt(spark, monkeypatch):
    from talkmill.llm import decontam

    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(40)]
    long = rng.choices(vocabulary, k=700)
    items = [("long", " ".join(long)), ("copy", " ".join(long)), (None, " ".join(long[:60]))] + [("short", "tiny item")] * 30 + [(f"i{k}", " ".join(rng.choices(vocabulary, k=15))) for k in range(20)]
    monkeypatch.setattr(decontam, "PIECE_WORDS", 23)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 9000)
    bench = spark.createDataFrame(items, "item_id string, text string")
    pieces, blocks = decontam.benchmark_blocks(bench, 10)
    sizes = {r["block"]: r["s"] for r in pieces.groupBy("block").agg(F.sum("size").alias("s")).collect()}
    assert blocks > 3 and max(sizes.values()) <= 9000
    texts = [" ".join(long[a : a + n]) + " " + " ".join(rng.choices(vocabulary, k=9)) for a, n in [(0, 700), (17, 30), (10, 9), (330, 12), (690, 10)]]
    texts += ["x tiny item y", "", None, items[-1][1] + " z", LONG[0][:4_000] + " " + " ".join(long[5:40])]
    ids = [0, 1, 2, None, None, 5, 5, 7, 8, 9]
    table = spark.createDataFrame(list(zip(ids, texts, ["k"] * 10, strict=True)), "doc_id long, text string, _row string")
    got = [tuple(r) for r in contamination(table, bench).collect()]
    named = [(i, t) for i, t in items if i is not None]
    want = []
    for i, t in zip(ids, texts, strict=True):
        n, hits, *rest = brute_hits(t, items)
        want.append((i, n, hits, *brute_hits(t, named)[2:4], bool(hits)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = drop_contaminated(table, bench)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((w[0] for w in want if not w[5]), key=repr)


def test_a_block_takes_few_bytes_a_window():
    import pickle

    rng = random.Random(2)
    rows = [(str(i), " ".join(rng.choices([f"word{k}" for k in range(5000)], k=500))) for i in range(200)]
    block = Benchmark(rows, 10)
    assert len(pickle.dumps(block)) < 64 * sum(len(m.begins) for m in block.machines)


def test_shift_tables_skip():
    machine = Benchmark([("a", " ".join(f"p{i}" for i in range(10)))], 10).machines[0]
    assert machine.shift.max() == 9
    assert machine.shift.min() == 0


def test_token_files_round_trip(spark, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "FILE_BYTES", 2000)
    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = AWKWARD + [f"word{i} and more text, {i} times!" * (i % 9) for i in range(120)]
    folder, manifest = token_files.write_token_files(docs(spark, texts), path, f"file://{tmp_path}/tokens")
    rows = {r["doc_id"]: r for r in token_files.read_token_files(folder, manifest).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (rows[i]["ids"], rows[i]["start"], rows[i]["n_tokens"]) == (ids, start, len(ids)), t
        start += len(ids)
    assert manifest.count() > 2
    digests = {r["doc_id"]: r["ids_crc32"] for r in token_files.read_digests(folder, manifest).collect()}
    assert all(digests[i] == zlib.crc32(np.array(rows[i]["ids"], "<u4").tobytes()) for i in rows)
    name = manifest.orderBy("part").first()["file"]
    one = token_files.TokenFile(folder, name)
    assert one.find(3)[0].tolist() == rows[3]["ids"] and one.find(10**9) == []
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.TokenFile(folder, name, b"other")


@pytest.mark.parametrize("texts", [["x"], AWKWARD, [f"some words, {i}" for i in range(300)]])
def test_there_is_always_a_dictionary(spark, tmp_path, texts):
    path = tokenizer_file("byte_bpe_50k.json")
    folder, manifest = token_files.write_token_files(docs(spark, texts), path, f"file://{tmp_path}/tokens")
    assert token_files.read_dictionary(folder)
    assert token_files.read_digests(folder, manifest).count() == len(texts)


def test_token_ids_equal_the_library_on_odd_texts():
    encoder = token_files.encoder(tokenizer_file("byte_bpe_50k.json"), 2)
    rng = random.Random(8)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "²", "!", "\u3000", "\u00a0", "\u2009", "\x85", "日", "가", "<|endoftext|>", "\x1c", "\r", "_", "ß.", "'ll", "ñ,", "🙂", "ـ", "Ⅷ"]
    texts = [None, "", *LONG] + ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)]
    want = encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [e.ids for e in want]


def test_a_call_that_cannot_be_told_apart_is_repeated_alone():
    encoder = token_files.Encoder(tokenizer_file("byte_bpe_50k.json"), 2)
    encoder.blank_first[:] = False
    assert encoder.encode(pa.array(["one two three"]))[0].tolist() == encoder.library.encode("one two three").ids


def test_token_files_awkward_tables(spark):
    path = tokenizer_file("byte_bpe_50k.json")
    folder, manifest = token_files.write_token_files(docs(spark, ["x"]).limit(0), path)
    assert manifest.count() == 0 and token_files.read_digests(folder, manifest).count() == 0
    same = spark.createDataFrame([(4, "b c"), (4, "a"), (4, "a"), (None, "b c"), (None, None), (-3, "a")], "doc_id long, text string")
    folder, manifest = token_files.write_token_files(same, path)
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in token_files.read_digests(folder, manifest).collect())
    assert got == [(0, 1, None), (1, 3, None), (4, 2, -3), (6, 2, 4), (8, 2, 4), (10, 3, 4)]
    file = token_files.TokenFile(folder, manifest.orderBy("part").first()["file"])
    assert file.find(0) == []
    nameless = same.where("doc_id is null")
    assert token_files.read_digests(*token_files.write_token_files(nameless, path)).count() == 2


def brute_top(rows, k, every=20):
    whole = lambda x: math.floor(64 * float(x)) if abs(x) < 1e300 else 64 * int(x)
    q = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {i: min(w for j, w in q if j == i) for i, _ in q if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in q if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(512, 8192, 32_000_000, 2048), (3, 17, 3000, 5), (7, 50, 900, 0)])
def test_top_k_equals_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("QUERIES_A_CELL", "CANDIDATES_A_CELL", "QUERY_BYTES", "PILOT"), sizes, strict=True):
        monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.3, 40))]) for i in range(160)]
    rows += [(200 + i, rows[5][1]) for i in range(60)]  # ties
    rows += [(400, None), (420, [None, 1.0]), (440, [float("nan")]), (460, [float("inf"), 1.0]), (480, []), (500, [1.0, -2.0]), (None, [1.0])]
    rows += [(520, [0.5, 0.5]), (520, [0.25, 9.0]), (521, [0.5]), (521, [0.5])]  # repeated ids and rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = sorted(tuple(r) for r in topk.top_k(df, 7).collect())
    assert got == brute_top(rows, 7)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(i, [float(i), 1.0, -0.5]) for i in range(25)]
    rows += [(31, [2e9, 3.0]), (32, [float(2**21), 1.0]), (40, [float(2**21), 2.0**23 + 0.25]), (60, [2.0**30, -1.0]), (61, [-1e10]), (63, [123456.25, 7e7]), (64, [-1e300, 1.0])]
    df = lambda some: spark.createDataFrame(some, "vec_id long, embedding array<double>")
    want = brute_top(rows, 20)
    beyond = {q for q, _, _, s in want if abs(s) >= 2**63}
    assert beyond < {q for q, *_ in want} and beyond
    clear = lambda r: (*r[:3], r[3] if abs(r[3]) < 2**63 else None)  # noqa: E731  a score that no long holds is null
    assert sorted(tuple(r)[:3] + (r["score"],) for r in topk.top_k(df(rows), 20).collect()) == sorted(map(clear, want))
    few = [r for r in rows if r[0] not in beyond]
    assert sorted(tuple(r) for r in topk.top_k(df(few), 20).collect()) == brute_top(few, 20)


def test_lm_counts_and_probabilities(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "Cat", "dog,", "runs", "é", "x1"]
    texts = list(AWKWARD)
    for i in range(300):  # a word mostly foretells the next
        t = [rng.choice(vocabulary)]
        while rng.random() < 0.95:
            t.append(vocabulary[(vocabulary.index(t[-1]) + 1) % 7] if rng.random() < 0.8 else rng.choice(vocabulary))
        texts.append(" ".join(t))
    rows = {r["doc_id"]: r for r in lm.score_texts(docs(spark, texts)).collect()}
    tokens = {i: [*words(t), None] for i, t in enumerate(texts)}
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    count = collections.Counter(w for i, t in tokens.items() if fold(i) != 2 for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i) == 2, len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0
    held = [r for i, r in rows.items() if r["held_out"] and i >= len(AWKWARD)]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score_texts(docs(spark, texts).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, None), (3, "a b"), (3, "a b")], "doc_id long, text string")
    got = sorted((repr(r["doc_id"]), r["n_tokens"], r["train_tokens"]) for r in lm.score_texts(odd).collect())
    trained = sum(n for i, n in (("", 3), ("", 1), ("3", 3), ("3", 3)) if zlib.crc32(i.encode()) % 7 != 2)
    assert got == [("3", 3, trained), ("3", 3, trained), ("None", 1, trained), ("None", 3, trained)]
    twice = [sorted(tuple(r) for r in lm.score_texts(docs(spark, texts).coalesce(2)).collect()) for _ in range(2)]
    assert twice[0] == twice[1]


def test_lm_against_direct_interpolation(spark, monkeypatch):
    """With the learned weights, scores equal a plain evaluation, in blocks of any size."""
    monkeypatch.setattr(lm, "KEYS_A_RANGE", 10)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 200)
    seen = {}
    learned = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a, **k: seen.setdefault("w", learned(*a, **k)))
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["a", "b", "c", "d"], weights=[5, 3, 1, 1], k=rng.randrange(0, 30))) for _ in range(120)]
    rows = {r["doc_id"]: r for r in lm.score_texts(docs(spark, texts)).collect()}
    train = {i: ["<b>", *words(t), "<e>"] for i, t in enumerate(texts)}
    uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in train.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            uni.update(t[1:])
            bi.update(zip(t, t[1:], strict=False))
            ctx.update(t[:-1])
    n, v = sum(uni.values()), len(uni)
    for i, t in train.items():
        total = 0.0
        for u, w in zip(t, t[1:], strict=False):
            a, b, c = seen["w"][lm.bucket_of(np.array([ctx[u]]))[0]]
            total += math.log10(a * bi[u, w] / max(ctx[u], 1) + b * uni[w] / n + c / (v + 1))
        assert rows[i]["score"] == pytest.approx(total)
    assert seen["w"].sum(axis=1) == pytest.approx(1)


def test_em_improves_the_held_out_likelihood():
    rng = np.random.default_rng(0)
    cells = np.arange(1, 30) * (lm.BINS + 1) ** 2 // 3
    n, p2, p1 = rng.integers(1, 50, 29).astype(float), rng.random(29), rng.random(29) / 10
    value = lambda w: (n * np.log((w[cells // (lm.BINS + 1) ** 2] * np.column_stack((p2, p1, np.full(29, 1e-4)))).sum(axis=1))).sum()
    scores = [value(lm.learn_weights(cells, n, p2, p1, 1e-4, k)) for k in (0, 1, 5, 60)]
    assert scores == sorted(scores)


def test_quality_learns_from_positives_only(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choices(["the", "cat", "sat", "quietly.", "on", "it"], k=60)).capitalize()
    bad = lambda: " ".join(rng.choices(["BUY!!", "NOW!!", "###", "$$$ WIN"], k=60))
    texts = AWKWARD + [good() if i % 6 else bad() for i in range(600)]
    truth = {len(AWKWARD) + i: int(i % 6 > 0) for i in range(600)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in truth.items() if zlib.crc32(b"label%d" % i) % 3 == 0], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in pu_quality.score_quality(docs(spark, texts), labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert np.mean([rows[i]["predicted"] == q for i, q in truth.items() if rows[i]["held_out"]]) > 0.97
    kept = {r["doc_id"] for r in pu_quality.drop_bad(docs(spark, texts), labels).collect()}
    assert kept == {i for i, r in rows.items() if r["predicted"] == 1}


def direct_risk(f_p, f_u, prior):
    """Straight from the definition, loss by loss."""
    loss = lambda f, y: math.log1p(math.exp(-y * f))
    mean = lambda xs: sum(xs) / len(xs)
    inner = mean([loss(f, -1) for f in f_u]) - prior * mean([loss(f, -1) for f in f_p])
    return prior * mean([loss(f, 1) for f in f_p]) + max(0.0, inner), inner


@pytest.mark.parametrize(("shift", "prior"), [(0.0, 0.4), (1.0, 0.3), (-3.0, 0.9), (-1.0, 0.95)])
def test_risk_and_direction_by_brute_force(shift, prior):
    rng = np.random.default_rng(5)
    f_p, f_u = rng.normal(1, 1, 7), rng.normal(shift, 1, 11)
    value, g_p, g_u = pu_quality.risk(f_p, f_u, prior)
    want, inner = direct_risk(f_p, f_u, prior)
    assert value == pytest.approx(want)
    follow = (lambda a, b: direct_risk(a, b, prior)[0]) if inner >= 0 else (lambda a, b: -direct_risk(a, b, prior)[1])
    step = 1e-6
    for x, g, other in ((f_p, g_p, lambda y: follow(y, f_u)), (f_u, g_u, lambda y: follow(f_p, y))):
        slope = [(other(x + step * (np.arange(len(x)) == i)) - other(x - step * (np.arange(len(x)) == i))) / (2 * step) for i in range(len(x))]
        assert g == pytest.approx(np.array(slope), abs=1e-6)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(2)
    good, bad = lambda n: rng.normal(2, 1, (n, 3)), lambda n: rng.normal(-2, 1, (n, 3))
    n = 2000
    unlabelled = np.concatenate((good(int(n * prior)), bad(n - int(n * prior))))
    assert pu_quality.estimate_prior(good(800), rng.permutation(unlabelled)) == pytest.approx(prior, abs=0.06)


def test_quality_of_odd_rows(spark):
    texts = AWKWARD + LONG + ["good words here"] * 5
    labels = spark.createDataFrame([(i, q) for i in range(len(texts)) for q in (1, i % 2)] + [(None, 1), (3, None), (10**9, 1)], "doc_id long, quality int")
    rows = docs(spark, texts).union(docs(spark, texts[:4])).union(spark.createDataFrame([(None, "good words here", "x", 1)], "doc_id long, text string, sig string, block int"))
    got = pu_quality.score_quality(rows.withColumn("score", F.lit("clash")), labels).collect()
    assert len(got) == len(texts) + 5
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add(r["score"])
    assert all(len(s) == 1 and 0 <= min(s) <= 1 for s in by_id.values())
    assert by_id[None] == by_id[len(texts) - 1] and by_id[0] == by_id[1]


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in pu_quality.score_quality(docs(spark, AWKWARD), labels).collect()} == {0.5}
    assert pu_quality.score_quality(docs(spark, AWKWARD).limit(0), labels).count() == 0


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline
    from talkmill.llm.shared import materialise

    sf = "/root/testdata/sf0.001"
    current = spark.read.parquet(f"{sf}/documents.parquet")
    columns = current.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(current.select("doc_id", "text").collect())
        current = materialise(stage(spark, current, sf), f"test-{n}")
        after = {r["doc_id"] for r in current.collect()}
        if n < 3:
            assert current.columns == columns
        if n == 1:
            found = brute_components([r["text"] for r in before], 5, 80)
            assert after == {before[i]["doc_id"] for i, _, _, kept in found if kept}
        elif n == 2:
            assert after == {r["doc_id"] for r in before if not brute_hits(r["text"], items)[4]}
        elif n == 3:
            assert after == {r["doc_id"] for r in before} and all(r["lossless"] for r in current.collect())
    assert after == {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}


def test_empty_documents_pass_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_keys_of_many_rows_are_split(spark, monkeypatch):
    from talkmill.llm import shared
    from talkmill.llm.components import connected_components

    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    big = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 1), (2, 2), (3, 1), (9, 1)], "k long, x long")
    small = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k long, y string")
    hot = shared.hot_keys(big.groupBy(F.col("k").alias("key")).agg(F.count("*").alias("n")), big.count())
    assert [tuple(r) for r in hot.collect()] == [(1, 14)]
    split = sorted(map(tuple, shared.join_split(big, small, "k", "x", hot).collect()))
    assert split == sorted(map(tuple, big.join(small, "k").collect()))
    # Two stars, joined by a chain of hubs, and a pair of its own.
    edges = [(100, i) for i in range(1, 30)] + [(200, 200 + i) for i in range(1, 20)] + [(100, 150), (150, 200), (500, 501)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(found) == 29 + 19 + 3 + 2 and found.pop(500) == 500 and found.pop(501) == 500 and set(found.values()) == {1}


def test_blocks_compare_in_bounded_memory():
    """Blocks as large as they get, in which every pair has most of its sketch in common."""
    draw = np.random.default_rng(4)
    rows = near_dup.BLOCK_BYTES // (near_dup.ROW_BYTES + 8 * near_dup.K)
    common = draw.integers(0, 1 << 63, 40).astype(np.uint64)
    sets = [np.sort(np.concatenate((common, draw.integers(0, 1 << 63, near_dup.K - 40).astype(np.uint64)))).tobytes() for _ in range(2 * rows)]
    left = pd.DataFrame({"hashes": sets[:rows], "n": 100, "component": np.arange(rows)})
    right = pd.DataFrame({"hashes2": sets[rows:], "n2": 100, "component2": np.arange(rows) + rows})
    tracemalloc.start()
    fits = near_dup._likely(left, right, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert fits.all() and peak < 200_000_000, peak
