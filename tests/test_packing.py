"""Greedy packing in ranges against the fold it stands for."""

from __future__ import annotations

import random

import pytest

from talkmill.operators import packing


def folded(rows, budget):
    out, held = {}, {}
    for g, i, s in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])):
        n, total, chunk = held.get(g, (0, 0, 0))
        if n and total + (s or 0) > budget:
            n, total, chunk = 0, 0, chunk + 1
        held[g] = (n + 1, total + (s or 0), chunk)
        out[g, i] = chunk
    return out


SIZES = {
    "mixed": lambda rng: rng.choice([0, 1, 3, 9, 10, 11, 40, None]),
    "uniform": lambda rng: 3,
    "zeros": lambda rng: rng.choice([0, 0, 0, 0, 7]),
    "oversize": lambda rng: rng.choice([11, 100]),
    "tiny": lambda rng: rng.choice([0, 1]),
}


@pytest.mark.parametrize(("kind", "groups", "a_range"), [("mixed", [None, "a", "b"], 7), ("uniform", ["a"], 4), ("zeros", ["a", "b"], 5), ("oversize", ["a"], 6), ("tiny", ["a", None], 9), ("mixed", ["a"], 1000)])
def test_ranges_give_the_chunks_of_the_fold(spark, monkeypatch, kind, groups, a_range):
    monkeypatch.setattr(packing, "RANGE_ROWS", a_range)
    rng = random.Random(kind)
    rows = [(rng.choice(groups), i, SIZES[kind](rng)) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, i int, s int").repartition(3)
    got = {(r["g"], r["i"]): r["chunk"] for r in packing.greedy_chunks(df, "i", "s", 10, "g").collect()}
    assert got == folded(rows, 10)
    if len(groups) == 1:
        got = {r["i"]: r["chunk"] for r in packing.greedy_chunks(df.drop("g"), "i", "s", 10).collect()}
        assert got == {i: c for (_, i), c in folded(rows, 10).items()}
