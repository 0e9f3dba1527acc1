"""Greedy packing of ordered items into chunks, without a task that sees all of them.

Rows are sorted into ranges. Where a chunk begins follows from where the one before it began, so a range
alone knows only this: for each row, with what running total a chunk that begins there would leave
the range (a later row begins the next chunk as soon as the running total exceeds it). Chunks that begin
at different rows soon end together, so a range has few such totals (behind an item larger than a chunk stands the range's own number instead, as -1 - number: the next range's first row begins one). They are followed from range to range by pointer
doubling; then each range knows where its first chunk begins and marks the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.storage import written

#: Rows of a range; one task holds their sizes.
RANGE_ROWS = 500_000


class _Range:
    """Rows of a range in order. ``first_open``: its first group began in an earlier range; ``last_open``: its last one goes on."""

    def __init__(self, rows: pd.DataFrame, budget: int) -> None:
        rows = rows.sort_values("_at")
        self.at, self.n, self.part = rows["_at"].to_numpy(), len(rows), int(rows["_part"].iloc[0])
        self.group = rows["_g"].to_numpy()
        size = rows["_s"].to_numpy()
        self.upto = int(rows["_before"].iloc[0]) + np.cumsum(size)
        self.leaves = self.upto - size + budget
        self.begins = np.flatnonzero(np.append(True, self.group[1:] != self.group[:-1]))
        self.ends = np.append(self.begins[1:], self.n)
        self.end = np.repeat(self.ends, self.ends - self.begins)
        self.next = np.maximum(np.searchsorted(self.upto, self.leaves, "right"), np.arange(self.n) + 1)
        self.first_open, self.last_open = bool(rows["_first_open"].iloc[0]), bool(rows["_last_open"].iloc[0])

    def exits(self) -> np.ndarray:
        """For each row of the last group, the total with which chunks from there on leave the range."""
        inside = self.next < self.end
        last = np.where(inside, np.minimum(self.next, self.n - 1), np.arange(self.n))
        while True:
            further = last[last]
            if (further == last).all():
                return np.where(self.leaves < self.upto[-1], -1 - self.part, self.leaves)[last]
            last = further

    def entry(self, group, total: int) -> int | None:
        """The row that begins a chunk after one that left an earlier range of the group."""
        i = int(np.searchsorted(self.upto, total, "right")) if total >= 0 else 0
        return i if self.first_open and i < self.ends[0] and self.group[0] == group else None

    def walk(self, i: int) -> list[int]:
        end, out = self.end[i], []
        while i < end:
            out.append(i)
            i = int(self.next[i])
        return out


def _leaving(budget: int):
    """Totals that may leave a range; ``sure``: of the chunks of a group that begins in it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = _Range(rows, budget)
        if not r.last_open:
            return pd.DataFrame({"_g": rows["_g"].iloc[:0], "total": [], "sure": []}).astype({"total": "int64", "sure": "bool"})
        own = r.exits()[r.begins[-1] :]
        known = not (r.first_open and len(r.begins) == 1)
        totals = np.unique(own)
        return pd.DataFrame({"_g": [r.group[-1]] * len(totals), "total": totals, "sure": (totals == own[0]) & known})

    return run


def _following(budget: int):
    """Totals that enter a range, with those that leave it in turn, or null."""

    def run(rows: pd.DataFrame, coming: pd.DataFrame) -> pd.DataFrame:
        out: list[int | None] = []
        if len(rows):
            r = _Range(rows, budget)
            exits = r.exits()
            whole = r.last_open and len(r.begins) == 1
            for group, total in zip(coming["_g"], coming["total"], strict=True):
                i = r.entry(group, total)
                out.append(int(exits[i]) if i is not None and whole else None)
        return pd.DataFrame({"_g": coming["_g"][: len(out)], "total": coming["total"][: len(out)], "next": pd.array(out, "Int64")})

    return run


def _marked(budget: int):
    def run(rows: pd.DataFrame, coming: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"_at": [], "_g": rows["_g"], "_part": [], "nth": []})
        r = _Range(rows, budget)
        starts = [i for b in r.begins[1 if r.first_open else 0 :] for i in r.walk(int(b))]
        for group, total in zip(coming["_g"], coming["total"], strict=True):
            i = r.entry(group, total)
            starts += r.walk(i) if i is not None else []
        mark = np.zeros(r.n, np.int64)
        mark[starts] = 1
        nth = np.cumsum(mark)
        nth -= np.repeat(nth[r.begins] - mark[r.begins], r.ends - r.begins)  # chunks begun in the range, by group
        return pd.DataFrame({"_at": r.at, "_g": r.group, "_part": int(rows["_part"].iloc[0]), "nth": nth})

    return run


def _reached(start: DataFrame, edges: DataFrame, ranges: int) -> DataFrame:
    """Nodes (_g, total) that can be reached from ``start`` over (_g, total, next), by pointer doubling."""
    reached, jump = start.select("_g", "total").distinct(), edges.where("next is not null")
    for _ in range(max(1, (ranges - 1).bit_length())):
        one = jump.select("_g", "total", "next")
        reached = written(reached.union(reached.join(one, ["_g", "total"]).select("_g", F.col("next").alias("total"))).distinct(), "reached")
        jump = written(one.join(one.select("_g", F.col("total").alias("next"), F.col("next").alias("after")), ["_g", "next"]).select("_g", "total", F.col("after").alias("next")), "jumps")
    return reached


def greedy_chunks(df: DataFrame, order: str, size: str, budget: int, group: str | None = None) -> DataFrame:
    """Adds ``chunk`` (0, 1, ... in each group): items in order, a new chunk where the next would take one that isn't empty beyond the budget.

    A chunk may equal the budget; a larger single item stands alone. Sizes are whole and not negative, a null one counts as 0; order is
    unique in a group. No task sees more than RANGE_ROWS items, whatever the groups.
    """
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))) if group else F.lit("")
    items = df.select(key.alias("_g"), F.col(order).alias("_o"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_s"))
    ranges = max(1, -(-items.count() // RANGE_ROWS))
    rows = items.repartitionByRange(ranges, "_g", "_o").sortWithinPartitions("_g", "_o")
    rows = written(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "items")
    # A row for each range from here on.
    bounds = rows.groupBy("_part").agg(F.sum("_s").alias("_sum"), F.min_by("_g", "_at").alias("_first"), F.max_by("_g", "_at").alias("_last"))
    bounds = bounds.selectExpr(
        "_part",
        "sum(_sum) over (order by _part) as _upto",
        "sum(_sum) over (order by _part) - _sum as _before",
        "lead(_part) over (order by _part) as _behind",
        "coalesce(_first <=> lag(_last) over (order by _part) and row_number() over (order by _part) > 1, false) as _first_open",
        "coalesce(_last <=> lead(_first) over (order by _part) and row_number() over (order by _part desc) > 1, false) as _last_open",
    )
    bounds = written(bounds, "bounds")
    rows = rows.join(bounds.drop("_upto", "_behind"), "_part")
    coming = df.sparkSession.createDataFrame([], "_g string, total long, _part int")
    if ranges > 1:
        leaving = written(rows.groupBy("_part").applyInPandas(_leaving(budget), "_g string, total long, sure boolean"), "leaving")
        # A total enters the first range whose running total exceeds it.
        after_large = leaving.join(bounds, F.expr("-1 - total = _part")).selectExpr("_g", "total", "sure", "_behind as _part")
        both = leaving.where("total >= 0").select("_g", "total", "sure", F.lit(None).cast("int").alias("_part"), F.lit(1).alias("k")).union(bounds.select(F.lit(None).cast("string"), "_upto", F.lit(None).cast("boolean"), "_part", F.lit(0)))
        entering = both.selectExpr("_g", "total", "sure", "k", "min(_part) over (order by total, k rows between current row and unbounded following) as _part").where("k = 1 and _part is not null")
        entering = entering.drop("k").union(after_large)
        entering = written(entering.groupBy("_g", "total", "_part").agg(F.max("sure").alias("sure")), "entering")
        pairs = lambda table: rows.groupBy("_part").cogroup(table.select("_g", "total", "_part").groupBy("_part"))
        edges = written(pairs(entering).applyInPandas(_following(budget), "_g string, total long, next long"), "edges")
        reached = _reached(entering.where("sure"), edges, ranges)
        coming = entering.join(reached, ["_g", "total"], "left_semi")
    placed = written(rows.groupBy("_part").cogroup(coming.select("_g", "total", "_part").groupBy("_part")).applyInPandas(_marked(budget), "_at long, _g string, _part int, nth long"), "marked")
    sizes = placed.groupBy("_g", "_part").agg(F.max("nth").alias("n"))
    offsets = sizes.selectExpr("_g as _g2", "_part as _part2", "sum(n) over (partition by _g order by _part) - n as _offset")
    placed = placed.join(offsets, F.expr("_g <=> _g2 and _part = _part2")).select("_at", (F.col("_offset") + F.col("nth") - 1).cast("int").alias("chunk"))
    found = rows.select("_at", F.col("_g").alias("_g2"), F.col("_o").alias("_o2")).join(placed, "_at")
    return df.withColumn("_g", key).join(found, F.expr(f"_g <=> _g2 and `{order}` <=> _o2")).select(*df.columns, "chunk")
