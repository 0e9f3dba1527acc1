"""Counts taken while rows are written: no second scan, in batch and stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Name of the count of all rows; conditions can't be called so.
ROWS = "_rows"


def _counts(conditions: dict[str, Column]) -> list[Column]:
    if ROWS in conditions:
        raise ValueError(f"{ROWS} counts all rows")
    return [F.count(F.lit(1)).alias(ROWS), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]]


def missing(columns: list[str]) -> dict[str, Column]:
    """One condition a column: it is null."""
    return {c: F.col(c).isNull() for c in columns}


def counted(df: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """(the same rows, a function that gives the counts of rows that meet each condition).

    The counts are those of the first action that runs the table to its end, such as the write; the function waits for it. A null condition counts as
    not met. Without rows all counts are 0.
    """
    seen = Observation()
    return df.observe(seen, *_counts(conditions)), lambda: {k: v or 0 for k, v in seen.get.items()}


def report(counts: dict[str, int]) -> list[tuple[str, int, float | None]]:
    """(name, rows, share) of each condition; the share of no rows is null. As ``missing_report`` gives them."""
    rows = counts[ROWS]
    return [(n, c, c / rows if rows else None) for n, c in counts.items() if n != ROWS]


class StreamCounts(StreamingQueryListener):
    """Running counts of a stream's batches, for ``spark.streams.addListener``.

    A batch that is repeated after a restart counts once: the newest figures of each batch number hold.
    """

    def __init__(self, name: str):
        self.name = name
        self.batches: dict[int, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.batches[event.progress.batchId] = {k: v or 0 for k, v in seen.asDict().items()}

    def totals(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for batch in self.batches.values():
            for k, v in batch.items():
                out[k] = out.get(k, 0) + v
        return out


def counted_stream(df: DataFrame, conditions: dict[str, Column], name: str) -> tuple[DataFrame, StreamCounts]:
    """The same for a stream; ``totals()`` of the second, once it is added to ``spark.streams``, holds the sums so far."""
    return df.observe(name, *_counts(conditions)), StreamCounts(name)
