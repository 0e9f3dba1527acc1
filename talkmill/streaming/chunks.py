"""States of remote chunks as a stream of their events, kept over restarts.

A chunk's state is what its distinct events add up to, so events that are replayed, repeated or out of order change nothing: completed
once any batch of it completed; else failed for good after more than ``max_retries`` failed batches; else on its way while a
batch that was submitted hasn't failed; else pending. A pending chunk that failed before is due again after a pause.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talkmill.operators.batching import admit

EVENTS = "index long, batch string, outcome string"
STATES = "index long, status string, retries int, due boolean, version int"


def _status(completed: bool, submitted: int, failed: int, max_retries: int) -> str:
    if completed:
        return "completed"
    if failed > max_retries:
        return "failed_permanent"
    return "submitted" if submitted else "pending"


def chunk_states(events: DataFrame, max_retries: int = 2, pause: int | None = None) -> DataFrame:
    """Rows of STATES, one each time a chunk's state changes; ``version`` counts them.

    ``events``: a stream of EVENTS, outcomes 'submitted', 'completed' and 'failed'; others change nothing. ``pause``: milliseconds until a
    failed chunk is due again, kept by a timer; a query with timers never runs out of work, so give none with ``availableNow``. A chunk's state holds the names of its batches.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent, failed, completed, due, version, last = state.get if state.exists else ("", "", False, True, 0, "")
        sent, failed = ({x for x in names.split("\n") if x} for names in (sent, failed))
        before = len(failed)
        if state.hasTimedOut:
            due = True
        for rows in batches:
            for batch, outcome in zip(rows["batch"], rows["outcome"], strict=True):
                (sent if outcome == "submitted" else failed if outcome == "failed" else set()).add(batch or "-")
                completed |= outcome == "completed"
        if pause and len(failed) > before:
            due = False
        status = _status(completed, len(sent - failed), len(failed), max_retries)
        now = f"{status} {len(failed)} {due or status != 'pending'}"
        changed = now != last
        state.update(("\n".join(sorted(sent)), "\n".join(sorted(failed)), completed, due, version + changed, now))
        if status == "pending" and not due:
            state.setTimeoutDuration(pause)
        if changed:
            yield pd.DataFrame({"index": [key[0]], "status": [status], "retries": [len(failed)], "due": [due or status != "pending"], "version": [version + 1]}).astype({"retries": "int32", "version": "int32"})

    kept = "sent string, failed string, completed boolean, due boolean, version int, last string"
    return events.groupBy("index").applyInPandasWithState(fold, STATES, kept, "append", GroupStateTimeout.ProcessingTimeTimeout if pause else GroupStateTimeout.NoTimeout)


def latest_states(states: DataFrame) -> DataFrame:
    """The newest row of each chunk of what :func:`chunk_states` has written."""
    rest = [c for c in states.columns if c != "index"]
    return states.groupBy("index").agg(F.max_by(F.struct(*rest), "version").alias("s")).select("index", "s.*")


def settled(events: DataFrame, max_retries: int = 2) -> DataFrame:
    """(index, status, retries) of a table of all EVENTS: what the stream ends with."""
    of = lambda outcome: F.collect_set(F.when(F.col("outcome") == outcome, F.coalesce(F.nullif("batch", F.lit("")), F.lit("-"))))
    sets = events.groupBy("index").agg(of("submitted").alias("s"), of("failed").alias("f"), F.max(F.coalesce(F.col("outcome") == "completed", F.lit(False))).alias("done"))
    status: Column = F.when(F.col("done"), "completed").when(F.size("f") > max_retries, "failed_permanent").when(F.size(F.array_except("s", "f")) > 0, "submitted").otherwise("pending")
    return sets.select("index", status.alias("status"), F.size("f").alias("retries"))


def to_submit(plan: DataFrame, states: DataFrame, ceiling: int) -> DataFrame:
    """Chunks of ``plan`` (index, n_tokens) to submit now: due ones in order, under a ceiling that those on their way count against."""
    now = plan.join(latest_states(states), "index", "left").withColumns({"status": F.coalesce("status", F.lit("pending")), "due": F.coalesce("due", F.lit(True))})
    busy = now.where("status = 'submitted'").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    return admit(now.where("due or status <> 'pending'").select("index", "n_tokens", "status"), ceiling, busy).select("index", "n_tokens")
