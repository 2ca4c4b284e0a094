"""The replay of edits, the panel of counts and the report on written files as Structured Streaming queries."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators.clauses import hook_lines
from marlstone.operators.flows import EVENT, Replay


def stream_replay(events: DataFrame, key: str, time: str | None = None, late: str = "2 hours") -> DataFrame:
    """(key, writes, applied, divergences, unanchored) after each micro-batch; the state of a key is its text and counts.

    With `time`, events wait until the watermark has passed them and are applied in its order, so that those up to `late`
    out of order do no harm; equal ones within it are one, and later ones are dropped.  Without, order holds within a batch."""
    counts = "writes long, applied long, divergences long, unanchored long"
    timed = time is not None
    if timed:
        events = events.withWatermark(time, late).dropDuplicatesWithinWatermark([key, "ord", "kind", "content", "old", "new"])

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got = state.get if state.exists else (None, 0, 0, 0, 0, "[]")
        replay, waiting = Replay(got[0], tuple(got[1:5])), json.loads(got[5])
        for frame in [] if state.hasTimedOut else frames:
            for row in frame.itertuples():
                at = int(pd.Timestamp(row.when_).timestamp() * 1000) if timed else 0
                waiting.append([at, int(row.ord), row.kind, row.content, row.old, row.new, bool(row.replace_all)])
        waiting.sort(key=lambda e: (e[0], e[1]))  # stable: equal places in the order that they came
        mark = state.getCurrentWatermarkMs() if timed else 0
        ready = [e for e in waiting if not timed or e[0] <= mark]
        waiting = waiting[len(ready) :]
        for e in ready:
            replay.take(*e[2:])
        state.update((replay.current, *replay.tally, json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0], mark + 1))
        yield pd.DataFrame([[k[0], *replay.tally]], columns=[key, "writes", "applied", "divergences", "unanchored"])

    rows = events.select(key, *EVENT, *([F.col(time).alias("when_")] if timed else []))
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {dict(events.dtypes)[key]}, {counts}", f"current string, {counts}, waiting string", "update", timeout)


def stream_panel(events: DataFrame, time: str, by: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, by, n): tumbling counts with a watermark; later events than that are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def stream_hook(files: DataFrame, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A stream of written files (path, text) whose reports (path, report) go to `write`, a micro-batch at a time."""
    return files.writeStream.foreachBatch(lambda batch, number: write(hook_lines(batch), number))
