"""W05 and W06 over Structured Streaming: streaks of zero rewards or losses, one state per run.

Rows of a run may come in several files; within a micro-batch they are ordered by ``seq``, and the
state carries the streak on. Where batches come out of order, name the event-time column and how late a
row may be: rows then wait in the state until the watermark has passed them, and come out in order. Rows
later than that are dropped by the engine, as late rows always are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "run string, seq bigint, streak bigint, alarm string"


def _followed(streak: int, rows: list[tuple], warn: int, fatal: int) -> tuple[int, list[tuple]]:
    """The streak after rows of (seq, counts, resets, stops) in order, and (seq, streak, alarm) of each."""
    out = []
    for seq, counts, resets, stops in rows:
        if resets:
            streak = 0
        elif counts:
            streak += 1
        level = "none" if not counts else "fatal" if streak >= fatal else "warn" if streak == warn else "none"
        out.append((seq, streak, "stop" if stops else level))
    return streak, out


def streak_alarms(log: DataFrame, warn: int, fatal: int, at: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(run, seq, streak, alarm) over a stream of (run, seq, counts, resets) and, for W06, stops.

    A row that stops (a loss that is NaN or infinite) has the alarm ``stop``. ``at`` names the event time of a
    stream that comes out of order.
    """
    stops = F.col("stops") if "stops" in log.columns else F.lit(False)
    rows = log.select("run", "seq", "counts", "resets", stops.alias("stops"), *([F.col(at).cast("timestamp").alias("at")] if at else []))

    def values(frames: Iterator[pd.DataFrame]) -> list[tuple]:
        columns = ["seq", "counts", "resets", "stops"]
        return [(int(s), bool(c), bool(r), bool(x), *more) for f in frames for s, c, r, x, *more in zip(*(f[c] for c in columns), *([f["at"]] if at else []))]

    def in_order(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, out = _followed(state.get[0] if state.exists else 0, sorted(values(frames)), warn, fatal)
        state.update((streak,))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["run", "seq", "streak", "alarm"])

    def waiting(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, pending = state.get if state.exists else (0, "[]")
        held = [tuple(x) for x in json.loads(pending)] + [(*x[:4], int(x[4].timestamp() * 1000)) for x in values(frames)]
        passed = state.getCurrentWatermarkMs()
        streak, out = _followed(streak, [x[:4] for x in sorted(held) if x[4] <= passed], warn, fatal)
        rest = [x for x in held if x[4] > passed]
        state.update((streak, json.dumps(rest)))
        if rest:
            state.setTimeoutTimestamp(max(min(x[4] for x in rest), passed + 1))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["run", "seq", "streak", "alarm"])

    if at is None:
        return rows.groupBy("run").applyInPandasWithState(in_order, OUTPUT, "streak bigint", "append", GroupStateTimeout.NoTimeout)
    late = rows.withWatermark("at", lateness).groupBy("run")
    return late.applyInPandasWithState(waiting, OUTPUT, "streak bigint, pending string", "append", GroupStateTimeout.EventTimeTimeout)
