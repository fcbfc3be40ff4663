"""Streams on processing time: state with timeouts, so that keys leave it by themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds between two messages to one user, and days for which a closed position is known.
GAP_SECONDS, CLOSED_DAYS = 180, 7
MESSAGES = ["user_id", "n", "first_id", "last_id", "sent_ms"]


def digests(rows: DataFrame, gap_seconds: float = GAP_SECONDS) -> DataFrame:
    """Messages (user_id, n, first_id, last_id, sent_ms) from ``rows`` (user_id, id): at most one per user and gap.

    What comes sooner waits in the state, and a timeout sends it together when the gap is over.  A user with nothing
    waiting leaves the state with the next timeout."""
    gap = int(gap_seconds * 1000)

    def tell(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        last, waiting = state.get if state.exists else (None, [])
        waiting = sorted({*waiting, *([] if state.hasTimedOut else (int(i) for part in frames for i in part["id"]))})
        if last is not None and now - last < gap:
            state.update((last, waiting))
            state.setTimeoutDuration(max(1, last + gap - now))
        elif waiting:
            state.update((now, []))
            state.setTimeoutDuration(gap)
            yield pd.DataFrame([(key[0], len(waiting), waiting[0], waiting[-1], now)], columns=MESSAGES)
        else:
            state.remove()

    schema = "user_id long, n int, first_id long, last_id long, sent_ms long"
    return rows.groupBy("user_id").applyInPandasWithState(tell, schema, "last long, waiting array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def closes(quotes: DataFrame, days: float = CLOSED_DAYS) -> DataFrame:
    """(position_id, outcome, exit_price, ts): the one close of each position, from quotes as in jobs.closes.

    An open position has no state.  A closed one is known for ``days``, so late quotes don't close it again; then it
    leaves the state."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:  # quotes don't keep it alive
            state.setTimeoutDuration(max(1, state.get[1] - state.getCurrentProcessingTimeMs()))
            return
        for row in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples(index=False):
            way = 1 if row.direction == "long" else -1
            worst, best = (row.low, row.high) if way == 1 else (row.high, row.low)
            for level, side, seen, outcome in ((row.stop_loss, -way, worst, "stop_loss"), (row.take_profit, way, best, "take_profit")):
                if pd.notna(level) and level > 0 and (level - row.entry_price) * side > 0 and (seen - level) * side >= 0:
                    alive = int(days * 86_400_000)
                    state.update((outcome, state.getCurrentProcessingTimeMs() + alive))
                    state.setTimeoutDuration(alive)
                    yield pd.DataFrame([(key[0], outcome, float(level), row.ts)], columns=["position_id", "outcome", "exit_price", "ts"])
                    return

    schema = "position_id long, outcome string, exit_price double, ts timestamp"
    return quotes.groupBy("position_id").applyInPandasWithState(watch, schema, "outcome string, until long", "append", GroupStateTimeout.ProcessingTimeTimeout)
