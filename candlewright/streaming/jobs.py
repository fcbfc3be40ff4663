"""Streams: bars from ticks, deduplication with status, throttling, an outbox with idempotent batches.

State is per key and bounded: one row of state for a key, dropped by an event-time timeout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Hours in which a repeat of an active signal is suppressed.
DEDUPE_HOURS = {"1D": 20, "1H": 4}


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of closed windows; a window closes when the watermark passes it, so no partial bar leaves.

    ``ticks``: symbol, ts (timestamp), price, size, seq."""
    g = ticks.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "symbol")
    order = F.struct("ts", "seq")
    bars = g.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def digests(rows: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Count and top value of each user's tumbling window."""
    g = rows.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id")
    return g.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select(F.col("w.start").alias("start"), "user_id", "n", "top")


def first_active(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first active signal of a key; repeats inside its window are suppressed and don't extend it.

    ``rows``: user_id, symbol, action, timeframe, status, ts."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        hold = DEDUPE_HOURS.get(key[3], 20) * 3_600_000
        out = []
        for row in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples(index=False):
            at = int(row.ts.timestamp() * 1000)
            if row.status == "active" and (last is None or at - last >= hold):
                last = at
                out.append(row)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + hold, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "symbol", "action", "timeframe", "status", "ts"])

    schema = "user_id long, symbol string, action string, timeframe string, status string, ts timestamp"
    grouped = rows.withWatermark("ts", late).groupBy("user_id", "symbol", "action", "timeframe")
    return grouped.applyInPandasWithState(keep, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def throttled(rows: DataFrame, gap_seconds: int = 180, late: str = "1 hour") -> DataFrame:
    """Rows at least ``gap_seconds`` after the last one let through for the same user."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values(["ts", "id"], kind="stable").itertuples(index=False):
            at = int(row.ts.timestamp() * 1000)
            if last is None or at - last >= gap_seconds * 1000:
                last = at
                out.append(row)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "id", "ts"])

    grouped = rows.select("user_id", "id", "ts").withWatermark("ts", late).groupBy("user_id")
    return grouped.applyInPandasWithState(keep, "user_id long, id long, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def outbox(deliver: Callable[[DataFrame], None], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: delivers a batch once and marks its number after the delivery, so a batch
    that is tried again after its mark is not sent twice."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number}")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return
        deliver(batch)
        spark.range(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def closes(quotes: DataFrame, late: str = "1 hour") -> DataFrame:
    """The one close of each position: a stop before a target inside a quote, nothing after the first.

    ``quotes``: position_id, direction, entry_price, stop_loss, take_profit, low, high, ts."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:  # closed before: the state is the mark
            return
        for row in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples(index=False):
            sign = 1 if row.direction == "long" else -1
            worst, best = (row.low, row.high) if sign == 1 else (row.high, row.low)
            sided = lambda level, way: level is not None and level == level and level > 0 and (level - row.entry_price) * way > 0  # noqa: E731, B023
            for level, way, outcome, reached in ((row.stop_loss, -sign, "stop_loss", worst), (row.take_profit, sign, "take_profit", best)):
                if sided(level, way) and (reached - level) * way >= 0:
                    state.update((outcome,))
                    yield pd.DataFrame([(key[0], outcome, level, row.ts)], columns=["position_id", "outcome", "exit_price", "ts"])
                    return

    schema = "position_id long, outcome string, exit_price double, ts timestamp"
    return quotes.withWatermark("ts", late).groupBy("position_id").applyInPandasWithState(watch, schema, "outcome string", "append", GroupStateTimeout.NoTimeout)


def resolver(signals: DataFrame, bars_path: str, outcomes_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that resolves recorded signals as bars arrive.

    A batch is stored under its number, so one that is tried again replaces itself.  Signals that have an
    outcome in another batch are left out; those without one stay open."""
    from candlewright.operators.simulation import resolve_outcomes

    def stored(spark, path: str, number: int) -> DataFrame | None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        return spark.read.parquet(path).where(F.col("batch") != number)

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{bars_path}/batch={number}")
        done = stored(spark, outcomes_path, number)
        still = signals if done is None else signals.join(done.select("signal_id"), "signal_id", "left_anti")
        out = resolve_outcomes(still, spark.read.parquet(bars_path).drop("batch")).where("outcome IS NOT NULL")
        out.write.mode("overwrite").parquet(f"{outcomes_path}/batch={number}")

    return sink
