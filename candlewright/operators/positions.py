"""Live positions: price windows, stop and target evaluation, expiry, throttling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_start(last_bar: Column, regular: Column, now: Column) -> Column:
    """The earlier of the last bar's and the regular start, ignoring what lies in the future."""
    past = lambda x: F.when(x <= now, x)
    return F.least(past(last_bar), past(regular))


def price_window(quotes: DataFrame) -> DataFrame:
    """Adds win_low and win_high: the day's extremes only for positions opened before the session, else
    the last price."""
    whole = F.coalesce(F.col("opened_at") < F.col("session_start"), F.lit(False))
    return quotes.withColumn("win_low", F.when(whole, F.least("price", F.coalesce("day_low", "price"))).otherwise(F.col("price"))).withColumn("win_high", F.when(whole, F.greatest("price", F.coalesce("day_high", "price"))).otherwise(F.col("price")))


def evaluate(positions: DataFrame) -> DataFrame:
    """Adds outcome (stop_loss, take_profit or open), exit_price, pnl and ignored levels.

    A stop wins over a target in the same window.  A level that is not positive or on the wrong side of
    the entry is ignored and listed."""
    long = F.col("direction") == "long"
    entry = F.col("entry_price")
    sided = lambda level, below: F.when((level > 0) & F.when(long, level < entry if below else level > entry).otherwise(level > entry if below else level < entry), level)
    stop, target = sided(F.col("stop_loss"), True), sided(F.col("take_profit"), False)
    hit_stop = F.when(long, F.col("win_low") <= stop).otherwise(F.col("win_high") >= stop)
    hit_target = F.when(long, F.col("win_high") >= target).otherwise(F.col("win_low") <= target)
    out = positions.withColumn("outcome", F.when(hit_stop, "stop_loss").when(hit_target, "take_profit").otherwise("open"))
    out = out.withColumn("exit_price", F.when(F.col("outcome") == "stop_loss", stop).when(F.col("outcome") == "take_profit", target))
    sign = F.when(long, 1).otherwise(-1)
    pnl = (F.coalesce("exit_price", "price") - entry) * sign * F.col("quantity") - F.coalesce("fees", F.lit(0.0))
    ignored = F.array_compact(F.array(F.when(F.col("stop_loss").isNotNull() & stop.isNull(), "stop_loss"), F.when(F.col("take_profit").isNotNull() & target.isNull(), "take_profit")))
    return out.withColumn("pnl", F.round(pnl, 4)).withColumn("ignored", ignored)


def expire(rows: DataFrame, now: Column) -> DataFrame:
    """Active rows past their expiry become expired; a null expiry never does."""
    return rows.withColumn("status", F.when((F.col("status") == "active") & (F.col("expires_at") < now), "expired").otherwise(F.col("status")))


def pending(rows: DataFrame, now: Column, hours: int = 6, limit: int = 50) -> DataFrame:
    """Active unsent rows, newest first: at most ``limit``, of the last ``hours``, not expired."""
    young = F.col("created_at") >= now - F.expr(f"INTERVAL {hours} HOURS")
    return rows.where((F.col("status") == "active") & ~F.coalesce("push_sent", F.lit(False)) & young & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).orderBy(F.desc("created_at"), "id").limit(limit)


def throttle(rows: DataFrame, user: str, at: str, number: str, gap_seconds: int) -> DataFrame:
    """Adds allowed: whether a row goes out at least ``gap_seconds`` after the user's last one that did.

    Each row depends on the one let through before it, so rows run through a task in order of user and
    time, batch by batch; a task holds one batch and one time, however many rows a user has."""
    slim = rows.select(user, at, number)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, last = None, None
        for part in batches:
            allowed = []
            for u, t in zip(part[user].tolist(), part[at].astype("int64").tolist(), strict=True):
                if u != who or last is None or t - last >= gap_seconds * 1_000_000:
                    who, last = u, t
                    allowed.append(True)
                else:
                    allowed.append(False)
            yield part.assign(allowed=allowed)

    ordered = slim.withColumn(at, F.unix_micros(F.col(at).cast("timestamp"))).repartition(user).sortWithinPartitions(user, at, number)
    schema = f"{user} {dict(slim.dtypes)[user]}, {at} long, {number} {dict(slim.dtypes)[number]}, allowed boolean"
    return ordered.mapInPandas(run, schema).withColumn(at, F.timestamp_micros(at).cast(dict(slim.dtypes)[at]))
