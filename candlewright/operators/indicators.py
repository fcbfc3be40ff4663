"""Indicators as window expressions; the recursive ones are block scans.

Every window row is the value on the prefix that ends there, so nothing looks ahead.  Warm-up
values are null.  Sliding frames are at most 250 rows, whatever the length of a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.prices import exact_round
from candlewright.operators import scans
from candlewright.sources.bars import SERIES, series


def full(value: Column, counted: str | Column, frame, n: int) -> Column:
    """A frame's value where the frame holds n values, else null."""
    return F.when(F.count(counted).over(frame) == n, value)


def last(n: int):
    return series().rowsBetween(-(n - 1), 0)


def sma(column: str | Column, n: int) -> Column:
    return full(F.avg(column).over(last(n)), column, last(n), n)


def bollinger(column: str | Column = "close", n: int = 20, width: float = 2.0) -> tuple[Column, Column, Column]:
    """Lower, middle and upper band; population deviation."""
    mid, dev = sma(column, n), F.stddev_pop(column).over(last(n))
    return mid - width * dev, mid, mid + width * dev


def true_range() -> Column:
    before = F.lag("close").over(series())
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def with_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds atr, the plain mean of the last n true ranges (fewer at the start)."""
    return bars.withColumn("true_range", true_range()).withColumn("atr", F.avg("true_range").over(last(n)))


def with_swings(bars: DataFrame, reach: int = 5) -> DataFrame:
    """Adds swing_high and swing_low: strict extremes over ``reach`` bars on each side.

    The flag stands on the extreme's own bar and is known ``reach`` bars later."""
    before, after = series().rowsBetween(-reach, -1), series().rowsBetween(1, reach)
    whole = (F.count("high").over(before) == reach) & (F.count("high").over(after) == reach)
    high = whole & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after))
    low = whole & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after))
    return bars.withColumns({"swing_high": high, "swing_low": low})


def patterns() -> dict[str, Column]:
    """Candle patterns of a bar and the one before it."""
    w = series()
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    po, pc = F.lag("open").over(w), F.lag("close").over(w)
    body, span = F.abs(c - o), h - lo
    upper, lower = h - F.greatest(o, c), F.least(o, c) - lo
    return {
        "bullish_engulfing": F.coalesce((pc < po) & (c > o) & (c > po) & (o < pc), F.lit(False)),
        "bearish_engulfing": F.coalesce((pc > po) & (c < o) & (c < po) & (o > pc), F.lit(False)),
        "hammer": (lower > 2 * body) & (upper < 0.5 * body),
        "shooting_star": (upper > 2 * body) & (lower < 0.5 * body),
        "doji": (span > 0) & (body < 0.1 * span),
    }


def trend(close: Column, fast: Column, mid: Column, slow: Column) -> Column:
    """Alignment of close and averages; two averages where the slow one is not there yet."""
    up, down = (close > fast) & (fast > mid), (close < fast) & (fast < mid)
    agreed_up, agreed_down = slow.isNull() | (mid > slow), slow.isNull() | (mid < slow)
    return F.when(up & agreed_up, "uptrend").when(down & agreed_down, "downtrend").otherwise("sideways")


def efficiency_ratio(n: int = 20) -> tuple[Column, Column]:
    """(signed move, path length) of the last n steps; their quotient is the efficiency ratio."""
    move = F.col("close") - F.lag("close", n).over(series())
    return move, full(F.sum("step").over(last(n)), "step", last(n), n)


RECURSIVE = ["ema12", "ema20", "ema26", "macd", "macd_signal", "macd_hist", "rsi14"]
#: Rows of a block, for which a bar without a close leaves the recursive indicators null: then it has no weight any more.
SILENT = scans.block_rows(13 / 14, *(1 - 2 / (n + 1) for n in (12, 20, 26, 9)))


def mean_terms(value: Column, n: int, share: float, first: int, so_far) -> Column:
    """Terms of a recursion that begins ``first`` + n rows into its series with the plain mean of n values."""
    at = F.col("bar_idx")
    begin = F.avg(F.when(at.between(first, first + n - 1), value)).over(so_far)
    return F.when(at == first + n - 1, begin).when(at >= first + n, value * share)


def with_recursive(bars: DataFrame, chunk: int = scans.CHUNK) -> DataFrame:
    """Adds the recursive indicators: exponential means, MACD and its signal line, relative strength with Wilder's
    smoothing (100 where there was no loss).  See scans: chunks of one series are dealt to several tasks.

    A bar without a close makes them null for the ``SILENT`` bars from there."""
    w, at, close = scans.chunk_window(), F.col("bar_idx"), F.col("close")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = scans.in_chunks(bars, SILENT, chunk=chunk).withColumn("_step", close - F.lag("close").over(w))
    missing = F.last(F.when(close.isNull() | F.isnan(close), at), ignorenulls=True).over(so_far)
    gain, loss = F.greatest("_step", F.lit(0.0)), F.greatest(-F.col("_step"), F.lit(0.0))
    terms = {f"_t{n}": mean_terms(close, n, 2 / (n + 1), 0, so_far) for n in (12, 20, 26)} | {"_tg": mean_terms(gain, 14, 1 / 14, 1, so_far), "_tl": mean_terms(loss, 14, 1 / 14, 1, so_far)}
    df = df.withColumns(terms | {"_silent": F.coalesce(at - missing < SILENT, F.lit(False))})
    df = scans.scan(df, {f"ema{n}": (1 - 2 / (n + 1), f"_t{n}") for n in (12, 20, 26)} | {"_g": (13 / 14, "_tg"), "_l": (13 / 14, "_tl")}, SILENT)
    df = df.withColumn("macd", F.col("ema12") - F.col("ema26"))
    df = scans.scan(df.withColumn("_ts", mean_terms(F.col("macd"), 9, 2 / 10, 25, so_far)), {"macd_signal": (1 - 2 / 10, "_ts")}, SILENT)
    found = {"macd_hist": F.col("macd") - F.col("macd_signal"), "rsi14": F.when(F.col("_l") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide("_g", "_l")))}
    sound = [F.when(~F.col("_silent"), F.nanvl(found.get(c, F.col(c)), F.lit(None))).alias(c) for c in RECURSIVE]
    return scans.own_rows(df, chunk=chunk).select(*bars.columns, *sound)


def with_volatility(bars: DataFrame, decay: float = 0.94, chunk: int = scans.CHUNK) -> DataFrame:
    """Adds ewma_vol, the exponentially weighted volatility of log returns.  It begins with the first return;
    where a return is missing it is null and begins anew."""
    block, w = scans.block_rows(decay), scans.chunk_window()
    df = scans.in_chunks(bars, block, chunk=chunk).withColumn("_r", F.nanvl(F.ln("close") - F.ln(F.lag("close").over(w)), F.lit(None)))
    df = df.withColumn("_run", F.sum(F.col("_r").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_t", F.when(F.lag("_r").over(w).isNull(), F.col("_r") * F.col("_r")).otherwise(F.col("_r") * F.col("_r") * (1 - decay)))
    df = scans.scan(df, {"_v": (decay, "_t")}, block, [*SERIES, "_run"])
    return scans.own_rows(df, chunk=chunk).select(*bars.columns, F.when(F.col("_r").isNotNull(), F.sqrt("_v")).alias("ewma_vol"))


def with_levels(bars: DataFrame, reach: int = 5, kept: int = 3) -> DataFrame:
    """Adds supports (descending) and resistances (ascending): at each bar the last ``kept`` distinct levels, by first
    appearance, of swings that are ``reach`` bars old.

    A row with a new level knows the one before it, that one the one before, and so on, so the latest few are as many
    running values and no set of all levels is held."""
    w, kinds = series(), ("low", "high")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    df = with_swings(bars, reach).withColumns({f"_{k}": F.when(F.col(f"swing_{k}"), exact_round(F.col(k), 4, even=True)) for k in kinds})
    df = df.withColumns({f"_{k}": F.lag(f"_{k}", reach).over(w) for k in kinds})
    df = df.withColumns({f"_{k}": F.when(F.row_number().over(Window.partitionBy(*SERIES, f"_{k}").orderBy("ts")) == 1, F.col(f"_{k}")) for k in kinds})
    for n in range(kept):
        latest = lambda k, frame: F.last(f"_{k}", ignorenulls=True).over(frame)
        df = df.withColumns({f"_{k}{n}": latest(k, upto) for k in kinds} | {f"_{k}": F.when(F.col(f"_{k}").isNotNull(), latest(k, before)) for k in kinds})
    found = {k: F.sort_array(F.array_compact(F.array(*[f"_{k}{n}" for n in range(kept)])), k == "high") for k in kinds}
    return df.select(*bars.columns, found["low"].alias("supports"), found["high"].alias("resistances"))
