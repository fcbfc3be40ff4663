"""Time-series and cross-section features: frames over a series, ranks over a time step."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.prices import finite
from candlewright.operators.indicators import last
from candlewright.sources.bars import SERIES, series


def valid(value: Column, counted: str, n: int, least: int) -> Column:
    """A frame's value where the last n bars hold at least ``least`` values."""
    return F.when(F.count(counted).over(last(n)) >= least, value)


def rolling_mean(column: str, n: int, share: float = 0.6) -> Column:
    return valid(F.avg(column).over(last(n)), column, n, int(np.ceil(n * share)))


def rolling_z(column: str, n: int, least: int | None = None) -> Column:
    """(x - mean) / population deviation of the last n; null where the deviation is 0."""
    dev = F.stddev_pop(column).over(last(n))
    return valid(F.when(dev > 0, (F.col(column) - F.avg(column).over(last(n))) / dev), column, n, least or n)


def with_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Both columns null where either is, for pairwise-complete frames."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.withColumn("_x", F.when(both, F.col(x))).withColumn("_y", F.when(both, F.col(y)))


def rolling_corr_beta(df: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """Adds corr and beta of x on y over the last n complete pairs, from frame moments."""
    df = with_pairs(df, x, y)
    w = last(n)
    full = F.count("_x").over(w) == n
    sx, sy, var = F.stddev_pop("_x").over(w), F.stddev_pop("_y").over(w), F.var_pop("_y").over(w)
    cov = F.covar_pop("_x", "_y").over(w)
    df = df.withColumn("corr", F.when(full & (sx > 0) & (sy > 0), cov / (sx * sy))).withColumn("beta", F.when(full & (var > 0), cov / var))
    return df.drop("_x", "_y")


def cross_rank(df: DataFrame, column: str, step: list[str], least: int = 3, name: str = "xs_rank") -> DataFrame:
    """Average rank inside a time step, scaled to [-0.5, 0.5]; null under ``least`` values."""
    group, ordered = Window.partitionBy(*step), Window.partitionBy(*step).orderBy(F.col(column).asc_nulls_last())
    m = F.count(column).over(group)
    ties = F.count(column).over(Window.partitionBy(*step, column))
    place = (2 * (F.rank().over(ordered) - 1) + ties - 1) / 2
    return df.withColumn(name, F.when(F.col(column).isNotNull() & (m >= least) & (m > 1), place / (m - 1) - 0.5))


def counts_before(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value how many earlier ones are less, and how many are not above, in n log^2 n steps.

    Blocks of twice the length at each level: every value in the later half of a block counts the earlier half's
    values in one sort of all blocks at once."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64).ravel()
    at, width, less, upto = np.arange(n), 1, np.zeros(n, np.int64), np.zeros(n, np.int64)
    while width < n:
        block, later = at // (2 * width), (at // width) & 1
        for out, ties in ((upto, later), (less, 1 - later)):  # of equal ranks the earlier half first, or last
            order = np.argsort((block * (n + 1) + rank) * 2 + ties, kind="stable")
            seen = np.cumsum(1 - later[order])
            seen -= (block[order] * width)  # every block before this one is whole
            out[order] += np.where(later[order] == 1, seen, 0)
        width *= 2
    return less, upto


def expanding_array(x: np.ndarray, least: int, kind: str) -> np.ndarray:
    """percentile_array over all values so far."""
    out, live = np.full(len(x), np.nan), ~np.isnan(x)
    less, upto = counts_before(x[live])
    m = np.arange(len(less))
    if kind == "before":
        share, enough = upto / np.maximum(m, 1), m >= max(least, 1)
    else:
        share, enough = (less + (upto - less + 1) / 2 if kind == "mid" else upto + 1) / (m + 1), m + 1 >= least
    out[live] = np.where(enough, share, np.nan)
    return out


def percentile_array(x: np.ndarray, n: int | None, least: int, kind: str = "mid") -> np.ndarray:
    """Share of a sorted buffer of the last ``n`` values (none: all so far) that lies below each value.

    ``mid`` counts ties as half and the value itself, ``upto`` counts all that are not above, itself
    included, ``before`` likewise among earlier values alone.  Under ``least`` values there is none."""
    if n is None:
        return expanding_array(x, least, kind)
    held: list[float] = []
    out = np.full(len(x), np.nan)
    values = x.tolist()
    keep = n if kind != "before" else n + 1
    for i, v in enumerate(values):
        if i >= keep and values[i - keep] == values[i - keep]:
            held.pop(bisect.bisect_left(held, values[i - keep]))
        if v != v:
            continue
        lo, hi = bisect.bisect_left(held, v), bisect.bisect_right(held, v)
        if kind == "before" and len(held) >= least:
            out[i] = hi / len(held)
        held.insert(hi, v)
        if kind != "before" and len(held) >= least:
            out[i] = (lo + (hi - lo + 1) / 2 if kind == "mid" else hi + 1) / len(held)
    return out


def percentiles(df: DataFrame, columns: dict[str, str], n: int | None, least: int, kind: str = "mid") -> DataFrame:
    """Adds, for each column, its percentile under the given name.

    No frame function ranks inside a frame, so sorted buffers of a frame walk each series, and merges count a growing past, all columns
    in one pass."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        for column, name in columns.items():
            pdf[name] = percentile_array(pdf[column].to_numpy(float), n, least, kind)
        return pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {name} double" for name in columns.values())
    out = df.groupBy(*SERIES).applyInPandas(fill, schema)
    return out.withColumns({name: F.nanvl(name, F.lit(None)) for name in columns.values()})


def rolling_percentile(df: DataFrame, column: str, n: int, least: int, name: str = "pct") -> DataFrame:
    """Mid-rank share of the current value among the last n, itself included."""
    return percentiles(df, {column: name}, n, least)


def with_returns(bars: DataFrame) -> DataFrame:
    """Adds log_ret, the log return of one step."""
    return bars.withColumn("log_ret", F.ln(F.try_divide("close", F.lag("close").over(series()))))


def momentum(bars: DataFrame, steps: tuple[int, ...] = (1, 5, 20, 60)) -> DataFrame:
    """Log price moves over the given numbers of bars."""
    for n in steps:
        bars = bars.withColumn(f"mom_{n}", F.ln("close") - F.ln(F.lag("close", n).over(series())))
    return bars


def signed_index(returns: DataFrame, value: str, legs: dict[str, int], least: int) -> DataFrame:
    """An index of signed legs per timeframe and time step: the mean of the legs' values, each with its sign, where at
    least ``least`` of them have one.  Other symbols have no part in it."""
    sign = F.create_map(*[F.lit(x) for pair in legs.items() for x in pair])[F.col("symbol")]
    r = returns.withColumn("leg", sign * finite(F.col(value)))
    g = r.where("leg IS NOT NULL").groupBy("timeframe", "ts").agg(F.count(F.lit(1)).alias("legs"), F.avg("leg").alias("mean"))
    return g.select("timeframe", "ts", "legs", F.when(F.col("legs") >= least, F.col("mean")).alias("index_r"))


def volume_features(bars: DataFrame) -> DataFrame:
    """Volume z-score, trend, shock, imbalance, money flow, VWAP distance and illiquidity."""
    w = series()
    before = F.lag("close").over(w)
    b = bars.withColumn("ret", F.try_divide("close", before) - 1).withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    b = b.withColumn("up", F.when(F.col("ret") > 0, F.col("volume")).when(F.col("ret").isNotNull(), 0.0)).withColumn("down", F.when(F.col("ret") < 0, F.col("volume")).when(F.col("ret").isNotNull(), 0.0))
    b = b.withColumn("illiq", F.when((F.col("volume") > 0) & (F.col("close") > 0), F.abs("ret") / (F.col("volume") * F.col("close"))))
    b = b.withColumn("flow", F.col("typical") * F.col("volume")).withColumn("d_typical", F.col("typical") - F.lag("typical").over(w))
    b = b.withColumn("flow_in", F.when(F.col("d_typical") > 0, F.col("flow")).otherwise(0.0)).withColumn("flow_out", F.when(F.col("d_typical") < 0, F.col("flow")).otherwise(0.0))
    total = F.sum("up").over(last(20)) + F.sum("down").over(last(20))
    money = F.sum("flow_in").over(last(14)) + F.sum("flow_out").over(last(14))
    prior = series().rowsBetween(-20, -1)
    return (b.withColumn("vol_z20", rolling_z("volume", 20)).withColumn("vol_trend", valid(F.ln(F.try_divide(F.avg("volume").over(last(5)), F.avg("volume").over(last(20)))), "volume", 20, 20))
            .withColumn("vol_shock", F.when((F.count("volume").over(prior) == 20) & (F.max("volume").over(prior) > 0), F.col("volume") / F.max("volume").over(prior)))
            .withColumn("vol_ratio_median", F.ln(F.try_divide("volume", F.expr("percentile(volume, 0.5) OVER (PARTITION BY market, symbol, timeframe ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))))
            .withColumn("imbalance20", F.when((F.count("ret").over(last(20)) == 20) & (total > 0), (F.sum("up").over(last(20)) - F.sum("down").over(last(20))) / total))
            .withColumn("mfi14", F.when((F.count("d_typical").over(last(14)) == 14) & (money > 0), F.sum("flow_in").over(last(14)) / money - 0.5))
            .withColumn("vwap_gap", valid(F.ln(F.try_divide(F.col("close") * F.sum("volume").over(last(20)), F.sum("flow").over(last(20)))), "flow", 20, 12))
            .withColumn("log_amihud", F.when((F.count("illiq").over(last(20)) >= 12) & (F.avg("illiq").over(last(20)) > 0), F.ln(F.avg("illiq").over(last(20))))))


def bar_shape(bars: DataFrame) -> DataFrame:
    """Close location, body share, wick imbalance and signed efficiency of 10 steps."""
    span = F.col("high") - F.col("low")
    b = bars.withColumn("clv", F.when(span > 0, (2 * F.col("close") - F.col("high") - F.col("low")) / span)).withColumn("body", F.when(span > 0, (F.col("close") - F.col("open")) / span))
    b = b.withColumn("wick", F.when(span > 0, ((F.least("open", "close") - F.col("low")) - (F.col("high") - F.greatest("open", "close"))) / span))
    b = b.withColumn("clv5", F.when(F.count("clv").over(last(5)) == 5, F.avg("clv").over(last(5)))).withColumn("step", F.abs(F.col("close") - F.lag("close").over(series())))
    path = F.sum("step").over(last(10))
    return b.withColumn("eff10", F.when((F.count("step").over(last(10)) == 10) & (path > 0), (F.col("close") - F.lag("close", 10).over(series())) / path)).drop("step")


def extremes_age(bars: DataFrame, n: int = 20) -> DataFrame:
    """Bars since the first highest high minus bars since the first lowest low of the last n."""
    top = F.max_by("bar_idx", F.struct("high", -F.col("bar_idx"))).over(last(n))
    bottom = F.min_by("bar_idx", F.struct("low", "bar_idx")).over(last(n))
    return bars.withColumn("extremes_age", F.when(F.count("high").over(last(n)) == n, (F.col("bar_idx") - top) - (F.col("bar_idx") - bottom)))


def calendar(bars: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Local-time features; local days are counted in the exchange's zone."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    b = bars.withColumn("local_day", F.to_date(local)).withColumn("local_hour", F.hour(local)).withColumn("weekday", F.dayofweek(local))
    day = Window.partitionBy(*SERIES, "local_day")
    b = b.withColumn("bar_of_day", F.row_number().over(day.orderBy("ts"))).withColumn("bars_of_day", F.count(F.lit(1)).over(day))
    return b.withColumn("is_open_bar", F.col("bar_of_day") == 1).withColumn("is_late_bar", F.col("bar_of_day") == F.col("bars_of_day")).withColumn("turn_of_month", (F.dayofmonth("local_day") <= 3) | (F.dayofmonth("local_day") >= 28))


def forward_returns(bars: DataFrame, h: int, kind: str = "open_close") -> Column:
    """Log return after a bar: next open to close of h bars on, close to close, or open to open."""
    w = series()
    start, end = {"open_close": (F.lead("open", 1), F.lead("close", h)), "close_close": (F.col("close"), F.lead("close", h)), "open_open": (F.lead("open", 1), F.lead("open", h + 1))}[kind]
    start = start if kind == "close_close" else start.over(w)
    return F.ln(F.try_divide(end.over(w), start))


def breadth(bars: DataFrame) -> DataFrame:
    """Per time step: share of rising names, mean and deviation of returns, equal-weight index."""
    r = with_returns(bars).where("log_ret IS NOT NULL")
    step = r.groupBy("timeframe", "ts").agg(F.avg((F.col("log_ret") > 0).cast("double")).alias("breadth1"), F.avg("log_ret").alias("index_ret"), F.stddev_pop("log_ret").alias("dispersion"), F.count(F.lit(1)).alias("names"))
    return step.withColumn("index_cum", F.sum("index_ret").over(Window.partitionBy("timeframe").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))


def sum_back(column: str, n: int) -> Column:
    return F.sum(column).over(last(n))


def on_index(bars: DataFrame) -> DataFrame:
    """Bars with log_ret, index_ret (equal-weight mean of all names at the time) and index_cum."""
    step = breadth(bars).select("timeframe", "ts", "index_ret", "index_cum")
    return with_returns(bars).join(step, ["timeframe", "ts"], "left")


def against_index(bars: DataFrame, beta: int = 120, corr: int = 60, step: int = 20) -> DataFrame:
    """Adds corr60 (with the index), its change over as many bars, beta120, and idio20: momentum less beta
    times the index's own."""
    b = rolling_corr_beta(on_index(bars), "log_ret", "index_ret", corr).drop("beta").withColumnRenamed("corr", "corr60")
    b = rolling_corr_beta(b, "log_ret", "index_ret", beta).drop("corr").withColumnRenamed("beta", "beta120")
    w = series()
    mom = F.ln("close") - F.ln(F.lag("close", step).over(w))
    moved = F.col("index_cum") - F.lag("index_cum", step).over(w)
    return b.withColumn("corr_change", F.col("corr60") - F.lag("corr60", corr).over(w)).withColumn("idio20", mom - F.col("beta120") * moved)


def cumulative(bars_on_grid: DataFrame) -> DataFrame:
    """On a grid of times: the last known price, and the sum of log returns so far (a missing bar adds
    nothing); null before a series begins."""
    w = series()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    known = F.last("close", ignorenulls=True)
    before = known.over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = bars_on_grid.withColumn("filled", known.over(run)).withColumn("_r", F.when(F.col("close").isNotNull() & before.isNotNull(), F.ln(F.col("close") / before)))
    return b.withColumn("cum", F.when(F.col("filled").isNotNull(), F.coalesce(F.sum("_r").over(run), F.lit(0.0)))).drop("_r")


def group_breadth(bars: DataFrame, least: int = 3) -> DataFrame:
    """Per time step: breadth of 1 and 20 bars around a half, dispersion of 20-bar momentum, mean
    correlation with the index, and the z-scores of the last two over 20 steps."""
    b = against_index(momentum(bars, (20,)))
    share = lambda c: F.when(F.count(c) >= least, F.avg((F.col(c) > 0).cast("double")) - 0.5)
    step = b.groupBy("timeframe", "ts").agg(share("log_ret").alias("breadth1"), share("mom_20").alias("breadth20"), F.when(F.count("mom_20") >= least, F.stddev_pop("mom_20")).alias("disp20"), F.when(F.count("corr60") >= least, F.avg("corr60")).alias("avg_corr"))
    w = Window.partitionBy("timeframe").orderBy("ts").rowsBetween(-19, 0)  # one row per time step
    z = lambda c: F.when((F.count(c).over(w) == 20) & (F.stddev_pop(c).over(w) > 1e-12), (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w))
    return step.withColumn("disp_z", z("disp20")).withColumn("corr_z", z("avg_corr"))


#: Hours (UTC) of the sessions' overlap and of the quiet session.
OVERLAP, QUIET = (13, 16), (0, 7)


def sessions(bars: DataFrame, per_day: int = 24) -> DataFrame:
    """Adds overlap, quiet, monday, friday and day progress to calendar features."""
    hour = F.hour("ts")
    b = bars.withColumn("overlap", (hour >= OVERLAP[0]) & (hour < OVERLAP[1])).withColumn("quiet", (hour >= QUIET[0]) & (hour < QUIET[1]))
    b = b.withColumn("monday", F.col("weekday") == 2).withColumn("friday", F.col("weekday") == 6)
    return b.withColumn("progress", F.least(F.lit(1.0), (F.col("bar_of_day") - 1) / (per_day - 1)))


def range_features(bars_with_atr: DataFrame) -> DataFrame:
    """Adds range_z20, squeeze (log ATR of 5 over 20 bars), bb_width, gap_atr, vwap_atr and out_of_range."""
    w = series()
    before = F.lag("close").over(w)
    b = bars_with_atr.withColumn("span_pct", F.try_divide(F.col("high") - F.col("low"), "close")).withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    b = b.withColumn("flow", F.col("typical") * F.col("volume")).withColumn("range_z20", rolling_z("span_pct", 20, 15))
    atr5, atr20 = valid(F.avg("true_range").over(last(5)), "true_range", 5, 4), valid(F.avg("true_range").over(last(20)), "true_range", 20, 15)
    b = b.withColumn("squeeze", F.when((atr5 > 0) & (atr20 > 0), F.ln(atr5 / atr20)))
    b = b.withColumn("bb_width", valid(F.try_divide(4 * F.stddev_pop("close").over(last(20)), F.avg("close").over(last(20))), "close", 20, 20))
    b = b.withColumn("gap_atr", F.when(F.col("atr") > 0, (F.col("open") - before) / F.col("atr")))
    b = b.withColumn("vwap_atr", F.when((F.col("atr") > 0) & (F.count("flow").over(last(20)) >= 12), (F.col("close") - F.try_divide(sum_back("flow", 20), sum_back("volume", 20))) / F.col("atr")))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return b.withColumn("out_of_range", F.greatest((top - F.col("high")) / F.col("close"), (F.col("low") - bottom) / F.col("close"), F.lit(0.0))).drop("typical", "flow", "span_pct")


def gap_features(bars_with_atr: DataFrame) -> DataFrame:
    """Gap and the reversal of the previous bar, both in units of the previous bar's ATR share."""
    w = series()
    pc, ppc = F.lag("close").over(w), F.lag("close", 2).over(w)
    share = F.lag("atr").over(w) / pc
    base = F.coalesce((pc - ppc) / ppc, (pc - F.lag("open").over(w)) / F.lag("open").over(w))
    return bars_with_atr.withColumn("gap_z", F.when(share > 0, (F.col("open") - pc) / pc / share)).withColumn("rev_prev", F.when(share > 0, -base / share))


def turnover_features(bars: DataFrame) -> DataFrame:
    """z-score of log turnover over 20 bars, and the volume's z-score with the bar's sign."""
    b = bars.withColumn("log_turnover", F.when((F.col("volume") > 0) & (F.col("close") > 0), F.ln(F.col("volume") * F.col("close")))).withColumn("turnover_z20", rolling_z("log_turnover", 20))
    return b.withColumn("signed_vol_z20", rolling_z("volume", 20) * F.signum(F.col("close") - F.col("open"))).drop("log_turnover")
