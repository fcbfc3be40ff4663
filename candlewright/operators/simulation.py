"""Deal simulation: exits of all candidates in parallel, then the choice of deals that don't overlap.

The bars that a deal can see are a frame of a bounded number of rows after its signal, in the exchange
that the indicators already need; nothing is joined or shuffled again.  Only the choice of
non-overlapping deals is sequential.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions import prices
from candlewright.functions.prices import cost_bps, finite
from candlewright.sources.bars import SERIES, series


def hold_window(candidates: DataFrame, bars: DataFrame, hold: int | Column) -> DataFrame:
    """Each candidate (columns SERIES, bar_idx, ...) with the bars bar_idx+1 .. bar_idx+hold as b_*; k
    counts them from 0.  Bars beyond the series' end are missing."""
    hold = F.lit(hold) if isinstance(hold, int) else hold
    spread = candidates.withColumn("k", F.explode(F.sequence(F.lit(0), hold - 1))).withColumn("b_idx", F.col("bar_idx") + 1 + F.col("k"))
    path = bars.select(*SERIES, F.col("bar_idx").alias("b_idx"), *[F.col(c).alias(f"b_{c}") for c in ("ts", "open", "high", "low", "close")])
    return spread.join(path, [*SERIES, "b_idx"])


def with_ahead(bars: DataFrame, hold: int) -> DataFrame:
    """Adds ahead, the next ``hold`` bars of the series (fewer at its end)."""
    bar = F.struct("bar_idx", "ts", "open", "high", "low", "close")
    return bars.withColumn("ahead", F.collect_list(bar).over(series().rowsBetween(1, hold)))


def exits(candidates: DataFrame, hold: int | Column, fees_r: float = 0.0) -> DataFrame:
    """Exit of each candidate (with ``ahead``), entered at the next bar's open.

    Per usable bar: gap through the stop, gap through the target, stop, target; a bar that touches both
    is a stop.  Without any, the last usable close.  ``status`` is ``deal``, or ``skipped`` where the entry
    bar is unusable; candidates on a series' last bar are left out."""
    long = F.col("action") == "BUY"
    stop, target = F.col("stop_loss"), F.col("take_profit")

    def hit(bar: Column) -> Column:
        past = lambda x, level, towards: F.when(long, (x - level) * towards >= 0).otherwise((level - x) * towards >= 0)
        worst, best = F.when(long, bar["low"]).otherwise(bar["high"]), F.when(long, bar["high"]).otherwise(bar["low"])
        end = lambda reason, price: F.struct(bar["bar_idx"].alias("exit_idx"), bar["ts"].alias("exit_ts"), F.lit(reason).alias("reason"), price.alias("exit"))
        return (F.when(past(bar["open"], stop, -1), end("gap_stop", bar["open"])).when(past(bar["open"], target, 1), end("gap_target", bar["open"]))
                .when(past(worst, stop, -1), end("stop_loss", stop)).when(past(best, target, 1), end("take_profit", target)))

    def sound(bar: Column) -> Column:
        prices = [F.coalesce(finite(bar[c]) > 0, F.lit(False)) for c in ("open", "high", "low", "close")]
        return prices[0] & prices[1] & prices[2] & prices[3] & F.coalesce(bar["low"] <= bar["high"], F.lit(False))

    df = candidates.where(F.size("ahead") > 0).withColumn("path", F.filter(F.slice("ahead", 1, hold), sound))
    df = df.withColumn("hits", F.filter(F.transform("path", hit), lambda x: x.isNotNull()))
    bar = F.get("path", F.size("path") - 1)
    last = F.struct(bar["bar_idx"].alias("exit_idx"), bar["ts"].alias("exit_ts"), F.lit("time_exit").alias("reason"), bar["close"].alias("exit"))
    first = F.get("ahead", F.lit(0))
    begins = F.coalesce(F.get("path", F.lit(0))["bar_idx"] == first["bar_idx"], F.lit(False))
    df = df.withColumn("status", F.when(begins, "deal").otherwise("skipped")).withColumn("done", F.when(begins, F.coalesce(F.get("hits", F.lit(0)), last)))
    df = df.withColumn("entry", F.when(begins, first["open"])).withColumn("entry_ts", F.when(begins, first["ts"])).select("*", "done.*").drop("ahead", "path", "hits", "done")
    sign = F.when(long, 1).otherwise(-1)
    planned, realized = F.abs(F.col("entry_price") - stop), F.abs(F.col("entry") - stop)
    gain = (F.col("exit") - F.col("entry")) * sign
    return (df.withColumn("planned_risk", planned).withColumn("realized_risk", realized).withColumn("r_planned", F.when(planned > 0, gain / planned - fees_r))
            .withColumn("r_realized", F.when(realized > 0, gain / realized - fees_r)).withColumn("hold_bars", F.col("exit_idx") - F.col("bar_idx") - 1))


def pick(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Indices of deals in order of time, each begun at or after the exit bar of the one before."""
    chosen, free = [], -1
    for i, (begin, end) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        if begin >= free:
            chosen.append(i)
            free = end
    return np.array(chosen, int)


def without_overlap(deals: DataFrame, by: list[str] = SERIES) -> DataFrame:
    """Keeps the walk-forward's deals: after an exit, the next signal may fire on the exit bar.  Rows
    without an exit_idx are kept where the walk meets them, and don't hold it up."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx", kind="stable")
        return pdf.iloc[pick(pdf["bar_idx"].to_numpy(), pdf["exit_idx"].fillna(-1).to_numpy())]

    return deals.groupBy(*by).applyInPandas(choose, deals.schema)


def walk_forward(scored: DataFrame, hold: int = 10, min_history: int = 60, risk_model: str = "planned", fees_r: float = 0.0, entries: tuple | None = None, splits: dict[str, tuple] | None = None) -> DataFrame:
    """Deals of the rule engine, one at a time per series, and the signals it had to skip (status).

    ``r`` is the result in units of the chosen risk, after ``fees_r``; ``entries`` limits the time of the
    signal to [from, until), while exits may lie beyond.  ``splits`` names disjoint windows of the time of
    entry: each is a walk of its own from the same exits, and its name the deal's ``split``."""
    candidates = with_ahead(scored, hold).where(F.col("has_signal") & F.col("action").isin("BUY", "SELL") & (F.col("bar_idx") >= max(50, min_history)))
    if entries:
        candidates = candidates.where((F.col("ts") >= F.lit(entries[0]).cast("timestamp_ntz")) & (F.col("ts") < F.lit(entries[1]).cast("timestamp_ntz")))
    by = SERIES
    if splits:
        at, time = F.get("ahead", F.lit(0))["ts"], lambda t: F.lit(t).cast("timestamp_ntz")
        candidates = candidates.withColumn("split", F.coalesce(*[F.when((at >= time(lo)) & (at < time(hi)), F.lit(name)) for name, (lo, hi) in splits.items()])).where("split IS NOT NULL")
        by = [*SERIES, "split"]
    candidates = candidates.select(*by, "bar_idx", "ts", "action", "strength", "confidence", "entry_price", "stop_loss", "take_profit", "ahead")
    out = exits(candidates, hold, fees_r).withColumn("r", F.col("r_realized" if risk_model == "realized" else "r_planned"))
    none = F.col("r").isNull()
    out = out.withColumn("status", F.when(none, "skipped").otherwise(F.col("status"))).withColumn("exit_idx", F.when(~none, F.col("exit_idx")))
    return without_overlap(out, by)


def with_costs(deals: DataFrame, by_symbol: dict[str, float] | None = None, multiplier: float | Column = 1.0, risk_model: str = "planned") -> DataFrame:
    """Deals of the walk-forward with their costs and what a gap before the entry did to them.

    A deal pays the basis points of its symbol (``by_symbol``), else of its market, on its own entry price; one
    with neither is an error, as a fee of zero would pass unseen.  Costs in units of risk differ with the
    stop's distance: ``cost_r`` is multiplied by the scenario, ``cost_r_base`` never is, so that what can be
    traded does not change with the scenario.  ``risk_keep`` is the share of the planned risk that the open of
    the entry bar left; ``rr_planned`` is the signal's own, before any gap."""
    bps = prices.cost_bps(F.col("market"))
    if by_symbol:
        bps = F.coalesce(F.create_map(*[F.lit(x) for pair in by_symbol.items() for x in pair])[F.col("symbol")], bps)
    bps = F.coalesce(bps, F.raise_error(F.concat(F.lit("no fee for "), F.col("market"), F.lit("/"), F.col("symbol"))).cast("double"))
    risk, planned = F.col("realized_risk" if risk_model == "realized" else "planned_risk"), F.col("planned_risk")
    deals = deals.withColumn("cost_money_base", bps / 10000 * F.col("entry")).withColumn("cost_money", F.col("cost_money_base") * multiplier)
    gain = (F.col("exit") - F.col("entry")) * F.when(F.col("action") == "BUY", 1).otherwise(-1)
    return deals.withColumns({
        "r_gross": gain / risk, "cost_r": F.col("cost_money") / risk, "cost_r_base": F.col("cost_money_base") / risk, "r_net": (gain - F.col("cost_money")) / risk,
        "rr_planned": prices.risk_reward(F.col("entry_price"), F.col("stop_loss"), F.col("take_profit")), "stop_share": risk / F.col("entry"),
        "planned_stop_share": planned / F.col("entry_price"), "realized_stop_share": F.col("realized_risk") / F.col("entry"),
        "risk_keep": F.when(planned > 0, F.col("realized_risk") / planned), "year": F.year("entry_ts")})


#: Regime gates by name, and the combinations that are compared.
REGIME_VARIANTS = {"BASE": (), "T1": ("T1",), "T2": ("T2",), "M1": ("M1",), "M2": ("M2",), "V1": ("V1",), "V2": ("V2",), "T1+V2": ("T1", "V2"), "T2+M1": ("T2", "M1"), "T2+V2": ("T2", "V2"), "T2+M1+V2": ("T2", "M1", "V2")}


def regime_gates(rank: str = "atr_rank") -> dict[str, Column]:
    """Gates on a scored bar: trend not sideways (T1) or with the action (T2); price on the action's side
    of the long mean, which must exist (M1) or may be missing (M2); ATR share not in the top 20 % (V1) or
    33 % (V2) of its own past."""
    buy, up = F.col("action") == "BUY", F.col("close") > F.col("sma200")
    sided = F.when(buy, up).otherwise(F.col("close") < F.col("sma200"))
    quiet = lambda share: F.coalesce(F.col(rank) <= share, F.lit(True))
    return {"T1": F.col("trend") != "sideways", "T2": F.col("trend") == F.when(buy, "uptrend").otherwise("downtrend"), "M1": F.coalesce(sided, F.lit(False)), "M2": F.coalesce(sided, F.lit(True)), "V1": quiet(0.80), "V2": quiet(0.67)}


def regime_walk(scored: DataFrame, hold: int = 10, min_history: int = 60) -> DataFrame:
    """The walk-forward of every regime variant from one set of signals: exits are simulated once, each
    candidate goes to the variants whose gates it passes, and each variant chooses its own deals."""
    candidates = with_ahead(scored, hold).where(F.col("has_signal") & F.col("action").isin("BUY", "SELL") & (F.col("bar_idx") >= max(50, min_history)))
    gates = regime_gates()
    passed = [F.when(F.coalesce(*[F.when(~gates[g], F.lit(False)) for g in names], F.lit(True)), F.lit(variant)) for variant, names in REGIME_VARIANTS.items()]
    candidates = candidates.withColumn("variants", F.array_compact(F.array(*passed)))
    deals = exits(candidates.select(*SERIES, "bar_idx", "ts", "action", "entry_price", "stop_loss", "take_profit", "variants", "ahead"), hold).where("status = 'deal' AND r_planned IS NOT NULL")
    return without_overlap(deals.select(*SERIES, "bar_idx", "action", "exit_idx", F.col("r_planned").alias("r"), F.explode("variants").alias("variant")), [*SERIES, "variant"])


def directed(bars_with_atr: DataFrame, direction: Column, hold: int, stop_atr: float = 1.5, target_atr: float = 3.0) -> DataFrame:
    """Deals that enter at the signal bar's close in the given direction (1, -1; null for none), one at a
    time per series: the next one begins after the bar of the last exit.  ``gross`` is the share gained."""
    b = with_ahead(bars_with_atr, hold).withColumn("sign", direction).where("sign IS NOT NULL AND atr > 0 AND close > 0")
    b = b.withColumn("action", F.when(F.col("sign") > 0, "BUY").otherwise("SELL")).withColumn("entry_price", F.col("close"))
    b = b.withColumn("stop_loss", F.col("close") - F.col("sign") * stop_atr * F.col("atr")).withColumn("take_profit", F.col("close") + F.col("sign") * target_atr * F.col("atr")).where("stop_loss > 0 AND take_profit > 0")
    d = exits(b, hold).where("status = 'deal'").select(*SERIES, "bar_idx", "sign", "entry_price", "exit", "reason", F.col("exit_idx").alias("last_idx"))
    d = d.withColumn("gross", (F.col("exit") - F.col("entry_price")) / F.col("entry_price") * F.col("sign")).withColumn("exit_idx", F.col("last_idx") + 1)
    return without_overlap(d).drop("exit_idx").withColumnRenamed("last_idx", "exit_idx")


def replayed(stored: DataFrame, bars: DataFrame) -> DataFrame:
    """Stored deals simulated again from what was stored: time of entry, action, stop, target and bars held.

    Adds again_exit and again_reason (null where no bar has the time of entry).  Nothing of the engine is run: the bars from the entry on are
    met by an equal join on their numbers, and the first that ends the deal counts; without any, the last bar's close."""
    deal = [*SERIES, "entry_ts", "action"]
    at = bars.select(*SERIES, F.col("ts").alias("entry_ts"), (F.col("bar_idx") - 1).alias("bar_idx"))
    path = hold_window(stored.select(*deal, "stop_loss", "take_profit", "hold_bars").join(at, [*SERIES, "entry_ts"]), bars, F.col("hold_bars") + 1)
    side = F.when(F.col("action") == "BUY", 1).otherwise(-1)
    worst, best = F.when(side == 1, F.col("b_low")).otherwise(F.col("b_high")), F.when(side == 1, F.col("b_high")).otherwise(F.col("b_low"))
    ended = lambda reason, price: F.struct(price.alias("price"), F.lit(reason).alias("reason"))
    stop, target = F.col("stop_loss"), F.col("take_profit")
    hit = (F.when((F.col("b_open") - stop) * side <= 0, ended("gap_stop", F.col("b_open"))).when((F.col("b_open") - target) * side >= 0, ended("gap_target", F.col("b_open")))
           .when((worst - stop) * side <= 0, ended("stop_loss", stop)).when((best - target) * side >= 0, ended("take_profit", target)))
    done = path.withColumn("hit", hit).groupBy(*deal).agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("k"))).alias("hit"), F.max_by("b_close", "k").alias("close"))
    found = F.coalesce("hit", F.struct(F.col("close").alias("price"), F.lit("time_exit").alias("reason")))
    return stored.join(done.withColumn("again", found).select(*deal, F.col("again.price").alias("again_exit"), F.col("again.reason").alias("again_reason")), deal, "left")


def replay_faults(again: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: deals checked, deals without a bar, deals with another exit or reason, and the greatest difference of exits."""
    known, off = F.col("again_reason").isNotNull(), F.abs(F.col("again_exit") - F.col("exit"))
    return again.agg(F.count_if(known).alias("checked"), F.count_if(~known).alias("missing"), F.count_if(off > tolerance).alias("exit_off"), F.count_if(F.col("again_reason") != F.col("reason")).alias("reason_off"), F.max(off).alias("max_exit_error"))


def compared(deals: DataFrame, stored: DataFrame, keys: list[str], value: str = "r") -> DataFrame:
    """One row: deals that both have, that only one has, and the greatest difference of the value."""
    both = deals.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ours")).join(stored.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_theirs")), keys, "full_outer")
    return both.agg(F.count_if(F.col("_ours") & F.col("_theirs")).alias("both"), F.count_if(F.col("_theirs").isNull()).alias("only_new"), F.count_if(F.col("_ours").isNull()).alias("only_stored"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_diff"))


def deal_stats(deals: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Count, wins, losses, rates, drawdown and longest losing streak of deals in order of time."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    t = deals.withColumn("equity", F.sum("r").over(run)).withColumn("island", F.sum((F.col("r") >= 0).cast("int")).over(run))
    t = t.withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(run)))
    t = t.withColumn("streak", F.sum((F.col("r") < 0).cast("int")).over(Window.partitionBy(*by, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    win, loss = F.sum(F.when(F.col("r") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("r") < 0, -F.col("r")).otherwise(0.0))
    return t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") > 0).alias("wins"), F.count_if(F.col("r") < 0).alias("losses"), F.avg("r").alias("avg_r"),
                              win.alias("gross_win"), loss.alias("gross_loss"), F.when(loss > 0, win / loss).alias("profit_factor"),
                              F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"), F.max("streak").alias("max_losses_in_row"))


def horizon_extremes(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Highest high and lowest low of the next h bars, for each h; null where the series ends sooner."""
    for h in horizons:
        ahead = series().rowsBetween(1, h)
        whole = F.count("high").over(ahead) == h
        bars = bars.withColumn(f"max_{h}", F.when(whole, F.max("high").over(ahead))).withColumn(f"min_{h}", F.when(whole, F.min("low").over(ahead)))
    return bars


def fixed_geometry(bars_with_atr: DataFrame, stop_atr: float = 1.5, target_atr: float = 3.0) -> DataFrame:
    """Both directions at every bar with ATR distances; rows on the wrong side of zero are left out."""
    both = F.explode(F.array(F.lit("BUY"), F.lit("SELL")))
    sign = F.when(F.col("action") == "BUY", 1).otherwise(-1)
    df = bars_with_atr.where("atr > 0 AND close > 0").withColumn("action", both).withColumn("entry_price", F.col("close"))
    df = df.withColumn("stop_loss", F.col("close") - sign * stop_atr * F.col("atr")).withColumn("take_profit", F.col("close") + sign * target_atr * F.col("atr"))
    return df.where("stop_loss > 0 AND take_profit > 0")


#: Bars after which an undecided signal times out.
HOLD_CAPS = {"1H": 24, "1D": 20}


def resolve_outcomes(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Outcome of recorded signals by the bars that open after them.

    Stop before target inside a bar; a bar at or after expiry closes at its close; the hold cap
    closes when it is full; else the outcome is null and the signal stays open."""
    long = F.col("action") == "BUY"
    entry, stop, target = F.col("entry_price"), F.col("stop_loss"), F.col("take_profit")
    risk = F.abs(entry - stop)
    sided = F.when(long, (stop < entry) & (target > entry)).otherwise((stop > entry) & (target < entry))
    bad = F.when(~F.col("action").isin("BUY", "SELL"), "direction").when(entry.isNull() | stop.isNull() | target.isNull(), "not_a_number").when(~(risk > 0) | (risk / F.abs(entry) < 1e-6), "no_risk").when(~sided, "wrong_side")
    df = signals.withColumn("note", bad)
    cap = F.coalesce(F.create_map(*[F.lit(x) for pair in HOLD_CAPS.items() for x in pair])[F.col("timeframe")], F.lit(20))
    path = hold_window(df.where("note IS NULL").withColumn("cap", cap), bars, F.col("cap"))
    favour = F.when(long, F.col("b_high") - entry).otherwise(entry - F.col("b_low")) / risk
    adverse = F.when(long, F.col("b_low") - entry).otherwise(entry - F.col("b_high")) / risk
    w = Window.partitionBy(*SERIES, "signal_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumn("mfe", F.max(favour).over(w)).withColumn("mae", F.min(adverse).over(w))
    hit_stop = F.when(long, F.col("b_low") <= stop).otherwise(F.col("b_high") >= stop)
    hit_target = F.when(long, F.col("b_high") >= target).otherwise(F.col("b_low") <= target)
    expired = F.coalesce(F.col("b_ts") >= F.col("expires_at"), F.lit(False))
    end = F.when(hit_stop, F.struct(F.lit("sl").alias("outcome"), stop.alias("price"))).when(hit_target, F.struct(F.lit("tp").alias("outcome"), target.alias("price")))
    end = end.when(expired | (F.col("k") == F.col("cap") - 1), F.struct(F.lit("timeout").alias("outcome"), F.col("b_close").alias("price")))
    path = path.withColumn("end", end).where("end IS NOT NULL")
    done = path.groupBy("signal_id").agg(F.min_by(F.struct("end.outcome", F.col("end.price").alias("exit_price"), "b_ts", "mfe", "mae"), "k").alias("d"), (F.min("k") + 1).alias("bars_held"))
    out = df.join(done, "signal_id", "left")
    raw = F.when(long, F.col("d.exit_price") - entry).otherwise(entry - F.col("d.exit_price")) / risk
    cost = cost_bps(F.col("market")) / 10000 * F.abs(entry) / risk
    return out.select("signal_id", *SERIES, "action", F.when(F.col("note").isNotNull(), "unresolvable").otherwise(F.col("d.outcome")).alias("outcome"), F.col("d.exit_price").alias("exit_price"),
                      "bars_held", F.round(raw, 4).alias("raw_r"), F.when(raw.isNotNull(), F.round(cost, 4)).alias("cost_r"), F.round(raw - cost, 4).alias("realized_r"),
                      F.round("d.mfe", 4).alias("mfe_r"), F.round("d.mae", 4).alias("mae_r"), F.col("d.b_ts").alias("resolved_at"), "note")
