"""Rule scores of every bar, action, strength, levels; the gate and its ranking.

All bars are scored at once; the last bar of each series is the live scan.  One column per rule is
kept, so scores can be decomposed, and every rule has a weight that a configuration can change.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from candlewright.functions.prices import exact_round, risk_reward, rounder
from candlewright.operators.indicators import bollinger, patterns, sma, trend, with_atr, with_levels, with_recursive
from candlewright.sources.bars import SERIES, dealt, series


@dataclass(frozen=True)
class EngineConfig:
    """Weights and thresholds.  Unknown names and wrong types are refused."""

    rsi_low: float = 30.0
    rsi_high: float = 70.0
    rsi_extreme: int = 2
    rsi_cross: int = 1
    macd_cross: int = 2
    hist_expand: int = 1
    trend_confirmed: int = 2
    trend_short: int = 1
    band_touch: int = 1
    bullish_engulfing: int = 2
    hammer: int = 2
    bearish_engulfing: int = 2
    shooting_star: int = 2
    level: int = 1
    level_share: float = 0.015
    act_at: int = 3
    stop_atr: float = 1.5
    target_atr: float = 3.0

    def patched(self, patch: dict) -> EngineConfig:
        known = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        for name, value in patch.items():
            if name not in known:
                raise KeyError(f"unknown setting {name}")
            if not isinstance(value, (int, float)) or isinstance(value, bool) or known[name] is int and not isinstance(value, int):
                raise TypeError(f"{name} must be {known[name].__name__}")
        return replace(self, **patch)

    def diff(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) != f.default}


def with_indicators(bars: DataFrame) -> DataFrame:
    """Bars with every indicator that the rules read."""
    out = with_levels(with_atr(dealt(with_recursive(bars))))
    lower, _, upper = bollinger()
    out = out.withColumns({"sma50": sma("close", 50), "sma200": sma("close", 200), "bb_lower": lower, "bb_upper": upper})
    return out.withColumn("trend", trend(F.col("close"), F.col("ema20"), F.col("sma50"), F.col("sma200")))


def _rule(bull: Column, bear: Column, weight: int | Column) -> Column:
    """Signed score: positive for bulls.  A missing input counts as not met."""
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    return F.when(F.coalesce(bull, F.lit(False)), weight).when(F.coalesce(bear, F.lit(False)), -weight).otherwise(0)


def score_rules(df: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    w = series()
    before = {c: F.lag(c).over(w) for c in ("rsi14", "macd", "macd_signal", "macd_hist")}
    rsi, macd, line, hist, close = (F.col(c) for c in ("rsi14", "macd", "macd_signal", "macd_hist", "close"))
    flags = patterns()
    near_support = F.get(F.filter("supports", lambda s: (s < close) & (F.try_divide(close - s, close) < config.level_share)), 0)
    near_resistance = F.get(F.filter("resistances", lambda r: (r > close) & (F.try_divide(r - close, close) < config.level_share)), 0)
    middle = rsi.between(config.rsi_low, config.rsi_high)
    tone = F.col("news") if "news" in df.columns else F.lit(None).cast("double")
    rules = {
        "r_rsi_extreme": _rule(rsi < config.rsi_low, rsi > config.rsi_high, config.rsi_extreme),
        "r_rsi_cross": _rule(middle & (rsi > 50) & (before["rsi14"] < 50), middle & (rsi < 50) & (before["rsi14"] > 50), config.rsi_cross),
        "r_macd": _rule((macd > line) & (before["macd"] <= before["macd_signal"]), (macd < line) & (before["macd"] >= before["macd_signal"]), config.macd_cross),
        "r_hist": _rule((hist > 0) & (before["macd_hist"] < hist), (hist < 0) & (before["macd_hist"] > hist), config.hist_expand),
        "r_trend": _rule(F.col("trend") == "uptrend", F.col("trend") == "downtrend", F.when(F.col("sma200").isNotNull(), config.trend_confirmed).otherwise(config.trend_short)),
        "r_band": _rule(close < F.col("bb_lower"), close > F.col("bb_upper"), config.band_touch),
        "r_news": _rule(tone > 0.3, tone < -0.3, F.floor(F.abs(tone) * 2 + 0.5).cast("int")),
    }
    scored = {f"s_{n}": getattr(config, n) * F.col(n).cast("int") for n in ("bullish_engulfing", "hammer", "bearish_engulfing", "shooting_star")}
    out = df.withColumns(rules | flags | {"near_support": near_support, "near_resistance": near_resistance}).withColumns(scored)
    return out.withColumns({"p_bull": F.col("s_bullish_engulfing") + F.col("s_hammer"), "p_bear": F.col("s_bearish_engulfing") + F.col("s_shooting_star")})


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("entry_price", "stop_loss", "take_profit")]))
def deal_levels(close: pd.Series, market: pd.Series, atr: pd.Series, support: pd.Series, resistance: pd.Series, action: pd.Series, stop_atr: pd.Series, target_atr: pd.Series) -> pd.DataFrame:
    """Entry, stop and target.

    Levels near the price count if they stay on their side after their margin; else ATR distances.
    Rounded levels that fall on the entry fall back once more; where that fails too, stop and target
    are null.  The steps refer to each other many times over, which as column expressions would be
    copied into one another; here each is computed once per Arrow batch."""
    price, hold, sign = close.to_numpy(float), (action == "HOLD").to_numpy(), np.where(action == "SELL", -1.0, 1.0)
    unit = np.where(atr.to_numpy(float) > 0, atr.to_numpy(float), price * 0.02)
    rounded = rounder(market)
    far_stop, far_target = price - sign * stop_atr.to_numpy(float) * unit, price + sign * target_atr.to_numpy(float) * unit
    below, above = support.to_numpy(float), resistance.to_numpy(float)
    behind, ahead = np.where(sign > 0, below * 0.995, above * 1.005), np.where(sign > 0, above * 0.995, below * 1.005)
    stop = np.where((price - behind) * sign > 0, behind, far_stop)
    target = np.where((ahead - price) * sign > 0, ahead, far_target)
    stop, target = np.where(hold, price - unit, stop), np.where(hold, price + unit, target)
    entry, stop, target = rounded(price), rounded(stop), rounded(target)
    stop = np.where(hold | ((entry - stop) * sign > 0), stop, rounded(far_stop))
    target = np.where(hold | ((target - entry) * sign > 0), target, rounded(far_target))
    dead = ~hold & ((stop == entry) | (target == entry) | (stop <= 0) | (target <= 0))
    return pd.DataFrame({"entry_price": entry, "stop_loss": np.where(dead, np.nan, stop), "take_profit": np.where(dead, np.nan, target)})


#: Reasons in the order of their rules, (type, label, score column, its sign, weight).
REASONS = (
    ("technical", "RSI Oversold", "r_rsi_extreme", 1, 0.2),
    ("technical", "RSI Overbought", "r_rsi_extreme", -1, 0.2),
    ("technical", "RSI Cross 50", "r_rsi_cross", 1, 0.15),
    ("technical", "RSI Cross 50", "r_rsi_cross", -1, 0.15),
    ("technical", "MACD Bullish Cross", "r_macd", 1, 0.2),
    ("technical", "MACD Bearish Cross", "r_macd", -1, 0.2),
    ("technical", "Uptrend", "r_trend", 1, 0.2),
    ("technical", "Downtrend", "r_trend", -1, 0.2),
    ("technical", "BB Lower Touch", "r_band", 1, 0.15),
    ("technical", "BB Upper Touch", "r_band", -1, 0.15),
    ("pattern", "Bullish Engulfing", "s_bullish_engulfing", 1, 0.2),
    ("pattern", "Bearish Engulfing", "s_bearish_engulfing", 1, 0.2),
    ("pattern", "Hammer", "s_hammer", 1, 0.2),
    ("pattern", "Shooting Star", "s_shooting_star", 1, 0.2),
    ("technical", "At Support", "s_support", 1, 0.15),
    ("technical", "At Resistance", "s_resistance", 1, 0.15),
    ("news", "Bullish News", "r_news", 1, 0.2),
    ("news", "Bearish News", "r_news", -1, 0.2),
)
#: Names and places of the published indicators.
INDICATORS = {"rsi": ("rsi14", 2), "macd": ("macd", 4), "macd_signal": ("macd_signal", 4), "ma20": ("ema20", 4), "ma50": ("sma50", 4), "ma200": ("sma200", 4), "atr": ("atr", 4)}


def indicator_map() -> Column:
    """The published indicators by name, rounded from their exact binary value; missing ones are left out."""
    values = F.create_map(*[x for name, (column, places) in INDICATORS.items() for x in (F.lit(name), exact_round(F.col(column), places))])
    return F.map_filter(values, lambda _, v: v.isNotNull())


def signals(df: DataFrame, config: EngineConfig = EngineConfig(), min_bars: int = 50) -> DataFrame:
    """Scored bars with action, strength, confidence, levels and reasons.  Bars with less than
    ``min_bars`` of history, or whose levels fall on the entry after rounding, have no signal."""
    rules = ["r_rsi_extreme", "r_rsi_cross", "r_macd", "r_hist", "r_trend", "r_band", "r_news"]
    df = score_rules(df, config)
    at_support, at_resistance = F.col("near_support").isNotNull().cast("int"), F.col("near_resistance").isNotNull().cast("int")
    bull = sum((F.greatest(F.col(r), F.lit(0)) for r in rules), F.col("p_bull") + config.level * at_support)
    bear = sum((F.greatest(-F.col(r), F.lit(0)) for r in rules), F.col("p_bear") + config.level * at_resistance)
    df = df.withColumns({"bull": bull, "bear": bear, "s_support": config.level * at_support, "s_resistance": config.level * at_resistance})
    net, top = F.col("bull") - F.col("bear"), F.greatest("bull", "bear")
    action = F.when(net >= config.act_at, "BUY").when(net <= -config.act_at, "SELL").otherwise("HOLD")
    strength = F.when(top >= 8, "very_strong").when(top >= 5, "strong").when(top >= 3, "moderate").otherwise("weak")
    df = df.withColumns({"action": action, "strength": strength, "confidence": F.least(F.lit(95), 40 + 6 * top).cast("double")})
    levels = deal_levels("close", "market", "atr", "near_support", "near_resistance", "action", F.lit(config.stop_atr), F.lit(config.target_atr))
    df = df.withColumn("levels", levels).select("*", *[F.nanvl(f"levels.{c}", F.lit(None)).alias(c) for c in ("entry_price", "stop_loss", "take_profit")]).drop("levels")
    reasons = [F.when(F.col(column) * sign > 0, F.struct(F.lit(kind).alias("type"), F.lit(label).alias("label"), F.lit(weight).alias("weight"))) for kind, label, column, sign, weight in REASONS]
    held = F.when(F.col("timeframe") == "1H", F.expr("INTERVAL 48 HOURS")).otherwise(F.expr("INTERVAL 168 HOURS"))
    told = {"reasons": F.slice(F.array_compact(F.array(*reasons)), 1, 5), "indicators": indicator_map(), "expires_at": F.col("ts") + held}
    return df.withColumns({"has_signal": (F.col("bar_idx") + 1 >= min_bars) & (F.col("close") > 0) & F.col("stop_loss").isNotNull()} | told)


def all_signals(bars: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return signals(with_indicators(bars), config)


def latest(df: DataFrame) -> DataFrame:
    """The last row of each series."""
    w = Window.partitionBy(*SERIES).orderBy(F.desc("ts"))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: The gate's thresholds.
GATE = {"min_strength": 2, "min_confidence": 70.0, "min_rr": 1.5, "max_rr": None, "min_stop_pct": 0.15, "max_stop_pct": 8.0, "per_run": 5}
STRENGTHS = ("weak", "moderate", "strong", "very_strong")


def gate(df: DataFrame, limits: dict = GATE) -> DataFrame:
    """Adds rr, stop_pct, rejections and accepted.  A structural failure is the only code of its row;
    otherwise every limit that fails is listed."""
    entry, stop, target, buy = F.col("entry_price"), F.col("stop_loss"), F.col("take_profit"), F.col("action") == "BUY"
    sided = F.when(buy, (stop < entry) & (target > entry)).otherwise((stop > entry) & (target < entry))
    df = df.withColumn("rr", risk_reward(entry, stop, target)).withColumn("stop_pct", F.when(entry > 0, F.abs(entry - stop) / entry * 100))
    structural = F.when(~F.col("has_signal"), "no_signal").when(~F.col("action").isin("BUY", "SELL"), "action_hold").when(~F.coalesce(sided & (entry > 0), F.lit(False)), "invalid_levels")
    rank = F.array_position(F.array(*map(F.lit, STRENGTHS)), F.col("strength")) - 1
    soft = [F.when(rank < limits["min_strength"], "below_min_strength"), F.when(~(F.col("confidence") >= limits["min_confidence"]), "below_min_confidence"),
            F.when(F.col("rr") < limits["min_rr"], "below_min_rr"), F.when(F.col("stop_pct") < limits["min_stop_pct"], "stop_too_tight"), F.when(F.col("stop_pct") > limits["max_stop_pct"], "stop_too_wide")]
    if limits["max_rr"] is not None:
        soft.append(F.when(F.col("rr") > limits["max_rr"], "above_max_rr"))
    codes = F.when(structural.isNotNull(), F.array(structural)).otherwise(F.array_compact(F.array(*soft)))
    return df.withColumn("rejections", codes).withColumn("accepted", F.size("rejections") == 0)


def ranked(df: DataFrame, by: list[str], limit: int = GATE["per_run"]) -> DataFrame:
    """Accepted rows of each recipient or run, best first, at most ``limit``."""
    w = Window.partitionBy(*by).orderBy(F.desc("confidence"), F.desc("rr"), "symbol", "timeframe")
    return df.where("accepted").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
