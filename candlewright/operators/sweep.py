"""Many configurations of the rule engine in one plan.

Configurations are rows of a small table.  Indicators and rule scores are computed once; an arm's net score is the product of
a bar's rule scores with the arm's weight row, so arms cost a few additions a bar.  Arms that act in the same
direction with the same geometry of exits have the same deal at that bar: it is simulated once and then handed to
all of them.  Each arm then chooses its own deals that don't overlap.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.operators import signals as engine
from candlewright.operators import simulation
from candlewright.sources.bars import SERIES

#: The rules that an arm can weigh, and the scores (bull, bear) that each stands for.
RULES = {
    "rsi_zone": ("r_rsi_extreme",), "rsi_cross": ("r_rsi_cross",), "macd_cross": ("r_macd",), "macd_hist": ("r_hist",), "trend": ("r_trend",), "bollinger": ("r_band",), "news": ("r_news",),
    "patterns": ("p_bull", "p_bear"), "levels": ("l_bull", "l_bear"),
}


@dataclass(frozen=True)
class Arm:
    """A configuration: rules that are off, thresholds of the net score, geometry of the exits, longest hold."""

    name: str
    off: tuple[str, ...] = ()
    buy_at: int = 3
    sell_at: int = -3
    stop_atr: float = 1.5
    target_atr: float = 3.0
    at_levels: bool = True
    hold: int = 10
    group: str = field(default="", compare=False)

    def __post_init__(self) -> None:
        if unknown := set(self.off) - set(RULES):
            raise KeyError(f"unknown rules {sorted(unknown)}")

    def geometry(self) -> tuple:
        return (self.stop_atr, self.target_atr, self.at_levels, self.hold)


_RSI, _WITH, _AGAINST = ("rsi_zone", "rsi_cross"), ("trend", "macd_cross", "macd_hist", "rsi_cross"), ("rsi_zone", "bollinger", "levels", "patterns")
#: The diagnostic configurations, the ablation arms, and the holds that are probed.
DIAGNOSTIC = (
    Arm("baseline"), Arm("reasons99"),
    Arm("off:rsiZone", ("rsi_zone",)), Arm("off:rsiCross", ("rsi_cross",)), Arm("off:rsiAll", _RSI), Arm("off:macdCross", ("macd_cross",)), Arm("off:macdHist", ("macd_hist",)),
    Arm("off:trend", ("trend",)), Arm("off:bollinger", ("bollinger",)), Arm("off:patterns", ("patterns",)), Arm("off:srScore", ("levels",)),
    Arm("exits:noSR", at_levels=False), Arm("exits:tp1", target_atr=1.0), Arm("exits:tp1.5", target_atr=1.5), Arm("exits:tp2", target_atr=2.0), Arm("exits:sl3tp3", stop_atr=3.0),
    Arm("exits:atrOnly_tp1.5", target_atr=1.5, at_levels=False),
)
ABLATION = (
    Arm("B0", group="ref"), Arm("F1", _AGAINST, group="fam"), Arm("F2", _WITH, group="fam"),
    Arm("N1", buy_at=-1000, group="null"), Arm("N2", buy_at=1000, sell_at=1000, group="null"), Arm("C4", buy_at=4, sell_at=-4, group="ctrl"), Arm("C5", buy_at=5, sell_at=-5, group="ctrl"),
    Arm("L1", _RSI, group="loo"), Arm("L2", ("rsi_zone",), group="loo"), Arm("L3", ("rsi_cross",), group="loo"), Arm("L4", ("macd_cross",), group="loo"), Arm("L5", ("macd_hist",), group="loo"),
    Arm("L6", ("trend",), group="loo"), Arm("L7", ("bollinger",), group="loo"), Arm("L8", ("patterns",), group="loo"), Arm("L9", ("levels",), group="loo"), Arm("L10", ("news",), group="loo"),
)
HOLD_PROBES = tuple(Arm(f"hold:{n}", hold=n) for n in (5, 10, 20, 40))


def weight_row(spark, arms: tuple[Arm, ...]) -> DataFrame:
    """One row: the geometries, each with its arms and their weights in the order of RULES."""
    if len({a.name for a in arms}) != len(arms):
        raise ValueError("two arms of one name")
    by: dict[tuple, list] = {}
    for a in arms:
        by.setdefault(a.geometry(), []).append((a.name, [int(r not in a.off) for r in RULES], a.buy_at, a.sell_at))
    kind = "stop_atr:double,target_atr:double,at_levels:boolean,hold:int,arms:array<struct<arm:string,weights:array<int>,buy_at:int,sell_at:int>>"
    return spark.createDataFrame([([(*geometry, own) for geometry, own in by.items()],)], f"geometries array<struct<{kind}>>")


def scored_bars(bars: DataFrame) -> DataFrame:
    """Bars with what every arm reads: the net score of each rule as an array in the order of RULES."""
    df = engine.score_rules(engine.with_indicators(bars))
    df = df.withColumn("l_bull", F.col("near_support").isNotNull().cast("int")).withColumn("l_bear", F.col("near_resistance").isNotNull().cast("int"))
    net = [F.col(c[0]) - F.col(c[1]) if len(c) == 2 else F.col(c[0]) for c in RULES.values()]
    return df.select(*SERIES, "bar_idx", "ts", "open", "high", "low", "close", "atr", "trend", "near_support", "near_resistance", F.array(*net).alias("scores"))


def sweep(bars: DataFrame, arms: tuple[Arm, ...], min_history: int = 60) -> DataFrame:
    """Deals of every arm: arm, series, bar_idx, ts, action, trend, entry_price, stop_loss, entry, exit, exit_idx, reason, r (by planned
    risk).  An arm with the engine's own values gives the deals of the walk-forward."""
    df = simulation.with_ahead(scored_bars(bars), max(a.hold for a in arms)).where((F.col("bar_idx") >= max(50, min_history)) & (F.col("close") > 0) & (F.size("ahead") > 0))
    df = df.crossJoin(F.broadcast(weight_row(bars.sparkSession, arms))).select("*", F.inline("geometries")).drop("geometries")  # one row
    score = lambda a: F.aggregate(F.zip_with("scores", a["weights"], lambda s, w: s * w), F.lit(0), lambda t, x: t + x)
    sides = F.transform("arms", lambda a: F.struct(a["arm"].alias("arm"), F.when(score(a) >= a["buy_at"], "BUY").when(score(a) <= a["sell_at"], "SELL").alias("action")))
    acting = lambda side: F.transform(F.filter("sides", lambda a: a["action"] == side), lambda a: a["arm"])
    df = df.withColumn("sides", sides).drop("arms", "scores")
    once = df.select("*", F.inline(F.array(*[F.struct(F.lit(side).alias("action"), acting(side).alias("arms")) for side in ("BUY", "SELL")]))).drop("sides").where(F.size("arms") > 0)
    level = lambda c: F.when(F.col("at_levels"), F.col(c))
    placed = once.withColumn("levels", engine.deal_levels("close", "market", "atr", level("near_support"), level("near_resistance"), "action", "stop_atr", "target_atr"))
    placed = placed.select(*once.columns, *[F.nanvl(f"levels.{c}", F.lit(None)).alias(c) for c in ("entry_price", "stop_loss", "take_profit")]).where("stop_loss IS NOT NULL")
    done = simulation.exits(placed, F.col("hold")).where("status = 'deal' AND r_planned IS NOT NULL")
    deals = done.select(F.explode("arms").alias("arm"), *SERIES, "bar_idx", "ts", "action", "trend", "entry_price", "stop_loss", "entry", "exit", "exit_idx", "reason", F.col("r_planned").alias("r"))
    return simulation.without_overlap(deals, [*SERIES, "arm"])


def arm_stats(deals: DataFrame) -> DataFrame:
    """One row per arm."""
    return deals.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "BUY").alias("buys"), F.count_if(F.col("r") > 0).alias("wins"), F.sum("r").alias("total_r"), F.avg("r").alias("avg_r"))
