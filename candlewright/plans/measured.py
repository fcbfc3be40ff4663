"""Named queries of costs on the walk-forward's deals and of the dollar index, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewright.functions import prices
from candlewright.operators import features, simulation
from candlewright.operators import signals as engine
from candlewright.plans.engine_sql import walk_sql
from candlewright.plans.queries import DAILY_SQL, P, r6, register
from candlewright.plans.research import r8
from candlewright.plans.studies import COST_SQL
from candlewright.sources.bars import DOLLAR_LEGS, PAIR_SQL, SERIES, daily_bars, pair_bars

SPLITS = {"train": ("1992-01-01", "1998-07-01"), "test": ("1998-07-01", "2003-01-01")}
SYMBOL_BPS = {"S3": 8.0, "S11": 2.5}
#: What a scenario multiplies the fees by.
SCENARIOS = {"zero": 0.0, "base": 1.0, "pessimistic": 2.0}
_SPLIT = "CASE " + " ".join(f"WHEN entry_ts >= TIMESTAMP '{lo}' AND entry_ts < TIMESTAMP '{hi}' THEN '{name}'" for name, (lo, hi) in SPLITS.items()) + " END"
_BPS = "CASE symbol " + " ".join(f"WHEN '{s}' THEN {bps!r}::DOUBLE" for s, bps in SYMBOL_BPS.items()) + f" ELSE {COST_SQL} END"
COSTED_SQL = walk_sql(DAILY_SQL, split=_SPLIT) + f""", cd AS (SELECT d.*, {_BPS} / 10000 * entry AS base, s.take_profit FROM deals d JOIN sig s USING (market, symbol, timeframe, bar_idx))"""


def split_deals(spark, sf_dir):
    return simulation.walk_forward(engine.all_signals(daily_bars(spark, sf_dir)), splits=SPLITS).where("status = 'deal'")


@register(COSTED_SQL.replace("s.take_profit", "s.take_profit AS target") + """ SELECT market, symbol, timeframe, split, bar_idx, action, round(gain / planned_risk, 6) AS r_gross, round(2 * base / planned_risk, 6) AS cost_r, round(base / planned_risk, 6) AS cost_r_base, round((gain - 2 * base) / planned_risk, 6) AS r_net,
 round(abs(target - entry_price) / planned_risk, 6) AS rr_planned, round(planned_risk / entry, 6) AS stop_share, round(planned_risk / entry_price, 6) AS planned_stop_share, round(realized_risk / entry, 6) AS realized_stop_share, round(realized_risk / planned_risk, 6) AS risk_keep, round(2 * base, 12) AS cost_money, CAST(year(entry_ts) AS INTEGER) AS year FROM cd""")
def split_deal_costs(spark, sf_dir):
    """Deals of a walk of its own in each split, with the cost of each at its symbol's or market's fee, doubled, and its gap ratios."""
    d = simulation.with_costs(split_deals(spark, sf_dir), SYMBOL_BPS, SCENARIOS["pessimistic"])
    return d.select(*SERIES, "split", "bar_idx", "action", *r6("r_gross", "cost_r", "cost_r_base", "r_net", "rr_planned", "stop_share", "planned_stop_share", "realized_stop_share", "risk_keep"), F.round("cost_money", 12).alias("cost_money"), "year")


@register(COSTED_SQL + f""" SELECT market, split, scenario, count(*) AS n, count(*) FILTER (round((gain - base * m) / planned_risk, 9) > 0) AS wins, count(*) FILTER (round(base / planned_risk, 9) < 0.5) AS affordable, round(avg(gain / planned_risk), 8) AS gross, round(avg(base * m / planned_risk), 8) AS cost, round(avg((gain - base * m) / planned_risk), 8) AS net, round(avg(realized_risk / planned_risk), 8) AS risk_keep
 FROM cd, (VALUES {", ".join(f"('{name}', {m!r}::DOUBLE)" for name, m in SCENARIOS.items())}) AS v(scenario, m) GROUP BY ALL""")
def cost_scenarios(spark, sf_dir):
    """What is left of the deals of each market and split without fees, with them, and with twice as much; one walk for all."""
    scenario = F.explode(F.create_map(*[F.lit(x) for pair in SCENARIOS.items() for x in pair])).alias("scenario", "times")
    d = simulation.with_costs(split_deals(spark, sf_dir).select("*", scenario), SYMBOL_BPS, F.col("times"))
    return d.groupBy("market", "split", "scenario").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.round("r_net", 9) > 0).alias("wins"), F.count_if(F.round("cost_r_base", 9) < 0.5).alias("affordable"), r8(F.avg("r_gross"), "gross"), r8(F.avg("cost_r"), "cost"), r8(F.avg("r_net"), "net"), r8(F.avg("risk_keep"), "risk_keep"))


RISKS, TICKS = (500.0, 1000.0, 2000.0, 5000.0, 10000.0, 20000.0), (1, 2)
_TICK = "CASE " + " ".join(f"WHEN entry >= {at!r}::DOUBLE THEN {tick!r}::DOUBLE" for at, tick in reversed(prices.TICK_BANDS)) + f" ELSE {prices.TICK_BANDS[0][1]!r}::DOUBLE END"
_QUARTER = "round(quantile_cont(bps, {q}), 6)"


@register(walk_sql(DAILY_SQL) + f""", th AS (SELECT gain / planned_risk AS r, planned_risk / entry AS dist, {_TICK} / entry AS tick FROM deals WHERE market = 'TH_STOCK'),
va AS (SELECT *, risked / dist AS worth FROM th, (SELECT unnest({list(RISKS)})::DOUBLE AS risked), (SELECT unnest({list(TICKS)})::INTEGER AS ticks)),
co AS (SELECT *, 2 * greatest(worth * {prices.COMMISSION!r}::DOUBLE, {prices.LEAST_FEE!r}::DOUBLE) / risked AS comm, ticks * tick / dist AS slip FROM va), cp AS (SELECT *, round((comm + slip) * dist * 10000, 2) AS bps FROM co)
SELECT risked, ticks, count(*) AS n, round(avg(r), 8) AS gross, round(avg(comm), 8) AS commission_r, round(avg(slip), 8) AS tick_r, round(avg(r - comm - slip), 8) AS net, round(avg(CASE WHEN round(worth, 6) < {round(prices.LEAST_FEE / prices.COMMISSION, 6)!r}::DOUBLE THEN 1 ELSE 0 END), 8) AS least_fee_share,
 {_QUARTER.format(q=0.25)} AS bps_p25, {_QUARTER.format(q=0.5)} AS bps_median, {_QUARTER.format(q=0.75)} AS bps_p75, round(2 * {prices.LEAST_FEE!r}::DOUBLE / risked, 8) AS floor_r, round({prices.COMMISSION!r}::DOUBLE * risked / {prices.LEAST_FEE!r}::DOUBLE, 8) AS stop_where_floor_binds FROM cp GROUP BY ALL""")
def risk_sweep(spark, sf_dir):
    """The exchange's real costs on its deals for six amounts at risk and spreads of one and two ticks, the floor that the
    least commission sets, and quartiles of the cost in basis points, taken from counts of hundredths of one."""
    deals = simulation.walk_forward(engine.all_signals(daily_bars(spark, sf_dir))).where("status = 'deal' AND market = 'TH_STOCK'")
    d = deals.select("entry", "r", (F.col("planned_risk") / F.col("entry")).alias("dist"), F.explode(F.array(*map(F.lit, RISKS))).alias("risked")).withColumn("ticks", F.explode(F.array(*map(F.lit, TICKS))))
    d = d.withColumn("c", prices.thai_cost_parts(F.col("entry"), F.col("dist"), F.col("risked"), F.col("ticks"))).select("*", "c.*").withColumn("cost", F.col("commission_r") + F.col("tick_r"))
    names = ("r", "commission_r", "tick_r", "cost")
    counted = d.groupBy("risked", "ticks", F.round(F.col("cost") * F.col("dist") * 10000, 2).alias("bps")).agg(F.count(F.lit(1)).alias("c"), F.count_if("least_fee").alias("floored"), *[F.sum(x).alias(x) for x in names])
    n = F.sum("c")
    out = counted.groupBy("risked", "ticks").agg(n.alias("n"), (F.sum("floored") / n).alias("least_fee_share"), F.percentile("bps", [0.25, 0.5, 0.75], F.col("c")).alias("q"), *[(F.sum(x) / n).alias(x) for x in names])
    return out.select("risked", "ticks", "n", r8("r", "gross"), r8("commission_r", "commission_r"), r8("tick_r", "tick_r"), r8(F.col("r") - F.col("cost"), "net"), r8("least_fee_share", "least_fee_share"),
                      *[F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(("bps_p25", "bps_median", "bps_p75"))], r8(2 * prices.LEAST_FEE / F.col("risked"), "floor_r"), r8(prices.COMMISSION * F.col("risked") / prices.LEAST_FEE, "stop_where_floor_binds"))


@register(PAIR_SQL + f""", m AS (SELECT *, ln(close) - ln(lag(close) {P})) AS r FROM bars), g AS (SELECT timeframe, ts, r * CASE WHEN symbol IN {tuple(s for s, sign in DOLLAR_LEGS.items() if sign > 0)} THEN 1 WHEN symbol IN {tuple(s for s, sign in DOLLAR_LEGS.items() if sign < 0)} THEN -1 END AS leg FROM m)
SELECT timeframe, ts, count(*) AS legs, round(CASE WHEN count(*) >= 6 THEN avg(leg) END, 6) AS index_r FROM g WHERE leg IS NOT NULL GROUP BY ALL""")
def dollar_index(spark, sf_dir):
    """The dollar's move per day from ten signed currency pairs, six of them at least."""
    r = features.momentum(pair_bars(spark, sf_dir), (1,))
    return features.signed_index(r, "mom_1", DOLLAR_LEGS, 6).select("timeframe", "ts", "legs", *r6("index_r"))
