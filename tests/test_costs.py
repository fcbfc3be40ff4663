"""Costs of deals, walks by split and the signed index against plain Python."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from candlewright.functions import prices
from candlewright.operators import features, simulation
from candlewright.operators import signals as engine
from candlewright.sources.bars import DOLLAR_LEGS, SERIES, daily_bars

CUT = dt.datetime(1998, 7, 1)
SPLITS = {"old": ("1990-01-01", "1998-07-01"), "new": ("1998-07-01", "2010-01-01")}


def naive_walk(bars, signals, hold, least):
    """One series, one split: the loop that the columns stand for.  ``least`` tells whether a bar may be entered."""
    out, i = [], 60
    while i < len(bars) - 1:
        s = signals.get(i)
        if s is None or not least(bars[i + 1]["ts"]):
            i += 1
            continue
        side = 1 if s["action"] == "BUY" else -1
        last, price = min(i + hold, len(bars) - 1), None
        for j in range(i + 1, last + 1):
            b = bars[j]
            worst, best = (b["low"], b["high"]) if side == 1 else (b["high"], b["low"])
            if (b["open"] - s["stop_loss"]) * side <= 0 or (b["open"] - s["take_profit"]) * side >= 0:
                price = b["open"]
            elif (worst - s["stop_loss"]) * side <= 0:
                price = s["stop_loss"]
            elif (best - s["take_profit"]) * side >= 0:
                price = s["take_profit"]
            if price is not None:
                break
        else:
            j, price = last, bars[last]["close"]
        out.append((i, j, price))
        i = j
    return out


def test_each_split_is_a_walk_of_its_own(spark, sf):
    scored = engine.all_signals(daily_bars(spark, sf)).where("symbol IN ('S3', 'S4')").cache()
    deals = simulation.walk_forward(scored, splits=SPLITS).where("status = 'deal'").collect()
    rows = scored.orderBy(*SERIES, "bar_idx").collect()
    want = {}
    for symbol in ("S3", "S4"):
        bars = [r for r in rows if r["symbol"] == symbol]
        signals = {r["bar_idx"]: r for r in bars if r["has_signal"] and r["action"] in ("BUY", "SELL")}
        for split, inside in (("old", lambda t: t < CUT), ("new", lambda t: t >= CUT)):
            for i, j, price in naive_walk(bars, signals, 10, inside):
                want[symbol, split, i] = (j, price)
    assert {(d["symbol"], d["split"], d["bar_idx"]): (d["exit_idx"], d["exit"]) for d in deals} == want and {k[1] for k in want} == {"old", "new"}


def test_costs_of_a_deal(spark):
    rows = [("FOREX", "S1", "BUY", 100.0, 98.0, 106.0, 99.0, 104.0, 2.0, 1.0), ("TH_STOCK", "S2", "SELL", 50.0, 52.0, 45.0, 50.5, 52.0, 2.0, 1.5), ("FOREX", "S6", "BUY", 100.0, 98.0, 106.0, 98.0, 99.0, 2.0, 0.0)]
    names = "market string, symbol string, action string, entry_price double, stop_loss double, take_profit double, entry double, exit double, planned_risk double, realized_risk double"
    d = spark.createDataFrame(rows, names).withColumn("entry_ts", F.lit(dt.datetime(1996, 5, 1)))
    got = {r["symbol"]: r for r in simulation.with_costs(d, {"S6": 7.0}, 2.0).collect()}
    for market, symbol, action, price, stop, target, entry, out, planned, realized in rows:
        bps, side, g = {"S6": 7.0}.get(symbol, prices.COST_BPS[market]), 1 if action == "BUY" else -1, got[symbol]
        want = {"r_gross": (out - entry) * side / planned, "cost_r": 2 * bps / 1e4 * entry / planned, "cost_r_base": bps / 1e4 * entry / planned, "rr_planned": abs(target - price) / abs(price - stop),
                "stop_share": planned / entry, "planned_stop_share": planned / price, "realized_stop_share": realized / entry, "risk_keep": realized / planned, "year": 1996}
        want["r_net"] = want["r_gross"] - want["cost_r"]
        assert {k: g[k] for k in want} == pytest.approx(want, rel=1e-12)
    assert simulation.with_costs(d, risk_model="realized").where("symbol = 'S2'").first()["r_gross"] == pytest.approx(-1.0)
    with pytest.raises(Exception, match="no fee for MOON/S1"):
        simulation.with_costs(d.where("symbol = 'S1'").withColumn("market", F.lit("MOON"))).collect()
    assert simulation.with_costs(d.where("false")).count() == 0


def test_parts_make_the_exchange_cost(spark):
    d = spark.createDataFrame([(1.5, 0.02), (30.0, 0.05), (250.0, 0.4), (99.0, 0.001)], "price double, dist double")
    parts = prices.thai_cost_parts(F.col("price"), F.col("dist"))
    for r in d.select("*", prices.thai_cost_r(F.col("price"), F.col("dist")).alias("whole"), parts.alias("p"), prices.thai_cost_parts(F.col("price"), F.col("dist"), 20000.0, 2).alias("q")).collect():
        assert r["p"]["commission_r"] + r["p"]["tick_r"] == pytest.approx(r["whole"], rel=1e-12)
        assert r["q"]["tick_r"] == pytest.approx(2 * r["p"]["tick_r"], rel=1e-12) and r["q"]["commission_r"] <= r["p"]["commission_r"] + 1e-12
        assert r["p"]["least_fee"] == (prices.RISKED / r["dist"] * prices.COMMISSION < prices.LEAST_FEE)


def test_signed_index(spark):
    day = [dt.datetime(2000, 1, k) for k in (1, 2, 3)]
    legs = list(DOLLAR_LEGS)
    rows = [("1D", day[0], s, 0.01 * k) for k, s in enumerate(legs)] + [("1D", day[1], s, 0.5) for s in legs[:5]] + [("1D", day[1], "EURJPY", 9.0), ("1D", day[2], legs[0], None), ("1D", day[0], legs[1] + "X", 1.0), ("1D", day[1], legs[5], math.nan)]
    got = {r["ts"]: (r["legs"], r["index_r"]) for r in features.signed_index(spark.createDataFrame(rows, "timeframe string, ts timestamp_ntz, symbol string, r double"), "r", DOLLAR_LEGS, 6).collect()}
    assert got[day[0]] == (10, pytest.approx(sum(0.01 * k * DOLLAR_LEGS[s] for k, s in enumerate(legs)) / 10)) and got[day[1]] == (5, None) and day[2] not in got
