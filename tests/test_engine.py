"""Recursive indicators, levels, simulation and outcomes against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewright.operators import indicators, positions, signals, simulation, statistics
from candlewright.sources import files, synthetic


def naive_deals(rows, bars, hold=10, floor=60):
    out, i = [], floor
    while i <= len(bars) - 2:
        s = rows[i]
        if not s["has_signal"] or s["action"] == "HOLD":
            i += 1
            continue
        sign = 1 if s["action"] == "BUY" else -1
        stop, target, entry = s["stop_loss"], s["take_profit"], bars[i + 1]["open"]
        last = min(i + hold, len(bars) - 1)
        for j in range(i + 1, last + 1):
            b = bars[j]
            worst, best = (b["low"], b["high"]) if sign == 1 else (b["high"], b["low"])
            if (b["open"] - stop) * sign <= 0:
                done = (j, b["open"], "gap_stop")
            elif (b["open"] - target) * sign >= 0:
                done = (j, b["open"], "gap_target")
            elif (worst - stop) * sign <= 0:
                done = (j, stop, "stop_loss")
            elif (best - target) * sign >= 0:
                done = (j, target, "take_profit")
            else:
                continue
            break
        else:
            done = (last, bars[last]["close"], "time_exit")
        out.append((i, done[0], round(done[1], 6), done[2]))
        assert entry > 0
        i = done[0]
    return out


@pytest.mark.parametrize("profile", ["side", "chop", "vshape", "squeeze"])
def test_walk_forward_equals_loop(spark, profile):
    bars = synthetic.to_spark(spark, synthetic.candles(profile, 260, seed=3))
    scored = signals.all_signals(bars).cache()
    rows = [r.asDict() for r in scored.orderBy("bar_idx").collect()]
    plain = [r.asDict() for r in bars.orderBy("bar_idx").collect()]
    got = [(r["bar_idx"], r["exit_idx"], round(r["exit"], 6), r["reason"]) for r in simulation.walk_forward(scored).orderBy("bar_idx").collect()]
    assert got == naive_deals(rows, plain)
    for r in rows:
        if r["has_signal"] and r["action"] != "HOLD":
            sign = 1 if r["action"] == "BUY" else -1
            assert (r["entry_price"] - r["stop_loss"]) * sign > 0 and (r["take_profit"] - r["entry_price"]) * sign > 0
    scored.unpersist()


def test_nothing_looks_ahead(spark):
    """Values before a cut do not change when the future goes."""
    frame = synthetic.candles("side", 160, seed=5)
    whole, cut = (signals.with_indicators(synthetic.to_spark(spark, f)).where("bar_idx < 120").orderBy("bar_idx") for f in (frame, frame.iloc[:120]))
    columns = [c for c in whole.columns if c not in ("swing_high", "swing_low")]
    assert whole.select(columns).collect() == cut.select(columns).collect()


@pytest.mark.parametrize("kind", synthetic.CORRUPTIONS)
def test_corrupt_series_do_not_break(spark, kind):
    bars = synthetic.to_spark(spark, synthetic.corrupt(synthetic.candles("side", 80), kind))
    row = signals.gate(signals.all_signals(bars)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("stop_loss")).alias("nan")).first()
    assert row["n"] == 80 and row["nan"] == 0


GOLDEN = [
    ("BUY", 100, 98, 104, [(100, 105, 97, 101)], ("sl", 98.0, 1)),
    ("BUY", 100, 98, 104, [(100, 101, 99.5, 100.5), (100, 104.5, 100, 104)], ("tp", 104.0, 2)),
    ("BUY", 100, 98, 104, [(100, 100.5, 97.9, 98.2)], ("sl", 98.0, 1)),
    ("SELL", 100, 102, 96, [(100, 100.5, 95.5, 96)], ("tp", 96.0, 1)),
    ("SELL", 100, 102, 96, [(100, 103, 95, 99)], ("sl", 102.0, 1)),
    ("BUY", 100, 98, 104, [(100, 101, 99, 100)], (None, None, None)),
    ("BUY", 100, 104, 98, [(100, 101, 99, 100)], ("unresolvable", None, None)),
]


@pytest.mark.parametrize("action,entry,stop,target,path,want", GOLDEN)
def test_outcomes(spark, action, entry, stop, target, path, want):
    bars = spark.sql("SELECT 'FOREX' market, 'T' symbol, '1H' timeframe, i bar_idx, timestamp_ntz'2026-01-01' + make_interval(0,0,0,0,i) ts FROM VALUES " + ",".join(f"({i + 1})" for i in range(len(path))) + " t(i)")
    prices = spark.createDataFrame([(i + 1, *map(float, p)) for i, p in enumerate(path)], "bar_idx int, open double, high double, low double, close double")
    sig = spark.sql(f"SELECT 's' signal_id, 'FOREX' market, 'T' symbol, '1H' timeframe, 0 bar_idx, '{action}' action, double({entry}) entry_price, double({stop}) stop_loss, double({target}) take_profit, CAST(NULL AS timestamp_ntz) expires_at")
    r = simulation.resolve_outcomes(sig, bars.join(prices, "bar_idx")).first()
    assert (r["outcome"], r["exit_price"], r["bars_held"]) == want
    if want[0] == "tp":
        assert r["raw_r"] == 2.0 and r["cost_r"] == 0.0075 and r["realized_r"] == 1.9925


def test_positions(spark):
    rows = [("long", 100.0, 95.0, 110.0, 100.0, 94.0, 111.0, "stop_loss"), ("long", 100.0, 95.0, 110.0, 100.0, 99.0, 111.0, "take_profit"), ("short", 100.0, 105.0, 90.0, 100.0, 89.0, 104.0, "take_profit"), ("long", 100.0, 101.0, None, 100.0, 90.0, 120.0, "open")]
    df = spark.createDataFrame([(*r, 1.0, 0.0) for r in rows], "direction string, entry_price double, stop_loss double, take_profit double, price double, win_low double, win_high double, want string, quantity double, fees double")
    out = positions.evaluate(df).collect()
    assert all(r["outcome"] == r["want"] for r in out)
    assert [list(r["ignored"]) for r in out][-1] == ["stop_loss"]


def test_statistics():
    assert abs(statistics.t_test_p(2.0, 10) - 0.07338803) < 1e-6
    assert abs(statistics.t_test_p(0.0, 5) - 1) < 1e-9


def test_upserts(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, files.upsert(a, b, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, files.insert_missing(a, b, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, files.update_where(a, F.col("k") == 1, {"v": F.lit("z")}).collect())) == [(1, "z"), (2, "b")]
    assert sorted(map(tuple, files.delete_keys(a, b.select("k")).collect())) == [(1, "a")]


def test_config_is_closed():
    config = signals.EngineConfig().patched({"macd_cross": 3})
    assert config.diff() == {"macd_cross": 3}
    with pytest.raises(KeyError):
        config.patched({"nope": 1})
    with pytest.raises(TypeError):
        config.patched({"macd_cross": "3"})
