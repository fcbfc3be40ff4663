"""Bootstraps, permutation tests, sweeps and comparisons against plain loops."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewright.operators import resampling, signals, simulation, statistics, sweep
from candlewright.plans import resampled
from candlewright.sources import synthetic


def count(seed, key, draw, mean=1.0):
    """A cluster's count in a draw, from the definition."""
    x = int(hashlib.md5(f"{seed}:{key}:{draw // 4}".encode()).hexdigest()[8 * (draw % 4) : 8 * (draw % 4) + 8], 16) / 2**32
    k, total = 0, math.exp(-mean)
    while x >= total:
        k += 1
        total += math.exp(-mean) * mean**k / math.factorial(k)
    return k


def interval(values, tail=0.025):
    v = np.array(values)
    return np.quantile(v, tail), np.quantile(v, 1 - tail), min(1.0, 2 * (min((v <= 0).sum(), (v >= 0).sum()) + 1) / (len(v) + 1))


def rows(n=300):
    rng = np.random.default_rng(5)
    return pd.DataFrame([(f"c{i % 12}", int(rng.integers(0, 50)), float(rng.normal(0.1)), "ab"[i % 2]) for i in range(n)], columns=["g", "x", "r", "arm"])


def test_counts_are_poisson():
    counts = [count(3, f"k{i}", d) for i in range(40) for d in range(100)]
    assert abs(np.mean(counts) - 1) < 0.05 and abs(np.var(counts) - 1) < 0.1
    assert [at / 2**32 for at in resampling.limits(1.0)[:3]] == pytest.approx([0.36788, 0.73576, 0.91970], abs=1e-4)


def test_means_per_arm_share_counts(spark):
    p, draws = rows(), 101
    p.loc[p.g == "c3", "arm"] = "a"  # an arm without one of the clusters
    p.loc[7, "r"] = np.nan
    df = spark.createDataFrame(p).withColumn("r", F.nanvl("r", F.lit(None)))
    got = {r["arm"]: r for r in resampling.bootstrap_mean(df, "r", F.col("g"), ["arm"], draws, seed=4).collect()}
    live = p.dropna()
    for arm, own in live.groupby("arm"):
        sums = own.groupby("g").r.agg(["sum", "count"])
        values = []
        for d in range(draws):
            c = np.array([count(4, g, d) for g in sums.index])
            values.append((sums["sum"] * c).sum() / (sums["count"] * c).sum() if c.any() else 0.0)
        lo, hi, q = interval(values)
        assert np.allclose([got[arm][k] for k in ("value", "lo", "hi", "p")], [own.r.mean(), lo, hi, q]) and got[arm]["clusters"] == len(sums)
    wide = resampling.bootstrap_mean(df, "r", F.col("g"), [], draws, seed=4, tests=10).first()
    one = resampling.bootstrap_mean(df, "r", F.col("g"), [], draws, seed=4).first()
    assert wide["lo"] <= one["lo"] <= one["value"] <= one["hi"] <= wide["hi"]
    assert resampling.bootstrap_mean(df.where("g = 'none'"), "r", F.col("g"), ["arm"], draws).collect() == []


def test_blocks(spark):
    p, draws, block = rows(), 60, 3
    got = resampling.bootstrap_mean(spark.createDataFrame(p), "r", F.col("g"), [], draws, seed=2, block=block).first()
    sums = p.groupby("g").r.agg(["sum", "count"]).sort_index()
    values = []
    for d in range(draws):
        starts = [count(2, i, d, 1 / block) for i in range(len(sums))]
        c = np.array([sum(starts[(i - o) % len(sums)] for o in range(block)) for i in range(len(sums))])
        values.append((sums["sum"] * c).sum() / (sums["count"] * c).sum() if c.any() else 0.0)
    assert np.allclose([got["lo"], got["hi"], got["p"]], interval(values))


def test_rank_correlation_and_pairs(spark):
    p, draws = rows(), 80
    df = spark.createDataFrame(p)
    ranked = statistics.joined_rank(statistics.joined_rank(df, "x", "rx"), "r", "ry")
    s = resampling.bootstrap_spearman(ranked, F.col("g"), draws).first()
    q = p.assign(rx=p.x.rank(), ry=p.r.rank())
    values = []
    for d in range(draws):
        z = q.loc[q.index.repeat([count(7, g, d) for g in q.g])]
        values.append(z.rx.corr(z.ry))
    assert np.isclose(s["value"], q.rx.corr(q.ry)) and np.allclose([s["lo"], s["hi"], s["p"]], interval(values))
    d = resampling.paired_bootstrap(df, "r", F.when(F.col("arm") == "a", 1).otherwise(-1), F.col("g"), draws).first()
    sums = p.assign(s=np.where(p.arm == "a", p.r, -p.r)).groupby("g").s.sum()
    assert np.isclose(d["value"], sums.mean()) and d["clusters"] == 12 and d["lo"] <= d["value"] <= d["hi"]


def test_a_hash_is_taken_once_for_four_draws(spark):
    """Every draw's sums, and a plan that adds up before it parts a hash into draws."""
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", -3.0, 1.0), (None, 0.5, 4.0)], "_c string, s double, n double")
    for draws in (1, 6, 9):
        got = {r["draw"]: (r["s"], r["n"]) for r in resampling.draw_sums(df, ["s", "n"], [], draws, 3).collect()}
        own = [[count(3, k, d) for k in ("a", "b", "")] for d in range(draws)]
        assert got == {d: (c[0] - 3 * c[1] + c[2] / 2, 2 * c[0] + c[1] + 4 * c[2]) for d, c in enumerate(own)}
    plan = resampling.draw_sums(df.withColumn("arm", F.col("n")), ["s", "n"], ["arm"], 40, 3)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    assert plan.count("md5(") == 1 and "conv(" not in plan and "Join" not in plan
    assert next(i for i, line in enumerate(lines) if "Generate inline" in line) < next(i for i, line in enumerate(lines) if "Aggregate" in line)


def test_estimates_of_nothing_count_on_both_sides(spark):
    """Tenths whose sum is 0 in some draws, where doubles leave a last bit."""
    tenths, draws = {"a": 1, "b": 2, "c": -3}, 200
    counts = np.array([[count(7, g, d) for g in tenths] for d in range(draws)])
    df = spark.createDataFrame([(g, t / 10) for g, t in tenths.items()], "g string, r double")
    p = interval(counts @ np.array(list(tenths.values())))[2]
    for df in (df, df.withColumn("r", F.col("r") * 2.0**-60)):  # whatever the unit
        assert np.isclose(resampling.bootstrap_mean(df, "r", F.col("g"), [], draws).first()["p"], p)
        assert np.isclose(resampling.paired_bootstrap(df, "r", F.lit(1), F.col("g"), draws).first()["p"], p)
    arms = spark.createDataFrame([("x", side, g, t / 10, 1.0) for side, own in (("left", (1, 2, 4)), ("right", (3, 0, 4))) for g, t in zip("abc", own, strict=True)], "id string, side string, _c string, s double, n double")
    gaps = (counts @ np.array([-2, 2, 0])) / np.maximum(counts.sum(1), 1)
    assert np.isclose(resampling.bootstrap_difference(arms, draws).first()["p"], interval(gaps)[2])


def test_nothing_reaches_the_driver(spark):
    """The plan of a bootstrap holds no collected rows: clusters stay in Spark."""
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("double").alias("r"))
    plan = resampling.bootstrap_mean(df, "r", F.col("id"), [], 40)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "LocalTableScan" not in plan


def test_permutations(spark):
    rng = np.random.default_rng(3)
    x, draws, top = rng.normal(size=14).round(1), 300, 4
    y = (x + rng.normal(size=14)).round(1)
    units = spark.createDataFrame([(f"u{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [("none", None, 1.0)], "u string, x double, y double")
    got = resampling.permutation_test(units, "u", "x", "y", [], top, draws, seed=9).first()
    names = [f"u{i}" for i in range(14)]
    rx, ry = pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy()
    place = {n: i for i, n in enumerate(sorted(names, key=lambda n: (-x[int(n[1:])], n)))}
    best = [i for i in range(14) if place[f"u{i}"] < top]
    seen, rho, lifts, rhos = y[best].mean(), np.corrcoef(rx, ry)[0, 1], 0, 0
    for d in range(draws):
        order = sorted(range(14), key=lambda i: (hashlib.md5(f"9:{d}:u{i}".encode()).hexdigest(), f"u{i}"))
        at = {k: order[k] for k in range(14)}  # the unit that takes place k
        lifts += np.mean([y[at[k]] for k in range(top)]) >= seen - 1e-9
        to = sorted(range(14), key=lambda i: place[f"u{i}"])
        rhos += np.corrcoef(rx[to], ry[[at[k] for k in range(14)]])[0, 1] >= rho - 1e-9
    assert np.isclose(got["rho"], rho) and np.isclose(got["top_y"], seen) and got["n"] == 14
    assert np.isclose(got["lift_p"], (1 + lifts) / (draws + 1)) and np.isclose(got["rho_p"], (1 + rhos) / (draws + 1))


@pytest.fixture(scope="module")
def bars(spark):
    out = None
    for k, profile in enumerate(("side", "chop", "vshape")):
        own = synthetic.to_spark(spark, synthetic.candles(profile, 260, seed=k)).withColumn("symbol", F.lit(f"S{k}"))
        out = own if out is None else out.unionByName(own)
    return out.cache()


def test_each_arm_equals_its_own_walk(spark, bars):
    deals = sweep.sweep(bars, sweep.DIAGNOSTIC).toPandas()
    key = ["symbol", "bar_idx", "action", "exit_idx", "reason"]
    configs = {"baseline": {}, "reasons99": {}, "off:rsiZone": {"rsi_extreme": 0}, "off:macdCross": {"macd_cross": 0}, "off:trend": {"trend_confirmed": 0, "trend_short": 0}, "off:srScore": {"level": 0}, "exits:tp1": {"target_atr": 1.0}, "exits:sl3tp3": {"stop_atr": 3.0},
               "off:patterns": {"bullish_engulfing": 0, "hammer": 0, "bearish_engulfing": 0, "shooting_star": 0}}
    for arm, patch in configs.items():
        walk = simulation.walk_forward(signals.all_signals(bars, signals.EngineConfig().patched(patch))).where("status = 'deal'").toPandas()
        own = deals[deals.arm == arm]
        assert sorted(own[key].itertuples(index=False)) == sorted(walk[key].itertuples(index=False)) and len(own) > 3, arm
        assert np.isclose(own.r.sum(), walk.r.sum())


def test_null_arms_take_every_bar_they_can(bars):
    deals = sweep.sweep(bars, sweep.ABLATION).toPandas()
    for arm, action in (("N1", "BUY"), ("N2", "SELL")):
        own = deals[deals.arm == arm].sort_values(["symbol", "bar_idx"])
        assert set(own.action) == {action} and (own.groupby("symbol").bar_idx.min() == 60).all()
        for _, one in own.groupby("symbol"):
            assert (one.bar_idx.to_numpy()[1:] == one.exit_idx.to_numpy()[:-1]).all()
    news = deals[deals.arm.isin(["B0", "L10"])].groupby("arm").r.sum()
    assert news["B0"] == news["L10"]
    with pytest.raises(KeyError):
        sweep.Arm("x", ("nope",))


def test_comparisons(spark, bars):
    deals = sweep.sweep(bars, sweep.ABLATION).cache()
    got = {r["id"]: r for r in resampled.compared(spark, deals, 50).collect()}
    p = deals.toPandas()
    p["cohort"] = np.where(p.trend == "sideways", "sideways", np.where((p.trend == "uptrend") == (p.action == "BUY"), "aligned", "counter"))
    b = p[p.arm == "B0"]
    for name, arm in (("H1", "F1"), ("H26", "L10")):
        assert np.isclose(got[name]["diff"], p[p.arm == arm].r.mean() - b.r.mean())
    if {"aligned", "sideways"} <= set(b.cohort):
        assert np.isclose(got["H9"]["diff"], b[b.cohort == "aligned"].r.mean() - b[b.cohort == "sideways"].r.mean())
    share, n = (b.action == "BUY").mean(), {a: p[p.arm == a].r for a in ("N1", "N2")}
    mixed = (n["N1"].sum() * share + n["N2"].sum() * (1 - share)) / (len(n["N1"]) * share + len(n["N2"]) * (1 - share))
    assert np.isclose(got["H11"]["right"], mixed)
    assert got["H26"]["diff"] == 0 and got["H26"]["p"] == 1
    adjusted, run = defaultdict(float), 0.0
    order = sorted(got.values(), key=lambda r: (r["p"], r["id"]))
    for k, r in enumerate(order):
        run = max(run, min(1.0, (len(order) - k) * r["p"]))
        adjusted[r["id"]] = run
    assert all(np.isclose(r["holm_p"], adjusted[r["id"]]) for r in order)
    deals.unpersist()
