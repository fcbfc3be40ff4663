"""Percentiles, resampling, ridge, the engine on odd series, files and streams against plain Python."""

import datetime
import json
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewright.functions import prices
from candlewright.operators import features, joins, positions, signals, simulation, statistics
from candlewright.plans.engine_sql import signals_sql, walk_sql
from candlewright.sources import files, synthetic
from candlewright.streaming import jobs


@pytest.mark.parametrize("kind", ["mid", "upto", "before"])
@pytest.mark.parametrize("n", [7, None])
def test_percentiles_equal_loops(kind, n):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, 60).astype(float)
    x[rng.integers(0, 60, 8)] = np.nan
    got = features.percentile_array(x, n, 3, kind)
    for i, v in enumerate(x):
        lo = 0 if n is None else max(0, i - n + (kind != "before"))
        seen = [u for u in x[lo : i + (kind != "before")] if u == u]
        want = np.nan
        if v == v and len(seen) >= 3:
            want = (sum(u < v for u in seen) + sum(u == v for u in seen) / 2 if kind == "mid" else sum(u <= v for u in seen)) / len(seen)
        assert np.isclose(got[i], want, equal_nan=True)


def moment(text: str, **after) -> datetime.datetime:
    return datetime.datetime.fromisoformat(text) + datetime.timedelta(**after)


#: Without constant series: there every comparison hangs on the last bit of a mean.
ODD = ["none", "zeroCloseLast", "negativeMiddle", "highLowSwapped", "hugeOutlier", "extremeHigh", "microLast", "missingVolume"]


def test_engine_and_walk_equal_sql_on_odd_series(spark):
    frames = []
    for profile in (p for p in synthetic.PROFILES if p != "flat"):
        for kind in ODD:
            f = synthetic.corrupt(synthetic.candles(profile, 240, seed=11), kind)
            frames.append(f.assign(market=["FOREX", "CRYPTO"][len(frames) % 2], symbol=f"{profile}-{kind}", timeframe="1D", bar_idx=np.arange(len(f), dtype=np.int32)))
    all_bars = pd.concat(frames)
    df = spark.createDataFrame(all_bars[["market", "symbol", "timeframe", "ts", "open", "high", "low", "close", "volume", "bar_idx"]], "market string, symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double, bar_idx int")
    con = duckdb.connect()
    con.register("given", all_bars)
    bars_sql = "WITH b AS (SELECT 1 AS one), bars AS (SELECT market, symbol, timeframe, ts, bar_idx, open, high, low, close, volume FROM given)"
    want = con.sql(signals_sql(bars_sql) + " SELECT symbol, bar_idx, has_signal, action, bull, bear, confidence, entry_price, stop_loss, take_profit, reasons FROM sig").df().sort_values(["symbol", "bar_idx"]).reset_index(drop=True)
    scored = signals.all_signals(df).cache()
    got = scored.select("symbol", "bar_idx", "has_signal", "action", "bull", "bear", "confidence", "entry_price", "stop_loss", "take_profit", F.array_join(F.transform("reasons", lambda x: x["label"]), ",").alias("reasons")).toPandas().sort_values(["symbol", "bar_idx"]).reset_index(drop=True)
    live = (want.has_signal == True) & (got.has_signal == True)  # noqa: E712
    assert (want.has_signal == got.has_signal).mean() == 1 and live.sum() > 5000
    for c in ("action", "bull", "bear", "confidence", "reasons"):
        off = live & (want[c] != got[c])
        assert not off.any(), (c, want[off].head(3).to_dict("records"), got[off].head(3).to_dict("records"))
    for c in ("entry_price", "stop_loss", "take_profit"):
        assert np.allclose(want[c][live], got[c][live], rtol=1e-9, atol=1e-9), c
    sound = [s for s in all_bars.symbol.unique() if s.split("-")[1] in ("none", "hugeOutlier", "missingVolume")]
    deals = con.sql(walk_sql(bars_sql) + " SELECT symbol, bar_idx, exit_idx, reason FROM deals").df()
    mine = simulation.walk_forward(scored).where("status = 'deal'").select("symbol", "bar_idx", "exit_idx", "reason").toPandas()
    rows = lambda d: sorted(map(tuple, d[d.symbol.isin(sound)].astype({"bar_idx": int, "exit_idx": int}).values.tolist()))
    assert rows(deals) == rows(mine) and len(mine)
    scored.unpersist()


def test_walk_forward_counts_skips_and_fees(spark):
    frame = synthetic.candles("vshape", 200, seed=4)
    scored = signals.all_signals(synthetic.to_spark(spark, frame)).cache()
    first = simulation.walk_forward(scored).where("status = 'deal'").orderBy("bar_idx").first()
    bad = frame.copy()
    bad.loc[first["bar_idx"] + 1, "open"] = 0.0
    broken = signals.all_signals(synthetic.to_spark(spark, bad))
    out = {r["bar_idx"]: r for r in simulation.walk_forward(broken).collect()}
    assert out[first["bar_idx"]]["status"] == "skipped" and out[first["bar_idx"]]["exit_idx"] is None
    plain, paid = (simulation.walk_forward(scored, fees_r=f).where("status = 'deal'").orderBy("bar_idx").toPandas() for f in (0.0, 0.1))
    assert np.allclose(plain.r - 0.1, paid.r) and (plain.exit_idx == paid.exit_idx).all()
    later = simulation.walk_forward(scored, entries=("2026-05-01", "2026-06-01")).toPandas()
    assert len(later) and later.ts.between("2026-05-01", "2026-06-01").all()
    scored.unpersist()


def test_student_p(spark):
    got = [r[0] for r in spark.createDataFrame([(2.0, 10.0), (0.0, 3.0), (None, 4.0), (-2.571, 5.0)], "t double, d double").select(statistics.student_p("t", "d")).collect()]
    assert got[2] is None and np.allclose([got[0], got[1], got[3]], [0.073388, 1.0, 0.05], atol=1e-4)


def test_constant_ranks_have_no_correlation(spark):
    rows = statistics.spearman(spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 5.0), (2, 2.0, 4.0)], "g int, x double, y double"), "x", "y", ["g"]).orderBy("g").collect()
    assert rows[0]["rho"] is None and np.isclose(rows[1]["rho"], -1)


def test_expanding_ridge_equals_refits(spark):
    rng = np.random.default_rng(9)
    rows = [(t, float(a), float(b), float(0.5 * a - b) + float(rng.normal())) for t in range(6) for a, b in rng.normal(size=(20, 2))]
    got = {r["penalty"]: r for r in statistics.expanding_ridge(spark.createDataFrame(rows, "t int, a double, b double, y double"), ["a", "b"], "y", "t", (1.0, 50.0)).collect()}
    p = pd.DataFrame(rows, columns=["t", "a", "b", "y"])
    for penalty in (1.0, 50.0):
        errors = []
        for at in range(3, 6):
            fit, test = p[p.t < at - 1], p[p.t == at]
            x, y = fit[["a", "b"]].to_numpy(), fit.y.to_numpy()
            mean, dev = x.mean(axis=0), x.std(axis=0)
            z = (x - mean) / dev
            w = np.linalg.solve(z.T @ z + penalty * np.eye(2), z.T @ (y - y.mean()))
            errors += ((test.y - y.mean() - ((test[["a", "b"]].to_numpy() - mean) / dev) @ w) ** 2).tolist()
        assert np.isclose(got[penalty]["error"], np.mean(errors)) and got[penalty]["n"] == len(errors)


def test_bucketed_asof_equals_plain(spark):
    rng = np.random.default_rng(6)
    at = lambda n: [(moment("2026-01-01", minutes=int(m)),) for m in sorted(rng.choice(9000, n, replace=False))]
    left = spark.createDataFrame([(i, t[0]) for i, t in enumerate(at(80))], "id int, ts timestamp_ntz")
    right = spark.createDataFrame([(float(i), t[0]) for i, t in enumerate(at(15))], "v double, ts timestamp_ntz")
    got = {r["id"]: r["r_v"] for r in joins.asof_bucketed(left, right, "ts", ["v"]).collect()}
    r = right.toPandas().sort_values("ts")
    for row in left.collect():
        before = r[r.ts <= row["ts"]]
        assert got[row["id"]] == (before.v.iloc[-1] if len(before) else None)


def test_running_rank_over_cells(spark):
    x = [3.0, 1.0, 1.0, 7.5, 7.5, 7.5, -2.0, 100.0]
    got = {r["i"]: r["rank"] for r in statistics.joined_rank(spark.createDataFrame(list(enumerate(x)), "i int, x double"), "x", "rank").collect()}
    assert [got[i] for i in range(len(x))] == pd.Series(x).rank().tolist()


def test_strict_lookup_fails_on_a_gap(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    table = spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert joins.fallback(left, [(table, ["k"])], "v").where("v IS NULL").count() == 1
    with pytest.raises(Exception, match="no v"):
        joins.fallback(left, [(table, ["k"])], "v", strict=True).collect()


def test_prices_round_and_cost(spark):
    rows = [(1.234565, "FOREX"), (0.0123456789, "CRYPTO"), (0.0123456789, "FOREX"), (98.90605, "GOLD"), (0.0, "GOLD")]
    got = [r[0] for r in spark.createDataFrame(rows, "x double, m string").select(prices.round_price(F.col("x"), F.col("m"))).collect()]
    assert np.allclose(got, [1.23457, 0.0123457, 0.012346, 98.9061, 0.0], atol=1e-12)
    cost = spark.createDataFrame([(10.0, 0.05)], "p double, s double").select(prices.thai_cost_r(F.col("p"), F.col("s"))).first()[0]
    value = prices.RISKED / 0.05
    assert np.isclose(cost, (2 * max(value * prices.COMMISSION, prices.LEAST_FEE) + value * 0.10 / 10.0) / prices.RISKED)


def test_session_and_window(spark):
    t = moment
    rows = [(t("2026-01-02 09:00"), t("2026-01-02 08:00"), t("2026-01-02 10:00")), (t("2026-01-02 11:00"), t("2026-01-02 08:00"), t("2026-01-02 10:00")), (None, t("2026-01-02 12:00"), t("2026-01-02 10:00"))]
    got = [r[0] for r in spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz, n timestamp_ntz").select(positions.session_start(F.col("a"), F.col("b"), F.col("n"))).collect()]
    assert got == [t("2026-01-02 08:00"), t("2026-01-02 08:00"), None]
    q = spark.createDataFrame([(5.0, 4.0, 7.0, t("2026-01-01"), t("2026-01-02")), (5.0, 4.0, 7.0, t("2026-01-03"), t("2026-01-02")), (5.0, None, 4.0, t("2026-01-01"), t("2026-01-02"))], "price double, day_low double, day_high double, opened_at timestamp_ntz, session_start timestamp_ntz")
    assert [(r["win_low"], r["win_high"]) for r in positions.price_window(q).collect()] == [(4.0, 7.0), (5.0, 5.0), (5.0, 5.0)]


def test_files(spark, tmp_path):
    series = {"symbol": "S1", "market": "GOLD", "timeframe": "1D", "quality": {"usable": {"from": "2026-01-02T00:00:00"}, "verdict": "good"}, "candles": [{"timestamp": f"2026-01-0{d}T00:00:00", "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 10.0} for d in (1, 2, 3)]}
    (tmp_path / "candles").mkdir()
    (tmp_path / "candles" / "s1.json").write_text(json.dumps(series))
    (tmp_path / "candles" / "s2.json").write_text(json.dumps(series | {"symbol": "S2", "market": "CRYPTO", "quality": None}))
    path = f"file://{tmp_path}/candles"
    assert {(r["symbol"], r["n"]) for r in files.read_candles(spark, path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).collect()} == {("S1", 2), ("S2", 3)}
    assert [r["symbol"] for r in files.read_metadata(spark, path, markets=["GOLD"]).collect()] == ["S1"]
    assert files.train_only(files.read_candles(spark, path), "2026-01-03").count() == 3
    (tmp_path / "universe.json").write_text(json.dumps({"markets": {"GOLD": [{"symbol": "S1", "name": "one"}], "CRYPTO": [{"symbol": "S2", "name": "two"}, {"symbol": "S3", "name": "three"}]}}))
    assert {(r["market"], r["symbol"]) for r in files.read_universe(spark, f"file://{tmp_path}/universe.json").collect()} == {("GOLD", "S1"), ("CRYPTO", "S2"), ("CRYPTO", "S3")}
    deals = spark.createDataFrame([("GOLD", "S1", "1D", "BUY", 1, 3, 1.0, 2.0, 0.5, 2.0, 2.0, "take_profit", moment("2026-01-01"), moment("2026-01-03"))], files.DEALS)
    files.write_deals(deals, f"{tmp_path}/deals")
    assert files.read_deals(spark, f"{tmp_path}/deals").collect() == deals.collect()
    for _ in range(2):
        files.append(deals.select("symbol", "r"), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    files.write_report(deals.select("symbol", "r"), f"file://{tmp_path}/report", "Deals")
    page = [r[0] for r in spark.read.text(f"file://{tmp_path}/report/page").collect()]
    assert page[0] == "# Deals" and page[-1] == "| S1 | 2.0 |"
    files.write_report(spark.range(2500).select("id", F.when(F.col("id") % 2 == 0, "a|b").alias("x")), f"file://{tmp_path}/long", "All")
    page = [r[0] for r in spark.read.text(f"file://{tmp_path}/long/page").collect()]
    assert len(page) == 2504 and page[4] == "| 0 | a\\|b |" and page[5] == "| 1 |  |" and spark.read.json(f"file://{tmp_path}/long/data").count() == 2500
    digest = files.write_ledger(files.read_deals(spark, f"{tmp_path}/deals"), {"b": 1, "a": 2}, f"file://{tmp_path}/ledger")
    ledger = spark.read.json(f"file://{tmp_path}/ledger").collect()
    assert ledger and all(r["config_hash"] == digest and "deals" in r["input"] for r in ledger)
    assert files.slim(deals, ["symbol", "r", "none"]).columns == ["symbol", "r"]
    changed = files.affected(deals, F.col("r") > 1, {"reason": F.lit("checked")}).collect()
    assert len(changed) == 1 and changed[0]["reason"] == "checked" and files.affected(deals, F.col("r") > 5, {}).count() == 0


def test_positions_close_once(spark, tmp_path):
    schema = "position_id long, direction string, entry_price double, stop_loss double, take_profit double, low double, high double, ts timestamp"
    t = moment("2026-01-01 10:00")
    first = [(1, "long", 10.0, 9.0, 12.0, 9.5, 10.5, t), (2, "short", 10.0, 11.0, 8.0, 7.9, 11.5, t), (3, "long", 10.0, 11.0, 12.0, 9.0, 10.0, t)]
    second = [(1, "long", 10.0, 9.0, 12.0, 8.0, 13.0, t + datetime.timedelta(hours=1)), (2, "short", 10.0, 11.0, 8.0, 7.0, 12.0, t + datetime.timedelta(hours=1)), (3, "long", 10.0, 11.0, 12.0, 9.0, 12.5, t + datetime.timedelta(hours=1))]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = jobs.closes(stream).writeStream.format("memory").queryName("closed_once").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["position_id"], r["outcome"], r["exit_price"]) for r in spark.table("closed_once").collect())
    assert got == [(1, "stop_loss", 9.0), (2, "stop_loss", 11.0), (3, "take_profit", 12.0)]


def test_outcomes_resolve_as_bars_arrive(spark, tmp_path):
    frame = synthetic.candles("side", 60, seed=8)
    bars = synthetic.to_spark(spark, frame).cache()
    rows = bars.where("bar_idx IN (5, 20, 40, 57)").select(F.concat(F.lit("s"), "bar_idx").alias("signal_id"), "market", "symbol", "timeframe", "bar_idx", "ts", F.lit("BUY").alias("action"), F.col("close").alias("entry_price"), (F.col("close") * 0.97).alias("stop_loss"), (F.col("close") * 1.03).alias("take_profit"), (F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("expires_at")).cache()
    sink = jobs.resolver(rows, f"{tmp_path}/bars", f"{tmp_path}/out")
    for number, (lo, hi) in enumerate(((0, 20), (20, 45), (45, 60))):
        part = bars.where((F.col("bar_idx") >= lo) & (F.col("bar_idx") < hi))
        sink(part, number)
        sink(part, number)  # tried again
    got = {r["signal_id"]: (r["outcome"], r["exit_price"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r["signal_id"]: (r["outcome"], r["exit_price"]) for r in simulation.resolve_outcomes(rows, bars).where("outcome IS NOT NULL").collect()}
    assert got == want and len(want) >= 2 and spark.read.parquet(f"{tmp_path}/out").count() == len(want)
    bars.unpersist()
    rows.unpersist()


def test_throttle_equals_loop(spark):
    rng = np.random.default_rng(12)
    rows = [(int(rng.integers(0, 4)), i, moment("2026-01-01", seconds=int(rng.integers(0, 4000)))) for i in range(200)]
    got = {r["n"]: r["allowed"] for r in positions.throttle(spark.createDataFrame(rows, "u int, n int, t timestamp_ntz").repartition(5), "u", "t", "n", 180).collect()}
    last = {}
    for u, n, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        ok = u not in last or (t - last[u]).total_seconds() >= 180
        assert got[n] == ok
        if ok:
            last[u] = t


def test_sign_test_equals_sums(spark):
    rows = [(n, k) for n in (1, 5, 9) for k in range(math.ceil(n / 2), n + 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "n long, k long").select(statistics.sign_test(F.col("k"), F.col("n"))).collect()]
    assert np.allclose(got, [min(1, 2 * sum(math.comb(n, j) for j in range(k, n + 1)) / 2**n) for n, k in rows])
