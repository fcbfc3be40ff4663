"""Ingest, keyed writes, replay of stored deals, the scorecard and ranks of a growing past, against plain loops."""

import datetime
import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewright.operators import features, scorecard, signals, simulation
from candlewright.sources import files, ingest, partitioned, synthetic

BARS = "market string, symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def day(n, hours=0):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n, hours=hours)


def test_splits(spark):
    bars = spark.createDataFrame([("M", s, "1D", day(d), 60.0, 66.0, 54.0, 60.0, 10.0) for s in "AB" for d in range(6)], BARS)
    splits = spark.createDataFrame([("M", "A", "1D", day(2), 2.0), ("M", "A", "1D", day(4), 3.0), ("M", "A", "1D", day(4), 5.0), ("M", "A", "1D", day(1), 0.0), ("M", "A", "1D", day(3), None), ("M", "A", "1D", day(9), 2.0)], "market string, symbol string, timeframe string, ts timestamp_ntz, ratio double")
    got = {(r["symbol"], (r["ts"] - day(0)).days): (r["split_factor"], r["close"], r["volume"]) for r in ingest.split_adjusted(bars, splits).collect()}
    want = {0: 60.0, 1: 60.0, 2: 30.0, 3: 30.0, 4: 2.0, 5: 2.0}  # a split after the last bar counts for all
    assert got == {("A", d): (f, 60.0 / f, 10.0 * f) for d, f in want.items()} | {("B", d): (1.0, 60.0, 10.0) for d in range(6)}
    assert ingest.split_adjusted(bars, splits.limit(0)).where("split_factor <> 1").count() == 0 == ingest.split_adjusted(bars.limit(0), splits).count()


def test_verdicts_and_cleaning(spark):
    nan = float("nan")
    good = [("M", "good", "1D", day(d), 1.0, 2.0, 0.5, 1.5, 7.0) for d in range(5)]
    rows = good + [("M", "good", "1D", day(5), 1.0, 2.0, 0.5, None, 7.0), ("M", "good", "1D", day(6), 1.0, 0.4, 0.5, 1.0, 7.0), ("M", "good", "1D", day(7), 1.0, 2.0, 0.5, 1.5, nan), ("M", "good", "1D", day(8), 1.0, 2.0, 0.5, 1.5, 7.0)]
    rows += [("M", "coarse", "1H", day(d), 1.0, 2.0, 0.5, 1.5, 7.0) for d in range(5)] + [("M", "empty", "1D", day(d), -1.0, 2.0, 0.5, 1.5, 7.0) for d in range(3)] + [("M", "one", "1D", day(0), 1.0, 2.0, 0.5, 1.5, 7.0)]
    raw, at = spark.createDataFrame(rows, BARS), F.lit(day(8, 12)).cast("timestamp_ntz")
    v = ingest.verdicts(raw, at)
    assert {r["symbol"]: (r["reason"], r["raw_bars"], r["unfinished"], r["null_or_nan"], r["inverted"], r["bars"]) for r in v.collect()} == {
        "good": (None, 9, 1, 1, 1, 6), "coarse": ("granularity", 5, 0, 0, 0, 5), "empty": ("no_bars", 3, 0, 3, 0, 0), "one": (None, 1, 0, 0, 0, 1)}
    bars = ingest.cleaned(raw, v, at).collect()
    assert sorted((r["symbol"], (r["ts"] - day(0)).days, r["volume"]) for r in bars) == sorted([("good", d, 7.0) for d in range(5)] + [("good", 7, 0.0), ("one", 0, 7.0)])


def names(path):
    return {p: sorted(os.path.basename(f) for f in glob.glob(f"{path}/p={p}/*.parquet")) for p in "abcde"}


def test_keyed_writes_touch_only_their_partitions(spark, tmp_path):
    path, by = f"{tmp_path}/t", ["p"]
    partitioned.create(spark.createDataFrame([(f"{p}{i}", i, p) for p in "abcde" for i in range(4)], "k string, v int, p string"), path, by)
    rows = lambda: {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    before = names(path)
    new = spark.createDataFrame([("a1", 100, "a"), ("b9", 900, "b"), ("b9", 901, "b")], "k string, v int, p string")
    assert partitioned.upsert(spark, path, new, ["k"], by, [F.desc("v")]) == 1
    after = names(path)
    assert all(after[p] == before[p] for p in "cde") and all(not set(after[p]) & set(before[p]) for p in "ab")
    assert rows()["a1"] == 100 and rows()["b9"] == 901 and len(rows()) == 21
    assert partitioned.insert_missing(spark, path, spark.createDataFrame([("c0", 7, "c"), ("c7", 7, "c")], "k string, v int, p string"), ["k"], by) == 2
    assert rows()["c0"] == 0 and rows()["c7"] == 7
    assert partitioned.update_where(spark, path, F.col("k") == "d2", {"v": F.lit(-1)}, by) == 3 and rows()["d2"] == -1 and names(path)["e"] == before["e"]
    assert partitioned.delete_keys(spark, path, spark.createDataFrame([(f"e{i}", "e") for i in range(4)], "k string, p string"), by) == 4
    assert not os.path.exists(f"{path}/p=e") and not any(k.startswith("e") for k in rows()) and len(rows()) == 18
    held = names(path)
    with pytest.raises(partitioned.Conflict):  # begun from a version that is no longer the last
        partitioned.upsert(spark, path, new, ["k"], by, base=2)
    assert names(path) == held and not glob.glob(f"{path}/_staged*") and partitioned.version(spark, path) == 4
    assert partitioned.update_where(spark, path, F.col("k") == "none", {"v": F.lit(0)}, by) == 4  # nothing to change, no version


def test_stored_deals_are_replayed(spark, tmp_path):
    bars = synthetic.to_spark(spark, synthetic.candles("chop", 400, seed=6)).cache()
    deals = simulation.walk_forward(signals.all_signals(bars)).where("status = 'deal'").select("market", "symbol", "timeframe", "action", (F.col("bar_idx") + 1).alias("entry_idx"), "exit_idx", "entry", "exit", "stop_loss", "take_profit", "r", "reason", F.col("entry_ts").cast("timestamp").alias("entry_ts"), F.col("exit_ts").cast("timestamp").alias("exit_ts"))
    files.write_deals(deals, f"{tmp_path}/deals")
    stored = files.read_deals(spark, f"{tmp_path}/deals").withColumn("hold_bars", F.col("exit_idx") - F.col("entry_idx")).withColumn("entry_ts", F.col("entry_ts").cast("timestamp_ntz"))
    n = stored.count()
    clean = simulation.replay_faults(simulation.replayed(stored, bars)).first()
    assert n > 10 and (clean["checked"], clean["missing"], clean["exit_off"], clean["reason_off"]) == (n, 0, 0, 0)
    first = stored.orderBy("entry_idx").first()["entry_idx"]
    altered = stored.withColumn("exit", F.when(F.col("entry_idx") == first, F.col("exit") + 0.5).otherwise(F.col("exit")))
    again = simulation.replayed(altered, bars)
    assert simulation.replay_faults(again).first()["exit_off"] == 1 and again.where("abs(again_exit - exit) > 0.4").first()["entry_idx"] == first
    bars.unpersist()


def test_scorecard(spark, tmp_path):
    at = day(3)
    deals = [("M", "A", "1H", "take_profit", 1, 2.0, at, True)] * 3 + [("M", "A", "1H", "stop_loss", 1, -1.0, at, True)] + [("M", "B", "1H", "time_exit", 5, 0.5, at, False)] * 2 + [("N", "C", "1D", "gap_target", 2, 1.0, at, False)]
    df = spark.createDataFrame(deals, "market string, symbol string, timeframe string, reason string, held int, r double, exit_ts timestamp_ntz, gated boolean")
    policy = spark.createDataFrame([("1H", True, False, True)], scorecard.POLICY)
    card = scorecard.build(df, policy, 3, "v1")
    scorecard.write(card, f"file://{tmp_path}/card")
    scorecard.write(scorecard.build(df.withColumn("exit_ts", F.col("exit_ts") + F.expr("INTERVAL 1 DAY")).where("symbol <> 'B'"), policy, 3, "v2"), f"file://{tmp_path}/card")
    old, new = (scorecard.read(spark, f"file://{tmp_path}/card", v) for v in ("v1", None))
    assert {r["version"] for r in new.collect()} == {"v2"} and old.count() == 2
    asked = spark.createDataFrame([("A", "M", "1H"), ("B", "M", "1H"), ("Z", "M", "1H"), ("Z", "X", "1H"), ("C", "N", "1D"), ("Z", "Z", "4H")], "symbol string, market string, timeframe string")
    got = {(r["symbol"], r["market"], r["timeframe"]): r for r in scorecard.speed(asked, old).collect()}
    show = lambda *k: (got[k]["basis"], got[k]["sample_size"], got[k]["score"], got[k]["p_target2"], got[k]["result2"], got[k]["gated_n"], got[k]["may_rank_by_profit"], list(got[k]["warnings"]))
    assert show("A", "M", "1H") == ("pair", 4, 50, 0.75, 1.25, 4, False, ["rarely_within_one"])
    assert show("B", "M", "1H") == ("market", 6, 50, 0.5, pytest.approx(5 / 6), 4, False, ["few_deals", "rarely_within_one"])
    assert show("Z", "M", "1H")[-1] == ["unknown_pair", "rarely_within_one"] and show("Z", "X", "1H")[:2] == ("timeframe", 6)
    assert show("C", "N", "1D") == ("market", 1, 0, 1.0, 1.0, 0, False, ["not_measurable", "few_deals"])
    assert show("Z", "Z", "4H") == ("none", 0, 50, None, None, 0, False, ["not_measurable", "pairs_not_proven", "no_data"])
    assert json.loads(spark.read.text(f"file://{tmp_path}/card").first()[0])["pairs"]


def test_scorecard_without_deals_keeps_its_policy(spark, tmp_path):
    none = spark.createDataFrame([], "market string, symbol string, timeframe string, reason string, held int, r double, exit_ts timestamp_ntz, gated boolean")
    card = scorecard.build(none, spark.createDataFrame([("1H", True, True, True)], scorecard.POLICY), 3, "v1")
    scorecard.write(card, f"file://{tmp_path}/card")
    asked = spark.createDataFrame([("A", "M", "1H"), ("A", "M", "4H")], "symbol string, market string, timeframe string")
    for c in (card, scorecard.read(spark, f"file://{tmp_path}/card", "v1")):
        got = {r["timeframe"]: (r["basis"], r["sample_size"], r["score"], r["p_target2"], r["gated_n"], r["may_rank_by_profit"], list(r["warnings"])) for r in scorecard.speed(asked, c).collect()}
        assert got == {"1H": ("none", 0, 50, None, 0, True, ["unknown_pair", "no_data"]), "4H": ("none", 0, 50, None, 0, False, ["not_measurable", "pairs_not_proven", "no_data"])}


@pytest.mark.parametrize("kind", ["mid", "upto", "before"])
def test_ranks_of_a_growing_past(kind):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 333):
        x = rng.integers(0, 20, n).astype(float)
        x[rng.random(n) < 0.1] = np.nan
        want = np.full(n, np.nan)
        for i, v in enumerate(x):
            past = x[: i + (kind != "before")]
            past = past[~np.isnan(past)]
            if v == v and len(past) >= 5:
                want[i] = ((past < v).sum() + (past == v).sum() / 2 if kind == "mid" else (past <= v).sum()) / len(past)
        assert np.allclose(features.percentile_array(x, None, 5, kind), want, equal_nan=True)
    big = rng.normal(size=300_000)  # a list would take minutes
    got = features.percentile_array(big, None, 1, "upto")
    assert got[0] == 1 and abs(np.nanmean(got) - 0.5) < 0.01
