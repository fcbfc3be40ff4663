"""Block scans, levels and exact rounding against plain loops."""

import random
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewright.functions.prices import exact_round
from candlewright.operators import indicators, scans

SCHEMA = "market string, symbol string, timeframe string, bar_idx int, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, n, missing=(), seed=1):
    rng = np.random.default_rng(seed)
    close = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))), 2)
    rows = [("GOLD", "A", "1H", i, np.datetime64("2020-01-01T00", "us").astype("datetime64[us]").item() + np.timedelta64(i, "h").item(), float(c), float(c) + 1, float(c) - 1, None if i in missing else float(c), 1.0) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, SCHEMA), close


def ema(x, n):
    out = [None] * (n - 1) + [float(np.mean(x[:n]))]
    for v in x[n:]:
        out.append(v * 2 / (n + 1) + out[-1] * (1 - 2 / (n + 1)))
    return out


def rsi(x, n=14):
    d = np.diff(x)
    g, s = float(np.maximum(d[:n], 0).mean()), float(np.maximum(-d[:n], 0).mean())
    out = [None] * n + [100.0 if s == 0 else 100 - 100 / (1 + g / s)]
    for v in d[n:]:
        g, s = (g * (n - 1) + max(v, 0)) / n, (s * (n - 1) + max(-v, 0)) / n
        out.append(100.0 if s == 0 else 100 - 100 / (1 + g / s))
    return out


def same(got, want, tolerance=1e-9):
    assert [g is None for g in got] == [w is None for w in want]
    assert np.allclose([g for g in got if g is not None], [w for w in want if w is not None], rtol=tolerance, atol=tolerance)


@pytest.mark.parametrize(("n", "chunk"), [(3300, 1024), (3300, 16_384), (20, 1024), (1, 1024)])
def test_recursive_indicators(spark, n, chunk):
    df, close = bars(spark, n)
    rows = indicators.with_recursive(df, chunk).orderBy("bar_idx").collect()
    assert [r["bar_idx"] for r in rows] == list(range(n))
    if n < 14:
        assert all(r[c] is None for r in rows for c in indicators.RECURSIVE)
        return
    for k in (12, 20, 26):
        same([r[f"ema{k}"] for r in rows], ema(close, k)[:n])
    same([r["rsi14"] for r in rows], rsi(close))
    if n > 40:
        macd = [a - b for a, b in zip(ema(close, 12)[25:], ema(close, 26)[25:], strict=True)]
        same([r["macd"] for r in rows][25:], macd)
        same([r["macd_signal"] for r in rows][25:], ema(macd, 9))


def test_chunks_of_one_series_go_to_several_tasks(spark):
    df, _ = bars(spark, 6000)
    placed = scans.in_chunks(df, indicators.SILENT, chunk=1024).withColumn("n", F.count("close").over(scans.chunk_window())).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts so few rows together again
    try:
        assert placed.select("task").distinct().count() > 1
        assert placed.groupBy("_chunk").agg(F.countDistinct("task").alias("n")).where("n > 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "ArrowEval" not in (plan := indicators.with_recursive(df)._jdf.queryExecution().toString()) and "FlatMapGroups" not in plan and "Python" not in plan


def test_a_missing_close_has_no_weight_after_a_while(spark):
    df, close = bars(spark, 2500, missing=(700,))
    rows = indicators.with_recursive(df, 1024).orderBy("bar_idx").collect()
    assert all((r["ema20"] is None) == (i < 19 or 700 <= i < 700 + indicators.SILENT) for i, r in enumerate(rows))
    after = 700 + indicators.SILENT
    same([r["ema20"] for r in rows[after:]], ema(close, 20)[after:])
    same([r["rsi14"] for r in rows[after:]], rsi(close)[after:])


@pytest.mark.parametrize("missing", [(), (5, 900, 901)])
def test_volatility(spark, missing):
    df, close = bars(spark, 2100, missing)
    want, v, x = [None], None, [None if i in missing else c for i, c in enumerate(close)]
    for a, b in zip(x, x[1:]):
        r = None if a is None or b is None else float(np.log(b) - np.log(a))
        v = None if r is None else r * r if v is None else 0.94 * v + 0.06 * r * r
        want.append(None if v is None else v**0.5)
    same([r["ewma_vol"] for r in indicators.with_volatility(df, chunk=1024).orderBy("bar_idx").collect()], want)


def test_levels(spark):
    df, _ = bars(spark, 900, seed=4)
    df = df.withColumn("low", F.round("low", 0)).withColumn("high", F.round("high", 0))  # so that levels come again
    rows = indicators.with_levels(df).orderBy("bar_idx").collect()
    for column, price, sign in (("supports", "low", -1), ("resistances", "high", 1)):
        p, seen = [r[price] for r in rows], []
        for i, r in enumerate(rows):
            j = i - 5
            if j >= 5 and all(sign * p[j] > sign * p[q] for q in [*range(j - 5, j), *range(j + 1, j + 6)]) and round(p[j], 4) not in seen:
                seen.append(round(p[j], 4))
            assert r[column] == sorted(seen[-3:], reverse=sign < 0), i
        assert len(seen) > 5


def test_exact_round(spark):
    rng = random.Random(6)
    x = [k / 4000 for k in range(-400, 400)] + [k / 32 for k in range(50)] + [rng.uniform(-1e4, 1e4) for _ in range(500)] + [0.0, 1e15, 1e18, 2.5, 1.00005, 2.675, 0.125, 1e-9]
    x += [np.nextafter(v, s) for v in (1.00005, 0.00025, 154.31255) for s in (0, 1e9)]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for p in (2, 4):
        unit = Decimal(1).scaleb(-p)
        for r in df.select("x", exact_round(F.col("x"), p).alias("up"), exact_round(F.col("x"), p, even=True).alias("even")).collect():
            exact = Decimal(r["x"])
            assert r["up"] == float(exact.quantize(unit, ROUND_HALF_UP)) and r["even"] == float(exact.quantize(unit, ROUND_HALF_EVEN)), r
    assert spark.range(1).select(exact_round(F.lit(None).cast("double"), 2)).first()[0] is None
