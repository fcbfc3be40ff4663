"""Named queries of the research side: percentiles, regimes, baselines, audits, gates, scores.

As elsewhere, each has SQL of its own, and values are rounded where two engines sum in different orders."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from candlewright.functions import prices
from candlewright.operators import features, indicators, joins, scorecard, simulation, statistics
from candlewright.operators import signals as engine
from candlewright.plans.engine_sql import signals_sql, walk_sql
from candlewright.plans.queries import DAILY_SQL, DEALS_SQL, HOURLY_SQL, KEY, KEYS, P, SIGNALS_SQL, TR_SQL, closed_deals, flat_signals, r6, register
from candlewright.plans.studies import COST_SQL, MARKET_SQL
from candlewright.sources.bars import SERIES, daily_bars, hourly_bars, market_of, series, table

SAME = "b.market = a.market AND b.symbol = a.symbol AND b.timeframe = a.timeframe"


def r8(value: Column | str, name: str) -> Column:
    return F.round(value, 8).alias(name)


# Percentiles of a value among its own past


def _percentile_sql(x: str, before: int | None, least: int, kind: str) -> str:
    share = {"mid": "(count(*) FILTER (b.v < a.v) + count(*) FILTER (b.v = a.v) / 2) / count(*)", "upto": "count(*) FILTER (b.v <= a.v) / count(*)", "before": "count(*) FILTER (b.v <= a.v) / count(*)"}[kind]
    reach = "b.bar_idx <= a.bar_idx" if before is None else f"b.bar_idx BETWEEN a.bar_idx - {before} AND a.bar_idx{' - 1' if kind == 'before' else ''}"
    return f", x AS (SELECT *, {x} AS v FROM s WHERE {x} IS NOT NULL) SELECT a.market, a.symbol, a.timeframe, a.ts, round({share}, 6) AS pct FROM x a JOIN x b ON {SAME} AND {reach} GROUP BY ALL HAVING count(*) >= {least}"


@register(HOURLY_SQL + ", s AS (SELECT * FROM bars)" + _percentile_sql("round(close, 9)", 249, 150, "mid"))
def percentile_causal(spark, sf_dir):
    b = hourly_bars(spark, sf_dir).withColumn("v", F.round("close", 9))
    return features.percentiles(b, {"v": "pct"}, 250, 150).where("pct IS NOT NULL").select(*KEY, *r6("pct"))


@register(HOURLY_SQL + TR_SQL + ", s AS (SELECT * FROM atr)" + _percentile_sql("round(atr / close, 9)", None, 250, "upto"))
def percentile_expanding(spark, sf_dir):
    """Share of all ATR shares so far that are not above the current one."""
    b = indicators.with_atr(hourly_bars(spark, sf_dir)).withColumn("v", F.round(F.col("atr") / F.col("close"), 9))
    return features.percentiles(b, {"v": "pct"}, None, 250, "upto").where("pct IS NOT NULL").select(*KEY, *r6("pct"))


@register(HOURLY_SQL + ", s AS (SELECT * FROM bars)" + _percentile_sql("volume", 250, 30, "before"))
def percentile_trailing(spark, sf_dir):
    return features.percentiles(hourly_bars(spark, sf_dir), {"volume": "pct"}, 250, 30, "before").where("pct IS NOT NULL").select(*KEY, *r6("pct"))


@register(HOURLY_SQL + f", q AS (SELECT *, round(ln(close / lag(close) {P})), 9) AS m, round((high - low) / close, 9) AS w FROM bars), s AS (SELECT market, symbol, timeframe, ts, bar_idx, unnest(['move', 'width']) AS name, unnest([m, w]) AS v FROM q), x AS (SELECT * FROM s WHERE v IS NOT NULL) SELECT a.market, a.symbol, a.timeframe, a.ts, a.name, round((count(*) FILTER (b.v < a.v) + count(*) FILTER (b.v = a.v) / 2) / count(*), 6) AS pct FROM x a JOIN x b ON {SAME} AND b.name = a.name AND b.bar_idx BETWEEN a.bar_idx - 99 AND a.bar_idx GROUP BY ALL HAVING count(*) >= 60")
def percentile_series(spark, sf_dir):
    """Percentiles of several features in one pass over each series."""
    b = features.with_returns(hourly_bars(spark, sf_dir)).withColumn("m", F.round("log_ret", 9)).withColumn("w", F.round((F.col("high") - F.col("low")) / F.col("close"), 9))
    p = features.percentiles(b.select(*KEY, "m", "w"), {"m": "move", "w": "width"}, 100, 60)
    return p.select(*KEY, F.explode(F.create_map(F.lit("move"), "move", F.lit("width"), "width")).alias("name", "pct")).where("pct IS NOT NULL").select(*KEY, "name", *r6("pct"))


# Features against the group


@register(DAILY_SQL + """, n AS (SELECT DISTINCT market, symbol, timeframe FROM bars), t AS (SELECT DISTINCT timeframe, ts FROM bars), g AS (SELECT n.market, n.symbol, n.timeframe, t.ts, bars.close FROM n JOIN t ON t.timeframe = n.timeframe LEFT JOIN bars ON bars.symbol = n.symbol AND bars.market = n.market AND bars.timeframe = n.timeframe AND bars.ts = t.ts),
f AS (SELECT *, last_value(close IGNORE NULLS) OVER w AS filled, first_value(close IGNORE NULLS) OVER w AS opening FROM g WINDOW w AS (PARTITION BY market, symbol, timeframe ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT market, symbol, timeframe, ts, round(filled, 9) AS filled, round(ln(filled / opening), 6) AS cum FROM f""")
def cumulative_return(spark, sf_dir):
    """On the grid of all times: the last known price and the sum of log returns so far."""
    return features.cumulative(joins.on_grid(daily_bars(spark, sf_dir))).select(*KEY, F.round("filled", 9).alias("filled"), *r6("cum"))


INDEX_SQL = DAILY_SQL + f""", l AS (SELECT *, ln(close / lag(close) {P})) AS x, ln(close) - ln(lag(close, 20) {P})) AS m20 FROM bars), st AS (SELECT timeframe, ts, avg(x) AS ir FROM l WHERE x IS NOT NULL GROUP BY ALL), ic AS (SELECT *, sum(ir) OVER (PARTITION BY timeframe ORDER BY ts ROWS UNBOUNDED PRECEDING) AS icum FROM st),
j AS (SELECT l.*, CASE WHEN x IS NOT NULL THEN ir END AS ir, icum, CASE WHEN ir IS NOT NULL THEN x END AS xx FROM l LEFT JOIN ic ON ic.timeframe = l.timeframe AND ic.ts = l.ts),
k AS (SELECT *, CASE WHEN count(xx) {P} ROWS 59 PRECEDING) = 60 THEN corr(xx, ir) {P} ROWS 59 PRECEDING) END AS c60, CASE WHEN count(xx) {P} ROWS 119 PRECEDING) = 120 THEN regr_slope(xx, ir) {P} ROWS 119 PRECEDING) END AS b120 FROM j),
ix AS (SELECT *, c60 - lag(c60, 60) {P}) AS cc, m20 - b120 * (icum - lag(icum, 20) {P})) AS idio FROM k)"""


@register(INDEX_SQL + f" SELECT {KEYS}, round(c60, 5) AS corr60, round(cc, 5) AS corr_change, round(b120, 5) AS beta120, round(idio, 5) AS idio20 FROM ix WHERE c60 IS NOT NULL")
def index_features(spark, sf_dir):
    """Correlation with the equal-weight index and its change, beta, and momentum beyond beta."""
    b = features.against_index(daily_bars(spark, sf_dir)).where("corr60 IS NOT NULL")
    return b.select(*KEY, *[F.round(c, 5).alias(c) for c in ("corr60", "corr_change", "beta120", "idio20")])


@register(INDEX_SQL + """, g AS (SELECT timeframe, ts, CASE WHEN count(x) >= 3 THEN avg(CASE WHEN x > 0 THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END) - 0.5 END AS b1, CASE WHEN count(m20) >= 3 THEN avg(CASE WHEN m20 > 0 THEN 1.0 WHEN m20 IS NOT NULL THEN 0.0 END) - 0.5 END AS b20, CASE WHEN count(m20) >= 3 THEN stddev_pop(m20) END AS d, CASE WHEN count(c60) >= 3 THEN avg(c60) END AS c FROM ix GROUP BY ALL),
z AS (SELECT *, CASE WHEN count(d) OVER w = 20 AND stddev_pop(d) OVER w > 1e-12 THEN (d - avg(d) OVER w) / stddev_pop(d) OVER w END AS dz, CASE WHEN count(c) OVER w = 20 AND stddev_pop(c) OVER w > 1e-12 THEN (c - avg(c) OVER w) / stddev_pop(c) OVER w END AS cz FROM g WINDOW w AS (PARTITION BY timeframe ORDER BY ts ROWS 19 PRECEDING))
SELECT timeframe, ts, round(b1, 6) AS breadth1, round(b20, 6) AS breadth20, round(dz, 5) AS disp_z, round(cz, 5) AS corr_z FROM z""")
def group_breadth(spark, sf_dir):
    return features.group_breadth(daily_bars(spark, sf_dir)).select("timeframe", "ts", *r6("breadth1", "breadth20"), F.round("disp_z", 5).alias("disp_z"), F.round("corr_z", 5).alias("corr_z"))


@register(HOURLY_SQL + """, c AS (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lt FROM bars), d AS (SELECT *, CAST(lt AS DATE) AS day FROM c), e AS (SELECT *, row_number() OVER (PARTITION BY market, symbol, timeframe, day ORDER BY ts) AS i, count(*) OVER (PARTITION BY market, symbol, timeframe, day) AS n FROM d)
SELECT market, symbol, timeframe, ts, i = 1 AS is_open_bar, i = n AS is_late_bar, hour(ts) >= 13 AND hour(ts) < 16 AS overlap, hour(ts) < 7 AS quiet, dayofweek(lt) = 1 AS monday, dayofweek(lt) = 5 AS friday, round(least(1.0, (i - 1) / 23), 6) AS progress FROM e""")
def calendar_sessions(spark, sf_dir):
    b = features.sessions(features.calendar(hourly_bars(spark, sf_dir)))
    return b.select(*KEY, "is_open_bar", "is_late_bar", "overlap", "quiet", "monday", "friday", *r6("progress"))


@register(DAILY_SQL + TR_SQL + f""", v AS (SELECT *, (high - low) / close AS sp, (high + low + close) / 3 AS tp, lag(close) {P}) AS before FROM atr),
f AS (SELECT *, avg(sp) {P} ROWS 19 PRECEDING) AS sm, stddev_pop(sp) {P} ROWS 19 PRECEDING) AS sd, count(sp) {P} ROWS 19 PRECEDING) AS n20, avg(true_range) {P} ROWS 4 PRECEDING) AS a5, avg(true_range) {P} ROWS 19 PRECEDING) AS a20, count(true_range) {P} ROWS 4 PRECEDING) AS c5, count(true_range) {P} ROWS 19 PRECEDING) AS c20,
 sum(tp * volume) {P} ROWS 19 PRECEDING) / sum(volume) {P} ROWS 19 PRECEDING) AS vw, stddev_pop(close) {P} ROWS 19 PRECEDING) AS cd, avg(close) {P} ROWS 19 PRECEDING) AS cm FROM v)
SELECT {KEYS}, round(CASE WHEN n20 >= 15 AND round(sd, 12) > 0 THEN (sp - sm) / sd END, 5) AS range_z20, round(CASE WHEN c5 >= 4 AND c20 >= 15 AND a5 > 0 AND a20 > 0 THEN ln(a5 / a20) END, 6) AS squeeze, round(CASE WHEN n20 = 20 THEN 4 * cd / cm END, 6) AS bb_width, round(CASE WHEN atr > 0 THEN (open - before) / atr END, 6) AS gap_atr,
 round(CASE WHEN n20 >= 12 AND atr > 0 THEN (close - vw) / atr END, 6) AS vwap_atr, round(greatest((greatest(open, close) - high) / close, (low - least(open, close)) / close, 0), 8) AS out_of_range FROM f""")
def range_features(spark, sf_dir):
    b = features.range_features(indicators.with_atr(daily_bars(spark, sf_dir)))
    return b.select(*KEY, F.round("range_z20", 5).alias("range_z20"), *r6("squeeze", "bb_width", "gap_atr", "vwap_atr"), r8("out_of_range", "out_of_range"))


@register(HOURLY_SQL + TR_SQL + f", w AS (SELECT *, lag(close) {P}) AS c1, lag(close, 2) {P}) AS c2, lag(open) {P}) AS o1, lag(atr) {P}) AS a1 FROM atr) SELECT {KEYS}, round((open - c1) / c1 / (a1 / c1), 6) AS gap_z, round(-coalesce((c1 - c2) / c2, (c1 - o1) / o1) / (a1 / c1), 6) AS rev_prev FROM w WHERE a1 > 0")
def gap_reversal(spark, sf_dir):
    return features.gap_features(indicators.with_atr(hourly_bars(spark, sf_dir))).where("gap_z IS NOT NULL").select(*KEY, *r6("gap_z", "rev_prev"))


@register(DAILY_SQL + f""", l AS (SELECT *, ln(volume * close) AS t FROM bars), m AS (SELECT *, avg(t) {P} ROWS 19 PRECEDING) AS tm, stddev_pop(t) {P} ROWS 19 PRECEDING) AS td, avg(volume) {P} ROWS 19 PRECEDING) AS vm, stddev_pop(volume) {P} ROWS 19 PRECEDING) AS vd FROM l)
SELECT {KEYS}, round((t - tm) / td, 5) AS turnover_z20, round(CASE WHEN round(vd, 9) > 0 THEN (volume - vm) / vd * sign(close - open) END, 5) AS signed_vol_z20 FROM m WHERE bar_idx >= 19""")
def turnover_z(spark, sf_dir):
    b = features.turnover_features(daily_bars(spark, sf_dir)).where("bar_idx >= 19")
    return b.select(*KEY, *[F.round(c, 5).alias(c) for c in ("turnover_z20", "signed_vol_z20")])


@register(HOURLY_SQL + f", v AS (SELECT *, CASE WHEN bar_idx % 4 > 0 THEN close END AS x FROM bars) SELECT {KEYS}, round(CASE WHEN count(x) {P} ROWS 9 PRECEDING) >= 6 THEN avg(x) {P} ROWS 9 PRECEDING) END, 6) AS mean10 FROM v")
def rolling_mean_valid(spark, sf_dir):
    """A mean of ten that needs six values; every fourth one is missing here."""
    b = hourly_bars(spark, sf_dir).withColumn("x", F.when(F.col("bar_idx") % 4 > 0, F.col("close")))
    return b.select(*KEY, F.round(features.rolling_mean("x", 10), 6).alias("mean10"))


# Regimes, baselines, ceilings


def _regime_sql(bars_sql: str) -> str:
    test = {"T1": "trend <> 0", "T2": "trend = sign", "M1": "ma200 IS NOT NULL AND sign * (close - ma200) > 0", "M2": "ma200 IS NULL OR sign * (close - ma200) > 0", "V1": "coalesce(rk <= 0.80, true)", "V2": "coalesce(rk <= 0.67, true)"}
    arms = ", ".join(f"CASE WHEN {' AND '.join(f'({test[g]})' for g in gates) or 'true'} THEN '{name}' END" for name, gates in simulation.REGIME_VARIANTS.items())
    return f""", ap AS (SELECT market, symbol, timeframe, bar_idx, round(atr / close, 9) AS v FROM sig WHERE atr IS NOT NULL), rkd AS (SELECT a.market, a.symbol, a.timeframe, a.bar_idx, count(*) FILTER (b.v <= a.v) / count(*) AS rk FROM ap a JOIN ap b ON {SAME} AND b.bar_idx <= a.bar_idx GROUP BY ALL HAVING count(*) >= 250),
tr AS (SELECT sig.*, CASE WHEN r_trend > 0 THEN 1 WHEN r_trend < 0 THEN -1 ELSE 0 END AS trend, rk FROM sig LEFT JOIN rkd ON rkd.market = sig.market AND rkd.symbol = sig.symbol AND rkd.timeframe = sig.timeframe AND rkd.bar_idx = sig.bar_idx WHERE has_signal AND action <> 'HOLD' AND sig.bar_idx >= 60),
va AS (SELECT *, unnest(list_filter([{arms}], lambda q: q IS NOT NULL)) AS variant FROM tr)"""


def _regime_scored(spark, sf_dir):
    s = engine.all_signals(hourly_bars(spark, sf_dir)).withColumn("v", F.round(F.col("atr") / F.col("close"), 9))
    slim = s.select(*SERIES, "bar_idx", "ts", "open", "high", "low", "close", "action", "has_signal", "trend", "sma200", "entry_price", "stop_loss", "take_profit", "v")
    return features.percentiles(slim, {"v": "atr_rank"}, None, 250, "upto")


@register(signals_sql(HOURLY_SQL) + _regime_sql(HOURLY_SQL) + " SELECT variant, action, count(*) AS n FROM va GROUP BY ALL")
def regime_gates(spark, sf_dir):
    """Signals that each variant of the regime gates lets through."""
    s = _regime_scored(spark, sf_dir).where("has_signal AND action <> 'HOLD' AND bar_idx >= 60")
    gates = simulation.regime_gates()
    passed = [F.when(F.coalesce(*[F.when(~gates[g], F.lit(False)) for g in names], F.lit(True)), F.lit(variant)) for variant, names in simulation.REGIME_VARIANTS.items()]
    return s.select("action", F.explode(F.array_compact(F.array(*passed))).alias("variant")).groupBy("variant", "action").agg(F.count(F.lit(1)).alias("n"))


@register(walk_sql(HOURLY_SQL) + _regime_sql(HOURLY_SQL) + """, vx AS MATERIALIZED (SELECT ex.*, va.variant FROM ex JOIN va ON va.market = ex.market AND va.symbol = ex.symbol AND va.timeframe = ex.timeframe AND va.bar_idx = ex.bar_idx),
vn AS MATERIALIZED (SELECT a.market, a.symbol, a.timeframe, a.variant, a.bar_idx, b.bar_idx AS next_idx FROM vx a ASOF LEFT JOIN (SELECT market, symbol, timeframe, variant, bar_idx FROM vx) b ON a.market = b.market AND a.symbol = b.symbol AND a.timeframe = b.timeframe AND a.variant = b.variant AND a.exit_idx <= b.bar_idx),
vc AS (SELECT market, symbol, timeframe, variant, min(bar_idx) AS bar_idx FROM vx GROUP BY ALL UNION ALL SELECT vn.market, vn.symbol, vn.timeframe, vn.variant, vn.next_idx FROM vc JOIN vn ON vn.market = vc.market AND vn.symbol = vc.symbol AND vn.timeframe = vc.timeframe AND vn.variant = vc.variant AND vn.bar_idx = vc.bar_idx WHERE vn.next_idx IS NOT NULL)
SELECT variant, count(*) AS n, round(sum((exit - entry) * sign / abs(entry_price - stop_loss)), 6) AS total_r FROM vx JOIN vc USING (market, symbol, timeframe, variant, bar_idx) GROUP BY variant""")
def regime_walk(spark, sf_dir):
    """Each variant's own walk-forward, from one set of signals and exits."""
    return simulation.regime_walk(_regime_scored(spark, sf_dir)).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 6).alias("total_r"))


DIRECTED_SQL = """, c AS (SELECT market, symbol, timeframe, bar_idx, sign, arm, close, round(close - sign * 1.5 * atr, 6) AS stop, round(close + sign * 3.0 * atr, 6) AS target FROM arms WHERE atr > 0 AND close > 0),
p AS (SELECT c.*, f.bar_idx AS j, f.open AS fo, f.close AS fc, CASE WHEN sign = 1 THEN f.low ELSE f.high END AS worst, CASE WHEN sign = 1 THEN f.high ELSE f.low END AS best FROM c JOIN bars f ON f.market = c.market AND f.symbol = c.symbol AND f.timeframe = c.timeframe AND f.bar_idx BETWEEN c.bar_idx + 1 AND c.bar_idx + 10 WHERE stop > 0 AND target > 0),
h AS (SELECT *, CASE WHEN sign * (fo - stop) <= 0 THEN fo WHEN sign * (fo - target) >= 0 THEN fo WHEN sign * (worst - stop) <= 0 THEN stop WHEN sign * (best - target) >= 0 THEN target END AS hit FROM p),
e AS MATERIALIZED (SELECT market, symbol, timeframe, arm, sign, bar_idx, close, coalesce(min(j) FILTER (hit IS NOT NULL), max(j)) AS exit_idx, coalesce(arg_min(hit, j) FILTER (hit IS NOT NULL), arg_max(fc, j)) AS exit FROM h GROUP BY ALL),
n AS MATERIALIZED (SELECT a.market, a.symbol, a.timeframe, a.arm, a.bar_idx, b.bar_idx AS next_idx FROM e a ASOF LEFT JOIN (SELECT market, symbol, timeframe, arm, bar_idx FROM e) b ON a.market = b.market AND a.symbol = b.symbol AND a.timeframe = b.timeframe AND a.arm = b.arm AND a.exit_idx < b.bar_idx),
ch AS (SELECT market, symbol, timeframe, arm, min(bar_idx) AS bar_idx FROM e GROUP BY ALL UNION ALL SELECT n.market, n.symbol, n.timeframe, n.arm, n.next_idx FROM ch JOIN n ON n.market = ch.market AND n.symbol = ch.symbol AND n.timeframe = ch.timeframe AND n.arm = ch.arm AND n.bar_idx = ch.bar_idx WHERE n.next_idx IS NOT NULL)
SELECT arm, symbol, count(*) AS n, round(avg((exit - close) / close * sign), 8) AS mean_gross FROM e JOIN ch USING (market, symbol, timeframe, arm, bar_idx) GROUP BY ALL"""


def _arms(spark, sf_dir, directions: dict[str, Column]):
    b = indicators.with_atr(hourly_bars(spark, sf_dir)).withColumn("z", features.rolling_z("volume", 20))
    found = [simulation.directed(b, direction, 10).select(F.lit(name).alias("arm"), "symbol", "gross") for name, direction in directions.items()]
    out = found[0]
    for arm in found[1:]:
        out = out.unionByName(arm)
    return out.groupBy("arm", "symbol").agg(F.count(F.lit(1)).alias("n"), r8(F.avg("gross"), "mean_gross"))


@register((HOURLY_SQL + TR_SQL + ", arms AS (SELECT *, unnest(['long', 'short']) AS arm, unnest([1, -1]) AS sign FROM atr)" + DIRECTED_SQL).replace("WITH b AS", "WITH RECURSIVE b AS", 1).replace("round(close - sign * 1.5 * atr, 6)", "close - sign * 1.5 * atr").replace("round(close + sign * 3.0 * atr, 6)", "close + sign * 3.0 * atr"))
def baselines(spark, sf_dir):
    """Always long and always short, one deal at a time: what a strategy without any signal gets."""
    return _arms(spark, sf_dir, {"long": F.lit(1), "short": F.lit(-1)})


@register((HOURLY_SQL + TR_SQL + f", zz AS (SELECT *, CASE WHEN bar_idx >= 19 AND stddev_pop(volume) {P} ROWS 19 PRECEDING) > 0 THEN (volume - avg(volume) {P} ROWS 19 PRECEDING)) / stddev_pop(volume) {P} ROWS 19 PRECEDING) END AS z FROM atr), arms AS (SELECT *, 'score' AS arm, CASE WHEN z >= 1 THEN 1 ELSE -1 END AS sign FROM zz WHERE z >= 1 OR z <= -1)" + DIRECTED_SQL).replace("WITH b AS", "WITH RECURSIVE b AS", 1).replace("round(close - sign * 1.5 * atr, 6)", "close - sign * 1.5 * atr").replace("round(close + sign * 3.0 * atr, 6)", "close + sign * 3.0 * atr"))
def threshold_strategy(spark, sf_dir):
    """Long at a score of 1 or more, short at -1 or less, while no deal of the series is open."""
    return _arms(spark, sf_dir, {"score": F.when(F.col("z") >= 1, 1).when(F.col("z") <= -1, -1)})


@register("SELECT b.market, b.symbol, b.timeframe, b.bar_idx, round(greatest(max(CASE WHEN action = 'BUY' THEN (exit - entry) / planned END), max(CASE WHEN action = 'SELL' THEN (entry - exit) / planned END)), 6) AS best_r FROM (" + HOURLY_SQL + TR_SQL + """, c AS (SELECT *, unnest(['BUY', 'SELL']) AS action FROM atr WHERE atr > 0), l AS (SELECT *, CASE WHEN action = 'BUY' THEN 1 ELSE -1 END AS sign FROM c), q AS (SELECT *, close - sign * 1.5 * atr AS stop, close + sign * 3.0 * atr AS target FROM l),
p AS (SELECT q.market, q.symbol, q.timeframe, q.bar_idx, q.action, q.sign, q.stop, q.target, abs(q.close - q.stop) AS planned, f.bar_idx AS j, f.open AS fo, f.close AS fc, CASE WHEN sign = 1 THEN f.low ELSE f.high END AS worst, CASE WHEN sign = 1 THEN f.high ELSE f.low END AS best FROM q JOIN bars f ON f.market = q.market AND f.symbol = q.symbol AND f.timeframe = q.timeframe AND f.bar_idx BETWEEN q.bar_idx + 1 AND q.bar_idx + 10 WHERE stop > 0 AND target > 0),
h AS (SELECT *, CASE WHEN sign * (fo - stop) <= 0 THEN fo WHEN sign * (fo - target) >= 0 THEN fo WHEN sign * (worst - stop) <= 0 THEN stop WHEN sign * (best - target) >= 0 THEN target END AS hit FROM p)
SELECT market, symbol, timeframe, bar_idx, action, max(planned) AS planned, arg_min(fo, j) AS entry, coalesce(arg_min(hit, j) FILTER (hit IS NOT NULL), arg_max(fc, j)) AS exit FROM h GROUP BY ALL) b GROUP BY ALL""")
def ceiling_simulated(spark, sf_dir):
    """The better of a long and a short deal at every bar, by simulated exits."""
    c = simulation.fixed_geometry(simulation.with_ahead(indicators.with_atr(hourly_bars(spark, sf_dir)), 10))
    return simulation.exits(c, 10).where("status = 'deal'").groupBy(*SERIES, "bar_idx").agg(F.round(F.max("r_planned"), 6).alias("best_r"))


HITS = (1, 5, 10, 20)


@register(HOURLY_SQL + TR_SQL + """, q AS (SELECT *, close + 2 * atr AS up, close - 2 * atr AS down FROM atr WHERE atr > 0),
p AS (SELECT q.market, q.symbol, q.timeframe, q.bar_idx, min(f.bar_idx - q.bar_idx) FILTER (f.high >= up) AS t_up, min(f.bar_idx - q.bar_idx) FILTER (f.low <= down) AS t_down FROM q JOIN bars f ON f.market = q.market AND f.symbol = q.symbol AND f.timeframe = q.timeframe AND f.bar_idx BETWEEN q.bar_idx + 1 AND q.bar_idx + 20 GROUP BY ALL),
h AS (SELECT unnest([1, 5, 10, 20]) AS horizon) SELECT symbol, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, count(*) FILTER (t_up <= horizon) AS up, count(*) FILTER (t_down <= horizon) AS down, count(*) FILTER (t_up <= horizon AND t_down <= horizon) AS both FROM p, h GROUP BY ALL""")
def first_hits(spark, sf_dir):
    """Bars until two ATR up and down are first touched, counted at four horizons."""
    b = simulation.with_ahead(indicators.with_atr(hourly_bars(spark, sf_dir)), max(HITS)).where("atr > 0 AND size(ahead) > 0")
    until = lambda touched: F.array_min(F.transform(F.filter("ahead", touched), lambda x: x["bar_idx"])) - F.col("bar_idx")
    b = b.select("symbol", until(lambda x: x["high"] >= F.col("close") + 2 * F.col("atr")).alias("up"), until(lambda x: x["low"] <= F.col("close") - 2 * F.col("atr")).alias("down"), F.explode(F.array(*map(F.lit, HITS))).alias("horizon"))
    up, down = F.col("up") <= F.col("horizon"), F.col("down") <= F.col("horizon")
    return b.groupBy("symbol", "horizon").agg(F.count(F.lit(1)).alias("n"), F.count_if(up).alias("up"), F.count_if(down).alias("down"), F.count_if(up & down).alias("both"))


# Audits of deals


AUDIT_SQL = walk_sql(HOURLY_SQL) + ", au AS (SELECT *, gain / realized_risk AS old, gain / planned_risk AS new, realized_risk / planned_risk AS keep FROM deals WHERE realized_risk > 0)"


def gated_deal() -> Column:
    """Whether a deal passes the gate's price limits by the price it was entered at."""
    risk, reward, g = F.abs(F.col("entry") - F.col("stop_loss")), F.abs(F.col("take_profit") - F.col("entry")), engine.GATE
    return (risk > 0) & (reward > 0) & (F.try_divide(reward, risk) >= g["min_rr"]) & (risk / F.col("entry") * 100).between(g["min_stop_pct"], g["max_stop_pct"])


def _walk(spark, sf_dir):
    return simulation.walk_forward(engine.all_signals(hourly_bars(spark, sf_dir))).where("status = 'deal'")


@register(AUDIT_SQL + " SELECT id, count(*) AS n, round(avg(v), 6) AS mean_r, round(max(abs(v)), 6) AS widest FROM (SELECT 'A' AS id, old AS v FROM au UNION ALL SELECT 'B', old FROM au WHERE keep >= 0.2 UNION ALL SELECT 'C', greatest(-5, least(5, old)) FROM au UNION ALL SELECT 'D', new FROM au UNION ALL SELECT 'E', greatest(-10, least(10, new)) FROM au) GROUP BY id")
def metric_candidates(spark, sf_dir):
    """Five definitions of a deal's result: by risk after the gap (A), without deals that kept under 20 % of
    it (B), cut at 5 (C), by planned risk (D), cut at 10 (E)."""
    w = _walk(spark, sf_dir).where("realized_risk > 0")
    old, new = F.col("r_realized"), F.col("r_planned")
    kept = F.when(F.col("realized_risk") / F.col("planned_risk") >= 0.2, old)
    cut = lambda x, at: F.greatest(F.lit(-float(at)), F.least(F.lit(float(at)), x))
    rows = w.select(F.explode(F.create_map(*[x for name, v in (("A", old), ("B", kept), ("C", cut(old, 5)), ("D", new), ("E", cut(new, 10))) for x in (F.lit(name), v)])).alias("id", "v")).where("v IS NOT NULL")
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean_r"), F.round(F.max(F.abs("v")), 6).alias("widest"))


@register(AUDIT_SQL + """ SELECT grp, count(*) AS n, count(*) FILTER (old > 0) AS positive, round(sum(old), 6) AS old_r, round(sum(new), 6) AS new_r FROM (SELECT *, unnest(list_filter(['all', CASE WHEN keep < 1 THEN 'gap_ate' END, CASE WHEN keep > 1 THEN 'gap_widened' END, CASE WHEN NOT keep >= 0.2 THEN 'dropped' END, CASE WHEN abs(old) > 5 THEN 'clipped' END, CASE WHEN abs(new - old) >= 0.1 THEN 'moved' END], lambda q: q IS NOT NULL)) AS grp FROM au) GROUP BY grp""")
def gap_fairness(spark, sf_dir):
    """Whether a definition of the result picks sides: the deals that each rule touches, under both."""
    w = _walk(spark, sf_dir).where("realized_risk > 0").select(F.col("r_realized").alias("old"), F.col("r_planned").alias("new"), (F.col("realized_risk") / F.col("planned_risk")).alias("keep"))
    groups = [("all", F.lit(True)), ("gap_ate", F.col("keep") < 1), ("gap_widened", F.col("keep") > 1), ("dropped", F.col("keep") < 0.2), ("clipped", F.abs("old") > 5), ("moved", F.abs(F.col("new") - F.col("old")) >= 0.1)]
    rows = w.withColumn("grp", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in groups]))))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("old") > 0).alias("positive"), F.round(F.sum("old"), 6).alias("old_r"), F.round(F.sum("new"), 6).alias("new_r"))


@register(walk_sql(HOURLY_SQL) + """, st AS (SELECT *, bar_idx % 11 = 3 AS gone, bar_idx % 7 = 2 AS price, bar_idx % 5 = 1 AND reason <> 'time_exit' AS label FROM deals)
SELECT count(*) FILTER (NOT gone) AS checked, count(*) FILTER (gone) AS missing, count(*) FILTER (NOT gone AND price) AS exit_off, count(*) FILTER (NOT gone AND label) AS reason_off, round(max(CASE WHEN price THEN abs(exit) * 0.01 ELSE 0 END) FILTER (NOT gone), 6) AS max_exit_error FROM st""")
def replay_check(spark, sf_dir):
    """Stored deals simulated again from their entry and levels.  Faults are planted on purpose, by the number of the signal's bar: exits
    moved by a hundredth, reasons changed, entries at a time without a bar.  Just these must be found."""
    i = F.col("bar_idx")
    stored = _walk(spark, sf_dir).withColumn("entry_ts", F.when(i % 11 == 3, F.col("entry_ts") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("entry_ts")))
    stored = stored.withColumns({"exit": F.when(i % 7 == 2, F.col("exit") * 1.01).otherwise(F.col("exit")), "reason": F.when(i % 5 == 1, "time_exit").otherwise(F.col("reason"))})
    again = simulation.replayed(stored.select(*SERIES, "entry_ts", "action", "stop_loss", "take_profit", "hold_bars", "exit", "reason"), hourly_bars(spark, sf_dir))
    return simulation.replay_faults(again).select("checked", "missing", "exit_off", "reason_off", *r6("max_exit_error"))


@register(walk_sql(HOURLY_SQL) + " SELECT count(*) AS n, count(*) FILTER (risk > 0 AND reward > 0 AND reward / risk >= 1.5 AND risk / entry * 100 >= 0.15 AND risk / entry * 100 <= 8) AS kept FROM (SELECT abs(deals.entry - deals.stop_loss) AS risk, abs(cand.take_profit - deals.entry) AS reward, deals.entry FROM deals JOIN cand USING (market, symbol, timeframe, bar_idx))")
def gate_on_deals(spark, sf_dir):
    """The gate's price limits on past deals, by the price they were entered at."""
    w = _walk(spark, sf_dir)
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(gated_deal()).alias("kept"))


@register(DEALS_SQL + """, m AS (SELECT t.*, CASE market WHEN 'GOLD' THEN 5.0::DOUBLE WHEN 'FOREX' THEN 1.5::DOUBLE WHEN 'TH_STOCK' THEN 40.0::DOUBLE WHEN 'US_STOCK' THEN 5.0::DOUBLE ELSE 25.0::DOUBLE END AS bps, market, s.entry, s.stop FROM t JOIN (SELECT *, """ + MARKET_SQL + """ AS market FROM s) s USING (signal_id)), c AS (SELECT market, bps, abs(entry - stop) / entry AS dist, bps / 10000 * entry / abs(entry - stop) AS cost_r FROM m)
SELECT market, count(*) AS n, round(max(abs(bps / 10000 / dist - cost_r) / greatest(1e-12, abs(cost_r))), 9) AS max_rel_error FROM c GROUP BY market""")
def cost_identity(spark, sf_dir):
    """Cost in risk must be basis points over the stop's distance."""
    s = flat_signals(spark, sf_dir).where("status = 'F'").withColumn("market", market_of(F.col("signal_id") % 20)).withColumn("bps", prices.cost_bps(F.col("market")))
    dist = F.abs(F.col("entry") - F.col("stop")) / F.col("entry")
    cost = F.col("bps") / 10000 * F.col("entry") / F.abs(F.col("entry") - F.col("stop"))
    return s.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("bps") / 10000 / dist - cost) / F.greatest(F.lit(1e-12), F.abs(cost))), 9).alias("max_rel_error"))


@register(DEALS_SQL + ", e AS (SELECT symbol, avg(r) AS edge FROM t GROUP BY symbol), f AS (SELECT unnest([1.5, 5, 10, 25, 40]) AS bps) SELECT symbol, CAST(bps AS DOUBLE) AS bps, round(CASE WHEN edge > 0 THEN bps / 10000 / edge END, 9) AS needed_stop, round(edge - bps / 10000 / 0.02, 8) AS net_at_2pct FROM e, f")
def fee_levels(spark, sf_dir):
    """The stop distance at which an edge just pays each fee level."""
    e = closed_deals(spark, sf_dir).groupBy("symbol").agg(F.avg("r").alias("edge")).withColumn("bps", F.explode(F.array(*map(F.lit, (1.5, 5.0, 10.0, 25.0, 40.0)))))
    return e.select("symbol", "bps", F.round(F.when(F.col("edge") > 0, F.col("bps") / 10000 / F.col("edge")), 9).alias("needed_stop"), r8(F.col("edge") - F.col("bps") / 10000 / 0.02, "net_at_2pct"))


# Joins


@register(DAILY_SQL + """, q AS (SELECT symbol, arg_max(close, ts) AS price FROM bars GROUP BY symbol), o AS (SELECT o_orderkey AS id, concat('S', o_orderkey % 20) AS symbol, o_totalprice AS price FROM orders WHERE o_orderstatus = 'O') SELECT o.id, o.symbol, round(q.price, 9) AS price, round(q.price - o.price, 6) AS moved FROM o JOIN q ON q.symbol = o.symbol""")
def position_quotes(spark, sf_dir):
    """Open positions with their symbol's latest price."""
    quotes = daily_bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    p = flat_signals(spark, sf_dir).where("status = 'O'").select(F.col("signal_id").alias("id"), "symbol", "entry")
    return p.join(F.broadcast(quotes), "symbol").select("id", "symbol", F.round("price", 9).alias("price"), F.round(F.col("price") - F.col("entry"), 6).alias("moved"))  # one row per symbol


@register(HOURLY_SQL + TR_SQL + """, q AS (SELECT *, unnest([10, 3]) AS hold FROM atr WHERE atr > 0), p AS (SELECT q.market, q.symbol, q.timeframe, q.bar_idx, q.hold, q.close, q.atr, f.bar_idx AS j, f.open AS fo, f.high AS fh, f.low AS fl, f.close AS fc FROM q JOIN bars f ON f.market = q.market AND f.symbol = q.symbol AND f.timeframe = q.timeframe AND f.bar_idx BETWEEN q.bar_idx + 1 AND q.bar_idx + q.hold WHERE q.close - 1.5 * q.atr > 0),
h AS (SELECT *, CASE WHEN fo <= close - 1.5 * atr THEN fo WHEN fo >= close + 3.0 * atr THEN fo WHEN fl <= close - 1.5 * atr THEN close - 1.5 * atr WHEN fh >= close + 3.0 * atr THEN close + 3.0 * atr END AS hit FROM p),
e AS (SELECT market, symbol, timeframe, bar_idx, hold, (coalesce(arg_min(hit, j) FILTER (hit IS NOT NULL), arg_max(fc, j)) - arg_min(fo, j)) / max(1.5 * atr) AS r FROM h GROUP BY ALL)
SELECT a.symbol, count(*) AS n, round(avg(a.r - b.r), 6) AS mean_diff, count(*) FILTER (round(a.r, 9) = round(b.r, 9)) AS same FROM e a JOIN e b ON a.hold = 10 AND b.hold = 3 AND a.market = b.market AND a.symbol = b.symbol AND a.timeframe = b.timeframe AND a.bar_idx = b.bar_idx GROUP BY a.symbol""")
def paired_entries(spark, sf_dir):
    """Two hold caps compared deal by deal, paired by series and entry."""
    b = simulation.with_ahead(indicators.with_atr(hourly_bars(spark, sf_dir)), 10)
    c = simulation.fixed_geometry(b).where("action = 'BUY'")
    arms = [simulation.exits(c, hold).where("status = 'deal'").select(*SERIES, "bar_idx", F.col("r_planned").alias(name)) for hold, name in ((10, "x"), (3, "y"))]
    both = arms[0].join(arms[1], [*SERIES, "bar_idx"])
    return both.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x") - F.col("y")), 6).alias("mean_diff"), F.count_if(F.round("x", 9) == F.round("y", 9)).alias("same"))


@register(DAILY_SQL + """, c AS (SELECT timeframe, ts, count(*) AS c FROM bars GROUP BY ALL), k AS (SELECT *, sum(c) OVER (PARTITION BY timeframe ORDER BY ts) AS t, sum(c) OVER (PARTITION BY timeframe) AS n FROM c), s AS (SELECT timeframe, min(ts) FILTER (t > floor(n * 0.6)) AS a, min(ts) FILTER (t > floor(n * 0.8)) AS z FROM k GROUP BY timeframe)
SELECT symbol, CASE WHEN ts < a THEN 'train' WHEN ts < z THEN 'validation' ELSE 'test' END AS split, count(*) AS bars, round(avg(volume), 6) AS mean_volume FROM bars JOIN s ON s.timeframe = bars.timeframe GROUP BY ALL""")
def split_bars(spark, sf_dir):
    """Bars by the split that their timeframe's boundaries put them in."""
    b = daily_bars(spark, sf_dir)
    cuts = statistics.time_split(b).select("timeframe", "train_end", "validation_end")
    split = F.when(F.col("ts") < F.col("train_end"), "train").when(F.col("ts") < F.col("validation_end"), "validation").otherwise("test")
    return b.join(F.broadcast(cuts), "timeframe").groupBy("symbol", split.alias("split")).agg(F.count(F.lit(1)).alias("bars"), F.round(F.avg("volume"), 6).alias("mean_volume"))  # a row per timeframe


@register(walk_sql(HOURLY_SQL) + " SELECT bars.market, bars.symbol, bars.timeframe, bars.ts, d.action, round(d.gain / d.planned_risk, 6) AS r FROM bars LEFT JOIN deals d ON d.market = bars.market AND d.symbol = bars.symbol AND d.timeframe = bars.timeframe AND d.bar_idx + 1 = bars.bar_idx")
def deals_on_bars(spark, sf_dir):
    """Every bar, with the deal that was entered at its open."""
    scored = engine.all_signals(hourly_bars(spark, sf_dir))
    d = simulation.walk_forward(scored).where("status = 'deal'").select(*SERIES, (F.col("bar_idx") + 1).alias("bar_idx"), "action", "r")
    return hourly_bars(spark, sf_dir).join(d, [*SERIES, "bar_idx"], "left").select(*KEY, "action", *r6("r"))


# Aggregates


@register(walk_sql(HOURLY_SQL) + """, dl AS (SELECT *, gain / planned_risk AS r, exit_idx - bar_idx AS held FROM deals), k AS (SELECT unnest([1, 2, 3, 6]) AS k)
SELECT symbol, CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(CASE WHEN reason IN ('take_profit', 'gap_target') AND held <= k THEN 1.0 ELSE 0.0 END), 6) AS p_target, round(avg(CASE WHEN reason IN ('stop_loss', 'gap_stop') AND held <= k THEN 1.0 ELSE 0.0 END), 6) AS p_stop, round(avg(CASE WHEN held <= k THEN r ELSE 0.0 END), 6) AS e_r,
 round(avg(CASE WHEN reason = 'time_exit' THEN 1.0 ELSE 0.0 END), 6) AS time_share, CAST(median(held) AS DOUBLE) AS median_held, round(median(r), 6) AS median_r FROM dl, k GROUP BY ALL""")
def speed_aggregate(spark, sf_dir):
    """How soon deals end, over all deals: by target, by stop, result within k bars, exit shares, medians."""
    d = _walk(spark, sf_dir).withColumn("held", F.col("exit_idx") - F.col("bar_idx")).withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3, 6)))))
    within = F.col("held") <= F.col("k")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return d.groupBy("symbol", "k").agg(F.count(F.lit(1)).alias("n"), share(F.col("reason").isin("take_profit", "gap_target") & within).alias("p_target"), share(F.col("reason").isin("stop_loss", "gap_stop") & within).alias("p_stop"), F.round(F.avg(F.when(within, F.col("r")).otherwise(0.0)), 6).alias("e_r"),
                                        share(F.col("reason") == "time_exit").alias("time_share"), F.percentile("held", F.lit(0.5)).alias("median_held"), F.round(F.percentile("r", F.lit(0.5)), 6).alias("median_r"))


@register(DEALS_SQL + """, q AS (SELECT *, CAST(year(created_at) AS INTEGER) AS year, CASE WHEN r > 0 THEN 'win' ELSE 'loss' END AS outcome FROM t) SELECT symbol, action, year, outcome, count(*) AS n, round(avg(r), 8) AS mean_r, round(avg(r) - 1.96 * stddev_samp(r) / sqrt(count(*)), 8) AS lo, round(avg(r) + 1.96 * stddev_samp(r) / sqrt(count(*)), 8) AS hi FROM q GROUP BY GROUPING SETS ((symbol), (action), (year), (outcome), ())""")
def grouped_ci(spark, sf_dir):
    """Means with their intervals for every dimension by itself, in one pass."""
    q = closed_deals(spark, sf_dir).withColumn("year", F.year("created_at")).withColumn("outcome", F.when(F.col("r") > 0, "win").otherwise("loss"))
    half = 1.96 * F.stddev_samp("r") / F.sqrt(F.count(F.lit(1)))
    sets = q.groupingSets([["symbol"], ["action"], ["year"], ["outcome"], []], "symbol", "action", "year", "outcome")
    return sets.agg(F.count(F.lit(1)).alias("n"), r8(F.avg("r"), "mean_r"), r8(F.avg("r") - half, "lo"), r8(F.avg("r") + half, "hi"))


@register(SIGNALS_SQL + """, i AS (SELECT signal_id, user_id, action, CAST(date_diff('day', DATE '1970-01-01', CAST(created_at AS DATE)) AS BIGINT) AS a FROM s), x AS (SELECT count(DISTINCT x.signal_id) AS n FROM i x JOIN i y ON x.user_id = y.user_id AND x.action = 'BUY' AND y.action = 'SELL' AND y.a <= x.a + 30 AND y.a + 10 >= x.a)
SELECT count(*) FILTER (action = 'BUY') AS first, count(*) FILTER (action = 'SELL') AS second, max(x.n) AS overlap, round(max(x.n) / count(*), 8) AS share FROM i, x""")
def overlap_share(spark, sf_dir):
    """Share of two sets of deals whose spans touch."""
    s = flat_signals(spark, sf_dir).select("signal_id", "user_id", "action", F.datediff(F.to_date("created_at"), F.lit("1970-01-01")).cast("long").alias("begin"))
    a, b = s.where("action = 'BUY'").withColumn("end", F.col("begin") + 30), s.where("action = 'SELL'").withColumn("end", F.col("begin") + 10)
    n = joins.overlapping(a, b, ["user_id"], "begin", "end").agg(F.count(F.lit(1)).alias("overlap"))
    sizes = s.agg(F.count_if(F.col("action") == "BUY").alias("first"), F.count_if(F.col("action") == "SELL").alias("second"))
    return sizes.crossJoin(n).select("first", "second", "overlap", r8(F.col("overlap") / (F.col("first") + F.col("second")), "share"))  # one row each


@register(SIGNALS_SQL + """, d AS (SELECT signal_id, abs(entry - stop) / entry AS dist, ((signal_id * 7) % 41 - 20) / 10 AS r FROM s WHERE status = 'F'), b AS (SELECT *, CAST(floor(dist * 100) AS BIGINT) AS bucket FROM d), g AS (SELECT bucket, count(*) AS n, median(dist) AS md, avg(1 / dist) AS inv, avg(r) AS edge FROM b GROUP BY bucket), f AS (SELECT unnest([0.0, 1.5, 5.0, 10.0, 25.0, 40.0]) AS bps)
SELECT bucket, CAST(bps AS DOUBLE) AS bps, n, round(md, 8) AS median_dist, round(edge, 8) AS edge, round(bps / 10000 * inv, 8) AS cost_r, round(edge - bps / 10000 * inv, 8) AS net, round(CASE WHEN edge > 0 THEN edge / inv * 10000 END, 6) AS breakeven_bps FROM g, f""")
def bucket_study(spark, sf_dir):
    """Buckets of stop distance: edge, cost at six fee levels, and the fee at which nothing is left."""
    dist = F.abs(F.col("entry") - F.col("stop")) / F.col("entry")
    d = flat_signals(spark, sf_dir).where("status = 'F'").select(dist.alias("dist"), (((F.col("signal_id") * 7) % 41 - 20) / 10).alias("r")).withColumn("bucket", F.floor(F.col("dist") * 100))
    g = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.percentile("dist", F.lit(0.5)).alias("md"), F.avg(1 / F.col("dist")).alias("inv"), F.avg("r").alias("edge"))
    g = g.withColumn("bps", F.explode(F.array(*map(F.lit, (0.0, 1.5, 5.0, 10.0, 25.0, 40.0))))).withColumn("cost", F.col("bps") / 10000 * F.col("inv"))
    return g.select("bucket", "bps", "n", r8("md", "median_dist"), r8("edge", "edge"), r8("cost", "cost_r"), r8(F.col("edge") - F.col("cost"), "net"), F.round(F.when(F.col("edge") > 0, F.col("edge") / F.col("inv") * 10000), 6).alias("breakeven_bps"))


@register(DAILY_SQL + f""", q AS (SELECT symbol, ln(close / lag(close, 5) {P})) AS m, ln(lead(close, 5) {P}) / close) AS y FROM bars), h AS (SELECT *, m * y > 0 AS hit FROM q WHERE m IS NOT NULL AND y IS NOT NULL)
SELECT symbol, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 8) AS hit_share, round(avg(abs(y)) FILTER (hit) / avg(abs(y)) FILTER (NOT hit), 6) AS size_ratio, round(avg(abs(m)) FILTER (hit) / avg(abs(m)) FILTER (NOT hit), 6) AS stake_ratio, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 8) AS long_share FROM h GROUP BY symbol""")
def hit_miss(spark, sf_dir):
    """Momentum as a forecast: how much larger moves and stakes are where it was right."""
    b = daily_bars(spark, sf_dir).withColumn("m", F.ln(F.col("close") / F.lag("close", 5).over(series()))).withColumn("y", features.forward_returns(None, 5, "close_close")).where("m IS NOT NULL AND y IS NOT NULL").withColumn("hit", F.col("m") * F.col("y") > 0)
    ratio = lambda c: F.round(F.avg(F.when(F.col("hit"), F.abs(c))) / F.avg(F.when(~F.col("hit"), F.abs(c))), 6)
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r8(F.avg(F.col("hit").cast("double")), "hit_share"), ratio("y").alias("size_ratio"), ratio("m").alias("stake_ratio"), r8(F.avg((F.col("m") > 0).cast("double")), "long_share"))


@register(DAILY_SQL + """, g AS (SELECT *, date_diff('day', lag(ts) OVER (PARTITION BY market, symbol, timeframe ORDER BY ts), ts) AS gap FROM bars), y AS (SELECT market, symbol, timeframe, CAST(year(ts) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (gap > 3) AS holes, count(*) FILTER (high = low) AS flat FROM g GROUP BY ALL), f AS (SELECT *, holes * 10 > n OR flat * 2 > n AS failing FROM y)
SELECT market, symbol, timeframe, CAST(sum(n) AS BIGINT) AS bars, max(year) FILTER (failing) AS last_failing, min(year) AS first_year, coalesce(max(year) FILTER (failing) + 1, min(year)) AS usable_from, CASE WHEN count(*) FILTER (NOT failing) = 0 THEN 'unusable' WHEN count(*) FILTER (failing) = 0 THEN 'good' ELSE 'partly' END AS verdict FROM f GROUP BY ALL""")
def usable_era(spark, sf_dir):
    """From which year on a series is usable: after its last failing one; and the verdict on it."""
    b = daily_bars(spark, sf_dir).withColumn("gap", F.datediff("ts", F.lag("ts").over(series())))
    y = b.groupBy(*SERIES, F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") > 3).alias("holes"), F.count_if(F.col("high") == F.col("low")).alias("flat"))
    y = y.withColumn("failing", (F.col("holes") * 10 > F.col("n")) | (F.col("flat") * 2 > F.col("n")))
    last = F.max(F.when(F.col("failing"), F.col("year")))
    verdict = F.when(F.count_if(~F.col("failing")) == 0, "unusable").when(F.count_if(F.col("failing")) == 0, "good").otherwise("partly")
    return y.groupBy(*SERIES).agg(F.sum("n").alias("bars"), last.alias("last_failing"), F.min("year").alias("first_year"), F.coalesce(last + 1, F.min("year")).alias("usable_from"), verdict.alias("verdict"))


# Order, filters, gates


@register(SIGNALS_SQL + "SELECT signal_id, symbol, confidence, CAST(row_number() OVER (ORDER BY confidence DESC, signal_id) AS INTEGER) AS place FROM s WHERE status = 'P' QUALIFY row_number() OVER (ORDER BY confidence DESC, signal_id) <= 20")
def by_confidence(spark, sf_dir):
    """The page's list, most confident first: a report of twenty."""
    top = flat_signals(spark, sf_dir).where("status = 'P'").orderBy(F.desc("confidence"), "signal_id").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("confidence"), "signal_id"))).select("signal_id", "symbol", "confidence", "place")


@register(SIGNALS_SQL + """, q AS (SELECT *, (signal_id * 11) % 10 AS speed, CASE WHEN confidence >= 85 THEN 40 WHEN confidence >= 70 THEN 28 WHEN confidence >= 55 THEN 14 ELSE 0 END + confidence / 100 * 30 + least(abs(target - entry) / abs(entry - stop), 3) / 3 * 20 AS score FROM s WHERE status = 'P' AND abs(entry - stop) > 0)
SELECT user_id, signal_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY speed DESC, round(score, 9) DESC, confidence DESC, symbol, timeframe, signal_id) AS INTEGER) AS place FROM q""")
def digest_ranking(spark, sf_dir):
    """A recipient's digest: speed, then score up to nine places, then confidence and names."""
    s = flat_signals(spark, sf_dir).where("status = 'P'").withColumn("speed", (F.col("signal_id") * 11) % 10).withColumn("rr", prices.risk_reward(F.col("entry"), F.col("stop"), F.col("target"))).where("rr IS NOT NULL")
    strength = F.when(F.col("confidence") >= 85, "very_strong").when(F.col("confidence") >= 70, "strong").when(F.col("confidence") >= 55, "moderate").otherwise("weak")
    score = F.round(prices.composite_score(strength, F.col("confidence"), F.col("rr"), F.lit(0.0)), 9)
    w = Window.partitionBy("user_id").orderBy(F.desc("speed"), F.desc(score), F.desc("confidence"), "symbol", "timeframe", "signal_id")
    return s.select("user_id", "signal_id", F.row_number().over(w).alias("place"))


@register(SIGNALS_SQL + "SELECT signal_id, symbol, action, status FROM s WHERE action = 'BUY' AND upper(timeframe) = '1D' AND status = 'O' AND contains(lower(symbol), 's1')")
def page_filter(spark, sf_dir):
    """The page's filters: action, timeframe in any case, status, part of a symbol."""
    wanted = (F.col("action") == "BUY") & (F.upper("timeframe") == F.upper(F.lit("1d"))) & (F.col("status") == "O") & F.lower("symbol").contains("s1")
    return flat_signals(spark, sf_dir).where(wanted).select("signal_id", "symbol", "action", "status")


@register("""WITH c AS (SELECT p_partkey AS id, p_brand AS grp, p_size % 7 = 0 AS control, p_size % 3 > 0 AS holm, p_size % 4 > 0 AS ic_holm, (p_partkey * 13 % 41 - 20) / 10 AS net, p_size % 11 = 0 AS thin FROM part)
SELECT grp, count(*) AS n, count(*) FILTER (NOT control AND holm AND net > 0 AND NOT thin AND grp <> 'Brand#11') AS strict, count(*) FILTER (NOT control AND ic_holm AND net > 0 AND NOT thin AND grp <> 'Brand#11') AS loose FROM c GROUP BY grp""")
def cell_gate(spark, sf_dir):
    """Study cells that pass the five conditions, and the loose form with the weaker test."""
    size = F.col("p_size")
    common = (size % 7 != 0) & ((F.col("p_partkey") * 13 % 41 - 20) / 10 > 0) & (size % 11 != 0) & (F.col("p_brand") != "Brand#11")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count_if(common & (size % 3 > 0)).alias("strict"), F.count_if(common & (size % 4 > 0)).alias("loose"))


# Scores and statistics


FLOOR = 20
_WITHIN = "avg(CASE WHEN reason IN ({0}) AND held <= {1} THEN 1.0 ELSE 0.0 END)"
_HITS, _STOPS = "'take_profit', 'gap_target'", "'stop_loss', 'gap_stop'"
_RESULTS = ", ".join(f"avg(CASE WHEN held <= {k} THEN r ELSE 0 END) AS e{k}" for k in (2, 6))


@register(walk_sql(HOURLY_SQL) + f""", dl AS (SELECT deals.*, gain / planned_risk AS r, exit_idx - bar_idx AS held, abs(deals.entry - deals.stop_loss) AS risk, abs(cand.take_profit - deals.entry) AS reward FROM deals JOIN cand USING (market, symbol, timeframe, bar_idx)),
pr AS (SELECT market, symbol, timeframe, count(*) AS n, {_WITHIN.format(_HITS, 2)} AS p2, {_RESULTS} FROM dl GROUP BY ALL), mk AS (SELECT market, timeframe, count(*) AS n, {_WITHIN.format(_HITS, 2)} AS p2, {_RESULTS} FROM dl GROUP BY ALL), tf AS (SELECT timeframe, count(*) AS n, {_WITHIN.format(_HITS, 2)} AS p2, {_RESULTS} FROM dl GROUP BY ALL),
gd AS (SELECT * FROM dl WHERE risk > 0 AND reward > 0 AND reward / risk >= 1.5 AND risk / entry * 100 BETWEEN 0.15 AND 8), gt AS (SELECT timeframe, count(*) AS n, {_WITHIN.format(_HITS, 1)} AS p1, {_WITHIN.format(_STOPS, 1)} AS s1, {_RESULTS} FROM gd GROUP BY ALL), gm AS (SELECT market, timeframe, count(*) AS n, {_WITHIN.format(_HITS, 1)} AS p1, {_WITHIN.format(_STOPS, 1)} AS s1, {_RESULTS} FROM gd GROUP BY ALL),
q AS (SELECT DISTINCT symbol, m.market, t.timeframe FROM bars, (SELECT unnest(['CRYPTO', 'GOLD']) AS market) m, (SELECT unnest(['1H', '4H']) AS timeframe) t UNION ALL SELECT 'none', 'CRYPTO', '1H'),
j AS (SELECT q.*, pr.n AS pn, pr.p2 AS pp, pr.e2 AS pe, mk.n AS mn, mk.p2 AS mp, mk.e2 AS me, tf.n AS tn, tf.p2 AS tp, tf.e2 AS te, coalesce(gm.n, gt.n, 0) AS gated_n, coalesce(gm.p1, gt.p1) AS p1, coalesce(gm.s1, gt.s1) AS s1, CASE WHEN gm.n IS NOT NULL THEN gm.e2 ELSE gt.e2 END AS ge FROM q LEFT JOIN pr USING (market, symbol, timeframe) LEFT JOIN mk USING (market, timeframe) LEFT JOIN tf USING (timeframe) LEFT JOIN gm USING (market, timeframe) LEFT JOIN gt USING (timeframe)),
bs AS (SELECT *, CASE WHEN pn >= {FLOOR} AND timeframe = '1H' THEN 'pair' WHEN mn IS NOT NULL THEN 'market' WHEN tn IS NOT NULL THEN 'timeframe' ELSE 'none' END AS basis FROM j),
v AS (SELECT *, CASE basis WHEN 'pair' THEN pp WHEN 'market' THEN mp WHEN 'timeframe' THEN tp END AS x, CASE basis WHEN 'pair' THEN pn WHEN 'market' THEN mn WHEN 'timeframe' THEN tn ELSE 0 END AS sample_size, CASE basis WHEN 'pair' THEN pe WHEN 'market' THEN me WHEN 'timeframe' THEN te END AS e FROM bs)
SELECT symbol, market, timeframe, basis, sample_size, CAST(CASE WHEN x IS NULL THEN 50 ELSE floor((SELECT count(*) FILTER (round(pr.p2, 12) < round(x, 12)) / count(*) FROM pr WHERE pr.timeframe = v.timeframe) * 100 + 0.5) END AS INTEGER) AS score, round(x, 8) AS p_target2, round(e, 8) AS result2, gated_n,
 array_to_string(list_filter([CASE WHEN timeframe <> '1H' THEN 'not_measurable' END, CASE WHEN basis <> 'pair' THEN CASE WHEN pn < {FLOOR} THEN 'few_deals' WHEN timeframe <> '1H' THEN 'pairs_not_proven' WHEN pn IS NULL THEN 'unknown_pair' END END, CASE WHEN timeframe = '1H' AND p1 IS NOT NULL AND s1 IS NOT NULL THEN 'rarely_within_one' END, CASE WHEN ge < 0 THEN 'fast_is_not_profit' END, CASE WHEN x IS NULL THEN 'no_data' END], lambda w: w IS NOT NULL), ',') AS warnings FROM v""")
def speed_score(spark, sf_dir):
    """Speed of signals of every symbol in its own and a foreign market and timeframe, and of an unknown symbol, by the scorecard of
    real deals: by the pair's own deals where there are enough, else by its market, its timeframe, or not at all."""
    d = _walk(spark, sf_dir).withColumn("gated", gated_deal())
    policy = spark.createDataFrame([("1H", True, False, True)], scorecard.POLICY)
    card = scorecard.build(d.withColumn("held", F.col("exit_idx") - F.col("bar_idx")), policy, FLOOR, "1")
    symbols = hourly_bars(spark, sf_dir).select("symbol").distinct().withColumn("market", F.explode(F.array(F.lit("CRYPTO"), F.lit("GOLD")))).withColumn("timeframe", F.explode(F.array(F.lit("1H"), F.lit("4H"))))
    asked = symbols.unionByName(spark.createDataFrame([("none", "CRYPTO", "1H")], "symbol string, market string, timeframe string"))
    out = scorecard.speed(asked, card)
    return out.select("symbol", "market", "timeframe", "basis", "sample_size", "score", r8("p_target2", "p_target2"), r8("result2", "result2"), "gated_n", F.array_join("warnings", ",").alias("warnings"))


@register(DAILY_SQL + f""", q AS (SELECT symbol, year(ts) AS year, round(volume, 6) AS x, round(ln(lead(close, 5) {P}) / close), 6) AS y FROM bars), k AS (SELECT symbol, year, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2 AS ry FROM q WHERE y IS NOT NULL),
z AS (SELECT *, (rx - avg(rx) OVER w) / stddev_pop(rx) OVER w * (ry - avg(ry) OVER w) / stddev_pop(ry) OVER w AS zz FROM k WINDOW w AS (PARTITION BY symbol)), c AS (SELECT year, sum(zz) AS s, count(*) AS n FROM z GROUP BY year), a AS (SELECT sum(s) AS ts, sum(n) AS tn, count(*) AS g FROM c)
SELECT round(max(ts) / max(tn), 7) AS mean, CAST(max(tn) AS BIGINT) AS n, max(g) AS clusters, round(sqrt(sum((s - n * ts / tn) ** 2) * max(g) / (max(g) - 1)) / max(tn), 7) AS se FROM c, a""")
def pooled_rank_ic(spark, sf_dir):
    """Rank correlation pooled over symbols, with an error clustered by year."""
    b = daily_bars(spark, sf_dir).select("symbol", F.year("ts").alias("year"), F.round("volume", 6).alias("x"), F.round(features.forward_returns(None, 5, "close_close"), 6).alias("y"))
    out = statistics.pooled_ic(b, "x", "y", ["symbol"], ["year"])
    return out.select(F.round("mean", 7).alias("mean"), "n", "clusters", F.round("se", 7).alias("se"))


@register(HOURLY_SQL + f""", q AS (SELECT *, round(close, 9) AS v, ln(lead(close, 5) {P}) / lead(open) {P})) AS y FROM bars), p AS (SELECT a.symbol, a.ts, a.y, (count(*) FILTER (b.v < a.v) + count(*) FILTER (b.v = a.v) / 2) / count(*) AS pct FROM q a JOIN q b ON {SAME} AND b.bar_idx BETWEEN a.bar_idx - 249 AND a.bar_idx GROUP BY ALL HAVING count(*) >= 150)
SELECT symbol, CASE WHEN pct >= 0.9 THEN 1 ELSE -1 END AS side, count(*) AS n, round(avg(CASE WHEN pct >= 0.9 THEN y ELSE -y END), 8) AS gross, round(avg(CASE WHEN pct >= 0.9 THEN y ELSE -y END) - 0.0025, 8) AS net FROM p WHERE y IS NOT NULL AND (pct >= 0.9 OR pct <= 0.1) GROUP BY ALL""")
def decile_money(spark, sf_dir):
    """Money of the outer deciles of a causal percentile, taken with their direction, after a fee."""
    b = hourly_bars(spark, sf_dir).withColumn("v", F.round("close", 9)).withColumn("y", features.forward_returns(None, 5, "open_close"))
    p = features.percentiles(b.select(*KEY, "v", "y"), {"v": "pct"}, 250, 150).where("y IS NOT NULL AND (pct >= 0.9 OR pct <= 0.1)")
    side = F.when(F.col("pct") >= 0.9, 1).otherwise(-1)
    gross = F.avg(side * F.col("y"))
    return p.groupBy("symbol", side.alias("side")).agg(F.count(F.lit(1)).alias("n"), r8(F.avg(F.when(F.col("pct") >= 0.9, F.col("y")).otherwise(-F.col("y"))), "gross"), r8(F.avg(F.when(F.col("pct") >= 0.9, F.col("y")).otherwise(-F.col("y"))) - 0.0025, "net"))


@register(DEALS_SQL + """, y AS (SELECT symbol, year(created_at) AS year, sum(r) AS s FROM t GROUP BY ALL), g AS (SELECT symbol, count(*) AS n, greatest(count(*) FILTER (s > 0), count(*) FILTER (s < 0)) AS agree FROM y GROUP BY symbol), k AS (SELECT symbol, n, agree, unnest(range(agree, n + 1)) AS k FROM g)
SELECT symbol, n, agree, round(least(1, 2 * sum(factorial(CAST(n AS INTEGER)) / (factorial(CAST(k AS INTEGER)) * factorial(CAST(n - k AS INTEGER)))::DOUBLE * 0.5 ** n)), 8) AS p FROM k GROUP BY ALL""")
def sign_test(spark, sf_dir):
    """Years that agree in sign, against coin tosses."""
    y = closed_deals(spark, sf_dir).groupBy("symbol", F.year("created_at").alias("year")).agg(F.sum("r").alias("s"))
    g = y.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.count_if(F.col("s") > 0), F.count_if(F.col("s") < 0)).alias("agree"))
    return g.select("symbol", "n", "agree", r8(statistics.sign_test(F.col("agree"), F.col("n")), "p"))


@register()
def cluster_t_test(spark, sf_dir):
    out = statistics.cluster_t_test(closed_deals(spark, sf_dir), "r", ["symbol"], ["action"])
    return out.select("action", *r6("mean", "se", "z", "p"), "n", "clusters")


@register()
def ridge_choice(spark, sf_dir):
    """Error of each penalty under an expanding window of years with an embargo."""
    b = features.momentum(daily_bars(spark, sf_dir)).withColumn("y", features.forward_returns(None, 5, "close_close")).withColumn("year", F.year("ts"))
    return statistics.expanding_ridge(b, ["mom_1", "mom_5", "mom_20"], "y", "year", (0.1, 1.0, 10.0, 100.0))


# Universe, metadata, notices


@register(DAILY_SQL + "SELECT market, symbol, timeframe, count(*) AS bars, min(ts) AS from_ts, max(ts) AS to_ts, " + COST_SQL + " AS bps FROM bars WHERE market IN ('GOLD', 'CRYPTO') AND timeframe = '1D' GROUP BY ALL HAVING count(*) >= 100")
def series_metadata(spark, sf_dir):
    """What there is, without reading a bar more than its key: the filtered list of series."""
    b = daily_bars(spark, sf_dir).where(F.col("market").isin("GOLD", "CRYPTO") & (F.col("timeframe") == "1D"))
    g = b.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts")).where("bars >= 100")
    return g.withColumn("bps", prices.cost_bps(F.col("market")))


@register(SIGNALS_SQL + "SELECT user_id, max(created_at) FILTER (signal_id % 4 = 0) AS last_notified, count(*) FILTER (signal_id % 4 = 0) AS notified FROM s GROUP BY user_id")
def last_notified(spark, sf_dir):
    """When each user was last told of a signal."""
    sent = F.col("signal_id") % 4 == 0
    return flat_signals(spark, sf_dir).groupBy("user_id").agg(F.max(F.when(sent, F.col("created_at"))).alias("last_notified"), F.count_if(sent).alias("notified"))
