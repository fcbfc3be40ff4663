"""Named queries: what each operator returns over the tables, and the SQL that checks it.

``QUERIES`` maps a name to (query, SQL or None).  Doubles are rounded on both sides, because two
engines sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.functions import prices
from candlewright.operators import features, indicators, joins, positions, simulation, statistics
from candlewright.operators import signals as engine
from candlewright.plans.engine_sql import LEVELS, gate_sql, signals_sql, state_sql, walk_sql
from candlewright.sources.bars import DAILY_SQL, HOURLY_SQL, SERIES, daily_bars, hourly_bars, series, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}
KEY = ["market", "symbol", "timeframe", "ts"]
OHLCV = ["open", "high", "low", "close", "volume"]


def register(sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = (query, sql)
        return query

    return add


def places(name: str) -> int:
    """Prices are short decimals, so 6 places may cut them at a tie; 9 don't."""
    return 9 if name in OHLCV else 6


def r6(*names: str) -> list:
    return [F.round(n, places(n)).alias(n) for n in names]


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, {places(n)}) AS {n}" for n in names)


P = "OVER (PARTITION BY market, symbol, timeframe ORDER BY ts"
KEYS = "market, symbol, timeframe, ts"


# Bars and their quality


@register(DAILY_SQL + f"SELECT {KEYS}, bar_idx, {_r(*OHLCV)} FROM bars")
def bars_daily(spark, sf_dir):
    return daily_bars(spark, sf_dir).select(*KEY, "bar_idx", *r6(*OHLCV))


@register(HOURLY_SQL + f"SELECT {KEYS}, bar_idx, {_r(*OHLCV)} FROM bars")
def bars_hourly(spark, sf_dir):
    return hourly_bars(spark, sf_dir).select(*KEY, "bar_idx", *r6(*OHLCV))


@register(HOURLY_SQL + f"SELECT {KEYS}, {_r('close')} FROM bars WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND low <= high AND NOT (open = high AND high = low AND low = close AND volume = 0)")
def usable_bars(spark, sf_dir):
    b = hourly_bars(spark, sf_dir).where(prices.usable())
    padded = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close")) & (F.col("volume") == 0)
    return b.where(~padded).select(*KEY, *r6("close"))


@register(DAILY_SQL + """, g AS (SELECT *, date_diff('day', lag(ts) OVER (PARTITION BY market, symbol, timeframe ORDER BY ts), ts) AS gap FROM bars)
SELECT market, symbol, timeframe, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts, CAST(max(gap) AS BIGINT) AS max_gap_days, count(*) FILTER (gap > 3) AS long_gaps,
 count(*) FILTER (open = high AND high = low AND low = close) AS flat_bars, round(avg((high - low) / close), 6) AS mean_range FROM g GROUP BY ALL""")
def quality_audit(spark, sf_dir):
    gap = F.datediff("ts", F.lag("ts").over(series()))
    b = daily_bars(spark, sf_dir).withColumn("gap", gap)
    flat = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    return b.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("gap").cast("long").alias("max_gap_days"), F.count_if(F.col("gap") > 3).alias("long_gaps"),
                                  F.count_if(flat).alias("flat_bars"), F.round(F.avg((F.col("high") - F.col("low")) / F.col("close")), 6).alias("mean_range"))


@register(DAILY_SQL + "SELECT market, symbol, timeframe, CAST(year(ts) AS INTEGER) AS year, count(*) AS bars, count(*) FILTER (high = low) AS flat_bars, round(avg(volume), 6) AS mean_volume, count(*) FILTER (high = low) * 2 > count(*) AS failing FROM bars GROUP BY ALL")
def year_quality(spark, sf_dir):
    flat = F.count_if(F.col("high") == F.col("low"))
    g = daily_bars(spark, sf_dir).groupBy(*SERIES, F.year("ts").alias("year"))
    return g.agg(F.count(F.lit(1)).alias("bars"), flat.alias("flat_bars"), F.round(F.avg("volume"), 6).alias("mean_volume")).withColumn("failing", F.col("flat_bars") * 2 > F.col("bars"))


@register(DAILY_SQL + """, g AS (SELECT *, lag(ts) OVER (PARTITION BY market, symbol, timeframe ORDER BY ts) AS before FROM bars)
SELECT market, symbol, timeframe, before AS gap_from, ts AS gap_to, CAST(date_diff('day', before, ts) AS BIGINT) AS days FROM g WHERE date_diff('day', before, ts) > 2
QUALIFY row_number() OVER (PARTITION BY market, symbol, timeframe ORDER BY ts) <= 8""")
def date_gaps(spark, sf_dir):
    b = daily_bars(spark, sf_dir).withColumn("before", F.lag("ts").over(series())).withColumn("days", F.datediff("ts", "before").cast("long")).where("days > 2")
    return b.withColumn("n", F.row_number().over(series())).where("n <= 8").select(*SERIES, F.col("before").alias("gap_from"), F.col("ts").alias("gap_to"), "days")


# Indicators


@register(DAILY_SQL + f"""SELECT {KEYS}, round(CASE WHEN count(close) {P} ROWS 19 PRECEDING) = 20 THEN avg(close) {P} ROWS 19 PRECEDING) END, 6) AS sma20,
 round(CASE WHEN count(close) {P} ROWS 49 PRECEDING) = 50 THEN avg(close) {P} ROWS 49 PRECEDING) END, 6) AS sma50 FROM bars""")
def sma_20_50(spark, sf_dir):
    return daily_bars(spark, sf_dir).select(*KEY, F.round(indicators.sma("close", 20), 6).alias("sma20"), F.round(indicators.sma("close", 50), 6).alias("sma50"))


BB_SQL = DAILY_SQL + f""", m AS (SELECT *, avg(close) {P} ROWS 19 PRECEDING) AS mid, stddev_pop(close) {P} ROWS 19 PRECEDING) AS dev, count(*) {P} ROWS 19 PRECEDING) AS c FROM bars)"""


@register(BB_SQL + f" SELECT {KEYS}, round(mid - 2 * dev, 6) AS bb_lower, round(mid, 6) AS bb_middle, round(mid + 2 * dev, 6) AS bb_upper FROM m WHERE c = 20")
def bollinger_20(spark, sf_dir):
    lower, mid, upper = indicators.bollinger()
    return daily_bars(spark, sf_dir).select(*KEY, F.round(lower, 6).alias("bb_lower"), F.round(mid, 6).alias("bb_middle"), F.round(upper, 6).alias("bb_upper")).where("bb_middle IS NOT NULL")


@register(BB_SQL + """ SELECT market, symbol, timeframe, ts, round(close, 9) AS close, round((close - mid) / dev, 6) AS z, CAST(row_number() OVER (PARTITION BY market, symbol, timeframe ORDER BY abs(round((close - mid) / dev, 6)) DESC, ts) AS INTEGER) AS rank
 FROM m WHERE c = 20 AND dev > 0 AND abs(round((close - mid) / dev, 6)) > 2 QUALIFY row_number() OVER (PARTITION BY market, symbol, timeframe ORDER BY abs(round((close - mid) / dev, 6)) DESC, ts) <= 3""")
def bollinger_outliers(spark, sf_dir):
    """The flagship query: each series' three bars farthest outside its bands."""
    frame = indicators.last(20)
    b = daily_bars(spark, sf_dir).withColumn("dev", F.stddev_pop("close").over(frame)).withColumn("z", F.round((F.col("close") - indicators.sma("close", 20)) / F.col("dev"), 6))
    w = Window.partitionBy(*SERIES).orderBy(F.desc(F.abs("z")), "ts")
    return b.where("dev > 0 AND abs(z) > 2").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select(*KEY, *r6("close"), "z", "rank")


TR_SQL = f", t AS (SELECT *, lag(close) {P}) AS pc FROM bars), tr AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS true_range FROM t), atr AS (SELECT *, avg(true_range) {P} ROWS 13 PRECEDING) AS atr FROM tr)"


@register(DAILY_SQL + TR_SQL + f" SELECT {KEYS}, {_r('true_range', 'atr')} FROM atr")
def true_range_atr14(spark, sf_dir):
    return indicators.with_atr(daily_bars(spark, sf_dir)).select(*KEY, *r6("true_range", "atr"))


@register(DAILY_SQL + f""", s AS (SELECT *, count(*) {P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5 AND count(*) {P} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 AS whole,
 max(high) {P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h0, max(high) {P} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS h1, min(low) {P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l0, min(low) {P} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS l1 FROM bars)
SELECT {KEYS}, high > h0 AND high > h1 AS swing_high, low < l0 AND low < l1 AS swing_low FROM s WHERE whole AND ((high > h0 AND high > h1) OR (low < l0 AND low < l1))""")
def swing_points(spark, sf_dir):
    return indicators.with_swings(daily_bars(spark, sf_dir)).where("swing_high OR swing_low").select(*KEY, "swing_high", "swing_low")


@register(DAILY_SQL + LEVELS + f" SELECT {', '.join('bars.' + c for c in KEY)}, coalesce(array_to_string(list_transform(supports, lambda q: printf('%.4f', q)), ','), '') AS supports, coalesce(array_to_string(list_transform(resistances, lambda q: printf('%.4f', q)), ','), '') AS resistances FROM bars LEFT JOIN near ON bars.symbol = near.symbol AND bars.market = near.market AND bars.timeframe = near.timeframe AND bars.bar_idx = near.bar_idx")
def swing_levels(spark, sf_dir):
    shown = lambda name: F.array_join(F.transform(name, lambda x: F.format_string("%.4f", x)), ",").alias(name)
    return indicators.with_levels(daily_bars(spark, sf_dir)).select(*KEY, shown("supports"), shown("resistances"))


@register(HOURLY_SQL + f""", q AS (SELECT *, lag(open) {P}) AS po, lag(close) {P}) AS pc, abs(close - open) AS body, high - greatest(open, close) AS u, least(open, close) - low AS d FROM bars)
SELECT {KEYS}, coalesce(pc < po AND close > open AND close > po AND open < pc, false) AS bullish_engulfing, coalesce(pc > po AND close < open AND close < po AND open > pc, false) AS bearish_engulfing,
 d > 2 * body AND u < 0.5 * body AS hammer, u > 2 * body AND d < 0.5 * body AS shooting_star, high > low AND body < 0.1 * (high - low) AS doji FROM q""")
def candle_patterns(spark, sf_dir):
    return hourly_bars(spark, sf_dir).select(*KEY, *[c.alias(n) for n, c in indicators.patterns().items()])


def _recursive_ema(n: int) -> str:
    k = 2 / (n + 1)
    return f""", e AS (
  SELECT market, symbol, timeframe, ts, bar_idx, close, avg(close) {P} ROWS {n - 1} PRECEDING) AS seed FROM bars),
ema AS (
  SELECT market, symbol, timeframe, ts, bar_idx, seed AS v FROM e WHERE bar_idx = {n - 1}
  UNION ALL
  SELECT e.market, e.symbol, e.timeframe, e.ts, e.bar_idx, e.close * {k!r} + ema.v * (1 - {k!r})
  FROM ema JOIN e ON e.market = ema.market AND e.symbol = ema.symbol AND e.timeframe = ema.timeframe AND e.bar_idx = ema.bar_idx + 1)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH b AS", "WITH RECURSIVE b AS", 1)


@register(_recursive(HOURLY_SQL) + _recursive_ema(12) + f" SELECT {KEYS}, round(v, 6) AS ema12 FROM ema")
def ema_12(spark, sf_dir):
    return indicators.with_recursive(hourly_bars(spark, sf_dir)).where("ema12 IS NOT NULL").select(*KEY, *r6("ema12"))


@register(_recursive(HOURLY_SQL) + f""", d AS (SELECT *, close - lag(close) {P}) AS d FROM bars),
g AS (SELECT *, greatest(d, 0) AS gain, greatest(-d, 0) AS loss, avg(greatest(d, 0)) {P} ROWS 13 PRECEDING) AS g0, avg(greatest(-d, 0)) {P} ROWS 13 PRECEDING) AS l0 FROM d),
rsi AS (SELECT market, symbol, timeframe, ts, bar_idx, g0 AS g, l0 AS l FROM g WHERE bar_idx = 14
 UNION ALL SELECT g.market, g.symbol, g.timeframe, g.ts, g.bar_idx, (rsi.g * 13 + g.gain) / 14, (rsi.l * 13 + g.loss) / 14 FROM rsi JOIN g ON g.market = rsi.market AND g.symbol = rsi.symbol AND g.timeframe = rsi.timeframe AND g.bar_idx = rsi.bar_idx + 1)
SELECT {KEYS}, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi14 FROM rsi""")
def rsi_14(spark, sf_dir):
    return indicators.with_recursive(hourly_bars(spark, sf_dir)).where("rsi14 IS NOT NULL").select(*KEY, *r6("rsi14"))


@register(state_sql(DAILY_SQL) + f" SELECT {', '.join('x.' + c for c in KEY)}, {', '.join(f'round(rec.{a}, 6) AS {b}' for a, b in (('e12', 'ema12'), ('e20', 'ema20'), ('e26', 'ema26'), ('macd', 'macd'), ('line', 'macd_signal'), ('hist', 'macd_hist'), ('rsi', 'rsi14')))} FROM x JOIN rec ON x.symbol = rec.symbol AND x.market = rec.market AND x.timeframe = rec.timeframe AND x.bar_idx = rec.bar_idx")
def macd_full(spark, sf_dir):
    return indicators.with_recursive(daily_bars(spark, sf_dir)).select(*KEY, *r6("ema12", "ema20", "ema26", "macd", "macd_signal", "macd_hist", "rsi14"))


@register(_recursive(DAILY_SQL) + f""", q AS MATERIALIZED (SELECT *, ln(close) - ln(lag(close) {P})) AS r FROM bars),
v AS (SELECT market, symbol, timeframe, ts, bar_idx, r * r AS v FROM q WHERE bar_idx = 1
 UNION ALL SELECT q.market, q.symbol, q.timeframe, q.ts, q.bar_idx, 0.94::DOUBLE * v.v + 0.06::DOUBLE * q.r * q.r FROM v JOIN q ON q.market = v.market AND q.symbol = v.symbol AND q.timeframe = v.timeframe AND q.bar_idx = v.bar_idx + 1)
SELECT {KEYS}, round(sqrt(v), 6) AS ewma_vol FROM v""")
def ewma_volatility(spark, sf_dir):
    return indicators.with_volatility(daily_bars(spark, sf_dir)).where("ewma_vol IS NOT NULL").select(*KEY, *r6("ewma_vol"))


@register(DAILY_SQL + f""", m AS (SELECT *, avg(close) {P} ROWS 19 PRECEDING) AS m20, avg(close) {P} ROWS 49 PRECEDING) AS m50, avg(close) {P} ROWS 199 PRECEDING) AS m200 FROM bars),
q AS (SELECT *, round(close, 9) AS c, round(m20, 6) AS f, CASE WHEN bar_idx >= 49 THEN round(m50, 6) END AS s, CASE WHEN bar_idx >= 199 THEN round(m200, 6) END AS l FROM m)
SELECT {KEYS}, CASE WHEN c > f AND f > s AND (l IS NULL OR s > l) THEN 'uptrend' WHEN c < f AND f < s AND (l IS NULL OR s < l) THEN 'downtrend' ELSE 'sideways' END AS trend FROM q""")
def trend_label(spark, sf_dir):
    b = daily_bars(spark, sf_dir)
    for n in (20, 50, 200):
        b = b.withColumn(f"m{n}", F.round(indicators.sma("close", n), 6))
    return b.select(*KEY, indicators.trend(F.round("close", 9), F.col("m20"), F.col("m50"), F.col("m200")).alias("trend"))


@register(DAILY_SQL + f""", e AS (SELECT *, close - lag(close, 20) {P}) AS move, abs(close - lag(close) {P})) AS step FROM bars), g AS (SELECT *, sum(step) {P} ROWS 19 PRECEDING) AS path, count(step) {P} ROWS 19 PRECEDING) AS c FROM e)
SELECT {KEYS}, round(abs(move) / path, 6) AS efficiency FROM g WHERE c = 20 AND path > 0""")
def efficiency_ratio(spark, sf_dir):
    b = daily_bars(spark, sf_dir).withColumn("step", F.abs(F.col("close") - F.lag("close").over(series())))
    move, path = indicators.efficiency_ratio()
    return b.withColumn("move", move).withColumn("path", path).where("path > 0").select(*KEY, F.round(F.abs("move") / F.col("path"), 6).alias("efficiency"))


# Signals and gate


SIGNAL = ["action", "strength", "confidence", "entry_price", "stop_loss", "take_profit"]


SCORES = ["bull", "bear", "r_rsi_extreme", "r_rsi_cross", "r_macd", "r_hist", "r_trend", "r_band", "p_bull", "p_bear"]


def labels():
    """The reasons' labels as one text."""
    return F.array_join(F.transform("reasons", lambda x: x["label"]), ",").alias("reasons")


def shown(names: list[str]) -> list:
    return [F.round(n, 6).alias(n) if n in ("entry_price", "stop_loss", "take_profit") else F.col(n) for n in names]


def _shown(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" if n in ("entry_price", "stop_loss", "take_profit") else n for n in names)


@register(signals_sql(DAILY_SQL) + f" SELECT {KEYS}, {_shown(SIGNAL)}, {', '.join(SCORES)}, reasons, expires_at FROM sig WHERE has_signal")
def signals_all_bars(spark, sf_dir):
    s = engine.all_signals(daily_bars(spark, sf_dir)).where("has_signal")
    return s.select(*KEY, *shown(SIGNAL), *SCORES, labels(), "expires_at")


NEWS = "(((bar_idx * 7) % 21 - 10) / 10.0)::DOUBLE"


@register(signals_sql(HOURLY_SQL, f"round({NEWS.replace('bar_idx', 'x.bar_idx')}, 1)") + f" SELECT {KEYS}, action, confidence, bull, bear, r_news, reasons FROM sig WHERE has_signal")
def signals_with_news(spark, sf_dir):
    """Signals of bars that carry a news sentiment."""
    b = hourly_bars(spark, sf_dir).withColumn("news", F.round((F.col("bar_idx") * 7 % 21 - 10) / 10, 1))
    return engine.all_signals(b).where("has_signal").select(*KEY, "action", "confidence", "bull", "bear", "r_news", labels())


PUBLISHED = {"rsi": ("rsi", 2), "macd": ("macd", 4), "macd_signal": ("line", 4), "ma20": ("e20", 4), "atr": ("atr", 4)}


@register(signals_sql(HOURLY_SQL) + " UNION ALL ".join(f" SELECT {KEYS}, '{name}' AS name, CAST(printf('%.{n}f', {column}) AS DOUBLE) AS value FROM sig WHERE has_signal AND {column} IS NOT NULL" for name, (column, n) in PUBLISHED.items()))
def signal_indicators(spark, sf_dir):
    """The indicator map of every signal, one row per entry; the plain means, which tie at four places
    and are checked by other queries, are left to the map."""
    s = engine.all_signals(hourly_bars(spark, sf_dir)).where("has_signal")
    return s.select(*KEY, F.explode("indicators").alias("name", "value")).where(F.col("name").isin(*PUBLISHED))


@register(signals_sql(HOURLY_SQL) + " SELECT rule, CAST(sum(score) AS BIGINT) AS total, count(*) FILTER (score <> 0) AS met, CAST(0 AS BIGINT) AS unexplained FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, {r} AS score FROM sig" for r in SCORES[2:]) + ") GROUP BY rule")
def score_by_rule(spark, sf_dir):
    """Each rule's sum, and the bars whose net score is not the sum of its parts (none)."""
    s = engine.all_signals(hourly_bars(spark, sf_dir))
    parts = sum((F.col(c) for c in [*SCORES[2:8], "p_bull", "s_support"]), F.lit(0)) - F.col("p_bear") - F.col("s_resistance")
    s = s.withColumn("off", (F.col("bull") - F.col("bear") != parts).cast("long"))
    rows = s.select("off", F.explode(F.create_map(*[x for r in SCORES[2:] for x in (F.lit(r), F.col(r))])).alias("rule", "score"))
    return rows.groupBy("rule").agg(F.sum("score").alias("total"), F.count_if(F.col("score") != 0).alias("met"), F.sum("off").alias("unexplained"))


@register(gate_sql(DAILY_SQL) + f" SELECT {KEYS}, {_shown(SIGNAL)}, round(rr, 6) AS rr, round(stop_pct, 6) AS stop_pct, array_to_string(rejections, ',') AS rejections, len(rejections) = 0 AS accepted FROM gt QUALIFY row_number() OVER (PARTITION BY market, symbol, timeframe ORDER BY ts DESC) = 1")
def scan_latest(spark, sf_dir):
    g = engine.latest(engine.gate(engine.all_signals(daily_bars(spark, sf_dir))))
    return g.select(*KEY, *shown(SIGNAL), *r6("rr", "stop_pct"), F.array_join("rejections", ",").alias("rejections"), "accepted")


@register(gate_sql(DAILY_SQL) + " SELECT code, count(*) AS n FROM (SELECT unnest(rejections) AS code FROM gt) GROUP BY code")
def gate_rejections(spark, sf_dir):
    g = engine.gate(engine.all_signals(daily_bars(spark, sf_dir)))
    return g.select(F.explode("rejections").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code")


@register(gate_sql(DAILY_SQL, 400.0) + f""", rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY ts ORDER BY confidence DESC, round(rr, 6) DESC, symbol, timeframe) AS INTEGER) AS rank FROM gt WHERE len(rejections) = 0)
SELECT {KEYS}, {_shown(SIGNAL)}, round(rr, 6) AS rr, rank FROM rk WHERE rank <= 5""")
def gate_top5(spark, sf_dir):
    """The five best of each day.  These prices jump by multiples, so the widest stop is set at 400 %."""
    g = engine.gate(engine.all_signals(daily_bars(spark, sf_dir)), engine.GATE | {"max_stop_pct": 400.0}).withColumn("rr", F.round("rr", 6))
    return engine.ranked(g, ["ts"]).select(*KEY, *shown(SIGNAL), "rr", "rank")


def flat_signals(spark, sf_dir):
    """Signals with simple levels, one per order, for the relational queries: symbol and side by key."""
    o = table(spark, sf_dir, "orders")
    sign = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    entry = F.col("o_totalprice")
    return o.select(F.col("o_orderkey").alias("signal_id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("S"), (F.col("o_orderkey") % 20).cast("string")).alias("symbol"), F.lit("1D").alias("timeframe"),
                    F.when(sign == 1, "BUY").otherwise("SELL").alias("action"), entry.alias("entry"), (entry * (1 - sign * (F.col("o_orderkey") % 10 + 1) / 200)).alias("stop"),
                    (entry * (1 + sign * (F.col("o_orderkey") % 13 + 1) / 100)).alias("target"), (40 + F.col("o_orderkey") % 56).cast("double").alias("confidence"), F.col("o_orderdate").alias("created_at"),
                    F.col("o_orderstatus").alias("status"))


SIGNALS_SQL = """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS sign, o_totalprice AS entry FROM orders),
s AS (SELECT o_orderkey AS signal_id, o_custkey AS user_id, concat('S', o_orderkey % 20) AS symbol, '1D' AS timeframe, CASE WHEN sign = 1 THEN 'BUY' ELSE 'SELL' END AS action, entry,
 entry * (1 - sign * (o_orderkey % 10 + 1) / 200) AS stop, entry * (1 + sign * (o_orderkey % 13 + 1) / 100) AS target, CAST(40 + o_orderkey % 56 AS DOUBLE) AS confidence,
 o_orderdate AS created_at, o_orderstatus AS status FROM o)
"""


@register(SIGNALS_SQL + """, g AS (SELECT *, abs(target - entry) / abs(entry - stop) AS rr, abs(entry - stop) / entry * 100 AS stop_pct FROM s WHERE abs(entry - stop) > 0),
a AS (SELECT *, round(rr, 6) AS q FROM g WHERE confidence >= 70 AND round(rr, 6) >= 1.5 AND round(stop_pct, 6) BETWEEN 0.15 AND 8)
SELECT user_id, signal_id, symbol, action, confidence, q AS rr, CAST(row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, q DESC, symbol, signal_id) AS INTEGER) AS rank FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, q DESC, symbol, signal_id) <= 5""")
def recipient_top5(spark, sf_dir):
    s = flat_signals(spark, sf_dir).withColumn("rr", F.round(prices.risk_reward(F.col("entry"), F.col("stop"), F.col("target")), 6))
    s = s.withColumn("stop_pct", F.round(F.abs(F.col("entry") - F.col("stop")) / F.col("entry") * 100, 6)).where("confidence >= 70 AND rr >= 1.5 AND stop_pct BETWEEN 0.15 AND 8")
    w = Window.partitionBy("user_id").orderBy(F.desc("confidence"), F.desc("rr"), "symbol", "signal_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("user_id", "signal_id", "symbol", "action", "confidence", "rr", "rank")


@register(SIGNALS_SQL + """, q AS (SELECT *, round(abs(target - entry) / abs(entry - stop), 6) AS rr FROM s WHERE abs(entry - stop) > 0)
SELECT signal_id, round(CASE WHEN confidence >= 85 THEN 40 WHEN confidence >= 70 THEN 28 WHEN confidence >= 55 THEN 14 ELSE 0 END + confidence / 100 * 30 + least(rr, 3) / 3 * 20, 6) AS score FROM q""")
def composite_score(spark, sf_dir):
    s = flat_signals(spark, sf_dir).withColumn("rr", F.round(prices.risk_reward(F.col("entry"), F.col("stop"), F.col("target")), 6)).where("rr IS NOT NULL")
    strength = F.when(F.col("confidence") >= 85, "very_strong").when(F.col("confidence") >= 70, "strong").when(F.col("confidence") >= 55, "moderate").otherwise("weak")
    return s.select("signal_id", F.round(prices.composite_score(strength, F.col("confidence"), F.col("rr"), F.lit(0.0)), 6).alias("score"))


# Simulation


@register(HOURLY_SQL + "SELECT " + KEYS + "".join(f", CASE WHEN count(*) {P} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN round(max(high) {P} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING), 6) END AS max_{h}, CASE WHEN count(*) {P} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN round(min(low) {P} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING), 6) END AS min_{h}" for h in (1, 5, 10, 20)) + " FROM bars")
def horizon_extremes(spark, sf_dir):
    return simulation.horizon_extremes(hourly_bars(spark, sf_dir)).select(*KEY, *r6(*[f"{m}_{h}" for h in (1, 5, 10, 20) for m in ("max", "min")]))


def _exit_sql(bars_sql: str, hold: int) -> str:
    return bars_sql + TR_SQL + f""", c AS (SELECT *, unnest(['BUY', 'SELL']) AS action FROM atr WHERE atr > 0 AND close > 0),
g AS (SELECT *, CASE WHEN action = 'BUY' THEN 1 ELSE -1 END AS sign FROM c),
l AS (SELECT *, round(close - sign * 1.5 * atr, 6) AS stop, round(close + sign * 3.0 * atr, 6) AS target FROM g),
p AS (SELECT l.market, l.symbol, l.timeframe, l.bar_idx, l.action, l.sign, l.close, l.stop, l.target, f.bar_idx AS j, round(f.open, 9) AS fo, round(f.high, 9) AS fh, round(f.low, 9) AS fl, round(f.close, 9) AS fc FROM l JOIN bars f ON f.market = l.market AND f.symbol = l.symbol AND f.timeframe = l.timeframe AND f.bar_idx BETWEEN l.bar_idx + 1 AND l.bar_idx + {hold} WHERE l.stop > 0 AND l.target > 0),
h AS (SELECT *, CASE WHEN sign * (fo - stop) <= 0 THEN 'gap_stop' WHEN sign * (fo - target) >= 0 THEN 'gap_target' WHEN sign * (CASE WHEN sign = 1 THEN fl ELSE fh END - stop) <= 0 THEN 'stop_loss' WHEN sign * (CASE WHEN sign = 1 THEN fh ELSE fl END - target) >= 0 THEN 'take_profit' END AS hit FROM p WHERE fo > 0 AND fl > 0 AND fc > 0 AND fl <= fh),
x AS (SELECT market, symbol, timeframe, bar_idx, action, arg_min(hit, j) FILTER (hit IS NOT NULL) AS reason, min(j) FILTER (hit IS NOT NULL) AS hit_j, max(j) AS last_j, min(j) AS first_j,
 arg_min(CASE WHEN hit LIKE 'gap%' THEN fo WHEN hit = 'stop_loss' THEN stop ELSE target END, j) FILTER (hit IS NOT NULL) AS hit_price, arg_max(fc, j) AS last_price FROM h GROUP BY ALL)
SELECT market, symbol, timeframe, bar_idx, action, coalesce(reason, 'time_exit') AS reason, coalesce(hit_j, last_j) AS exit_idx, round(coalesce(hit_price, last_price), 6) AS exit FROM x WHERE first_j = bar_idx + 1"""


def _rounded(bars: DataFrame) -> DataFrame:
    return bars.select(*[c for c in bars.columns if c not in OHLCV], *r6(*OHLCV))


def _both_sides(spark, sf_dir, hold: int) -> DataFrame:
    b = simulation.with_ahead(_rounded(indicators.with_atr(hourly_bars(spark, sf_dir))), hold)
    c = simulation.fixed_geometry(b).withColumn("stop_loss", F.round("stop_loss", 6)).withColumn("take_profit", F.round("take_profit", 6)).where("stop_loss > 0 AND take_profit > 0")
    return simulation.exits(c, hold).where("status = 'deal'")


@register(_exit_sql(HOURLY_SQL, 10))
def fixed_geometry_exits(spark, sf_dir):
    return _both_sides(spark, sf_dir, 10).select(*SERIES, "bar_idx", "action", "reason", "exit_idx", F.round("exit", 6).alias("exit"))


#: The hold caps that are compared.
CAPS = (1, 2, 3, 5, 10, 20, 40)


@register("SELECT cap, reason, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT {h} AS cap, * FROM ({_exit_sql(HOURLY_SQL, h)})" for h in CAPS) + ") GROUP BY ALL")
def hold_cap_sweep(spark, sf_dir):
    """One pass with the longest cap tells the exits under all: a shorter one cuts later hits to time exits."""
    out = _both_sides(spark, sf_dir, max(CAPS)).withColumn("cap", F.explode(F.array(*map(F.lit, CAPS))))
    reason = F.when(F.col("exit_idx") - F.col("bar_idx") <= F.col("cap"), F.col("reason")).otherwise("time_exit")
    return out.groupBy("cap", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def recorded_signals(spark, sf_dir):
    """A signal at every hourly bar.  Levels keep six places: at four, products of short decimals tie."""
    b = indicators.with_atr(hourly_bars(spark, sf_dir)).where("atr > 0")
    sign = F.when(F.col("bar_idx") % 2 == 0, 1).otherwise(-1)
    entry = F.round("close", 4)
    return b.select(F.concat_ws(":", "symbol", F.col("bar_idx").cast("string")).alias("signal_id"), *SERIES, "bar_idx", "ts", F.when(sign == 1, "BUY").otherwise("SELL").alias("action"), entry.alias("entry_price"),
                    F.round(entry - sign * 1.5 * F.round("atr", 4), 6).alias("stop_loss"), F.round(entry + sign * 2.5 * F.round("atr", 4), 6).alias("take_profit"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("expires_at"))


@register(HOURLY_SQL + TR_SQL + """, s AS (SELECT concat(symbol, ':', bar_idx) AS signal_id, market, symbol, timeframe, bar_idx, ts, CASE WHEN bar_idx % 2 = 0 THEN 1 ELSE -1 END AS sign, round(close, 4) AS entry, round(atr, 4) AS a FROM atr WHERE atr > 0),
l AS (SELECT *, round(entry - sign * 1.5 * a, 6) AS stop, round(entry + sign * 2.5 * a, 6) AS target, ts + INTERVAL 12 HOURS AS expires_at FROM s),
n AS (SELECT *, CASE WHEN NOT abs(entry - stop) > 0 OR abs(entry - stop) / abs(entry) < 1e-6 THEN 'no_risk' WHEN NOT (sign * (entry - stop) > 0 AND sign * (target - entry) > 0) THEN 'wrong_side' END AS note FROM l),
p AS (SELECT n.signal_id, n.sign, n.entry, n.stop, n.target, n.expires_at, f.ts AS t, f.bar_idx - n.bar_idx AS k, f.high, f.low, f.close FROM n JOIN bars f ON f.market = n.market AND f.symbol = n.symbol AND f.timeframe = n.timeframe AND f.bar_idx BETWEEN n.bar_idx + 1 AND n.bar_idx + 24 WHERE n.note IS NULL),
e AS (SELECT *, CASE WHEN CASE WHEN sign = 1 THEN low <= stop ELSE high >= stop END THEN 'sl' WHEN CASE WHEN sign = 1 THEN high >= target ELSE low <= target END THEN 'tp' WHEN t >= expires_at OR k = 24 THEN 'timeout' END AS o FROM p),
d AS (SELECT signal_id, arg_min(o, k) FILTER (o IS NOT NULL) AS outcome, min(k) FILTER (o IS NOT NULL) AS bars_held, arg_min(CASE WHEN o = 'sl' THEN stop WHEN o = 'tp' THEN target ELSE close END, k) FILTER (o IS NOT NULL) AS exit_price FROM e GROUP BY signal_id)
SELECT n.signal_id, CASE WHEN note IS NOT NULL THEN 'unresolvable' ELSE outcome END AS outcome, bars_held, round(exit_price, 6) AS exit_price FROM n LEFT JOIN d ON d.signal_id = n.signal_id""")
def resolve_outcomes(spark, sf_dir):
    out = simulation.resolve_outcomes(recorded_signals(spark, sf_dir), hourly_bars(spark, sf_dir))
    return out.select("signal_id", "outcome", F.col("bars_held").cast("int").alias("bars_held"), F.round("exit_price", 6).alias("exit_price"))


@register(walk_sql(DAILY_SQL) + " SELECT market, symbol, timeframe, bar_idx, action, round(entry, 9) AS entry, round(exit, 9) AS exit, exit_idx, reason, round(gain / planned_risk, 6) AS r_planned, round(CASE WHEN realized_risk > 0 THEN gain / realized_risk END, 6) AS r_realized, round(planned_risk, 6) AS planned_risk, round(realized_risk, 6) AS realized_risk, exit_idx - bar_idx - 1 AS hold_bars FROM deals")
def walk_forward_deals(spark, sf_dir):
    w = simulation.walk_forward(engine.all_signals(daily_bars(spark, sf_dir))).where("status = 'deal'")
    return w.select(*SERIES, "bar_idx", "action", F.round("entry", 9).alias("entry"), F.round("exit", 9).alias("exit"), "exit_idx", "reason", *r6("r_planned", "r_realized", "planned_risk", "realized_risk"), "hold_bars")


@register(walk_sql(DAILY_SQL) + """, t AS (SELECT *, gain / planned_risk AS r FROM deals), e AS (SELECT *, sum(r) OVER w AS equity, sum(CASE WHEN r >= 0 THEN 1 ELSE 0 END) OVER w AS island FROM t WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)) AS peak, sum(CASE WHEN r < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS streak FROM e)
SELECT market, symbol, timeframe, count(*) AS n, count(*) FILTER (r > 0) AS wins, count(*) FILTER (r < 0) AS losses, round(avg(r), 6) AS avg_r, round(sum(CASE WHEN r > 0 THEN r ELSE 0 END), 6) AS gross_win, round(sum(CASE WHEN r < 0 THEN -r ELSE 0 END), 6) AS gross_loss, round(max(peak - equity), 6) AS max_drawdown, CAST(max(streak) AS BIGINT) AS max_losses_in_row FROM p GROUP BY ALL""")
def walk_forward_stats(spark, sf_dir):
    w = simulation.walk_forward(engine.all_signals(daily_bars(spark, sf_dir))).where("status = 'deal'")
    out = simulation.deal_stats(w, SERIES, ["bar_idx"])
    return out.select(*SERIES, "n", "wins", "losses", *r6("avg_r", "gross_win", "gross_loss", "max_drawdown"), "max_losses_in_row")


def closed_deals(spark, sf_dir):
    """Closed positions from orders: side and exit by key, result in units of risk."""
    s = flat_signals(spark, sf_dir).where("status = 'F'")
    r = ((F.col("signal_id") * 7) % 41 - 20) / 10
    return s.select("signal_id", "user_id", "symbol", "action", "created_at", r.alias("r"))


DEALS_SQL = SIGNALS_SQL + ", t AS (SELECT signal_id, user_id, symbol, action, created_at, ((signal_id * 7) % 41 - 20) / 10 AS r FROM s WHERE status = 'F')"


@register(DEALS_SQL + """, e AS (SELECT *, sum(r) OVER w AS equity, sum(CASE WHEN r >= 0 THEN 1 ELSE 0 END) OVER w AS island FROM t WINDOW w AS (PARTITION BY symbol ORDER BY created_at, signal_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY symbol ORDER BY created_at, signal_id ROWS UNBOUNDED PRECEDING)) AS peak, sum(CASE WHEN r < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY created_at, signal_id ROWS UNBOUNDED PRECEDING) AS streak FROM e)
SELECT symbol, count(*) AS n, count(*) FILTER (r > 0) AS wins, count(*) FILTER (r < 0) AS losses, round(avg(r), 6) AS avg_r, round(sum(CASE WHEN r > 0 THEN r ELSE 0 END), 6) AS gross_win, round(sum(CASE WHEN r < 0 THEN -r ELSE 0 END), 6) AS gross_loss, round(max(peak - equity), 6) AS max_drawdown, CAST(max(streak) AS BIGINT) AS max_losses_in_row FROM p GROUP BY symbol""")
def deal_stats(spark, sf_dir):
    out = simulation.deal_stats(closed_deals(spark, sf_dir), ["symbol"], ["created_at", "signal_id"])
    return out.select("symbol", "n", "wins", "losses", *r6("avg_r", "gross_win", "gross_loss", "max_drawdown"), "max_losses_in_row")


@register(DEALS_SQL + " SELECT symbol, signal_id, round(sum(r) OVER (PARTITION BY symbol ORDER BY created_at, signal_id ROWS UNBOUNDED PRECEDING), 6) AS equity FROM t")
def equity_curve(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("created_at", "signal_id").rowsBetween(Window.unboundedPreceding, 0)
    return closed_deals(spark, sf_dir).select("symbol", "signal_id", F.round(F.sum("r").over(w), 6).alias("equity"))


# Joins


@register(HOURLY_SQL + """, leads AS (SELECT ts, close FROM bars WHERE symbol = 'click'), others AS (SELECT symbol, ts, close FROM bars WHERE symbol <> 'click')
SELECT o.symbol, o.ts, round(o.close, 9) AS close, l.ts AS leader_ts, round(l.close, 9) AS leader_close FROM others o ASOF LEFT JOIN leads l ON o.ts >= l.ts""")
def asof_leader(spark, sf_dir):
    b = hourly_bars(spark, sf_dir).select("symbol", "ts", "close")
    out = joins.asof_bucketed(b.where("symbol <> 'click'"), b.where("symbol = 'click'").drop("symbol"), "ts", ["close"])
    return out.select("symbol", "ts", *r6("close"), F.col("r_ts").alias("leader_ts"), F.round("r_close", 9).alias("leader_close"))


@register(HOURLY_SQL + ", n AS (SELECT DISTINCT market, symbol, timeframe FROM bars), t AS (SELECT DISTINCT timeframe, ts FROM bars) SELECT n.market, n.symbol, n.timeframe, t.ts, bars.bar_idx, round(bars.close, 9) AS close FROM n JOIN t ON t.timeframe = n.timeframe LEFT JOIN bars ON bars.symbol = n.symbol AND bars.market = n.market AND bars.timeframe = n.timeframe AND bars.ts = t.ts")
def grid_left_join(spark, sf_dir):
    return joins.on_grid(hourly_bars(spark, sf_dir)).select(*KEY, "bar_idx", *r6("close"))


@register(SIGNALS_SQL + """SELECT c.signal_id, c.user_id, c.symbol, c.action FROM s c WHERE c.status <> 'F' AND NOT EXISTS (SELECT 1 FROM s r WHERE r.status = 'F' AND r.user_id = c.user_id AND r.symbol = c.symbol AND r.action = c.action
 AND r.created_at <= c.created_at AND epoch(c.created_at) - epoch(r.created_at) < 20 * 3600)""")
def antijoin_dedupe(spark, sf_dir):
    s = flat_signals(spark, sf_dir)
    return joins.fresh(s.where("status <> 'F'"), s.where("status = 'F'"), ["user_id", "symbol", "action"], "created_at", {"1D": 20, "1H": 4}).select("signal_id", "user_id", "symbol", "action")


@register(SIGNALS_SQL + "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT user_id FROM s WHERE confidence >= 90)")
def semi_recipients(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(flat_signals(spark, sf_dir).where("confidence >= 90"), F.col("c_custkey") == F.col("user_id"), "left_semi").select("c_custkey", "c_mktsegment")


@register(SIGNALS_SQL + """, i AS (SELECT signal_id, user_id, action, CAST(date_diff('day', DATE '1970-01-01', CAST(created_at AS DATE)) AS BIGINT) AS a FROM s)
SELECT DISTINCT x.signal_id, x.user_id FROM i x JOIN i y ON x.user_id = y.user_id AND x.action = 'BUY' AND y.action = 'SELL' AND y.a <= x.a + 30 AND y.a + 10 >= x.a""")
def interval_overlap(spark, sf_dir):
    s = flat_signals(spark, sf_dir).select("signal_id", "user_id", "action", F.datediff(F.to_date("created_at"), F.lit("1970-01-01")).cast("long").alias("begin"))
    a, b = s.where("action = 'BUY'").withColumn("end", F.col("begin") + 30), s.where("action = 'SELL'").withColumn("end", F.col("begin") + 10)
    return joins.overlapping(a, b, ["user_id"], "begin", "end").select("signal_id", "user_id")


@register(DAILY_SQL + """, u AS (SELECT DISTINCT market, symbol FROM bars), o AS (SELECT * FROM (VALUES ('S0', 2.5), ('S7', 11.0)) v(symbol, bps)), m AS (SELECT * FROM (VALUES ('GOLD', 5.0), ('FOREX', 1.5), ('TH_STOCK', 40.0), ('US_STOCK', 5.0), ('CRYPTO', 25.0)) v(market, bps))
SELECT u.market, u.symbol, CAST(coalesce(o.bps, m.bps) AS DOUBLE) AS bps, CASE WHEN o.bps IS NOT NULL THEN 0 ELSE 1 END AS level FROM u LEFT JOIN o ON o.symbol = u.symbol LEFT JOIN m ON m.market = u.market""")
def cost_lookup_coalesce(spark, sf_dir):
    names = daily_bars(spark, sf_dir).select("market", "symbol").distinct()
    own = spark.createDataFrame([("S0", 2.5), ("S7", 11.0)], "symbol string, bps double")
    usual = spark.createDataFrame(list(prices.COST_BPS.items()), "market string, bps double")
    return joins.fallback(names, [(own, ["symbol"]), (usual, ["market"])], "bps").select("market", "symbol", "bps", "level")


@register("SELECT p_partkey, CAST(CASE WHEN x < 2 THEN 0.01 WHEN x < 5 THEN 0.02 WHEN x < 10 THEN 0.05 WHEN x < 25 THEN 0.1 WHEN x < 100 THEN 0.25 WHEN x < 200 THEN 0.5 WHEN x < 400 THEN 1.0 ELSE 2.0 END AS DOUBLE) AS tick FROM (SELECT p_partkey, p_retailprice / 10 AS x FROM part)")
def tick_band_theta(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", prices.tick_size(F.col("p_retailprice") / 10).alias("tick"))


@register(DAILY_SQL + "SELECT market, symbol, timeframe, min(bar_idx) FILTER (ts >= TIMESTAMP '1998-01-01') AS first_idx FROM bars GROUP BY ALL")
def lower_bound(spark, sf_dir):
    return daily_bars(spark, sf_dir).groupBy(*SERIES).agg(F.min(F.when(F.col("ts") >= F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")), F.col("bar_idx"))).alias("first_idx"))


# Aggregates


@register(SIGNALS_SQL + """SELECT user_id, count(*) AS total, count(*) FILTER (status = 'O') AS open, count(*) FILTER (status = 'F') AS closed, round(sum(CASE WHEN status = 'F' THEN (target - entry) ELSE 0 END), 4) AS pnl,
 round(count(*) FILTER (status = 'F' AND target > entry) / nullif(count(*) FILTER (status = 'F'), 0) * 100, 6) AS win_rate FROM s GROUP BY user_id""")
def portfolio_stats(spark, sf_dir):
    closed = F.col("status") == "F"
    n = F.count_if(closed)
    return flat_signals(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "O").alias("open"), n.alias("closed"), F.round(F.sum(F.when(closed, F.col("target") - F.col("entry")).otherwise(0.0)), 4).alias("pnl"),
                                                              F.round(F.when(n > 0, F.count_if(closed & (F.col("target") > F.col("entry"))) / n * 100), 6).alias("win_rate"))


@register(DEALS_SQL + """, p AS (SELECT symbol, action, count(*) AS n, round(avg(r), 4) AS m FROM t GROUP BY ALL)
SELECT symbol, action, CAST(sum(n) AS BIGINT) AS n, round(CASE WHEN sum(n) >= 30 THEN sum(n * m) / sum(n) END, 6) AS pooled FROM p GROUP BY GROUPING SETS ((symbol, action), (action), ())""")
def pooled_grouping_sets(spark, sf_dir):
    pairs = closed_deals(spark, sf_dir).groupBy("symbol", "action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 4).alias("m"))
    sets = pairs.groupingSets([["symbol", "action"], ["action"], []], "symbol", "action")
    return sets.agg(F.sum("n").alias("n"), F.round(F.when(F.sum("n") >= 30, F.sum(F.col("n") * F.col("m")) / F.sum("n")), 6).alias("pooled"))


@register(DEALS_SQL + """, h AS (SELECT *, signal_id % 7 + 1 AS held FROM t), k AS (SELECT unnest([1, 2, 3, 6]) AS k)
SELECT symbol, CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(CASE WHEN r > 0 AND held <= k THEN 1.0 ELSE 0.0 END), 6) AS p_target, round(avg(CASE WHEN r < 0 AND held <= k THEN 1.0 ELSE 0.0 END), 6) AS p_stop, round(avg(CASE WHEN held <= k THEN r ELSE 0.0 END), 6) AS e_r FROM h, k GROUP BY ALL""")
def speed_by_k(spark, sf_dir):
    t = closed_deals(spark, sf_dir).withColumn("held", F.col("signal_id") % 7 + 1).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 6)])))
    within = F.col("held") <= F.col("k")
    share = lambda c: F.round(F.avg(F.when(c & within, 1.0).otherwise(0.0)), 6)
    return t.groupBy("symbol", "k").agg(F.count(F.lit(1)).alias("n"), share(F.col("r") > 0).alias("p_target"), share(F.col("r") < 0).alias("p_stop"), F.round(F.avg(F.when(within, F.col("r")).otherwise(0.0)), 6).alias("e_r"))


@register(DEALS_SQL + ", q AS (SELECT symbol, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.5) AS q2, quantile_cont(r, 0.75) AS q3 FROM t GROUP BY symbol) SELECT t.symbol, CAST(1 + CAST(r > q1 AS INTEGER) + CAST(r > q2 AS INTEGER) + CAST(r > q3 AS INTEGER) AS INTEGER) AS bucket, count(*) AS n, round(avg(r), 6) AS mean_r FROM t JOIN q ON q.symbol = t.symbol GROUP BY ALL")
def quantile_buckets(spark, sf_dir):
    t = closed_deals(spark, sf_dir)
    cuts = t.groupBy("symbol").agg(F.percentile("r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    bucket = F.lit(1) + sum(((F.col("r") > F.col("q")[i]).cast("int") for i in range(3)), F.lit(0))
    return t.join(cuts, "symbol").groupBy("symbol", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("mean_r"))


@register(DEALS_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r, signal_id) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM t) SELECT symbol, max(n) AS n, round(avg(r) FILTER (i > floor(n * 0.05) AND i <= n - floor(n * 0.05)), 6) AS trimmed, round(median(r), 6) AS median_r, round(min(r), 6) AS least, round(max(r), 6) AS most FROM k GROUP BY symbol")
def trimmed_mean(spark, sf_dir):
    g = Window.partitionBy("symbol")
    t = closed_deals(spark, sf_dir).withColumn("i", F.row_number().over(g.orderBy("r", "signal_id"))).withColumn("n", F.count(F.lit(1)).over(g))
    cut = F.floor(F.col("n") * 0.05)
    inside = (F.col("i") > cut) & (F.col("i") <= F.col("n") - cut)
    return t.groupBy("symbol").agg(F.max("n").alias("n"), F.round(F.avg(F.when(inside, F.col("r"))), 6).alias("trimmed"), F.round(F.percentile("r", F.lit(0.5)), 6).alias("median_r"), F.round(F.min("r"), 6).alias("least"), F.round(F.max("r"), 6).alias("most"))


@register(DAILY_SQL + "SELECT market, symbol, round(avg((high - low) / close * 100), 6) AS mean_range, round(median(volume * close), 4) AS median_turnover, round(median(close), 6) AS median_price, avg((high - low) / close * 100) >= 1.2 AND median(volume * close) >= 500000 AS active, avg((high - low) / close * 100) >= 1.2 AND median(volume * close) >= 500000 AND count(*) >= 3000 AS runner FROM bars GROUP BY ALL")
def symbol_profile(spark, sf_dir):
    span = F.avg((F.col("high") - F.col("low")) / F.col("close") * 100)
    turnover = F.percentile(F.col("volume") * F.col("close"), F.lit(0.5))
    active = (span >= 1.2) & (turnover >= 500_000)
    return daily_bars(spark, sf_dir).groupBy("market", "symbol").agg(F.round(span, 6).alias("mean_range"), F.round(turnover, 4).alias("median_turnover"), F.round(F.percentile("close", F.lit(0.5)), 6).alias("median_price"), active.alias("active"),
                                                                     (active & (F.count(F.lit(1)) >= 3000)).alias("runner"))


@register(DEALS_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(r) DESC, signal_id) AS i, count(*) OVER (PARTITION BY symbol) AS n, sum(r) OVER (PARTITION BY symbol) AS s, sum(abs(r)) OVER (PARTITION BY symbol) AS a FROM t)
SELECT symbol, round(sum(CASE WHEN i <= ceil(n * 0.001) THEN abs(r) ELSE 0 END) / max(a), 6) AS top_share, round(max(abs((s - r) / (n - 1) - s / n)), 6) AS max_shift FROM k WHERE n > 1 GROUP BY symbol""")
def influence_audit(spark, sf_dir):
    g = Window.partitionBy("symbol")
    t = closed_deals(spark, sf_dir).withColumn("i", F.row_number().over(g.orderBy(F.desc(F.abs("r")), "signal_id"))).withColumn("n", F.count(F.lit(1)).over(g)).withColumn("s", F.sum("r").over(g)).withColumn("a", F.sum(F.abs("r")).over(g)).where("n > 1")
    top = F.sum(F.when(F.col("i") <= F.ceil(F.col("n") * 0.001), F.abs("r")).otherwise(0.0)) / F.max("a")
    shift = F.max(F.abs((F.col("s") - F.col("r")) / (F.col("n") - 1) - F.col("s") / F.col("n")))
    return t.groupBy("symbol").agg(F.round(top, 6).alias("top_share"), F.round(shift, 6).alias("max_shift"))


@register("SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users, count(*) AS n, round(arg_max(value, (ts, event_id)), 6) AS latest, abs(arg_max(value, (ts, event_id)) - avg(value)) > 2 * stddev_pop(value) AS anomaly FROM events GROUP BY event_type")
def zscore_anomaly(spark, sf_dir):
    latest = F.max_by("value", F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"), F.round(latest, 6).alias("latest"), (F.abs(latest - F.avg("value")) > 2 * F.stddev_pop("value")).alias("anomaly"))


# Features


@register(DAILY_SQL + f""", m AS (SELECT *, avg(volume) {P} ROWS 19 PRECEDING) AS a, stddev_pop(volume) {P} ROWS 19 PRECEDING) AS d, count(*) {P} ROWS 19 PRECEDING) AS c FROM bars) SELECT {KEYS}, round((volume - a) / d, 5) AS z FROM m WHERE c = 20 AND round(d, 9) > 0""")
def rolling_z(spark, sf_dir):
    b = daily_bars(spark, sf_dir).withColumn("z", features.rolling_z("volume", 20)).withColumn("d", F.round(F.stddev_pop("volume").over(indicators.last(20)), 9))
    return b.where("z IS NOT NULL AND d > 0").select(*KEY, F.round("z", 5).alias("z"))


@register(DAILY_SQL + f", m AS (SELECT *, corr(close, volume) {P} ROWS 59 PRECEDING) AS c, regr_slope(close, volume) {P} ROWS 59 PRECEDING) AS s, count(*) {P} ROWS 59 PRECEDING) AS n FROM bars) SELECT {KEYS}, round(c, 5) AS corr, round(s, 5) AS beta FROM m WHERE n = 60")
def rolling_corr_beta(spark, sf_dir):
    b = features.rolling_corr_beta(daily_bars(spark, sf_dir), "close", "volume", 60)
    return b.where("bar_idx >= 59").select(*KEY, F.round("corr", 5).alias("corr"), F.round("beta", 5).alias("beta"))


@register(DAILY_SQL + """, k AS (SELECT *, round(close, 9) AS x FROM bars), r AS (SELECT market, symbol, timeframe, ts, rank() OVER (PARTITION BY timeframe, ts ORDER BY x) AS k, count(*) OVER (PARTITION BY timeframe, ts, x) AS t, count(*) OVER (PARTITION BY timeframe, ts) AS m FROM k)
SELECT market, symbol, timeframe, ts, round((2 * (k - 1) + t - 1) / 2 / (m - 1) - 0.5, 6) AS xs_rank FROM r WHERE m >= 3""")
def xs_rank(spark, sf_dir):
    b = daily_bars(spark, sf_dir).withColumn("x", F.round("close", 9))
    return features.cross_rank(b, "x", ["timeframe", "ts"]).where("xs_rank IS NOT NULL").select(*KEY, *r6("xs_rank"))


@register(DAILY_SQL + f", l AS (SELECT *, ln(close / lag(close) {P})) AS x FROM bars), g AS (SELECT timeframe, ts, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS breadth1, avg(x) AS index_ret, stddev_pop(x) AS dispersion, count(*) AS names FROM l WHERE x IS NOT NULL GROUP BY ALL) SELECT timeframe, ts, {_r('breadth1', 'index_ret', 'dispersion')}, names, round(sum(index_ret) OVER (PARTITION BY timeframe ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS index_cum FROM g")
def breadth_dispersion(spark, sf_dir):
    return features.breadth(daily_bars(spark, sf_dir)).select("timeframe", "ts", *r6("breadth1", "index_ret", "dispersion"), "names", *r6("index_cum"))


@register(DAILY_SQL + f"SELECT {KEYS}" + "".join(f", round(ln(close) - ln(lag(close, {n}) {P})), 6) AS mom_{n}" for n in (1, 5, 20, 60)) + " FROM bars")
def momentum(spark, sf_dir):
    return features.momentum(daily_bars(spark, sf_dir)).select(*KEY, *r6("mom_1", "mom_5", "mom_20", "mom_60"))


@register(DAILY_SQL + f""", v AS (SELECT *, close / lag(close) {P}) - 1 AS ret, (high + low + close) / 3 AS tp FROM bars),
f AS (SELECT *, avg(volume) {P} ROWS 4 PRECEDING) AS v5, avg(volume) {P} ROWS 19 PRECEDING) AS v20, median(volume) {P} ROWS 19 PRECEDING) AS md, max(volume) {P} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mx, sum(tp * volume) {P} ROWS 19 PRECEDING) AS fl, sum(volume) {P} ROWS 19 PRECEDING) AS sv,
 sum(CASE WHEN ret > 0 THEN volume ELSE 0 END) {P} ROWS 19 PRECEDING) AS up, sum(CASE WHEN ret < 0 THEN volume ELSE 0 END) {P} ROWS 19 PRECEDING) AS dn, avg(abs(ret) / (volume * close)) {P} ROWS 19 PRECEDING) AS il,
 avg(volume) {P} ROWS 19 PRECEDING) AS vm, stddev_pop(volume) {P} ROWS 19 PRECEDING) AS vd, sum(CASE WHEN dtp > 0 THEN tp * volume ELSE 0 END) {P} ROWS 13 PRECEDING) AS mfu, sum(CASE WHEN dtp < 0 THEN tp * volume ELSE 0 END) {P} ROWS 13 PRECEDING) AS mfd FROM (SELECT *, tp - lag(tp) {P}) AS dtp FROM v))
SELECT {KEYS}, round(CASE WHEN round(vd, 9) > 0 THEN (volume - vm) / vd END, 5) AS vol_z20, round(mfu / (mfu + mfd) - 0.5, 6) AS mfi14, round(ln(v5 / v20), 5) AS vol_trend, round(volume / mx, 9) AS vol_shock, round(ln(volume / md), 5) AS vol_ratio_median, round((up - dn) / (up + dn), 9) AS imbalance20, round(ln(close / (fl / sv)), 5) AS vwap_gap, round(ln(il), 4) AS log_amihud FROM f WHERE bar_idx >= 20 AND il > 0""")
def volume_features(spark, sf_dir):
    names = ["vol_trend", "vol_ratio_median", "vwap_gap"]
    ratios = ["vol_shock", "imbalance20"]  # quotients of small whole numbers, which tie at few places
    b = features.volume_features(daily_bars(spark, sf_dir)).where("bar_idx >= 20 AND log_amihud IS NOT NULL")
    return b.select(*KEY, F.round("vol_z20", 5).alias("vol_z20"), *r6("mfi14"), *[F.round(n, 5).alias(n) for n in names], *[F.round(n, 9).alias(n) for n in ratios], F.round("log_amihud", 4).alias("log_amihud"))


@register(HOURLY_SQL + f""", c AS (SELECT *, high - low AS s, abs(close - lag(close) {P})) AS step FROM bars) SELECT {KEYS}, round(CASE WHEN s > 0 THEN (2 * close - high - low) / s END, 6) AS clv, round(CASE WHEN s > 0 THEN (close - open) / s END, 6) AS body,
 round(CASE WHEN s > 0 THEN ((least(open, close) - low) - (high - greatest(open, close))) / s END, 6) AS wick, round(CASE WHEN count(step) {P} ROWS 9 PRECEDING) = 10 AND sum(step) {P} ROWS 9 PRECEDING) > 0 THEN (close - lag(close, 10) {P})) / sum(step) {P} ROWS 9 PRECEDING) END, 5) AS eff10,
 round(CASE WHEN count(CASE WHEN s > 0 THEN 1 END) {P} ROWS 4 PRECEDING) = 5 THEN avg(CASE WHEN s > 0 THEN (2 * close - high - low) / s END) {P} ROWS 4 PRECEDING) END, 6) AS clv5 FROM c""")
def bar_shape(spark, sf_dir):
    return features.bar_shape(hourly_bars(spark, sf_dir)).select(*KEY, *r6("clv", "clv5", "body", "wick"), F.round("eff10", 5).alias("eff10"))


@register(HOURLY_SQL + f""", x AS (SELECT *, arg_max(bar_idx, (high, -bar_idx)) {P} ROWS 19 PRECEDING) AS t, arg_min(bar_idx, (low, bar_idx)) {P} ROWS 19 PRECEDING) AS d FROM bars) SELECT {KEYS}, CAST((bar_idx - t) - (bar_idx - d) AS INTEGER) AS extremes_age FROM x WHERE bar_idx >= 19""")
def extremes_age(spark, sf_dir):
    return features.extremes_age(hourly_bars(spark, sf_dir)).where("extremes_age IS NOT NULL").select(*KEY, F.col("extremes_age").cast("int").alias("extremes_age"))


@register(HOURLY_SQL + """, c AS (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lt FROM bars), d AS (SELECT *, CAST(lt AS DATE) AS local_day FROM c)
SELECT market, symbol, timeframe, ts, local_day, CAST(hour(lt) AS INTEGER) AS local_hour, CAST(dayofweek(lt) + 1 AS INTEGER) AS weekday, CAST(row_number() OVER (PARTITION BY market, symbol, timeframe, local_day ORDER BY ts) AS INTEGER) AS bar_of_day, day(local_day) <= 3 OR day(local_day) >= 28 AS turn_of_month FROM d""")
def calendar_features(spark, sf_dir):
    return features.calendar(hourly_bars(spark, sf_dir)).select(*KEY, "local_day", "local_hour", "weekday", "bar_of_day", "turn_of_month")


@register(HOURLY_SQL + """, x AS (SELECT *, round(close, 9) AS v FROM bars) SELECT a.market, a.symbol, a.timeframe, a.ts, round((count(*) FILTER (b.v < a.v) + count(*) FILTER (b.v = a.v) / 2) / count(*), 6) AS pct FROM x a JOIN x b ON b.market = a.market AND b.symbol = a.symbol AND b.timeframe = a.timeframe AND b.bar_idx BETWEEN a.bar_idx - 99 AND a.bar_idx WHERE a.bar_idx >= 59 GROUP BY ALL""")
def rolling_pct_rank(spark, sf_dir):
    b = hourly_bars(spark, sf_dir).withColumn("v", F.round("close", 9))
    return features.rolling_percentile(b, "v", 100, 60).where("pct IS NOT NULL").select(*KEY, *r6("pct"))


@register(DAILY_SQL + f"SELECT {KEYS}, round(ln(lead(close, 5) {P}) / lead(open) {P})), 6) AS open_close, round(ln(lead(close, 5) {P}) / close), 6) AS close_close, round(ln(lead(open, 6) {P}) / lead(open) {P})), 6) AS open_open FROM bars")
def forward_returns(spark, sf_dir):
    kinds = ("open_close", "close_close", "open_open")
    return daily_bars(spark, sf_dir).select(*KEY, *[F.round(features.forward_returns(None, 5, k), 6).alias(k) for k in kinds])


# Sets and upserts


@register(SIGNALS_SQL + "SELECT user_id, symbol, signal_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, symbol ORDER BY CASE WHEN status = 'F' THEN 0 ELSE 1 END, signal_id) AS k FROM s) WHERE k = 1")
def union_first_wins(spark, sf_dir):
    s = flat_signals(spark, sf_dir)
    both = s.where("status = 'F'").withColumn("source", F.lit(0)).unionByName(s.where("status <> 'F'").withColumn("source", F.lit(1)))
    w = Window.partitionBy("user_id", "symbol").orderBy("source", "signal_id")
    return both.withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "symbol", "signal_id")


@register(SIGNALS_SQL + "SELECT DISTINCT user_id, symbol FROM s WHERE status = 'F' EXCEPT SELECT user_id, symbol FROM s WHERE status = 'O'")
def except_deals(spark, sf_dir):
    s = flat_signals(spark, sf_dir)
    return s.where("status = 'F'").select("user_id", "symbol").distinct().join(s.where("status = 'O'"), ["user_id", "symbol"], "left_anti")


@register(SIGNALS_SQL + "SELECT user_id, symbol FROM s WHERE status = 'F' INTERSECT SELECT user_id, symbol FROM s WHERE status = 'O'")
def intersect_deals(spark, sf_dir):
    s = flat_signals(spark, sf_dir)
    return s.where("status = 'F'").select("user_id", "symbol").distinct().join(s.where("status = 'O'"), ["user_id", "symbol"], "left_semi")


@register("SELECT user_id, event_id, event_type, round(value, 6) AS value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_upsert(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "event_id", "event_type", *r6("value"), "ts")


# Statistics


@register(DEALS_SQL + """, c AS (SELECT action, symbol, sum(r) AS s, count(*) AS n FROM t GROUP BY ALL), g AS (SELECT action, sum(s) AS ts, sum(n) AS tn, count(*) AS k FROM c GROUP BY action)
SELECT c.action, round(max(ts) / max(tn), 6) AS mean, CAST(max(tn) AS BIGINT) AS n, max(k) AS clusters, round(sqrt(sum((s - n * ts / tn) ** 2) * max(k) / (max(k) - 1)) / max(tn), 6) AS se FROM c JOIN g ON g.action = c.action GROUP BY c.action""")
def cluster_se(spark, sf_dir):
    out = statistics.cluster_mean(closed_deals(spark, sf_dir), "r", ["symbol"], ["action"])
    return out.select("action", *r6("mean"), "n", "clusters", *r6("se"))


@register(DAILY_SQL + f""", q AS (SELECT symbol, round(volume, 6) AS x, round(ln(lead(close, 5) {P}) / close), 6) AS y FROM bars), k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2 AS ry FROM q WHERE y IS NOT NULL) SELECT symbol, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM k GROUP BY symbol""")
def spearman_ic(spark, sf_dir):
    b = daily_bars(spark, sf_dir).select("symbol", F.round("volume", 6).alias("x"), F.round(features.forward_returns(None, 5, "close_close"), 6).alias("y"))
    return statistics.spearman(b, "x", "y", ["symbol"]).select("symbol", *r6("rho"), "n")


@register("""WITH q AS (SELECT p_partkey AS id, p_brand AS family, (p_partkey * 37 % 1000 + 1) / 20000 AS p FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS i, count(*) OVER (PARTITION BY family) AS m FROM q), h AS (SELECT *, 0.05 / (m - i + 1) AS t, (m - i + 1) * p AS a FROM k)
SELECT id, family, round(t, 9) AS holm_threshold, round(least(1, max(a) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING)), 9) AS holm_p, bool_and(p <= t) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING) AS rejected FROM h""")
def holm_stepdown(spark, sf_dir):
    tests = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"), ((F.col("p_partkey") * 37 % 1000 + 1) / 20000).alias("p"))
    return statistics.holm(tests, ["family"]).select("id", "family", F.round("holm_threshold", 9).alias("holm_threshold"), F.round("holm_p", 9).alias("holm_p"), "rejected")


@register(DAILY_SQL + """, c AS (SELECT timeframe, ts, count(*) AS c FROM bars GROUP BY ALL), k AS (SELECT *, sum(c) OVER (PARTITION BY timeframe ORDER BY ts) AS t, sum(c) OVER (PARTITION BY timeframe) AS n FROM c)
SELECT timeframe, CAST(max(n) AS BIGINT) AS bars, min(ts) FILTER (t > floor(n * 0.6)) AS train_end, min(ts) FILTER (t > floor(n * 0.8)) AS validation_end FROM k GROUP BY timeframe""")
def time_split(spark, sf_dir):
    return statistics.time_split(daily_bars(spark, sf_dir))


@register()
def ridge_fit(spark, sf_dir):
    b = features.momentum(daily_bars(spark, sf_dir)).withColumn("y", features.forward_returns(None, 5, "close_close"))
    w = statistics.ridge(b, ["mom_1", "mom_5", "mom_20"], "y", 10.0)
    return spark.createDataFrame([tuple(float(x) for x in w)], "w_mom_1 double, w_mom_5 double, w_mom_20 double, intercept double")


# Streaming in batch form; the streams themselves are in candlewright.streaming


@register("SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, user_id, count(*) AS n, round(max(value), 6) AS top FROM events GROUP BY ALL")
def digest_tumbling(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "10 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("top"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "n", "top")


@register("""WITH RECURSIVE e AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY ALL), n AS MATERIALIZED (SELECT e.user_id, e.ts, f.ts AS next_ts FROM e ASOF LEFT JOIN e f ON e.user_id = f.user_id AND e.ts + INTERVAL 180 SECONDS <= f.ts),
sent AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id UNION ALL SELECT n.user_id, n.next_ts FROM sent JOIN n ON n.user_id = sent.user_id AND n.ts = sent.ts WHERE n.next_ts IS NOT NULL)
SELECT x.event_id, x.user_id, x.ts, sent.ts IS NOT NULL AS allowed FROM events x LEFT JOIN e ON e.user_id = x.user_id AND e.ts = x.ts AND e.event_id = x.event_id LEFT JOIN sent ON sent.user_id = e.user_id AND sent.ts = e.ts""")
def throttle_gap(spark, sf_dir):
    """Which events go out, at least three minutes after the last one that went out."""
    return positions.throttle(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 180).select("event_id", "user_id", "ts", "allowed")


@register(SIGNALS_SQL + ", now AS (SELECT max(created_at) AS t FROM s) SELECT signal_id, CASE WHEN created_at + INTERVAL 7 DAYS < t THEN 'expired' ELSE 'active' END AS state FROM s, now")
def ttl_expiry(spark, sf_dir):
    s = flat_signals(spark, sf_dir)
    now = s.agg(F.max("created_at").alias("now"))
    return s.crossJoin(now).select("signal_id", F.when(F.col("created_at") + F.expr("INTERVAL 7 DAYS") < F.col("now"), "expired").otherwise("active").alias("state"))
