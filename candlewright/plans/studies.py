"""Further named queries: quotes, selection, costs, grouped studies, frame features, scores.

Results are rounded on both sides, to eight places where means of short decimals would tie at six.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions import prices
from candlewright.operators import features, indicators, joins, positions, statistics
from candlewright.operators import signals as engine
from candlewright.plans.queries import DAILY_SQL, HOURLY_SQL, KEY, KEYS, P, SIGNALS_SQL, TR_SQL, DEALS_SQL, closed_deals, flat_signals, r6, register
from candlewright.sources.bars import SERIES, daily_bars, hourly_bars, market_of, series, table

MARKET_SQL = "['GOLD','FOREX','TH_STOCK','US_STOCK','CRYPTO'][signal_id % 20 % 5 + 1]"
COST_SQL = "CASE market WHEN 'GOLD' THEN 5.0::DOUBLE WHEN 'FOREX' THEN 1.5::DOUBLE WHEN 'TH_STOCK' THEN 40.0::DOUBLE WHEN 'US_STOCK' THEN 5.0::DOUBLE ELSE 25.0::DOUBLE END"


def r8(value: Column | str, name: str) -> Column:
    return F.round(value, 8).alias(name)


# Quotes, selection, positions


@register(DAILY_SQL + f""", q AS (SELECT *, lag(close) {P}) AS before, row_number() OVER (PARTITION BY market, symbol, timeframe ORDER BY ts DESC) AS n FROM bars)
SELECT {KEYS}, round(close, 9) AS price, round(close - before, 6) AS moved, round((close - before) / before * 100, 6) AS moved_pct, round(high, 9) AS day_high, round(low, 9) AS day_low FROM q WHERE n = 1""")
def latest_quotes(spark, sf_dir):
    q = engine.latest(daily_bars(spark, sf_dir).withColumn("before", F.lag("close").over(series())))
    moved = F.col("close") - F.col("before")
    return q.select(*KEY, F.round("close", 9).alias("price"), F.round(moved, 6).alias("moved"), F.round(moved / F.col("before") * 100, 6).alias("moved_pct"), F.round("high", 9).alias("day_high"), F.round("low", 9).alias("day_low"))


@register(HOURLY_SQL + f", now AS (SELECT max(ts) AS t FROM events) SELECT {KEYS}, round(close, 9) AS close FROM bars, now WHERE bars.ts + INTERVAL 1 HOUR <= t")
def closed_bars(spark, sf_dir):
    """Bars that had ended when the last event came in."""
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    return hourly_bars(spark, sf_dir).join(F.broadcast(now), F.col("ts") + F.expr("INTERVAL 1 HOUR") <= F.col("now")).select(*KEY, *r6("close"))  # one row of now


@register(SIGNALS_SQL + """SELECT signal_id, user_id, action FROM s LEFT JOIN customer ON c_custkey = user_id
WHERE CASE c_mktsegment WHEN 'BUILDING' THEN action = 'BUY' WHEN 'MACHINERY' THEN action = 'SELL' WHEN 'AUTOMOBILE' THEN confidence >= 70 ELSE true END""")
def preference_filter(spark, sf_dir):
    """Signals that their recipient's preference lets through; no preference allows all."""
    wish = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    segment = F.col("c_mktsegment")
    allowed = F.when(segment == "BUILDING", F.col("action") == "BUY").when(segment == "MACHINERY", F.col("action") == "SELL").when(segment == "AUTOMOBILE", F.col("confidence") >= 70).otherwise(True)
    return flat_signals(spark, sf_dir).join(wish, "user_id", "left").where(allowed).select("signal_id", "user_id", "action")


@register(SIGNALS_SQL + """, e AS (SELECT signal_id AS id, created_at, CASE WHEN signal_id % 3 = 0 THEN NULL ELSE created_at + INTERVAL 10 DAYS END AS expires_at FROM s WHERE status = 'O' AND signal_id % 4 <> 0), now AS (SELECT max(created_at) AS t FROM s)
SELECT id, created_at FROM e, now WHERE created_at >= t - INTERVAL 720 HOURS AND (expires_at IS NULL OR expires_at > t) ORDER BY created_at DESC, id LIMIT 50""")
def pending_outbox(spark, sf_dir):
    """The fifty newest unsent signals of thirty days."""
    s = flat_signals(spark, sf_dir)
    s = s.crossJoin(F.broadcast(s.agg(F.max("created_at").alias("now"))))  # one row
    rows = s.select(F.col("signal_id").alias("id"), "created_at", "now", F.when(F.col("status") == "O", "active").otherwise("closed").alias("status"), (F.col("signal_id") % 4 == 0).alias("push_sent"),
                    F.when(F.col("signal_id") % 3 != 0, F.col("created_at") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))
    return positions.pending(rows, F.col("now"), hours=720).select("id", "created_at")


@register(SIGNALS_SQL + f", m AS (SELECT *, {MARKET_SQL} AS market FROM s), c AS (SELECT *, {COST_SQL} / 10000 * entry / abs(entry - stop) AS cost_r FROM m) SELECT market, count(*) AS signals, count(*) FILTER (round(cost_r, 9) < 0.5) AS affordable, round(avg(cost_r), 8) AS mean_cost_r, round(max(cost_r), 8) AS max_cost_r FROM c GROUP BY market")
def affordable_cohort(spark, sf_dir):
    s = flat_signals(spark, sf_dir).withColumn("market", market_of(F.col("signal_id") % 20))
    cost = prices.cost_bps(F.col("market")) / 10000 * F.col("entry") / F.abs(F.col("entry") - F.col("stop"))
    return s.withColumn("cost_r", cost).groupBy("market").agg(F.count(F.lit(1)).alias("signals"), F.count_if(F.round("cost_r", 9) < 0.5).alias("affordable"), r8(F.avg("cost_r"), "mean_cost_r"), r8(F.max("cost_r"), "max_cost_r"))


@register(DAILY_SQL + "SELECT market, timeframe, round(avg(CASE WHEN volume > 0 THEN 1.0 ELSE 0.0 END), 8) AS share, avg(CASE WHEN volume > 0 THEN 1.0 ELSE 0.0 END) >= 0.7 AS usable FROM bars GROUP BY ALL")
def volume_usable(spark, sf_dir):
    share = F.avg((F.col("volume") > 0).cast("double"))
    return daily_bars(spark, sf_dir).groupBy("market", "timeframe").agg(r8(share, "share"), (share >= 0.7).alias("usable"))


@register(SIGNALS_SQL + """, p AS (SELECT signal_id, sign_ AS sign, entry, CASE WHEN signal_id % 11 = 0 THEN target ELSE stop END AS stop, target, round(entry * (1 + ((signal_id * 13) % 21 - 10) / 100), 4) AS price, created_at < TIMESTAMP '1998-01-01' AS whole, signal_id % 5 + 1 AS quantity FROM (SELECT *, CASE WHEN action = 'BUY' THEN 1 ELSE -1 END AS sign_ FROM s)),
w AS (SELECT *, CASE WHEN whole THEN least(price, round(price * 0.98, 4)) ELSE price END AS lo, CASE WHEN whole THEN greatest(price, round(price * 1.02, 4)) ELSE price END AS hi, CASE WHEN stop > 0 AND (entry - stop) * sign > 0 THEN stop END AS sl, CASE WHEN target > 0 AND (target - entry) * sign > 0 THEN target END AS tp FROM p),
v AS (SELECT *, CASE WHEN CASE WHEN sign = 1 THEN lo <= sl ELSE hi >= sl END THEN 'stop_loss' WHEN CASE WHEN sign = 1 THEN hi >= tp ELSE lo <= tp END THEN 'take_profit' ELSE 'open' END AS outcome FROM w)
SELECT signal_id, outcome, round(CASE outcome WHEN 'stop_loss' THEN sl WHEN 'take_profit' THEN tp END, 6) AS exit_price, sl IS NULL AS stop_ignored FROM v""")
def position_evaluate(spark, sf_dir):
    """Open positions against the price window: a stop wins over a target, wrong-sided levels don't count."""
    s = flat_signals(spark, sf_dir)
    price = F.round(F.col("entry") * (1 + ((F.col("signal_id") * 13) % 21 - 10) / 100), 4)
    p = s.select("signal_id", F.when(F.col("action") == "BUY", "long").otherwise("short").alias("direction"), F.col("entry").alias("entry_price"), F.when(F.col("signal_id") % 11 == 0, F.col("target")).otherwise(F.col("stop")).alias("stop_loss"), F.col("target").alias("take_profit"),
                 price.alias("price"), (F.col("signal_id") % 5 + 1).cast("double").alias("quantity"), F.lit(1.0).alias("fees"), F.col("created_at").alias("opened_at"), F.lit("1998-01-01").cast("timestamp_ntz").alias("session_start"))
    p = p.withColumn("day_low", F.round(F.col("price") * 0.98, 4)).withColumn("day_high", F.round(F.col("price") * 1.02, 4))
    out = positions.evaluate(positions.price_window(p))
    return out.select("signal_id", "outcome", F.round("exit_price", 6).alias("exit_price"), F.array_contains("ignored", "stop_loss").alias("stop_ignored"))


@register(SIGNALS_SQL + "SELECT signal_id, round((stop - entry) / entry * 100, 6) AS stop_away, round((target - entry) / entry * 100, 6) AS target_away, round(abs(target - entry) / abs(entry - stop), 6) AS rr, concat(user_id, ':', symbol, ':', timeframe, ':', action) AS dedupe_key FROM s")
def level_ladder(spark, sf_dir):
    away = lambda level: F.round((F.col(level) - F.col("entry")) / F.col("entry") * 100, 6)
    return flat_signals(spark, sf_dir).select("signal_id", away("stop").alias("stop_away"), away("target").alias("target_away"), F.round(prices.risk_reward(F.col("entry"), F.col("stop"), F.col("target")), 6).alias("rr"),
                                              F.concat_ws(":", F.col("user_id").cast("string"), "symbol", "timeframe", "action").alias("dedupe_key"))


# Joins


@register(DAILY_SQL + ", q AS (SELECT symbol, arg_max(close, ts) AS price FROM bars GROUP BY symbol) SELECT c_custkey AS user_id, q.symbol, round(price, 9) AS price FROM customer JOIN q ON q.symbol = concat('S', c_custkey % 20)")
def watchlist_quotes(spark, sf_dir):
    watch = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("S"), (F.col("c_custkey") % 20).cast("string")).alias("symbol"))
    quotes = daily_bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    return watch.join(quotes, "symbol").select("user_id", "symbol", F.round("price", 9).alias("price"))


@register(SIGNALS_SQL + ", c AS (SELECT * FROM s WHERE status = 'P') SELECT n_nationkey AS recipient, signal_id FROM nation JOIN c ON n_nationkey % 5 = 0 OR c.symbol = concat('S', n_nationkey % 20)")
def recipients_fanout(spark, sf_dir):
    """Who gets which signal: recipients of one symbol by an equal join, those who follow everything by
    salted copies of the recipients, so that no key holds all signals."""
    n = table(spark, sf_dir, "nation")
    everything = F.col("n_nationkey") % 5 == 0
    offered = flat_signals(spark, sf_dir).where("status = 'P'").select("signal_id", F.col("symbol").alias("scope"))
    follows = n.where(~everything).select(F.col("n_nationkey").alias("recipient"), F.concat(F.lit("S"), (F.col("n_nationkey") % 20).cast("string")).alias("scope"))
    some = offered.join(follows, "scope").select("recipient", "signal_id")
    return some.unionByName(joins.to_all(offered.select("signal_id"), n.where(everything).select(F.col("n_nationkey").alias("recipient"))))


@register(HOURLY_SQL + TR_SQL + f""", g AS (SELECT *, lag(atr / close * 100) {P}) AS atr_before, avg(close) {P} ROWS 19 PRECEDING) AS m FROM atr), h AS (SELECT *, lag(CASE WHEN round(close, 9) > round(m, 6) THEN 'above' ELSE 'below' END) {P}) AS side_before FROM g)
SELECT {KEYS}, round(atr_before, 6) AS atr_before, side_before FROM h WHERE atr_before IS NOT NULL""")
def regime_before_entry(spark, sf_dir):
    """Volatility and side of the average on the bar before an entry, by an equal join on entry time."""
    b = indicators.with_atr(hourly_bars(spark, sf_dir)).withColumn("m", F.round(F.avg("close").over(indicators.last(20)), 6))
    side = F.when(F.round("close", 9) > F.col("m"), "above").otherwise("below")
    before = b.withColumn("side", side).select(*KEY, F.lag(F.col("atr") / F.col("close") * 100).over(series()).alias("atr_before"), F.lag("side").over(series()).alias("side_before"))
    entries = b.select(*KEY)
    return entries.join(before, KEY).where("atr_before IS NOT NULL").select(*KEY, F.round("atr_before", 6).alias("atr_before"), "side_before")


@register(DEALS_SQL + """, a AS (SELECT user_id, sum(r) AS x FROM t WHERE action = 'BUY' GROUP BY ALL), b AS (SELECT user_id, sum(r) AS y FROM t WHERE action = 'SELL' GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, round(coalesce(x, 0), 6) AS x, round(coalesce(y, 0), 6) AS y, round(coalesce(x, 0) - coalesce(y, 0), 6) AS diff FROM a FULL JOIN b ON a.user_id = b.user_id""")
def paired_arms(spark, sf_dir):
    t = closed_deals(spark, sf_dir)
    arms = [t.where(F.col("action") == side).groupBy("user_id").agg(F.sum("r").alias(name)) for side, name in (("BUY", "x"), ("SELL", "y"))]
    both = arms[0].join(arms[1], "user_id", "full_outer").fillna(0.0, ["x", "y"])
    return both.select("user_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(F.col("x") - F.col("y"), 6).alias("diff"))


@register(HOURLY_SQL + TR_SQL + """, s AS (SELECT concat(symbol, ':', bar_idx) AS signal_id, market, symbol, timeframe, bar_idx, CASE WHEN bar_idx % 2 = 0 THEN 1 ELSE -1 END AS sign, round(close, 4) AS entry, round(atr, 4) AS a FROM atr WHERE atr > 0),
l AS (SELECT *, 1.5::DOUBLE * a AS risk FROM s),
x AS (SELECT l.signal_id, max(sign * (CASE WHEN sign = 1 THEN f.high ELSE f.low END - entry) / risk) AS mfe, min(sign * (CASE WHEN sign = 1 THEN f.low ELSE f.high END - entry) / risk) AS mae, count(*) AS bars FROM l JOIN bars f ON f.market = l.market AND f.symbol = l.symbol AND f.timeframe = l.timeframe AND f.bar_idx BETWEEN l.bar_idx + 1 AND l.bar_idx + 10 WHERE risk > 0 GROUP BY l.signal_id)
SELECT signal_id, round(mfe, 6) AS mfe, round(mae, 6) AS mae, bars FROM x""")
def deal_excursions(spark, sf_dir):
    """Best and worst move of the ten bars after an entry, in units of risk."""
    s = indicators.with_atr(hourly_bars(spark, sf_dir)).where("atr > 0").withColumn("signal_id", F.concat_ws(":", "symbol", F.col("bar_idx").cast("string"))).withColumn("sign", F.when(F.col("bar_idx") % 2 == 0, 1).otherwise(-1))
    s = s.withColumn("entry_price", F.round("close", 4)).withColumn("risk", 1.5 * F.round("atr", 4)).where("risk > 0")
    s = s.withColumn("at", F.explode(F.sequence(F.col("bar_idx") + 1, F.col("bar_idx") + 10))).select("signal_id", *SERIES, "sign", "entry_price", "risk", F.col("at").alias("bar_idx"))
    path = s.join(hourly_bars(spark, sf_dir).select(*SERIES, "bar_idx", "high", "low"), [*SERIES, "bar_idx"])
    best, worst = F.when(F.col("sign") == 1, F.col("high")).otherwise(F.col("low")), F.when(F.col("sign") == 1, F.col("low")).otherwise(F.col("high"))
    in_r = lambda x: F.col("sign") * (x - F.col("entry_price")) / F.col("risk")
    return path.groupBy("signal_id").agg(F.round(F.max(in_r(best)), 6).alias("mfe"), F.round(F.min(in_r(worst)), 6).alias("mae"), F.count(F.lit(1)).alias("bars"))


# Grouped studies


@register(DEALS_SQL + """, y AS (SELECT *, CAST(year(created_at) AS INTEGER) AS year FROM t)
SELECT symbol, action, year, count(*) AS n, count(*) FILTER (r > 0) AS wins, round(avg(r), 8) AS mean_r, round(stddev_samp(r) / sqrt(count(*)), 8) AS se FROM y GROUP BY GROUPING SETS ((symbol), (action), (year))""")
def grouped_stats(spark, sf_dir):
    """One pass over deals for all dimensions, each on its own."""
    y = closed_deals(spark, sf_dir).withColumn("year", F.year("created_at"))
    sets = y.groupingSets([["symbol"], ["action"], ["year"]], "symbol", "action", "year")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") > 0).alias("wins"), r8(F.avg("r"), "mean_r"), r8(F.stddev_samp("r") / F.sqrt(F.count(F.lit(1))), "se"))


@register(DEALS_SQL + "SELECT symbol, count(*) AS n, round(sum(r), 6) AS raw, round(sum(greatest(least(r, 1.5), -1.0)), 6) AS winsorised, round(sum(r) / count(*) * 1000, 4) AS per_thousand FROM t GROUP BY symbol")
def winsorised_rates(spark, sf_dir):
    cut = F.greatest(F.least("r", F.lit(1.5)), F.lit(-1.0))
    return closed_deals(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 6).alias("raw"), F.round(F.sum(cut), 6).alias("winsorised"), F.round(F.sum("r") / F.count(F.lit(1)) * 1000, 4).alias("per_thousand"))


@register(DEALS_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY action) AS n FROM t),
e AS (SELECT action, list(r ORDER BY i) FILTER (i IN (floor(n / 5), floor(n * 2 / 5), floor(n * 3 / 5), floor(n * 4 / 5))) AS edges FROM k GROUP BY action)
SELECT t.action, CAST(len(list_filter(edges, lambda x: t.r >= x)) AS INTEGER) AS bucket, count(*) AS n, round(sum(r), 6) AS total FROM t JOIN e ON e.action = t.action GROUP BY ALL""")
def equal_count_buckets(spark, sf_dir):
    """Five buckets by edges that stand at equal counts; ties go up together."""
    t = closed_deals(spark, sf_dir)
    values = t.groupBy("action", "r").agg(F.count(F.lit(1)).alias("c"))  # rows of equal value together, before any order is asked for
    through = F.sum("c").over(Window.partitionBy("action").orderBy("r"))
    k = values.withColumn("through", through).withColumn("n", F.sum("c").over(Window.partitionBy("action")))
    at = lambda j: F.min(F.when(F.col("through") > F.floor(F.col("n") * j / 5), F.col("r")))
    edges = k.groupBy("action").agg(F.array(*[at(j) for j in range(1, 5)]).alias("edges"))
    bucket = F.size(F.filter("edges", lambda x: F.col("r") >= x))
    return t.join(edges, "action").groupBy("action", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 6).alias("total"))


@register(DEALS_SQL + """, w AS (SELECT symbol, avg(r) FILTER (r > 0) AS w, -avg(r) FILTER (r < 0) AS l, avg(r) AS m FROM t GROUP BY symbol), f AS (SELECT unnest([0, 10, 20, 32, 40]) AS bps)
SELECT symbol, CAST(bps AS INTEGER) AS bps, round((l + bps / 100) / (w + l), 8) AS breakeven_p, round(m - bps / 100, 8) AS net FROM w, f""")
def breakeven(spark, sf_dir):
    """The hit rate that a fee level asks for, and what is left after it."""
    w = closed_deals(spark, sf_dir).groupBy("symbol").agg(F.avg(F.when(F.col("r") > 0, F.col("r"))).alias("w"), (-F.avg(F.when(F.col("r") < 0, F.col("r")))).alias("l"), F.avg("r").alias("m"))
    w = w.withColumn("bps", F.explode(F.array(*map(F.lit, (0, 10, 20, 32, 40)))))
    return w.select("symbol", "bps", r8((F.col("l") + F.col("bps") / 100) / (F.col("w") + F.col("l")), "breakeven_p"), r8(F.col("m") - F.col("bps") / 100, "net"))


@register(SIGNALS_SQL + "SELECT action, count(*) FILTER (status = 'F') AS F, count(*) FILTER (status = 'O') AS O, count(*) FILTER (status = 'P') AS P FROM s GROUP BY action")
def action_census(spark, sf_dir):
    return flat_signals(spark, sf_dir).groupBy("action").pivot("status", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@register(DEALS_SQL + """, g AS (SELECT symbol, count(*) AS n, avg(r) AS m, var_pop(r) AS v FROM t GROUP BY symbol), a AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m FROM g)
SELECT round(sum(g.n * g.v) / max(a.n), 8) AS within_var, round(sum(g.n * (g.m - a.m) ** 2) / max(a.n), 8) AS between_var FROM g, a""")
def within_between(spark, sf_dir):
    """Variance inside and between symbols, from one row of moments per symbol."""
    g = closed_deals(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.var_pop("r").alias("v"))
    n, m = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    return g.agg(r8(F.sum(F.col("n") * F.col("v")) / n, "within_var"), r8(F.sum(F.col("n") * F.col("m") * F.col("m")) / n - m * m, "between_var"))


@register(SIGNALS_SQL + """, c AS (SELECT confidence, ((signal_id * 7) % 41 - 20) / 10 AS r FROM s WHERE status = 'F'), h AS (SELECT unnest([50, 60, 70, 80, 90]) AS least)
SELECT CAST(least AS INTEGER) AS threshold, count(*) FILTER (confidence >= least) AS kept, round(avg(r) FILTER (confidence >= least), 8) AS kept_r, round(avg(r) FILTER (confidence < least), 8) AS dropped_r FROM c, h GROUP BY least""")
def threshold_study(spark, sf_dir):
    c = flat_signals(spark, sf_dir).where("status = 'F'").select("confidence", (((F.col("signal_id") * 7) % 41 - 20) / 10).alias("r"), F.explode(F.array(*map(F.lit, (50, 60, 70, 80, 90)))).alias("threshold"))
    kept = F.col("confidence") >= F.col("threshold")
    return c.groupBy("threshold").agg(F.count_if(kept).alias("kept"), r8(F.avg(F.when(kept, F.col("r"))), "kept_r"), r8(F.avg(F.when(~kept, F.col("r"))), "dropped_r"))


@register(DEALS_SQL + "SELECT symbol, round(count(*) / ((epoch(max(created_at)) - epoch(min(created_at))) / 86400 / 30.436875), 6) AS per_month FROM t GROUP BY symbol HAVING max(created_at) > min(created_at)")
def deals_per_month(spark, sf_dir):
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    g = closed_deals(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (seconds(F.max("created_at")) - seconds(F.min("created_at"))).alias("s")).where("s > 0")
    return g.select("symbol", F.round(F.col("n") / (F.col("s") / 86400 / 30.436875), 6).alias("per_month"))


@register(DEALS_SQL + """, c AS (SELECT r, action, unnest(list_filter(['all', CASE WHEN r > 0 THEN 'winning' END, CASE WHEN abs(r) > 1 THEN 'large' END, CASE WHEN user_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS cohort FROM t)
SELECT cohort, count(*) AS n, round(avg(r), 8) AS mean_r, round(avg(CASE WHEN action = 'BUY' THEN 1.0 ELSE 0.0 END), 8) AS buy_share FROM c GROUP BY cohort""")
def cohort_digest(spark, sf_dir):
    """A deal counts in every cohort it belongs to."""
    r = F.col("r")
    cohorts = F.array_compact(F.array(F.lit("all"), F.when(r > 0, "winning"), F.when(F.abs(r) > 1, "large"), F.when(F.col("user_id") % 2 == 0, "even")))
    return closed_deals(spark, sf_dir).withColumn("cohort", F.explode(cohorts)).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), r8(F.avg("r"), "mean_r"), r8(F.avg((F.col("action") == "BUY").cast("double")), "buy_share"))


@register(DEALS_SQL + ", b AS (SELECT * FROM (VALUES ('S0', 'metals'), ('S1', 'currencies'), ('S2', 'asia'), ('S2', 'shares'), ('S3', 'shares'), ('S7', 'asia'), ('S7', 'shares')) v(symbol, grp)) SELECT grp, count(*) AS n, count(DISTINCT t.symbol) AS symbols, round(sum(r), 6) AS total FROM t JOIN b ON b.symbol = t.symbol GROUP BY grp")
def group_tallies(spark, sf_dir):
    """Tallies by group through a bridge table; a symbol may be in several groups."""
    bridge = spark.createDataFrame([("S0", "metals"), ("S1", "currencies"), ("S2", "asia"), ("S2", "shares"), ("S3", "shares"), ("S7", "asia"), ("S7", "shares")], "symbol string, grp string")
    per_symbol = closed_deals(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("s"))  # before the join, so that no deal is copied
    return per_symbol.join(F.broadcast(bridge), "symbol").groupBy("grp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("symbols"), F.round(F.sum("s"), 6).alias("total"))


@register(DEALS_SQL + ", g AS (SELECT symbol, count(*) FILTER (r > 0) AS wins FROM t GROUP BY symbol) SELECT symbol, wins FROM g ORDER BY wins DESC, symbol LIMIT 1")
def target_choice(spark, sf_dir):
    return closed_deals(spark, sf_dir).groupBy("symbol").agg(F.count_if(F.col("r") > 0).alias("wins")).orderBy(F.desc("wins"), "symbol").limit(1)


@register(DEALS_SQL + """, c AS (SELECT *, CASE WHEN created_at < TIMESTAMP '1996-07-01' THEN 1 ELSE 0 END AS train FROM t), q AS (SELECT quantile_cont(abs(r), [0.2, 0.4, 0.6, 0.8]) AS cuts FROM c WHERE train = 1)
SELECT CAST(len(list_filter(cuts, lambda x: round(abs(r), 9) > round(x, 9))) AS INTEGER) AS bucket, count(*) AS n, round(avg(r), 8) AS mean_r FROM c, q WHERE train = 0 GROUP BY ALL""")
def train_cuts(spark, sf_dir):
    """Quintile cuts fitted on the early deals, applied to the later ones."""
    c = closed_deals(spark, sf_dir).withColumn("early", F.col("created_at") < F.lit("1996-07-01").cast("timestamp_ntz"))
    cuts = c.where("early").agg(F.percentile(F.abs("r"), F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("cuts"))  # one row
    bucket = F.size(F.filter("cuts", lambda x: F.round(F.abs("r"), 9) > F.round(x, 9)))
    return c.where("NOT early").crossJoin(F.broadcast(cuts)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r8(F.avg("r"), "mean_r"))


# Frame features


@register(DAILY_SQL + f", l AS (SELECT *, ln(close) - ln(lag(close) {P})) AS x FROM bars) SELECT {KEYS}, round(stddev_pop(x) {P} ROWS 4 PRECEDING), 6) AS vol5, round(stddev_pop(x) {P} ROWS 19 PRECEDING), 6) AS vol20, round(ln(max(high) {P} ROWS 9 PRECEDING) / min(low) {P} ROWS 9 PRECEDING)), 6) AS range10 FROM l QUALIFY count(x) {P} ROWS 19 PRECEDING) = 20")
def realised_vol(spark, sf_dir):
    b = daily_bars(spark, sf_dir).withColumn("x", F.ln("close") - F.ln(F.lag("close").over(series())))
    dev = lambda n: F.round(F.stddev_pop("x").over(indicators.last(n)), 6)
    span = F.round(F.ln(F.max("high").over(indicators.last(10)) / F.min("low").over(indicators.last(10))), 6)
    return b.select(*KEY, dev(5).alias("vol5"), dev(20).alias("vol20"), span.alias("range10"), F.count("x").over(indicators.last(20)).alias("c")).where("c = 20").drop("c")


@register(DAILY_SQL + TR_SQL + f" SELECT {KEYS}, round(ln(atr / lag(atr, 10) {P})), 6) AS atr_change, round(atr / min(atr) {P} ROWS 19 PRECEDING), 6) AS squeeze FROM atr QUALIFY bar_idx >= 30")
def atr_change(spark, sf_dir):
    b = indicators.with_atr(daily_bars(spark, sf_dir))
    change, squeeze = F.ln(F.col("atr") / F.lag("atr", 10).over(series())), F.col("atr") / F.min("atr").over(indicators.last(20))
    return b.select(*KEY, "bar_idx", F.round(change, 6).alias("atr_change"), F.round(squeeze, 6).alias("squeeze")).where("bar_idx >= 30").drop("bar_idx")


@register(DAILY_SQL + f", g AS (SELECT *, open / lag(close) {P}) - 1 AS gap FROM bars) SELECT {KEYS}, round((gap - avg(gap) {P} ROWS 19 PRECEDING)) / stddev_pop(gap) {P} ROWS 19 PRECEDING), 5) AS gap_z FROM g QUALIFY count(gap) {P} ROWS 19 PRECEDING) = 20 AND round(stddev_pop(gap) {P} ROWS 19 PRECEDING), 9) > 0")
def gap_z(spark, sf_dir):
    b = daily_bars(spark, sf_dir).withColumn("gap", F.col("open") / F.lag("close").over(series()) - 1)
    b = b.withColumn("z", features.rolling_z("gap", 20)).withColumn("d", F.round(F.stddev_pop("gap").over(indicators.last(20)), 9)).where("z IS NOT NULL AND d > 0")
    return b.select(*KEY, F.round("z", 5).alias("gap_z"))


@register(DAILY_SQL + f""", d AS (SELECT *, sign(round(close - lag(close) {P}), 9)) AS up, CASE WHEN high > low THEN (2 * close - high - low) / (high - low) * volume ELSE 0 END AS flow FROM bars),
c AS (SELECT *, sum(coalesce(up, 0) * volume) {P} ROWS UNBOUNDED PRECEDING) AS obv, sum(flow) {P} ROWS UNBOUNDED PRECEDING) AS ad, sum(volume) {P} ROWS 9 PRECEDING) AS v FROM d)
SELECT {KEYS}, round((obv - lag(obv, 10) {P})) / v, 9) AS obv10, round((ad - lag(ad, 10) {P})) / v, 9) AS ad10 FROM c QUALIFY bar_idx >= 10""")
def volume_flow(spark, sf_dir):
    """Ten-bar changes of on-balance volume and of accumulation, over the volume of those bars."""
    w, total = series(), series().rowsBetween(Window.unboundedPreceding, 0)
    span = F.col("high") - F.col("low")
    b = daily_bars(spark, sf_dir).withColumn("up", F.coalesce(F.signum(F.round(F.col("close") - F.lag("close").over(w), 9)), F.lit(0.0)))
    b = b.withColumn("flow", F.when(span > 0, (2 * F.col("close") - F.col("high") - F.col("low")) / span * F.col("volume")).otherwise(0.0))
    b = b.withColumn("obv", F.sum(F.col("up") * F.col("volume")).over(total)).withColumn("ad", F.sum("flow").over(total)).withColumn("v", F.sum("volume").over(indicators.last(10)))
    change = lambda c: (F.col(c) - F.lag(c, 10).over(w)) / F.col("v")
    return b.select(*KEY, "bar_idx", F.round(change("obv"), 9).alias("obv10"), F.round(change("ad"), 9).alias("ad10")).where("bar_idx >= 10").drop("bar_idx")


@register(DAILY_SQL + f""", m AS (SELECT *, ln(close / avg(close) {P} ROWS 59 PRECEDING)) AS x, count(*) {P} ROWS 59 PRECEDING) AS c FROM bars) SELECT {KEYS}, round(x, 6) AS rel60, round(lag(x) {P}), 6) AS rel60_before FROM m QUALIFY c = 60""")
def relative_price(spark, sf_dir):
    """Log distance from the 60-bar mean, and its copy of one bar ago."""
    b = daily_bars(spark, sf_dir).withColumn("x", F.ln(F.col("close") / F.avg("close").over(indicators.last(60)))).withColumn("c", F.count(F.lit(1)).over(indicators.last(60)))
    return b.select(*KEY, "c", F.round("x", 6).alias("rel60"), F.round(F.lag("x").over(series()), 6).alias("rel60_before")).where("c = 60").drop("c")


@register(DAILY_SQL + f""", l AS (SELECT *, ln(close) - ln(lag(close) {P})) AS x FROM bars), g AS (SELECT timeframe, ts, avg(CASE WHEN market IN ('FOREX', 'GOLD') THEN -x ELSE x END) AS r, count(x) AS legs FROM l WHERE x IS NOT NULL GROUP BY ALL)
SELECT timeframe, ts, legs, round(CASE WHEN legs >= 6 THEN r END, 6) AS index_r FROM g""")
def signed_index(spark, sf_dir):
    """Mean of signed legs per time step; null under six legs."""
    r = features.momentum(daily_bars(spark, sf_dir), (1,)).where("mom_1 IS NOT NULL")
    leg = F.when(F.col("market").isin("FOREX", "GOLD"), -F.col("mom_1")).otherwise(F.col("mom_1"))
    g = r.groupBy("timeframe", "ts").agg(F.count(F.lit(1)).alias("legs"), F.avg(leg).alias("r"))
    return g.select("timeframe", "ts", "legs", F.round(F.when(F.col("legs") >= 6, F.col("r")), 6).alias("index_r"))


@register(DAILY_SQL + f""", m AS (SELECT *, avg((high - low) / close * 100) {P} ROWS 249 PRECEDING) AS span, avg(volume * close) {P} ROWS 249 PRECEDING) AS turnover FROM bars), q AS (SELECT *, round(turnover, 6) AS tq, round(span, 6) AS sq FROM m WHERE bar_idx >= 249),
h AS (SELECT *, median(tq) OVER (PARTITION BY timeframe, ts) AS mid, count(*) OVER (PARTITION BY timeframe, ts) AS n FROM q)
SELECT {KEYS}, sq AS mean_span FROM h WHERE n >= 3 AND tq >= round(mid, 6) QUALIFY row_number() OVER (PARTITION BY timeframe, ts ORDER BY sq DESC, market, symbol) <= 8""")
def runner_mask(spark, sf_dir):
    """Point-in-time choice: above-median turnover, then the eight widest ranges of each time step."""
    w = indicators.last(250)
    b = daily_bars(spark, sf_dir).withColumn("sq", F.round(F.avg((F.col("high") - F.col("low")) / F.col("close") * 100).over(w), 6)).withColumn("tq", F.round(F.avg(F.col("volume") * F.col("close")).over(w), 6)).where("bar_idx >= 249")
    step = b.groupBy("timeframe", "ts").agg(F.round(F.percentile("tq", F.lit(0.5)), 6).alias("mid"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    order = Window.partitionBy("timeframe", "ts").orderBy(F.desc("sq"), "market", "symbol")
    return b.join(step, ["timeframe", "ts"]).where("tq >= mid").withColumn("k", F.row_number().over(order)).where("k <= 8").select(*KEY, F.col("sq").alias("mean_span"))


@register(DAILY_SQL + f", p AS (SELECT *, max(close) {P} ROWS UNBOUNDED PRECEDING) AS peak FROM bars) SELECT market, symbol, timeframe, round(max(1 - close / peak), 8) AS max_drawdown FROM p GROUP BY ALL")
def price_drawdown(spark, sf_dir):
    peak = F.max("close").over(series().rowsBetween(Window.unboundedPreceding, 0))
    return daily_bars(spark, sf_dir).withColumn("peak", peak).groupBy(*SERIES).agg(r8(F.max(1 - F.col("close") / F.col("peak")), "max_drawdown"))


@register(DAILY_SQL + f"""SELECT {KEYS}, round(greatest(ln(lead(close, 5) {P}) / lead(open) {P})), -ln(lead(close, 5) {P}) / lead(open) {P}))), 6) AS ceiling FROM bars QUALIFY lead(close, 5) {P}) IS NOT NULL""")
def oracle_ceiling(spark, sf_dir):
    """The better of both directions over five bars: what no strategy can beat."""
    x = features.forward_returns(None, 5, "open_close")
    return daily_bars(spark, sf_dir).withColumn("x", x).where("x IS NOT NULL").select(*KEY, F.round(F.abs("x"), 6).alias("ceiling"))


# Order, sets, scores


@register(DAILY_SQL + f""", q AS (SELECT *, round((close / lag(close) {P}) - 1) * 100, 6) AS moved_pct, row_number() OVER (PARTITION BY market, symbol, timeframe ORDER BY ts DESC) AS n FROM bars) SELECT symbol, moved_pct FROM q WHERE n = 1 ORDER BY abs(moved_pct) DESC, symbol LIMIT 5""")
def top_movers(spark, sf_dir):
    b = daily_bars(spark, sf_dir).withColumn("moved_pct", F.round((F.col("close") / F.lag("close").over(series()) - 1) * 100, 6))
    return engine.latest(b).orderBy(F.desc(F.abs("moved_pct")), "symbol").limit(5).select("symbol", "moved_pct")


@register(DEALS_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY r DESC, signal_id) AS best, row_number() OVER (PARTITION BY action ORDER BY r, signal_id) AS worst FROM t) SELECT action, signal_id, round(r, 6) AS r, best <= 5 AS is_best FROM k WHERE best <= 5 OR worst <= 5")
def best_worst(spark, sf_dir):
    t, g = closed_deals(spark, sf_dir), Window.partitionBy("action")
    ends = [t.withColumn("k", F.row_number().over(g.orderBy(order, "signal_id"))).where("k <= 5").withColumn("is_best", F.lit(best)) for order, best in ((F.desc("r"), True), (F.asc("r"), False))]
    both = ends[0].unionByName(ends[1]).groupBy("action", "signal_id").agg(F.max("r").alias("r"), F.max("is_best").alias("is_best"))
    return both.select("action", "signal_id", F.round("r", 6).alias("r"), "is_best")


@register(DEALS_SQL + """, h AS (SELECT symbol, avg(r) FILTER (created_at < TIMESTAMP '1996-07-01') AS early, avg(r) FILTER (created_at >= TIMESTAMP '1996-07-01') AS late FROM t GROUP BY symbol)
SELECT symbol, round(early, 8) AS early, round(late, 8) AS late, row_number() OVER (ORDER BY round(early, 8) DESC NULLS LAST, symbol) <= 5 AS chosen FROM h""")
def train_top5(spark, sf_dir):
    """The five best symbols of the early half, beside what they did later."""
    early = F.col("created_at") < F.lit("1996-07-01").cast("timestamp_ntz")
    h = closed_deals(spark, sf_dir).groupBy("symbol").agg(r8(F.avg(F.when(early, F.col("r"))), "early"), r8(F.avg(F.when(~early, F.col("r"))), "late"))
    top = h.orderBy(F.desc_nulls_last("early"), "symbol").limit(5).select("symbol", F.lit(True).alias("chosen"))
    return h.join(top, "symbol", "left").fillna(False, ["chosen"])


@register(SIGNALS_SQL + "SELECT symbol, action, signal_id, confidence FROM s WHERE status = 'P' QUALIFY row_number() OVER (PARTITION BY symbol, action ORDER BY confidence DESC, created_at DESC, signal_id) = 1")
def digest_first(spark, sf_dir):
    """After ranking, the first signal of each symbol and action."""
    w = Window.partitionBy("symbol", "action").orderBy(F.desc("confidence"), F.desc("created_at"), "signal_id")
    return flat_signals(spark, sf_dir).where("status = 'P'").withColumn("k", F.row_number().over(w)).where("k = 1").select("symbol", "action", "signal_id", "confidence")


@register(DEALS_SQL + ", u AS (SELECT symbol, 0.3::DOUBLE * r AS x FROM t WHERE action = 'BUY' UNION ALL SELECT symbol, 0.7::DOUBLE * r FROM t WHERE action = 'SELL') SELECT symbol, round(sum(x), 6) AS mixed, count(*) AS n FROM u GROUP BY symbol")
def cluster_mixture(spark, sf_dir):
    """Cluster sums of two arms, scaled and merged."""
    t = closed_deals(spark, sf_dir)
    arms = [t.where(F.col("action") == side).groupBy("symbol").agg((share * F.sum("r")).alias("x"), F.count(F.lit(1)).alias("n")) for side, share in (("BUY", 0.3), ("SELL", 0.7))]
    return arms[0].unionByName(arms[1]).groupBy("symbol").agg(F.round(F.sum("x"), 6).alias("mixed"), F.sum("n").alias("n"))


@register(DAILY_SQL + """, k AS (SELECT *, CASE WHEN ts < TIMESTAMP '1999-01-01' THEN volume END AS fit FROM bars), f AS (SELECT market, symbol, timeframe, avg(fit) AS m, stddev_pop(fit) AS d FROM k GROUP BY ALL)
SELECT k.market, k.symbol, k.timeframe, k.ts, round((k.volume - m) / d, 6) AS z FROM k JOIN f ON f.market = k.market AND f.symbol = k.symbol AND f.timeframe = k.timeframe WHERE round(d, 9) > 0""")
def train_standardised(spark, sf_dir):
    """Volumes in deviations from the mean of the training years alone."""
    b = daily_bars(spark, sf_dir)
    fit = b.where(F.col("ts") < F.lit("1999-01-01").cast("timestamp_ntz")).groupBy(*SERIES).agg(F.avg("volume").alias("m"), F.stddev_pop("volume").alias("d")).where(F.round("d", 9) > 0)
    return b.join(fit, SERIES).select(*KEY, F.round((F.col("volume") - F.col("m")) / F.col("d"), 6).alias("z"))


@register("SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1) / count(*) OVER (PARTITION BY p_brand), 8) AS below FROM part")
def percentile_score(spark, sf_dir):
    """Share of a reference list that lies strictly below a value."""
    g = Window.partitionBy("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", r8((F.rank().over(g.orderBy("p_retailprice")) - 1) / F.count(F.lit(1)).over(g), "below"))


@register(DEALS_SQL + ", e AS (SELECT symbol, arg_min(10000 + r, (created_at, signal_id)) AS a, arg_max(10000 + r, (created_at, signal_id)) AS b FROM t GROUP BY symbol) SELECT symbol, round(b - a, 6) AS change, round((b - a) / a * 100, 6) AS change_pct FROM e")
def equity_change(spark, sf_dir):
    """From the first point to the last, in amount and percent."""
    at = F.struct("created_at", "signal_id")
    e = closed_deals(spark, sf_dir).groupBy("symbol").agg(F.min_by(10000 + F.col("r"), at).alias("a"), F.max_by(10000 + F.col("r"), at).alias("b"))
    return e.select("symbol", F.round(F.col("b") - F.col("a"), 6).alias("change"), F.round((F.col("b") - F.col("a")) / F.col("a") * 100, 6).alias("change_pct"))


def _ranked_step(bars: DataFrame) -> DataFrame:
    b = bars.select("timeframe", "ts", F.round("volume", 6).alias("x"), F.round(features.forward_returns(None, 5, "close_close"), 6).alias("y")).where("y IS NOT NULL")
    for c in ("x", "y"):
        ties = F.count(F.lit(1)).over(Window.partitionBy("timeframe", "ts", c))
        b = b.withColumn(f"r{c}", F.rank().over(Window.partitionBy("timeframe", "ts").orderBy(c)) + (ties - 1) / 2)
    return b


@register(DAILY_SQL + f""", q AS (SELECT timeframe, ts, round(volume, 6) AS x, round(ln(lead(close, 5) {P}) / close), 6) AS y FROM bars), k AS (SELECT timeframe, ts, rank() OVER (PARTITION BY timeframe, ts ORDER BY x) + (count(*) OVER (PARTITION BY timeframe, ts, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY timeframe, ts ORDER BY y) + (count(*) OVER (PARTITION BY timeframe, ts, y) - 1) / 2 AS ry FROM q WHERE y IS NOT NULL)
SELECT timeframe, ts, count(*) AS names, round(corr(rx, ry), 6) AS ic FROM k GROUP BY ALL HAVING count(*) >= 4 AND var_pop(rx) > 0 AND var_pop(ry) > 0""")
def cross_section_ic(spark, sf_dir):
    """Rank correlation of a feature with what follows, per time step of at least four names."""
    g = _ranked_step(daily_bars(spark, sf_dir)).groupBy("timeframe", "ts").agg(F.count(F.lit(1)).alias("names"), statistics.correlation("rx", "ry").alias("c"))
    return g.where("names >= 4 AND c IS NOT NULL").select("timeframe", "ts", "names", F.round("c", 6).alias("ic"))
