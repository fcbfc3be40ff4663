"""Named queries of sweeps, registered comparisons, bootstraps and permutation tests, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewright.operators import features, resampling, simulation, statistics, sweep
from candlewright.operators import signals as engine
from candlewright.plans.engine_sql import sweep_sql, walk_sql
from candlewright.plans.queries import DAILY_SQL, DEALS_SQL, HOURLY_SQL, KEY, SERIES, closed_deals, r6, register
from candlewright.plans.research import r8
from candlewright.sources.bars import daily_bars, hourly_bars

SEED = 7


# Sweeps


def _arms(arms: tuple[sweep.Arm, ...]) -> list[tuple]:
    return [(a.name, [int(r not in a.off) for r in sweep.RULES], a.buy_at, a.sell_at, a.stop_atr, a.target_atr, a.at_levels, a.hold) for a in arms]


_STATS = " SELECT arm, count(*) AS n, count(*) FILTER (sign = 1) AS buys, count(*) FILTER (r > 0) AS wins, round(sum(r), 6) AS total_r, round(avg(r), 6) AS avg_r FROM swept GROUP BY arm"


def _swept(spark, sf_dir, arms):
    return sweep.arm_stats(sweep.sweep(hourly_bars(spark, sf_dir), arms)).select("arm", "n", "buys", "wins", *r6("total_r", "avg_r"))


@register(sweep_sql(HOURLY_SQL, _arms(sweep.DIAGNOSTIC)) + _STATS)
def config_sweep(spark, sf_dir):
    """The walk-forward under seventeen diagnostic configurations, in one plan."""
    return _swept(spark, sf_dir, sweep.DIAGNOSTIC)


@register(sweep_sql(HOURLY_SQL, _arms(sweep.ABLATION)) + _STATS)
def ablation_sweep(spark, sf_dir):
    """Families of rules, rules left out, stricter thresholds, and entries at every bar."""
    return _swept(spark, sf_dir, sweep.ABLATION)


@register(sweep_sql(HOURLY_SQL, _arms(sweep.HOLD_PROBES)) + _STATS)
def hold_probes(spark, sf_dir):
    """The walk-forward under four longest holds; unlike hold_cap_sweep the choice of deals changes, too."""
    return _swept(spark, sf_dir, sweep.HOLD_PROBES)


# Registered comparisons

ALL, UP_DOWN, SIDE, WITH, AGAINST = "all", "trending", "sideways", "aligned", "counter"
_SWITCHED, _REVERSED = (("F1", UP_DOWN), ("F2", SIDE)), (("F1", SIDE), ("F2", UP_DOWN))
#: The registered comparisons (id, family, left, right).  A side is a sum of cohorts of arms; a right side of None is
#: the mix of entries at every bar that has the left side's share of buys.
COMPARISONS = (
    ("H1", "main", (("F1", ALL),), (("B0", ALL),)), ("H2", "main", (("F2", ALL),), (("B0", ALL),)), ("H3", "main", (("F1", ALL),), (("F2", ALL),)),
    ("H4", "regime", _SWITCHED, (("B0", ALL),)), ("H5", "regime", _REVERSED, (("B0", ALL),)), ("H6", "regime", _SWITCHED, _REVERSED),
    ("H7", "regime", (("F1", UP_DOWN),), (("F1", SIDE),)), ("H8", "regime", (("F2", SIDE),), (("F2", UP_DOWN),)),
    ("H9", "cohort", (("B0", WITH),), (("B0", SIDE),)), ("H10", "cohort", (("B0", WITH),), (("B0", AGAINST),)),
    ("H11", "null", (("B0", ALL),), None), ("H12", "null", (("F1", ALL),), None), ("H13", "null", (("F2", ALL),), None), ("H14", "null", _SWITCHED, None),
    ("H15", "control", (("C4", ALL),), (("B0", ALL),)), ("H16", "control", (("C5", ALL),), (("B0", ALL),)),
    *((f"H{16 + k}", "leave_one_out", ((f"L{k}", ALL),), (("B0", ALL),)) for k in range(1, 11)),
)
_NULL = (("N1", ALL, "buy"), ("N2", ALL, "sell"))


def members() -> list[tuple]:
    """(id, family, side, arm, cohort, mix) of every part of every side."""
    out = []
    for name, family, left, right in COMPARISONS:
        out += [(name, family, "left", arm, cohort, None) for arm, cohort in left]
        out += [(name, family, "right", *part) for part in _NULL] if right is None else [(name, family, "right", arm, cohort, None) for arm, cohort in right]
    return out


def compared(spark, deals, draws: int):
    """Every comparison's difference, interval, p, and Holm within its family and over all."""
    cohorts = F.array_compact(F.array(F.lit(ALL), F.when(F.col("trend") == "sideways", SIDE).otherwise(UP_DOWN), F.when(F.col("trend") != "sideways", F.when((F.col("trend") == "uptrend") == (F.col("action") == "BUY"), WITH).otherwise(AGAINST))))
    sums = deals.select("arm", F.explode(cohorts).alias("cohort"), "symbol", "r", (F.col("action") == "BUY").cast("double").alias("buy")).groupBy("arm", "cohort", F.col("symbol").alias("_c")).agg(F.sum("r").alias("s"), F.count("r").cast("double").alias("n"), F.sum("buy").alias("b"))
    parts = sums.join(F.broadcast(spark.createDataFrame(members(), "id string, family string, side string, arm string, cohort string, mix string")), ["arm", "cohort"])  # a row per part of a comparison
    share = parts.where("side = 'left'").groupBy("id").agg((F.sum("b") / F.sum("n")).alias("share"))
    weight = F.when(F.col("mix") == "buy", F.col("share")).when(F.col("mix") == "sell", 1 - F.col("share")).otherwise(1.0)
    sides = parts.join(share, "id").groupBy("id", "family", "side", "_c").agg(F.sum(F.col("s") * weight).alias("s"), F.sum(F.col("n") * weight).alias("n"))
    family = spark.createDataFrame([(c[0], c[1]) for c in COMPARISONS], "id string, family string")
    tested = resampling.bootstrap_difference(sides.drop("family"), draws, SEED).join(F.broadcast(family), "id").where("n_left > 0 AND n_right > 0")
    within = statistics.holm(tested, ["family"]).withColumnsRenamed({"holm_p": "family_p", "rejected": "family_rejected"}).drop("holm_threshold")
    return statistics.holm(within.withColumn("_all", F.lit(0)), ["_all"])


def counts_sql(key: str, draw: str, seed: int = SEED, mean: float = 1.0) -> str:
    """A cluster's count in a draw."""
    h = f"('0x' || substr(md5(concat('{seed}:', {key}, ':', {draw} // 4)), CAST(1 + 8 * ({draw} % 4) AS BIGINT), 8))::BIGINT"
    return f"list_sum(list_transform({resampling.limits(mean)}, lambda q: ({h} >= q)::INTEGER))"



DIFF_DRAWS = 400
_PARTS_SQL = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in members())


@register(sweep_sql(HOURLY_SQL, _arms(sweep.ABLATION)) + f""",
co AS (SELECT arm, symbol, r, (sign = 1)::INTEGER AS buy, unnest(list_filter(['all', CASE WHEN trend = 'sideways' THEN 'sideways' ELSE 'trending' END, CASE WHEN trend <> 'sideways' THEN CASE WHEN (trend = 'uptrend') = (sign = 1) THEN 'aligned' ELSE 'counter' END END], lambda q: q IS NOT NULL)) AS cohort FROM swept),
su AS (SELECT arm, cohort, symbol, sum(r) AS s, count(*)::DOUBLE AS n, sum(buy)::DOUBLE AS b FROM co GROUP BY ALL), me(id, family, side, arm, cohort, mix) AS (VALUES {_PARTS_SQL}),
pa AS (SELECT * FROM me JOIN su USING (arm, cohort)), sh AS (SELECT id, sum(b) / sum(n) AS share FROM pa WHERE side = 'left' GROUP BY id),
sd AS (SELECT id, family, symbol, coalesce(sum(s * w) FILTER (side = 'left'), 0) AS sl, coalesce(sum(n * w) FILTER (side = 'left'), 0) AS nl, coalesce(sum(s * w) FILTER (side = 'right'), 0) AS sr, coalesce(sum(n * w) FILTER (side = 'right'), 0) AS nr FROM (SELECT *, CASE mix WHEN 'buy' THEN share WHEN 'sell' THEN 1 - share ELSE 1 END AS w FROM pa JOIN sh USING (id)) GROUP BY ALL),
dr AS (SELECT id, draw, sum(sl * c) AS sl, sum(nl * c) AS nl, sum(sr * c) AS sr, sum(nr * c) AS nr FROM (SELECT *, {counts_sql("symbol", "draw")} AS c FROM (SELECT *, unnest(range({DIFF_DRAWS})) AS draw FROM sd)) GROUP BY ALL),
df AS (SELECT id, CASE WHEN nl > 0 THEN sl / nl ELSE 0 END - CASE WHEN nr > 0 THEN sr / nr ELSE 0 END AS e FROM dr),
iv AS (SELECT id, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.975) AS hi, least(1, 2 * (least(count(*) FILTER (e <= 0), count(*) FILTER (e >= 0)) + 1) / (count(*) + 1)) AS p FROM df GROUP BY id),
te AS (SELECT id, family, 0 AS al, sum(sl) / sum(nl) AS lft, sum(sr) / sum(nr) AS rgt, lo, hi, p FROM sd JOIN iv USING (id) GROUP BY ALL HAVING sum(nl) > 0 AND sum(nr) > 0),
rk AS (SELECT *, count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, id) + 1 AS left_f, count(*) OVER () - row_number() OVER (ORDER BY p, id) + 1 AS left_a FROM te)
SELECT id, family, round(lft, 6) AS "left", round(rgt, 6) AS "right", round(lft - rgt, 6) AS diff, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 8) AS p,
 round(least(1, max(left_f * p) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING)), 8) AS family_p, round(least(1, max(left_a * p) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING)), 8) AS holm_p,
 bool_and(p <= 0.05 / left_a) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING) AS rejected FROM rk""")
def registered_comparisons(spark, sf_dir):
    """Twenty-six comparisons of arms, cohorts and null mixes, registered beforehand, from one sweep: differences under
    shared resampling of symbols, with Holm within families and over all."""
    out = compared(spark, sweep.sweep(hourly_bars(spark, sf_dir), sweep.ABLATION), DIFF_DRAWS)
    return out.select("id", "family", *r6("left", "right", "diff", "lo", "hi"), r8("p", "p"), r8("family_p", "family_p"), r8("holm_p", "holm_p"), "rejected")


# Bootstraps


def _boot_sql(name: str, source: str, cluster: str, draws: int, tail: float = 0.025) -> str:
    return f"""{name}c AS (SELECT {cluster} AS c, sum(r) AS s, count(r)::DOUBLE AS n FROM {source} GROUP BY ALL),
{name}d AS (SELECT draw, sum(s * k) AS s, sum(n * k) AS n FROM (SELECT *, {counts_sql("c", "draw")} AS k FROM (SELECT *, unnest(range({draws})) AS draw FROM {name}c)) GROUP BY draw),
{name} AS (SELECT (SELECT sum(s) / sum(n) FROM {name}c) AS value, quantile_cont(e, {tail!r}) AS lo, quantile_cont(e, {1 - tail!r}) AS hi, least(1, 2 * (least(count(*) FILTER (e <= 0), count(*) FILTER (e >= 0)) + 1) / (count(*) + 1)) AS p, (SELECT count(*) FROM {name}c) AS clusters
 FROM (SELECT CASE WHEN n > 0 THEN s / n ELSE 0 END AS e FROM {name}d))"""


def _shown(names: str, kind: str) -> str:
    return f"SELECT '{kind}' AS kind, round(value, 6) AS value, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 8) AS p, clusters FROM {names}"


@register(DEALS_SQL + ", " + _boot_sql("b", "t", "symbol", 2000) + " SELECT round(value, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 8) AS p, clusters FROM b")
def bootstrap_ci(spark, sf_dir):
    """Interval of the mean result from resampled symbols."""
    b = resampling.bootstrap_mean(closed_deals(spark, sf_dir), "r", F.col("symbol"), [])
    return b.select(F.round("value", 6).alias("mean"), *r6("lo", "hi"), r8("p", "p"), "clusters")


DRAWS = 300
_RHO = "CASE WHEN m > 0 AND greatest(aa / m - (a / m) * (a / m), 0) * greatest(bb / m - (b / m) * (b / m), 0) > 0 THEN (ab / m - a / m * b / m) / (sqrt(greatest(aa / m - (a / m) * (a / m), 0) * greatest(bb / m - (b / m) * (b / m), 0))) ELSE 0 END"


@register(DEALS_SQL + ", u AS (SELECT *, strftime(created_at, '%Y-%m') AS month FROM t), " + _boot_sql("ii", "t", "signal_id", DRAWS) + ", " + _boot_sql("cl", "t", "symbol", DRAWS) + ", " + _boot_sql("bo", "t", "symbol", DRAWS, 0.0025) + f""",
blc AS (SELECT month AS c, sum(r) AS s, count(r)::DOUBLE AS n, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS g FROM u GROUP BY month),
bls AS (SELECT (i + o) % g AS i, draw, sum(k) AS k FROM (SELECT i, g, draw, unnest(range(3)) AS o, {counts_sql("i", "draw", mean=1 / 3)} AS k FROM (SELECT *, unnest(range({DRAWS})) AS draw FROM blc)) GROUP BY ALL),
bld AS (SELECT draw, sum(s * k) AS s, sum(n * k) AS n FROM blc JOIN bls USING (i) GROUP BY draw),
bl AS (SELECT (SELECT sum(s) / sum(n) FROM blc) AS value, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.975) AS hi, least(1, 2 * (least(count(*) FILTER (e <= 0), count(*) FILTER (e >= 0)) + 1) / (count(*) + 1)) AS p, (SELECT count(*) FROM blc) AS clusters FROM (SELECT CASE WHEN n > 0 THEN s / n ELSE 0 END AS e FROM bld)),
x AS (SELECT symbol, rank() OVER (ORDER BY signal_id % 97) + (count(*) OVER (PARTITION BY signal_id % 97) - 1) / 2 AS x, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS y FROM t),
xc AS (SELECT symbol, count(*)::DOUBLE AS m, sum(x) AS a, sum(y) AS b, sum(x * x) AS aa, sum(y * y) AS bb, sum(x * y) AS ab FROM x GROUP BY symbol),
xd AS (SELECT draw, sum(m * k) AS m, sum(a * k) AS a, sum(b * k) AS b, sum(aa * k) AS aa, sum(bb * k) AS bb, sum(ab * k) AS ab FROM (SELECT *, {counts_sql("symbol", "draw")} AS k FROM (SELECT *, unnest(range({DRAWS})) AS draw FROM xc)) GROUP BY draw),
sp AS (SELECT (SELECT {_RHO} FROM (SELECT sum(m) AS m, sum(a) AS a, sum(b) AS b, sum(aa) AS aa, sum(bb) AS bb, sum(ab) AS ab FROM xc)) AS value, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.975) AS hi, least(1, 2 * (least(count(*) FILTER (e <= 0), count(*) FILTER (e >= 0)) + 1) / (count(*) + 1)) AS p, (SELECT count(*) FROM xc) AS clusters FROM (SELECT {_RHO} AS e FROM xd)),
w AS (SELECT symbol, CASE WHEN action = 'BUY' THEN r ELSE -r END AS r FROM t), wc AS (SELECT symbol AS c, sum(r) AS s, 1::DOUBLE AS n FROM w GROUP BY symbol),
wd AS (SELECT draw, sum(s * k) AS s, sum(n * k) AS n FROM (SELECT *, {counts_sql("c", "draw")} AS k FROM (SELECT *, unnest(range({DRAWS})) AS draw FROM wc)) GROUP BY draw),
pa AS (SELECT (SELECT avg(s) FROM wc) AS value, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.975) AS hi, least(1, 2 * (least(count(*) FILTER (e <= 0), count(*) FILTER (e >= 0)) + 1) / (count(*) + 1)) AS p, (SELECT count(*) FROM wc) AS clusters FROM (SELECT CASE WHEN n > 0 THEN s / n ELSE 0 END AS e FROM wd)) """
          + " UNION ALL ".join(_shown(a, b) for a, b in (("ii", "iid"), ("cl", "cluster"), ("bl", "block"), ("bo", "bonferroni"), ("sp", "spearman"), ("pa", "paired"))))
def bootstrap_study(spark, sf_dir):
    """Intervals under several resamplings: single deals, symbols, runs of three months, Bonferroni; of a rank correlation; of
    the difference of two arms."""
    t = closed_deals(spark, sf_dir).withColumn("month", F.date_format("created_at", "yyyy-MM"))
    found = [(kind, resampling.bootstrap_mean(t, "r", F.col(cluster), [], DRAWS, **extra)) for kind, cluster, extra in (("iid", "signal_id", {}), ("cluster", "symbol", {}), ("block", "month", {"block": 3}), ("bonferroni", "symbol", {"tests": 10}))]
    ranked = statistics.joined_rank(statistics.joined_rank(t.withColumn("x", (F.col("signal_id") % 97).cast("double")), "x", "rx"), "r", "ry")
    found.append(("spearman", resampling.bootstrap_spearman(ranked, F.col("symbol"), DRAWS)))
    found.append(("paired", resampling.paired_bootstrap(t, "r", F.when(F.col("action") == "BUY", 1).otherwise(-1), F.col("symbol"), DRAWS)))
    out = None
    for kind, d in found:
        rows = d.select(F.lit(kind).alias("kind"), *r6("value", "lo", "hi"), r8("p", "p"), "clusters")
        out = rows if out is None else out.unionByName(rows)
    return out


# Permutations

TOP, PERMUTATIONS, CUT = 5, 10_000, "1995-07-01"


@register(walk_sql(DAILY_SQL) + f""", tr AS (SELECT symbol, gain / planned_risk AS r, b.ts < TIMESTAMP '{CUT}' AS train FROM deals JOIN bars b USING (market, symbol, timeframe, bar_idx)),
un AS (SELECT symbol, round(avg(r) FILTER (train), 9) AS x, round(avg(r) FILTER (NOT train), 9) AS y FROM tr GROUP BY symbol HAVING x IS NOT NULL AND y IS NOT NULL),
ra AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, row_number() OVER (ORDER BY x DESC, symbol) AS place, count(*) OVER () AS n FROM un),
mi AS (SELECT draw, ry, y, n, row_number() OVER (PARTITION BY draw ORDER BY md5(concat('{SEED}:', draw, ':', symbol)), symbol) AS place FROM (SELECT *, unnest(range({PERMUTATIONS})) AS draw FROM ra)),
ea AS (SELECT draw, avg(mi.y) FILTER (mi.place <= {TOP}) AS lift, sum((ra.rx - (mi.n + 1) / 2) * (mi.ry - (mi.n + 1) / 2)) AS rc FROM mi JOIN ra USING (place) GROUP BY draw),
se AS (SELECT max(n) AS n, avg(y) FILTER (place <= {TOP}) AS top_y, avg(y) AS all_y, avg(y) FILTER (place > n - {TOP}) AS bottom_y, sum((rx - (n + 1) / 2) * (ry - (n + 1) / 2)) AS c, var_pop(rx) * var_pop(ry) AS v FROM ra)
SELECT n, round(top_y, 6) AS top_y, round(all_y, 6) AS all_y, round(bottom_y, 6) AS bottom_y, (SELECT (1 + count(*) FILTER (lift >= top_y - 1e-9)) / ({PERMUTATIONS} + 1) FROM ea) AS lift_p, round(CASE WHEN v > 0 THEN c / n / sqrt(v) END, 6) AS rho, CASE WHEN v > 0 THEN (SELECT (1 + count(*) FILTER (rc >= c - 1e-6)) / ({PERMUTATIONS} + 1) FROM ea) END AS rho_p FROM se""")
def permutation_scores(spark, sf_dir):
    """Whether a symbol's result on earlier deals tells that on later ones: lift of the best five and rank correlation against
    ten thousand permutations."""
    deals = simulation.walk_forward(engine.all_signals(daily_bars(spark, sf_dir))).where("status = 'deal'")
    train = F.col("ts") < F.lit(CUT).cast("timestamp_ntz")
    units = deals.groupBy("symbol").agg(F.round(F.avg(F.when(train, F.col("r"))), 9).alias("x"), F.round(F.avg(F.when(~train, F.col("r"))), 9).alias("y"))
    out = resampling.permutation_test(units, "symbol", "x", "y", [], TOP, PERMUTATIONS, SEED)
    return out.select("n", *r6("top_y", "all_y", "bottom_y"), "lift_p", *r6("rho"), "rho_p")


@register(HOURLY_SQL + """, q AS (SELECT *, round(close, 9) AS v, ln(lead(close, 5) OVER (PARTITION BY market, symbol, timeframe ORDER BY ts) / lead(open) OVER (PARTITION BY market, symbol, timeframe ORDER BY ts)) AS y FROM bars),
p AS (SELECT a.symbol, a.ts, a.y, (count(*) FILTER (b.v < a.v) + count(*) FILTER (b.v = a.v) / 2) / count(*) AS pct FROM q a JOIN q b ON a.market = b.market AND a.symbol = b.symbol AND a.timeframe = b.timeframe AND b.bar_idx BETWEEN a.bar_idx - 249 AND a.bar_idx GROUP BY ALL HAVING count(*) >= 150)
SELECT symbol, CASE WHEN pct >= 2 / 3 THEN 'upper' WHEN pct <= 1 / 3 THEN 'lower' ELSE 'middle' END AS tercile, count(*) AS n, round(avg(y), 8) AS mean_y, round(avg(abs(y)), 8) AS size FROM p WHERE y IS NOT NULL GROUP BY ALL""")
def tercile_money(spark, sf_dir):
    """Mean of what follows, and its size, in each third of a causal percentile."""
    b = hourly_bars(spark, sf_dir).withColumn("v", F.round("close", 9)).withColumn("y", features.forward_returns(None, 5, "open_close"))
    p = features.percentiles(b.select(*KEY, "v", "y"), {"v": "pct"}, 250, 150).where("y IS NOT NULL AND pct IS NOT NULL")
    third = F.when(F.col("pct") >= 2 / 3, "upper").when(F.col("pct") <= 1 / 3, "lower").otherwise("middle")
    return p.groupBy("symbol", third.alias("tercile")).agg(F.count(F.lit(1)).alias("n"), r8(F.avg("y"), "mean_y"), r8(F.avg(F.abs("y")), "size"))


# Deals by every dimension

_RR = "CASE WHEN rr < 1 THEN 'under 1' WHEN rr < 1.5 THEN '1 to 1.5' WHEN rr < 2 THEN '1.5 to 2' WHEN rr < 3 THEN '2 to 3' ELSE '3 and more' END"
DIMENSIONS = ("market", "timeframe", "action", "strength", "month", "rr_bucket", "reason")


@register(walk_sql(HOURLY_SQL) + f""", dd AS (SELECT d.market, d.timeframe, d.action, s.strength, strftime(s.ts, '%Y-%m') AS month, abs(s.take_profit - d.entry_price) / d.planned_risk AS rr, d.reason, d.gain / d.planned_risk AS r FROM deals d JOIN sig s USING (market, symbol, timeframe, bar_idx)),
de AS (SELECT *, {_RR} AS rr_bucket FROM dd), lo AS ({" UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, r FROM de" for d in DIMENSIONS)})
SELECT dimension, value, count(*) AS n, count(*) FILTER (r > 0) AS wins, round(avg(r), 8) AS mean_r, round(avg(r) - 1.96 * stddev_samp(r) / sqrt(count(*)), 8) AS lo, round(avg(r) + 1.96 * stddev_samp(r) / sqrt(count(*)), 8) AS hi FROM lo GROUP BY ALL""")
def deal_dimensions(spark, sf_dir):
    """The walk-forward's deals by each of seven dimensions, with intervals: one pass over grouping sets."""
    rr = F.abs(F.col("take_profit") - F.col("entry_price")) / F.col("planned_risk")
    bucket = F.when(rr < 1, "under 1").when(rr < 1.5, "1 to 1.5").when(rr < 2, "1.5 to 2").when(rr < 3, "2 to 3").otherwise("3 and more")
    d = simulation.walk_forward(engine.all_signals(hourly_bars(spark, sf_dir))).where("status = 'deal'").withColumns({"month": F.date_format("ts", "yyyy-MM"), "rr_bucket": bucket})
    half = 1.96 * F.stddev_samp("r") / F.sqrt(F.count(F.lit(1)))
    sets = d.groupingSets([[c] for c in DIMENSIONS], *DIMENSIONS).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") > 0).alias("wins"), r8(F.avg("r"), "mean_r"), r8(F.avg("r") - half, "lo"), r8(F.avg("r") + half, "hi"))
    named = F.filter(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in DIMENSIONS]), lambda x: x["value"].isNotNull())  # no dimension is ever null
    return sets.select(F.inline(named), "n", "wins", "mean_r", "lo", "hi")


FEE_BPS = (0.0, 10.0, 20.0, 26.0, 31.0, 40.0)


@register(walk_sql(HOURLY_SQL) + f""", bd AS (SELECT symbol, round(planned_risk / entry_price, 9) AS dist, gain / planned_risk AS r FROM deals),
bk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dist) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bd), be AS (SELECT symbol, list(dist ORDER BY i) FILTER (i IN (floor(n / 5), floor(n * 2 / 5), floor(n * 3 / 5), floor(n * 4 / 5))) AS edges FROM bk GROUP BY symbol),
bb AS (SELECT bd.symbol, CAST(len(list_filter(edges, lambda x: bd.dist >= x)) AS INTEGER) AS bucket, count(*) AS n, avg(1 / dist) AS inv, round(avg(r), 9) AS edge FROM bd JOIN be ON be.symbol = bd.symbol GROUP BY ALL),
br AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY bucket) AS rx, rank() OVER (PARTITION BY symbol ORDER BY edge) + (count(*) OVER (PARTITION BY symbol, edge) - 1) / 2 AS ry FROM bb),
bt AS (SELECT symbol, CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS trend, arg_max(edge, bucket) - arg_min(edge, bucket) AS spread FROM br GROUP BY symbol)
SELECT br.symbol, bucket, CAST(bps AS DOUBLE) AS bps, n, round(edge, 8) AS edge, round(bps / 10000 * inv, 8) AS cost_r, round(edge - bps / 10000 * inv, 8) AS net, round(CASE WHEN edge > 0 THEN edge / inv * 10000 END, 6) AS breakeven_bps, round(trend, 8) AS trend, round(spread, 8) AS top_less_bottom FROM br JOIN bt ON bt.symbol = br.symbol, (SELECT unnest({list(FEE_BPS)}) AS bps)""")
def bucket_trend(spark, sf_dir):
    """Deals of each symbol in five buckets of their stop's distance: edge, cost at six fees, the fee that leaves nothing, the rank
    correlation of bucket and edge, and the last bucket less the first."""
    w = simulation.walk_forward(engine.all_signals(hourly_bars(spark, sf_dir))).where("status = 'deal'")
    d = w.select("symbol", F.round(F.col("planned_risk") / F.col("entry_price"), 9).alias("dist"), "r")
    values = d.groupBy("symbol", "dist").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("symbol")
    k = values.withColumn("through", F.sum("c").over(order.orderBy("dist"))).withColumn("n", F.sum("c").over(order))
    edges = k.groupBy("symbol").agg(F.array(*[F.min(F.when(F.col("through") > F.floor(F.col("n") * j / 5), F.col("dist"))) for j in range(1, 5)]).alias("edges"))
    b = d.join(edges, "symbol").groupBy("symbol", F.size(F.filter("edges", lambda x: F.col("dist") >= x)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(1 / F.col("dist")).alias("inv"), F.round(F.avg("r"), 9).alias("edge"))
    ends = b.groupBy("symbol").agg((F.max_by("edge", "bucket") - F.min_by("edge", "bucket")).alias("spread"))
    t = statistics.spearman(b, "bucket", "edge", ["symbol"]).select("symbol", F.col("rho").alias("trend")).join(ends, "symbol")
    out = b.join(t, "symbol").withColumn("bps", F.explode(F.array(*map(F.lit, FEE_BPS))))
    cost = F.col("bps") / 10000 * F.col("inv")
    return out.select("symbol", "bucket", "bps", "n", r8("edge", "edge"), r8(cost, "cost_r"), r8(F.col("edge") - cost, "net"), F.round(F.when(F.col("edge") > 0, F.col("edge") / F.col("inv") * 10000), 6).alias("breakeven_bps"), r8("trend", "trend"), r8("spread", "top_less_bottom"))
