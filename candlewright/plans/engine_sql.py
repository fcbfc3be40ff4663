"""SQL of the rule engine, its gate and its walk-forward, written from the rules themselves.

The recursive means run as one recursive query over bar numbers; levels come from ranks of first
appearance, and deals from a chain of "next candidate at or after the exit".  Nothing here shares code
with the operators that it checks.
"""

from __future__ import annotations

SERIES = "market, symbol, timeframe"
W = f"OVER (PARTITION BY {SERIES} ORDER BY bar_idx"


def same(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("market", "symbol", "timeframe"))


def _ema(n: int, name: str) -> str:
    k = 2 / (n + 1)
    return f"CASE WHEN x.bar_idx = {n - 1} THEN x.m{n} WHEN x.bar_idx > {n - 1} THEN x.close * {k!r}::DOUBLE + state.{name} * (1 - {k!r}::DOUBLE) END"


def state_sql(bars_sql: str) -> str:
    """CTE ``state``: one row per bar with the recursive indicators."""
    k = 2 / 10
    return bars_sql.replace("WITH b AS", "WITH RECURSIVE b AS", 1) + f""",
d AS (SELECT *, lag(open) {W}) AS po, lag(close) {W}) AS pc, close - lag(close) {W}) AS d FROM bars),
x AS MATERIALIZED (SELECT *, greatest(d, 0) AS gain, greatest(-d, 0) AS loss, avg(close) {W} ROWS 11 PRECEDING) AS m12, avg(close) {W} ROWS 19 PRECEDING) AS m20, avg(close) {W} ROWS 25 PRECEDING) AS m26,
 avg(greatest(d, 0)) {W} ROWS 13 PRECEDING) AS g14, avg(greatest(-d, 0)) {W} ROWS 13 PRECEDING) AS l14 FROM d),
state AS (
 SELECT {SERIES}, bar_idx, NULL::DOUBLE AS e12, NULL::DOUBLE AS e20, NULL::DOUBLE AS e26, NULL::DOUBLE AS macd, 0::DOUBLE AS macds, NULL::DOUBLE AS line, NULL::DOUBLE AS g, NULL::DOUBLE AS l FROM x WHERE bar_idx = 0
 UNION ALL
 SELECT x.market, x.symbol, x.timeframe, x.bar_idx, {_ema(12, "e12")} AS e12_, {_ema(20, "e20")} AS e20_, {_ema(26, "e26")} AS e26_, e12_ - e26_ AS macd_,
  state.macds + CASE WHEN x.bar_idx BETWEEN 25 AND 33 THEN macd_ ELSE 0 END AS macds_,
  CASE WHEN x.bar_idx = 33 THEN macds_ / 9 WHEN x.bar_idx > 33 THEN macd_ * {k!r}::DOUBLE + state.line * (1 - {k!r}::DOUBLE) END,
  CASE WHEN x.bar_idx = 14 THEN x.g14 WHEN x.bar_idx > 14 THEN (state.g * 13 + x.gain) / 14 END, CASE WHEN x.bar_idx = 14 THEN x.l14 WHEN x.bar_idx > 14 THEN (state.l * 13 + x.loss) / 14 END
 FROM state JOIN x ON {same("state", "x")} AND x.bar_idx = state.bar_idx + 1),
rec AS MATERIALIZED (SELECT *, macd - line AS hist, CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM state)"""


LEVELS = f""",
sw AS (SELECT *, count(*) {W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5 AND count(*) {W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 AS whole,
 high > max(high) {W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AND high > max(high) {W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS top,
 low < min(low) {W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AND low < min(low) {W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS bottom FROM bars),
lv AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {SERIES}, kind ORDER BY known) AS k FROM (
 SELECT {SERIES}, 's' AS kind, CAST(printf('%.4f', low) AS DOUBLE) AS v, min(bar_idx) + 5 AS known FROM sw WHERE whole AND bottom GROUP BY ALL
 UNION ALL SELECT {SERIES}, 'r', CAST(printf('%.4f', high) AS DOUBLE), min(bar_idx) + 5 FROM sw WHERE whole AND top GROUP BY ALL)),
seen AS (SELECT b.{SERIES.replace(", ", ", b.")}, b.bar_idx, b.close, b.kind, lv.k FROM (SELECT *, unnest(['s', 'r']) AS kind FROM bars) b ASOF JOIN lv ON {same("b", "lv")} AND b.kind = lv.kind AND b.bar_idx >= lv.known),
near AS (SELECT s.{SERIES.replace(", ", ", s.")}, s.bar_idx, max(v) FILTER (s.kind = 's' AND v < close AND (close - v) / close < 0.015) AS sup, min(v) FILTER (s.kind = 'r' AND v > close AND (v - close) / close < 0.015) AS res,
 list(v ORDER BY v DESC) FILTER (s.kind = 's') AS supports, list(v ORDER BY v) FILTER (s.kind = 'r') AS resistances
 FROM seen s JOIN lv ON {same("s", "lv")} AND s.kind = lv.kind AND lv.k BETWEEN s.k - 2 AND s.k GROUP BY ALL)"""


def _place(x: str) -> str:
    """Price rounding: half up on the scaled value."""
    scale = f"CASE WHEN abs({x}) < 1 AND {x} <> 0 THEN 10.0 ** (CASE WHEN market = 'FOREX' THEN 4 ELSE 5 END - floor(log10(abs({x}))))::DOUBLE ELSE CASE WHEN market = 'FOREX' THEN 1e5 ELSE 1e4 END END"
    return f"floor({x} * ({scale}) + 0.5) / ({scale})"


def signals_sql(bars_sql: str, news: str = "NULL::DOUBLE") -> str:
    """CTE ``sig``: every bar with scores, action, levels, reasons and has_signal."""
    return state_sql(bars_sql) + LEVELS + f""",
ind AS (SELECT x.*, e12, e20, e26, rec.macd, rec.line, rec.hist, rec.rsi, sup, res, {news} AS news, lag(rec.rsi) OVER w AS rsi0, lag(rec.macd) OVER w AS macd0, lag(rec.line) OVER w AS line0, lag(rec.hist) OVER w AS hist0,
 CASE WHEN x.bar_idx >= 49 THEN avg(close) OVER (w ROWS 49 PRECEDING) END AS ma50, CASE WHEN x.bar_idx >= 199 THEN avg(close) OVER (w ROWS 199 PRECEDING) END AS ma200,
 CASE WHEN x.bar_idx >= 19 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS mid, stddev_pop(close) OVER (w ROWS 19 PRECEDING) AS dev,
 CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, abs(close - open) AS body, high - greatest(open, close) AS upper, least(open, close) - low AS lower
 FROM x JOIN rec ON {same("x", "rec")} AND x.bar_idx = rec.bar_idx LEFT JOIN near ON {same("x", "near")} AND x.bar_idx = near.bar_idx WINDOW w AS (PARTITION BY x.market, x.symbol, x.timeframe ORDER BY x.bar_idx)),
ru AS (SELECT *, avg(tr) {W} ROWS 13 PRECEDING) AS atr, CAST(CASE WHEN rsi < 30 THEN 2 WHEN rsi > 70 THEN -2 ELSE 0 END AS INTEGER) AS r_rsi_extreme,
 CAST(CASE WHEN rsi < 30 OR rsi > 70 THEN 0 WHEN rsi > 50 AND rsi0 < 50 THEN 1 WHEN rsi < 50 AND rsi0 > 50 THEN -1 ELSE 0 END AS INTEGER) AS r_rsi_cross,
 CAST(CASE WHEN macd > line AND macd0 <= line0 THEN 2 WHEN macd < line AND macd0 >= line0 THEN -2 ELSE 0 END AS INTEGER) AS r_macd,
 CAST(CASE WHEN hist > 0 AND hist0 < hist THEN 1 WHEN hist < 0 AND hist0 > hist THEN -1 ELSE 0 END AS INTEGER) AS r_hist,
 CAST(CASE WHEN close > e20 AND e20 > ma50 AND (ma200 IS NULL OR ma50 > ma200) THEN 1 WHEN close < e20 AND e20 < ma50 AND (ma200 IS NULL OR ma50 < ma200) THEN -1 ELSE 0 END * CASE WHEN ma200 IS NULL THEN 1 ELSE 2 END AS INTEGER) AS r_trend,
 CAST(CASE WHEN close < mid - 2 * dev THEN 1 WHEN close > mid + 2 * dev THEN -1 ELSE 0 END AS INTEGER) AS r_band,
 CAST(CASE WHEN news > 0.3 THEN floor(news * 2 + 0.5) WHEN news < -0.3 THEN -floor(-news * 2 + 0.5) ELSE 0 END AS INTEGER) AS r_news,
 coalesce(pc < po AND close > open AND close > po AND open < pc, false) AS bue, coalesce(pc > po AND close < open AND close < po AND open > pc, false) AS bee, lower > 2 * body AND upper < 0.5 * body AS ham, upper > 2 * body AND lower < 0.5 * body AS sho FROM ind),
sc AS (SELECT *, CAST(2 * (bue::INTEGER + ham::INTEGER) AS INTEGER) AS p_bull, CAST(2 * (bee::INTEGER + sho::INTEGER) AS INTEGER) AS p_bear FROM ru),
tot AS (SELECT *, CAST(p_bull + (sup IS NOT NULL)::INTEGER + greatest(r_rsi_extreme, 0) + greatest(r_rsi_cross, 0) + greatest(r_macd, 0) + greatest(r_hist, 0) + greatest(r_trend, 0) + greatest(r_band, 0) + greatest(r_news, 0) AS INTEGER) AS bull,
 CAST(p_bear + (res IS NOT NULL)::INTEGER + greatest(-r_rsi_extreme, 0) + greatest(-r_rsi_cross, 0) + greatest(-r_macd, 0) + greatest(-r_hist, 0) + greatest(-r_trend, 0) + greatest(-r_band, 0) + greatest(-r_news, 0) AS INTEGER) AS bear FROM sc),
act AS (SELECT *, CASE WHEN bull - bear >= 3 THEN 'BUY' WHEN bear - bull >= 3 THEN 'SELL' ELSE 'HOLD' END AS action, greatest(bull, bear) AS score, CASE WHEN bull - bear <= -3 THEN -1 ELSE 1 END AS sign, CASE WHEN atr > 0 THEN atr ELSE close * 0.02 END AS unit FROM tot),
raw AS (SELECT *, close - sign * 1.5 * unit AS far_stop, close + sign * 3.0 * unit AS far_target, CASE WHEN sign > 0 THEN sup * 0.995::DOUBLE ELSE res * 1.005::DOUBLE END AS behind, CASE WHEN sign > 0 THEN res * 0.995::DOUBLE ELSE sup * 1.005::DOUBLE END AS ahead FROM act),
lev AS (SELECT *, CASE WHEN action = 'HOLD' THEN close - unit WHEN (close - behind) * sign > 0 THEN behind ELSE far_stop END AS stop0, CASE WHEN action = 'HOLD' THEN close + unit WHEN (ahead - close) * sign > 0 THEN ahead ELSE far_target END AS target0 FROM raw),
pl AS (SELECT *, {_place("close")} AS entry_price, {_place("stop0")} AS stop1, {_place("target0")} AS target1, {_place("far_stop")} AS stop2, {_place("far_target")} AS target2 FROM lev),
ok0 AS (SELECT *, CASE WHEN action = 'HOLD' OR (entry_price - stop1) * sign > 0 THEN stop1 ELSE stop2 END AS stop3, CASE WHEN action = 'HOLD' OR (target1 - entry_price) * sign > 0 THEN target1 ELSE target2 END AS target3 FROM pl),
ok AS (SELECT *, action <> 'HOLD' AND (stop3 = entry_price OR target3 = entry_price OR stop3 <= 0 OR target3 <= 0) AS dead FROM ok0),
sig AS MATERIALIZED (SELECT *, CASE WHEN NOT dead THEN stop3 END AS stop_loss, CASE WHEN NOT dead THEN target3 END AS take_profit, CASE WHEN score >= 8 THEN 'very_strong' WHEN score >= 5 THEN 'strong' WHEN score >= 3 THEN 'moderate' ELSE 'weak' END AS strength, CAST(least(95, 40 + 6 * score) AS DOUBLE) AS confidence,
 bar_idx >= 49 AND close > 0 AND NOT dead AS has_signal,
 array_to_string(list_filter([CASE WHEN r_rsi_extreme > 0 THEN 'RSI Oversold' WHEN r_rsi_extreme < 0 THEN 'RSI Overbought' END, CASE WHEN r_rsi_cross <> 0 THEN 'RSI Cross 50' END, CASE WHEN r_macd > 0 THEN 'MACD Bullish Cross' WHEN r_macd < 0 THEN 'MACD Bearish Cross' END,
  CASE WHEN r_trend > 0 THEN 'Uptrend' WHEN r_trend < 0 THEN 'Downtrend' END, CASE WHEN r_band > 0 THEN 'BB Lower Touch' WHEN r_band < 0 THEN 'BB Upper Touch' END, CASE WHEN bue THEN 'Bullish Engulfing' END, CASE WHEN bee THEN 'Bearish Engulfing' END, CASE WHEN ham THEN 'Hammer' END,
  CASE WHEN sho THEN 'Shooting Star' END, CASE WHEN sup IS NOT NULL THEN 'At Support' END, CASE WHEN res IS NOT NULL THEN 'At Resistance' END, CASE WHEN r_news > 0 THEN 'Bullish News' WHEN r_news < 0 THEN 'Bearish News' END], lambda q: q IS NOT NULL)[1:5], ',') AS reasons,
 ts + CASE WHEN timeframe = '1H' THEN INTERVAL 48 HOURS ELSE INTERVAL 168 HOURS END AS expires_at FROM ok)"""


def gate_sql(bars_sql: str, max_stop_pct: float = 8.0) -> str:
    """CTE ``gt``: ``sig`` with rr, stop_pct, the list of rejections and accepted."""
    return signals_sql(bars_sql) + f""",
ga AS (SELECT *, CASE WHEN abs(entry_price - stop_loss) > 0 THEN abs(take_profit - entry_price) / abs(entry_price - stop_loss) END AS rr, CASE WHEN entry_price > 0 THEN abs(entry_price - stop_loss) / entry_price * 100 END AS stop_pct,
 CASE WHEN action = 'BUY' THEN stop_loss < entry_price AND take_profit > entry_price ELSE stop_loss > entry_price AND take_profit < entry_price END AND entry_price > 0 AS sided FROM sig),
gt AS (SELECT *, CASE WHEN NOT has_signal THEN ['no_signal'] WHEN action = 'HOLD' THEN ['action_hold'] WHEN NOT coalesce(sided, false) THEN ['invalid_levels'] ELSE
 list_filter([CASE WHEN strength IN ('weak', 'moderate') THEN 'below_min_strength' END, CASE WHEN confidence < 70 THEN 'below_min_confidence' END, CASE WHEN rr < 1.5 THEN 'below_min_rr' END, CASE WHEN stop_pct < 0.15 THEN 'stop_too_tight' END, CASE WHEN stop_pct > {max_stop_pct} THEN 'stop_too_wide' END], lambda q: q IS NOT NULL) END AS rejections FROM ga)"""


def walk_sql(bars_sql: str, hold: int = 10, split: str = "'all'") -> str:
    """CTE ``deals``: the walk-forward's deals, one at a time per series and ``split``, an expression on entry_ts."""
    return signals_sql(bars_sql) + f""",
cand AS MATERIALIZED (SELECT {SERIES}, bar_idx, action, sign, entry_price, stop_loss, take_profit FROM sig WHERE has_signal AND action <> 'HOLD' AND bar_idx >= 60),
pth AS (SELECT c.*, f.bar_idx AS j, f.ts AS ft, f.open AS fo, f.close AS fc, CASE WHEN sign = 1 THEN f.low ELSE f.high END AS worst, CASE WHEN sign = 1 THEN f.high ELSE f.low END AS best FROM cand c JOIN bars f ON {same("c", "f")} AND f.bar_idx BETWEEN c.bar_idx + 1 AND c.bar_idx + {hold}),
ht AS (SELECT *, CASE WHEN sign * (fo - stop_loss) <= 0 THEN 'gap_stop' WHEN sign * (fo - take_profit) >= 0 THEN 'gap_target' WHEN sign * (worst - stop_loss) <= 0 THEN 'stop_loss' WHEN sign * (best - take_profit) >= 0 THEN 'take_profit' END AS hit FROM pth),
ex0 AS (SELECT {SERIES}, bar_idx, action, sign, entry_price, stop_loss, coalesce(arg_min(hit, j) FILTER (hit IS NOT NULL), 'time_exit') AS reason, coalesce(min(j) FILTER (hit IS NOT NULL), max(j)) AS exit_idx, arg_min(fo, j) AS entry, arg_min(ft, j) AS entry_ts,
 coalesce(arg_min(CASE WHEN hit LIKE 'gap%' THEN fo WHEN hit = 'stop_loss' THEN stop_loss ELSE take_profit END, j) FILTER (hit IS NOT NULL), arg_max(fc, j)) AS exit FROM ht GROUP BY ALL),
ex AS MATERIALIZED (SELECT *, {split} AS split FROM ex0 WHERE {split} IS NOT NULL),
nx AS MATERIALIZED (SELECT a.{SERIES.replace(", ", ", a.")}, a.split, a.bar_idx, b.bar_idx AS next_idx FROM ex a ASOF LEFT JOIN (SELECT {SERIES}, split, bar_idx FROM ex) b ON {same("a", "b")} AND a.split = b.split AND a.exit_idx <= b.bar_idx),
chain AS (SELECT {SERIES}, split, min(bar_idx) AS bar_idx FROM ex GROUP BY ALL UNION ALL SELECT nx.market, nx.symbol, nx.timeframe, nx.split, nx.next_idx FROM chain JOIN nx ON {same("chain", "nx")} AND nx.split = chain.split AND nx.bar_idx = chain.bar_idx WHERE nx.next_idx IS NOT NULL),
deals AS (SELECT ex.*, abs(entry_price - stop_loss) AS planned_risk, abs(entry - stop_loss) AS realized_risk, (exit - entry) * sign AS gain FROM ex JOIN chain ON {same("ex", "chain")} AND ex.split = chain.split AND ex.bar_idx = chain.bar_idx)"""


def sweep_sql(bars_sql: str, arms: list[tuple]) -> str:
    """CTE ``swept``: the deals of every arm.  ``arms``: (name, nine weights, buy_at, sell_at, stop_atr, target_atr, at_levels, hold)."""
    rows = ", ".join(f"('{name}', {list(w)}, {buy}, {sell}, {stop!r}::DOUBLE, {target!r}::DOUBLE, {str(levels).lower()}, {hold})" for name, w, buy, sell, stop, target, levels, hold in arms)
    scores = "[r_rsi_extreme, r_rsi_cross, r_macd, r_hist, r_trend, r_band, r_news, p_bull - p_bear, (sup IS NOT NULL)::INTEGER - (res IS NOT NULL)::INTEGER]"
    near = f"a.arm = b.arm AND {same('a', 'b')}"
    return signals_sql(bars_sql) + f""",
arms(arm, weights, buy_at, sell_at, stop_atr, target_atr, at_levels, hold) AS (VALUES {rows}),
av0 AS (SELECT tot.*, arms.*, list_dot_product(CAST({scores} AS DOUBLE[]), CAST(weights AS DOUBLE[])) AS net, CASE WHEN r_trend > 0 THEN 'uptrend' WHEN r_trend < 0 THEN 'downtrend' ELSE 'sideways' END AS trend, CASE WHEN atr > 0 THEN atr ELSE close * 0.02 END AS unit FROM tot, arms WHERE bar_idx >= 60 AND close > 0),
av1 AS (SELECT *, CASE WHEN net >= buy_at THEN 1 WHEN net <= sell_at THEN -1 END AS sign FROM av0),
av2 AS (SELECT *, close - sign * stop_atr * unit AS far_stop, close + sign * target_atr * unit AS far_target, CASE WHEN at_levels THEN CASE WHEN sign > 0 THEN sup * 0.995::DOUBLE ELSE res * 1.005::DOUBLE END END AS behind, CASE WHEN at_levels THEN CASE WHEN sign > 0 THEN res * 0.995::DOUBLE ELSE sup * 1.005::DOUBLE END END AS ahead FROM av1 WHERE sign IS NOT NULL),
av3 AS (SELECT *, CASE WHEN (close - behind) * sign > 0 THEN behind ELSE far_stop END AS stop0, CASE WHEN (ahead - close) * sign > 0 THEN ahead ELSE far_target END AS target0 FROM av2),
av4 AS (SELECT *, {_place("close")} AS entry_price, {_place("stop0")} AS stop1, {_place("target0")} AS target1, {_place("far_stop")} AS stop2, {_place("far_target")} AS target2 FROM av3),
av5 AS (SELECT *, CASE WHEN (entry_price - stop1) * sign > 0 THEN stop1 ELSE stop2 END AS stop_loss, CASE WHEN (target1 - entry_price) * sign > 0 THEN target1 ELSE target2 END AS take_profit FROM av4),
av AS MATERIALIZED (SELECT arm, {SERIES}, bar_idx, ts, sign, trend, hold, entry_price, stop_loss, take_profit FROM av5 WHERE stop_loss <> entry_price AND take_profit <> entry_price AND stop_loss > 0 AND take_profit > 0),
ap AS (SELECT c.*, f.bar_idx AS j, f.open AS fo, f.close AS fc, CASE WHEN sign = 1 THEN f.low ELSE f.high END AS worst, CASE WHEN sign = 1 THEN f.high ELSE f.low END AS best FROM av c JOIN bars f ON {same("c", "f")} AND f.bar_idx > c.bar_idx AND f.bar_idx <= c.bar_idx + c.hold),
ah AS (SELECT *, CASE WHEN sign * (fo - stop_loss) <= 0 THEN fo WHEN sign * (fo - take_profit) >= 0 THEN fo WHEN sign * (worst - stop_loss) <= 0 THEN stop_loss WHEN sign * (best - take_profit) >= 0 THEN take_profit END AS hit FROM ap),
ae AS MATERIALIZED (SELECT arm, {SERIES}, bar_idx, ts, sign, trend, entry_price, stop_loss, coalesce(min(j) FILTER (hit IS NOT NULL), max(j)) AS exit_idx, arg_min(fo, j) AS entry, coalesce(arg_min(hit, j) FILTER (hit IS NOT NULL), arg_max(fc, j)) AS exit FROM ah GROUP BY ALL),
an AS MATERIALIZED (SELECT a.arm, a.{SERIES.replace(", ", ", a.")}, a.bar_idx, b.bar_idx AS next_idx FROM ae a ASOF LEFT JOIN (SELECT arm, {SERIES}, bar_idx FROM ae) b ON {near} AND a.exit_idx <= b.bar_idx),
ac AS (SELECT arm, {SERIES}, min(bar_idx) AS bar_idx FROM ae GROUP BY ALL UNION ALL SELECT b.arm, b.{SERIES.replace(", ", ", b.")}, b.next_idx FROM ac a JOIN an b ON {near} AND a.bar_idx = b.bar_idx WHERE b.next_idx IS NOT NULL),
swept AS MATERIALIZED (SELECT a.*, (exit - entry) * sign / abs(entry_price - stop_loss) AS r FROM ae a JOIN ac b ON {near} AND a.bar_idx = b.bar_idx)"""
