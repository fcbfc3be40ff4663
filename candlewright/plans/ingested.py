"""Named queries of ingest, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewright.plans.queries import DAILY_SQL, KEY, KEYS, OHLCV, r6, register
from candlewright.sources import ingest
from candlewright.sources.bars import SERIES, daily_bars

FETCHED = "1998-11-01 12:00:00"


def fetched(spark, sf_dir):
    """Daily bars as a source might give them: missing closes, high and low exchanged, bars under another timeframe's name."""
    i, b = F.col("bar_idx"), daily_bars(spark, sf_dir)
    swapped = i % 89 == 7
    return b.select("market", "symbol", F.when(F.col("symbol") == "S7", "1H").otherwise(F.col("timeframe")).alias("timeframe"), "ts", "open", F.when(swapped, F.col("low")).otherwise(F.col("high")).alias("high"), F.when(swapped, F.col("high") + 1).otherwise(F.col("low")).alias("low"), F.when(i % 97 != 5, F.col("close")).alias("close"), "volume")


@register(DAILY_SQL + f""", f AS (SELECT market, symbol, CASE WHEN symbol = 'S7' THEN '1H' ELSE timeframe END AS timeframe, ts, open, CASE WHEN bar_idx % 89 = 7 THEN low ELSE high END AS high, CASE WHEN bar_idx % 89 = 7 THEN high + 1 ELSE low END AS low, CASE WHEN bar_idx % 97 <> 5 THEN close END AS close FROM bars),
g AS (SELECT *, CASE WHEN timeframe = '1H' THEN 3600 ELSE 86400 END AS want, ts + CASE WHEN timeframe = '1H' THEN INTERVAL 1 HOUR ELSE INTERVAL 1 DAY END > TIMESTAMP '{FETCHED}' AS late, coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0, false) AS present, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY market, symbol, timeframe ORDER BY ts) AS step FROM f),
m AS (SELECT market, symbol, timeframe, step FROM (SELECT market, symbol, timeframe, step, count(*) AS c FROM g WHERE step > 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY market, symbol, timeframe ORDER BY c DESC, step) = 1),
k AS (SELECT market, symbol, timeframe, max(want) AS want, count(*) AS raw_bars, count(*) FILTER (late) AS unfinished, count(*) FILTER (NOT late AND NOT present) AS null_or_nan, count(*) FILTER (NOT late AND present AND high < low) AS inverted, count(*) FILTER (NOT late AND present AND high >= low) AS bars FROM g GROUP BY ALL)
SELECT k.market, k.symbol, k.timeframe, raw_bars, unfinished, null_or_nan, inverted, bars, CAST(m.step AS BIGINT) AS modal_step, CASE WHEN m.step <> want THEN 'granularity' WHEN bars < 1 THEN 'no_bars' END AS reason FROM k LEFT JOIN m ON m.market = k.market AND m.symbol = k.symbol AND m.timeframe = k.timeframe""")
def ingest_verdicts(spark, sf_dir):
    """What is wrong with each fetched series, and which are rejected."""
    v = ingest.verdicts(fetched(spark, sf_dir), F.lit(FETCHED).cast("timestamp_ntz"))
    return v.select(*SERIES, "raw_bars", "unfinished", "null_or_nan", "inverted", "bars", "modal_step", "reason")


@register(DAILY_SQL + """, e AS (SELECT market, symbol, timeframe, ts, CASE WHEN bar_idx % 1400 = 350 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS ratio FROM bars WHERE bar_idx % 700 = 350 AND market IN ('US_STOCK', 'TH_STOCK')),
f AS (SELECT b.market, b.symbol, b.timeframe, b.ts, product(e.ratio) AS f FROM bars b JOIN e ON e.market = b.market AND e.symbol = b.symbol AND e.timeframe = b.timeframe AND e.ts > b.ts GROUP BY ALL)
SELECT """ + KEYS.replace("market", "b.market").replace(", symbol", ", b.symbol").replace(", timeframe", ", b.timeframe").replace(", ts", ", b.ts") + """, coalesce(f, 1) AS split_factor, round(open / coalesce(f, 1), 9) AS open, round(high / coalesce(f, 1), 9) AS high, round(low / coalesce(f, 1), 9) AS low, round(close / coalesce(f, 1), 9) AS close, round(volume * coalesce(f, 1), 9) AS volume FROM bars b LEFT JOIN f ON f.market = b.market AND f.symbol = b.symbol AND f.timeframe = b.timeframe AND f.ts = b.ts""")
def split_adjusted(spark, sf_dir):
    """Daily bars with the splits that the stock markets' series are given at some bars taken back."""
    b, i = daily_bars(spark, sf_dir), F.col("bar_idx")
    splits = b.where((i % 700 == 350) & F.col("market").isin("US_STOCK", "TH_STOCK")).select(*KEY, F.when(i % 1400 == 350, 2.0).otherwise(3.0).alias("ratio"))
    return ingest.split_adjusted(b, splits).select(*KEY, "split_factor", *r6(*OHLCV))
