"""Bar views: one row per (market, symbol, timeframe, ts) with open, high, low, close, volume.

A series is a partition key, never a Python object: every window of the library partitions by
``SERIES``, so one exchange serves all indicators of a plan.  ``bar_idx`` counts bars of a series
from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERIES = ["market", "symbol", "timeframe"]
#: The five markets, in the order of a symbol's number modulo five.
MARKETS = ("GOLD", "FOREX", "TH_STOCK", "US_STOCK", "CRYPTO")

#: The legs of the dollar index, with 1 where the pair's rise is the dollar's and -1 where it is its fall.
DOLLAR_LEGS = {"USDJPY": 1, "USDCAD": 1, "USDCHF": 1, "USDMXN": 1, "USDZAR": 1, "USDTHB": 1, "EURUSD": -1, "GBPUSD": -1, "AUDUSD": -1, "NZDUSD": -1}
PAIRS = (*DOLLAR_LEGS, "EURJPY", "EURGBP")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(order: str = "ts"):
    """The window over one series up to the current bar's neighbours."""
    return Window.partitionBy(*SERIES).orderBy(order)


def dealt(df: DataFrame, *also: str) -> DataFrame:
    """Rows dealt out by market and symbol (and ``also``) to as many tasks as the session shuffles to, which is what windows
    over series need.  Windows cost time rather than bytes, so the number is named: adaptive execution would
    put small partitions together into one task.  The timeframe is left out, as a constant one would hide that the rows lie right."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "market", "symbol", *also)


def market_of(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MARKETS)), (F.pmod(number, F.lit(5)) + 1).cast("int"))


def aggregate_bars(ticks: DataFrame) -> DataFrame:
    """Bars from ticks with columns series key, ts (bucket), price, size and ord (a number that orders
    ticks inside a bucket).  Partial aggregates go into the shuffle, ticks do not; with a number of fixed
    width they are hashed, where a struct would have all ticks sorted first."""
    return ticks.groupBy(*SERIES, "ts").agg(F.min_by("price", "ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ord").alias("close"), F.sum("size").alias("volume"))


def ordered_by(high: Column, low: Column, room: int) -> Column:
    """Two whole numbers as one, the first counting before the second, which stays below 10**room."""
    return (high.cast("decimal(24,0)") * F.lit(10**room).cast("decimal(13,0)") + low.cast("decimal(13,0)")).cast("decimal(38,0)")


def with_bar_idx(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar_idx", (F.row_number().over(series()) - 1).cast("int"))


def _daily(spark: SparkSession, sf_dir: str, market: Column, symbol: Column) -> DataFrame:
    ticks = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select(
        market.alias("market"), symbol.alias("symbol"), F.lit("1D").alias("timeframe"),
        F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"),
        ordered_by(F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_partkey"), 12).alias("ord"))
    return with_bar_idx(aggregate_bars(ticks))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of twenty symbols from ``lineitem`` unit prices."""
    number = F.col("l_suppkey") % 20
    return _daily(spark, sf_dir, market_of(number), F.concat(F.lit("S"), number.cast("string")))


def pair_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of twelve currency pairs from ``lineitem`` unit prices: those of the dollar index and two more."""
    return _daily(spark, sf_dir, F.lit("FOREX"), F.element_at(F.array(*map(F.lit, PAIRS)), (F.pmod(F.col("l_partkey"), F.lit(12)) + 1).cast("int")))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event types from ``events`` values; volume counts events."""
    ticks = table(spark, sf_dir, "events").select(
        F.lit("CRYPTO").alias("market"), F.col("event_type").alias("symbol"), F.lit("1H").alias("timeframe"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"),
        ordered_by(F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"), 12).alias("ord"))
    return with_bar_idx(aggregate_bars(ticks))


#: The same views for the SQL oracle: a common table expression list that begins every check.
DAILY_SQL = """
WITH b AS (
  SELECT ['GOLD','FOREX','TH_STOCK','US_STOCK','CRYPTO'][l_suppkey % 20 % 5 + 1] AS market,
         concat('S', l_suppkey % 20) AS symbol, '1D' AS timeframe,
         CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts,
         arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS close,
         sum(l_quantity) AS volume
  FROM lineitem WHERE l_quantity > 0 GROUP BY ALL),
bars AS (SELECT *, CAST(row_number() OVER (PARTITION BY market, symbol, timeframe ORDER BY ts) - 1 AS INTEGER) AS bar_idx FROM b)
"""
PAIR_SQL = DAILY_SQL.replace("['GOLD','FOREX','TH_STOCK','US_STOCK','CRYPTO'][l_suppkey % 20 % 5 + 1]", "'FOREX'").replace("concat('S', l_suppkey % 20)", f"{list(PAIRS)}[l_partkey % 12 + 1]")
HOURLY_SQL = """
WITH b AS (
  SELECT 'CRYPTO' AS market, event_type AS symbol, '1H' AS timeframe,
         CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY ALL),
bars AS (
  SELECT market, symbol, timeframe, bucket AS ts, open, high, low, close, volume,
         CAST(row_number() OVER (PARTITION BY market, symbol, timeframe ORDER BY bucket) - 1 AS INTEGER) AS bar_idx FROM b)
"""
