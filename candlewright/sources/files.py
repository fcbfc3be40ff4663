"""Readers and writers: candle JSON, deal CSV, universe, append, upsert, conditional update, delete, reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANDLE_FILE = "symbol string, market string, timeframe string, quality struct<usable: struct<`from`: string>>, candles array<struct<timestamp: string, open: double, high: double, low: double, close: double, volume: double>>"
DEALS = "market string, symbol string, timeframe string, action string, entry_idx int, exit_idx int, entry double, exit double, stop_loss double, take_profit double, r double, reason string, entry_ts timestamp, exit_ts timestamp"


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """One row per bar of JSON series files, from each file's usable start on."""
    files = spark.read.schema(CANDLE_FILE).option("multiLine", True).json(path)
    rows = files.select("market", "symbol", "timeframe", F.col("quality.usable.from").alias("usable"), F.explode("candles").alias("c"))
    rows = rows.select("market", "symbol", "timeframe", "usable", F.to_timestamp_ntz("c.timestamp").alias("ts"), "c.open", "c.high", "c.low", "c.close", "c.volume")
    return rows.where(F.col("usable").isNull() | (F.col("ts") >= F.to_timestamp_ntz("usable"))).drop("usable")


def read_metadata(spark: SparkSession, path: str, markets: list[str] | None = None, timeframes: list[str] | None = None, symbols: list[str] | None = None) -> DataFrame:
    """One row per series file, without its bars: the bars' column is pruned from the scan."""
    files = spark.read.schema("symbol string, market string, timeframe string, quality struct<usable: struct<`from`: string>, verdict: string>").option("multiLine", True).json(path)
    out = files.select("market", "symbol", "timeframe", F.col("quality.usable.from").alias("usable_from"), F.col("quality.verdict").alias("verdict"))
    for column, wanted in (("market", markets), ("timeframe", timeframes), ("symbol", symbols)):
        if wanted is not None:
            out = out.where(F.col(column).isin(*wanted))
    return out


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """(market, symbol, name) of a universe file: a JSON object with a list of symbols per market."""
    rows = spark.read.schema("markets map<string, array<struct<symbol: string, name: string>>>").option("multiLine", True).json(path)
    return rows.select(F.explode("markets").alias("market", "names")).select("market", F.explode("names").alias("s")).select("market", "s.symbol", "s.name")


def train_only(bars: DataFrame, until: str) -> DataFrame:
    """The bars before a time; later ones never leave the scan."""
    return bars.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))


def read_deals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEALS).option("header", True).csv(path)


def write_deals(deals: DataFrame, path: str) -> None:
    deals.write.mode("overwrite").option("header", True).csv(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_report(summary: DataFrame, path: str, title: str) -> None:
    """A table as JSON lines and as a Markdown page below ``path``, with all its rows.  The page is one file, written
    row by row by one task; nothing of it passes through the driver."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ")
    head = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + "---|" * len(summary.columns)]
    summary.write.mode("overwrite").json(f"{path}/data")
    first = summary.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1)
    body = summary.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, summary.columns)), F.lit(" |")).alias("value"))
    first.union(body).coalesce(1).write.mode("overwrite").text(f"{path}/page")


def write_ledger(result: DataFrame, config: dict, path: str) -> str:
    """What a result came from: the hash of its configuration and the files it reads; returns the hash."""
    text = json.dumps(config, sort_keys=True, default=str)
    digest = hashlib.sha256(text.encode()).hexdigest()
    rows = [(digest, text, f) for f in sorted(result.inputFiles())] or [(digest, text, None)]
    result.sparkSession.createDataFrame(rows, "config_hash string, config string, input string").coalesce(1).write.mode("overwrite").json(path)
    return digest


def slim(scorecard: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that a client may see."""
    return scorecard.select(*[c for c in scorecard.columns if c in columns])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The table after an upsert: new rows win; among new rows of a key the first in ``order``."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), *(order or []))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.join(table, keys, "left_anti"))


def update_where(table: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Compare-and-set: rows that meet the condition get the changes."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def affected(table: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """The rows that ``update_where`` changes, as they are afterwards."""
    return table.where(F.coalesce(condition, F.lit(False))).withColumns(changes)


def delete_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")
