"""Streams replayed over stored rows give what the batch rules say."""

import pandas as pd
from pyspark.sql import functions as F

from candlewright.streaming import jobs


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, pdf, schema, path):
    spark.createDataFrame(pdf, schema).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_bars(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq")).write.parquet(f"{tmp_path}/in")
    schema = "symbol string, ts timestamp, price double, size double, seq long"
    out = run(spark, jobs.stream_bars(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), "bars_out")
    ticks = spark.read.parquet(f"{tmp_path}/in")
    closed = ticks.groupBy("symbol", F.window("ts", "1 hour").start.alias("ts")).agg(F.sum("size").alias("volume"))
    assert out.join(closed, ["symbol", "ts", "volume"], "left_anti").count() == 0 and out.count() > 100


def test_dedupe_and_throttle(spark, tmp_path):
    at = pd.Timestamp("2026-01-01")
    rows = pd.DataFrame([(1, "A", "BUY", "1H", s, at + pd.Timedelta(hours=h)) for h, s in ((0, "active"), (3, "active"), (3.5, "expired"), (4, "active"), (7, "active"), (8, "active"))], columns=["user_id", "symbol", "action", "timeframe", "status", "ts"])
    schema = "user_id long, symbol string, action string, timeframe string, status string, ts timestamp"
    out = run(spark, jobs.first_active(stream(spark, rows, schema, f"{tmp_path}/d")), "dedupe_out")
    assert sorted(r["ts"].hour for r in out.collect()) == [0, 4, 8]
    rows = pd.DataFrame([(1, i, at + pd.Timedelta(seconds=s)) for i, s in enumerate((0, 100, 180, 300, 360))], columns=["user_id", "id", "ts"])
    out = run(spark, jobs.throttled(stream(spark, rows, "user_id long, id long, ts timestamp", f"{tmp_path}/t")), "throttle_out")
    assert sorted(r["id"] for r in out.collect()) == [0, 2, 4]


def test_outbox_sends_once(spark, tmp_path):
    sent = []
    sink = jobs.outbox(lambda b: sent.append(b.count()), f"file://{tmp_path}/marks")
    batch = spark.range(3)
    sink(batch, 1)
    sink(batch, 1)
    sink(batch, 2)
    assert sent == [3, 3]
