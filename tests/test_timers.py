"""Streams with timeouts, stopped and started again."""

import datetime
import time

from candlewright.streaming import timers


def steps(spark, tmp_path, schema, make):
    """Feeds rows into a newly started stream, until so many rows have come out or for so long; then it is stopped.  (Timeouts keep a
    stream on processing time busy, so it has no end of its own.)"""
    count, got = iter(range(100)), []

    def step(rows, want, seconds=60.0):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part{next(count)}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = make(stream).writeStream.foreachBatch(lambda batch, number: got.extend(map(tuple, batch.collect()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
        until = time.time() + seconds
        while time.time() < until and len(got) < want:
            time.sleep(0.5)
        query.stop()
        return list(got)

    return step


def test_digests_wait_for_the_gap(spark, tmp_path):
    gap = 40.0
    step = steps(spark, tmp_path, "user_id long, id long", lambda s: timers.digests(s, gap))
    first = step([(1, 1), (1, 2), (2, 5)], 2)
    assert sorted(r[:4] for r in first) == [(1, 2, 1, 2), (2, 1, 5, 5)]
    soon = step([(1, 3), (1, 3), (1, 4), (3, 9)], 3)  # the stream was started again; what is too soon waits
    assert sorted(r[:4] for r in soon) == [(1, 2, 1, 2), (2, 1, 5, 5), (3, 1, 9, 9)]
    last = step([(4, 7)], 5)  # another user's row wakes the stream; the timeout sends what waits, without a row of its own
    assert sorted(r[:4] for r in last) == [(1, 2, 1, 2), (1, 2, 3, 4), (2, 1, 5, 5), (3, 1, 9, 9), (4, 1, 7, 7)]
    times = sorted(r[4] for r in last if r[0] == 1)
    assert times[1] - times[0] >= gap * 1000


def test_closed_positions_leave_the_state(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1, 10)
    schema = "position_id long, direction string, entry_price double, stop_loss double, take_profit double, low double, high double, ts timestamp"
    quote = lambda i, low, high: (i, "long", 10.0, 9.0, 12.0, low, high, at)
    step = steps(spark, tmp_path, schema, lambda s: timers.closes(s, 30 / 86_400))
    out = step([quote(1, 8.0, 13.0), quote(2, 9.5, 10.5), (3, "short", 10.0, 9.0, 8.0, 7.0, 9.5, at)], 2)
    assert sorted(r[:3] for r in out) == [(1, "stop_loss", 9.0), (3, "take_profit", 8.0)]
    known = time.time()
    out = step([quote(2, 9.5, 12.5), quote(1, 8.0, 13.0)], 3)  # closed positions are known as such
    assert sorted(r[:3] for r in out) == [(1, "stop_loss", 9.0), (2, "take_profit", 12.0), (3, "take_profit", 8.0)]
    step([quote(9, 9.5, 10.5)], 99, max(5.0, known + 35 - time.time()))  # the timeout clears the state
    assert len(step([quote(1, 8.0, 13.0)], 4)) == 4
