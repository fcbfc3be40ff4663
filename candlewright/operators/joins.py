"""Joins: as-of, grid, fallback lookups, interval overlap, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str]) -> DataFrame:
    """Each left row with the latest right row at or before it.

    One union and one window: each side is shuffled once, no pair is made.  Right rows of a time sort
    before left rows of the same time."""
    tag = F.struct(*[F.col(c) for c in [on, *take]])
    both = left.withColumn("_r", F.lit(None).cast(right.select(tag).schema[0].dataType)).withColumn("_side", F.lit(1))
    add = right.select(*[F.col(c) if c in [*by, on] else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], tag.alias("_r"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.unionByName(add).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, F.col("_last")[on].alias(f"r_{on}"), *[F.col("_last")[c].alias(f"r_{c}") for c in take])


def on_grid(bars: DataFrame) -> DataFrame:
    """Bars on the union of all series' times of a timeframe: missing bars are rows with a null close.

    Times and series are distinct lists; their product is the grid itself, which is the result."""
    times = bars.select("timeframe", "ts").distinct()
    names = bars.select("market", "symbol", "timeframe").distinct()
    return names.join(times, "timeframe").join(bars, ["market", "symbol", "timeframe", "ts"], "left")


def fallback(left: DataFrame, lookups: list[tuple[DataFrame, list[str]]], value: str, strict: bool = False) -> DataFrame:
    """Value from the first lookup that has the key; lookups are (table, keys), most specific first.  A
    ``strict`` lookup fails on a row that none of them has."""
    names = []
    for i, (table, keys) in enumerate(lookups):
        names.append(f"_{value}{i}")
        left = left.join(table.select(*keys, F.col(value).alias(names[-1])), keys, "left")
    level = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(i)) for i, n in enumerate(names)])
    values = [F.col(n) for n in names]
    if strict:
        values.append(F.raise_error(F.lit(f"no {value} for a row")).cast(lookups[0][0].schema[value].dataType))
    return left.withColumn(value, F.coalesce(*values)).withColumn("level", level).drop(*names)


def overlapping(a: DataFrame, b: DataFrame, by: list[str], begin: str, end: str, bucket: int = 50) -> DataFrame:
    """Rows of a whose interval touches some interval of b in the same group, once each.

    Intervals are dealt to the buckets that they touch, so the join is by equality on the bucket."""
    cells = lambda t: F.sequence(F.floor(F.col(begin) / bucket), F.floor(F.col(end) / bucket))
    left = a.withColumn("_cell", F.explode(cells(a)))
    right = b.select(*by, F.col(begin).alias("_b"), F.col(end).alias("_e"), F.explode(cells(b)).alias("_cell"))
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*by, "_cell"]] + [F.col("r._b") <= F.col(f"l.{end}"), F.col("r._e") >= F.col(f"l.{begin}")]
    near = left.alias("l").join(right.alias("r"), same, "left_semi")
    return near.drop("_cell").distinct()


def fresh(candidates: DataFrame, recent: DataFrame, keys: list[str], at: str, hours: dict[str, int]) -> DataFrame:
    """Candidates without a recent active row of the same key inside their timeframe's window."""
    window = F.create_map(*[F.lit(x) for pair in hours.items() for x in pair])[F.col("c.timeframe")]
    same = [F.col(f"c.{k}") == F.col(f"r.{k}") for k in keys]
    seen = (F.col(f"r.{at}") <= F.col(f"c.{at}")) & (F.unix_seconds(F.col(f"c.{at}").cast("timestamp")) - F.unix_seconds(F.col(f"r.{at}").cast("timestamp")) < window * 3600)
    return candidates.alias("c").join(recent.alias("r"), [*same, seen], "left_anti")


def to_all(left: DataFrame, right: DataFrame, spread: int = 64) -> DataFrame:
    """Each left row with every right row, where that is the result itself (signals for those who follow
    everything): the right rows are copied to ``spread`` keys and the left ones dealt to them."""
    keys = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_k")
    dealt = left.withColumn("_k", F.pmod(F.xxhash64(*left.columns), F.lit(spread)).cast("int"))
    return dealt.join(right.select("*", keys), "_k").drop("_k")


def asof_bucketed(left: DataFrame, right: DataFrame, on: str, take: list[str], by: list[str] | None = None, width: str = "day") -> DataFrame:
    """As-of backward join without or with few keys, dealt out by time.

    Both sides are cut into time buckets and each bucket is one window of its own.  The last right row of
    earlier buckets, one row per bucket, is carried in by a running last over buckets."""
    by = by or []
    bucket = F.date_trunc(width, on).alias("_bucket")
    left, right = left.select("*", bucket), right.select("*", bucket)
    tag = lambda c: F.struct(*[F.col(x) for x in [on, *take]]).alias(c)
    ends = right.groupBy(*by, "_bucket").agg(F.max_by(tag("t"), on).alias("_end"))
    buckets = left.select(*by, "_bucket").distinct().join(ends, [*by, "_bucket"], "full_outer")
    run = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*by, "_bucket", F.last("_end", ignorenulls=True).over(run).alias("_carried"))
    out = asof_backward(left, right, [*by, "_bucket"], on, take).join(carried, [*by, "_bucket"])
    found = [F.coalesce(f"r_{c}", F.col("_carried")[c]).alias(f"r_{c}") for c in [on, *take]]
    return out.select(*[c for c in left.columns if c != "_bucket"], *found)
