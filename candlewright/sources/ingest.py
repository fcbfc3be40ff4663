"""Ingest of fetched series: granularity, unfinished bars, split events, cleaning; rejected series with a reason.

Everything is decided per series by grouped counts and windows over its bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.prices import finite, usable
from candlewright.sources.bars import SERIES, series

#: Seconds of a bar.
STEP_SECONDS = {"1H": 3600, "1D": 86400}
PRICES = ["open", "high", "low", "close"]


def step_seconds() -> Column:
    return F.create_map(*[F.lit(x) for pair in STEP_SECONDS.items() for x in pair])[F.col("timeframe")]


def unfinished(fetched_at: Column) -> Column:
    """Whether a bar was not over when it was fetched."""
    return F.col("ts") + F.make_interval(secs=step_seconds()) > fetched_at


def verdicts(raw: DataFrame, fetched_at: Column, least: int = 1) -> DataFrame:
    """One row per fetched series: its counts, the step that most of its bars have, and why it is rejected (null: accepted).

    ``granularity``: the source gave other bars than were asked for; ``no_bars``: under ``least`` are left after cleaning."""
    present = F.lit(True)
    for c in PRICES:
        present = present & F.coalesce(finite(F.col(c)) > 0, F.lit(False))
    late = unfinished(fetched_at)
    gaps = raw.withColumn("step", F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(series()).cast("timestamp")))
    steps = gaps.where("step > 0").groupBy(*SERIES, "step").agg(F.count(F.lit(1)).alias("c")).groupBy(*SERIES).agg(F.max_by("step", F.struct("c", -F.col("step"))).alias("modal_step"))
    counts = raw.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("raw_bars"), F.count_if(late).alias("unfinished"), F.count_if(~late & ~present).alias("null_or_nan"), F.count_if(~late & present & (F.col("high") < F.col("low"))).alias("inverted"), F.count_if(~late & usable()).alias("bars"))
    reason = F.when(F.col("modal_step") != step_seconds(), "granularity").when(F.col("bars") < least, "no_bars")
    return counts.join(steps, SERIES, "left").withColumn("reason", reason)


def cleaned(raw: DataFrame, verdict: DataFrame, fetched_at: Column) -> DataFrame:
    """The finished, usable bars of accepted series; a volume that is missing or no number is 0."""
    accepted = verdict.where("reason IS NULL").select(*SERIES)
    bars = raw.where(usable() & ~unfinished(fetched_at)).join(accepted, SERIES, "left_semi")
    return bars.withColumn("volume", F.coalesce(finite(F.col("volume")), F.lit(0.0)))


def split_adjusted(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Prices divided by the ratios of all later splits, volume multiplied; adds split_factor.

    ``splits``: series, ts, ratio (2 for two new for one old); several of one time multiply, ratios that are not positive
    count as none.  A split's own bar already has the new price.  Events are few: each gets the product of the ratios
    from it to the end.  Events and bars are then put in order, backwards in time, and a bar takes over the product
    of the event next to it, so nothing is joined by ranges."""
    product = lambda x: F.aggregate(x, F.lit(1.0), lambda a, r: a * r)
    events = splits.where("ratio > 0").groupBy(*SERIES, "ts").agg(product(F.sort_array(F.collect_list(F.col("ratio").cast("double")))).alias("own"))
    back = Window.partitionBy(*SERIES).orderBy(F.desc("ts"))
    events = events.select(*SERIES, "ts", product(F.collect_list("own").over(back.rowsBetween(Window.unboundedPreceding, 0))).alias("split_factor"), F.lit(False).alias("_bar"))
    both = bars.withColumn("_bar", F.lit(True)).unionByName(events, allowMissingColumns=True)
    before = Window.partitionBy(*SERIES).orderBy(F.desc("ts"), F.desc("_bar")).rowsBetween(Window.unboundedPreceding, -1)  # a bar comes before an event of its own time
    placed = both.withColumn("split_factor", F.coalesce(F.last("split_factor", ignorenulls=True).over(before), F.lit(1.0))).where("_bar")
    return placed.withColumns({c: F.col(c) / F.col("split_factor") for c in PRICES} | {"volume": F.col("volume") * F.col("split_factor")}).select(*bars.columns, "split_factor")
