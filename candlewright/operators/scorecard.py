"""The speed scorecard: how soon deals end, built from deals, kept as a versioned nested artefact, read by its rules.

One row per timeframe holds what was measured: pairs, markets and the whole timeframe, the same of deals that pass the gate, the
pairs' shares in order (against which a score is a percentile), the least number of deals that is trusted, and the
policy: whether a pair's own figures may be used for speed or for profit, and whether the timeframe can answer the
question at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POLICY = "timeframe string, pair_speed boolean, pair_profit boolean, measurable boolean"
HITS, STOPS = ("take_profit", "gap_target"), ("stop_loss", "gap_stop")
_STATS = "n:bigint,p1:double,s1:double,p2:double,s2:double,e2:double,e6:double"
CARD = (
    f"version string, timeframe string, measured_at timestamp_ntz, least bigint, pairs array<struct<market:string,symbol:string,{_STATS}>>, markets array<struct<market:string,{_STATS}>>, pooled struct<{_STATS}>, "
    f"gated_markets array<struct<market:string,{_STATS}>>, gated struct<{_STATS}>, reference array<double>, pair_speed boolean, pair_profit boolean, measurable boolean"
)


def stats() -> Column:
    """Deals, shares ended by target and by stop within 1 and 2 bars, result within 2 and 6."""
    share = lambda reasons, k: F.avg(F.when(F.col("reason").isin(*reasons) & (F.col("held") <= k), 1.0).otherwise(0.0))
    result = lambda k: F.avg(F.when(F.col("held") <= k, F.col("r")).otherwise(0.0))
    parts = {"n": F.count(F.lit(1)), "p1": share(HITS, 1), "s1": share(STOPS, 1), "p2": share(HITS, 2), "s2": share(STOPS, 2), "e2": result(2), "e6": result(6)}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def build(deals: DataFrame, policy: DataFrame, least: int, version: str) -> DataFrame:
    """The artefact of ``deals`` (series, reason, held, r, exit_ts, gated), one row per timeframe of a deal or of the policy (CARD).
    Timeframes without a policy may use no pair and count as not measurable; those without deals keep their policy, and the rest is null."""
    sets = lambda df: df.groupingSets([["timeframe", "market", "symbol"], ["timeframe", "market"], ["timeframe"]], "timeframe", "market", "symbol").agg(stats().alias("s"), F.max("exit_ts").alias("until"), F.grouping_id().alias("level"))
    own = lambda level, *names: F.sort_array(F.collect_list(F.when(F.col("level") == level, F.struct(*names, "s.*"))))  # noqa: E731  one entry per symbol or market
    whole = lambda: F.max(F.when(F.col("level") == 3, F.col("s")))
    every = sets(deals).groupBy("timeframe").agg(F.max("until").cast("timestamp_ntz").alias("measured_at"), own(0, "market", "symbol").alias("pairs"), own(1, "market").alias("markets"), whole().alias("pooled"))
    passed = sets(deals.where("gated")).groupBy("timeframe").agg(own(1, "market").alias("gated_markets"), whole().alias("gated"))
    card = every.join(passed, "timeframe", "left").join(policy, "timeframe", "full")
    card = card.withColumns({"version": F.lit(version), "least": F.lit(least).cast("long"), "reference": F.sort_array(F.transform("pairs", lambda p: F.round(p["p2"], 12)))})
    return card.fillna(False, ["pair_speed", "pair_profit", "measurable"]).select(*[f.split()[0] for f in CARD.split(", ")])


def write(card: DataFrame, path: str) -> None:
    """Adds a version; earlier ones stay."""
    card.write.mode("append").partitionBy("version").json(path)


def read(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """A version of the artefact, or the one measured last."""
    cards = spark.read.schema(CARD).json(path)
    if version is None:
        last = cards.agg(F.max_by("version", "measured_at").alias("version"))  # one row
        return cards.join(F.broadcast(last), "version")
    return cards.where(F.col("version") == version)


def speed(signals: DataFrame, card: DataFrame) -> DataFrame:
    """Score of each signal (symbol, market, timeframe): basis, sample_size, score 0 to 100, p_target2, result2, gated_n, gated_result2,
    may_rank_by_profit, warnings."""
    pairs = card.select("timeframe", F.inline("pairs")).select("timeframe", "market", "symbol", F.struct("n", "p2", "e2").alias("pair"))
    markets = card.select("timeframe", F.inline("markets")).select("timeframe", "market", F.struct("n", "p2", "e2").alias("by_market"))
    gated = card.select("timeframe", F.inline("gated_markets")).select("timeframe", "market", F.struct("n", "p1", "s1", "e2").alias("gated_market"))
    head = card.select("timeframe", "least", "pooled", F.col("gated").alias("gated_all"), "reference", "pair_speed", "pair_profit", "measurable")
    df = signals.join(pairs, ["timeframe", "market", "symbol"], "left").join(markets, ["timeframe", "market"], "left").join(gated, ["timeframe", "market"], "left").join(head, "timeframe", "left")
    df = df.fillna(False, ["pair_speed", "pair_profit", "measurable"])
    known, enough = F.col("pair").isNotNull(), F.col("pair.n") >= F.col("least")
    narrow = lambda c: F.struct(F.col(f"{c}.n").alias("n"), F.col(f"{c}.p2").alias("p2"), F.col(f"{c}.e2").alias("e2"))
    basis = F.when(known & enough & F.col("pair_speed"), "pair").when(F.col("by_market").isNotNull(), "market").when(F.col("pooled").isNotNull(), "timeframe").otherwise("none")
    df = df.withColumn("basis", basis)
    df = df.withColumn("source", F.when(F.col("basis") == "pair", narrow("pair")).when(F.col("basis") == "market", narrow("by_market")).when(F.col("basis") == "timeframe", narrow("pooled")))
    met = F.coalesce(F.when(F.col("gated_market").isNotNull(), F.col("gated_market")), F.when(F.col("gated_all").isNotNull(), F.struct(F.col("gated_all.n").alias("n"), F.col("gated_all.p1").alias("p1"), F.col("gated_all.s1").alias("s1"), F.col("gated_all.e2").alias("e2"))))
    df = df.withColumn("met", met)
    below = F.size(F.filter("reference", lambda v: v < F.round(F.col("source.p2"), 12)))
    score = F.when(F.col("source.p2").isNull() | F.coalesce(F.size("reference") <= 0, F.lit(True)), 50).otherwise(F.floor(below / F.size("reference") * 100 + 0.5))
    fallen = F.when(F.col("basis") != "pair", F.when(known & ~enough, "few_deals").when(~F.col("pair_speed"), "pairs_not_proven").when(~known, "unknown_pair"))
    rarely = F.when(F.col("measurable") & F.col("met.p1").isNotNull() & F.col("met.s1").isNotNull(), "rarely_within_one")
    told = F.array_compact(F.array(F.when(~F.col("measurable"), "not_measurable"), fallen, rarely, F.when(F.col("met.e2") < 0, "fast_is_not_profit"), F.when(F.col("source.p2").isNull(), "no_data")))
    return df.select(*signals.columns, F.when(F.col("source.p2").isNull(), "none").otherwise(F.col("basis")).alias("basis"), F.when(F.col("source.p2").isNull(), 0).otherwise(F.col("source.n")).cast("long").alias("sample_size"), score.cast("int").alias("score"),
                     F.col("source.p2").alias("p_target2"), F.col("source.e2").alias("result2"), F.coalesce("met.n", F.lit(0)).cast("long").alias("gated_n"), F.col("met.e2").alias("gated_result2"), F.col("pair_profit").alias("may_rank_by_profit"), told.alias("warnings"))
