"""Resampling inside Spark: bootstraps and permutation tests of any number of clusters and arms.

Bootstrap.  A draw gives every cluster a count.  Counts come from a hash of seed, cluster and draw, so nothing is drawn in order: a
cluster's sums meet their counts where they are, each task adds up its share of every draw, and only one row per task,
arm and hash (of four draws) is shuffled.  All arms see the same counts.  A count is Poisson with mean 1 (the large-sample form of drawing
clusters with replacement), so the size of a draw varies and estimates are ratios of sums.  A block bootstrap gives
counts to the beginnings of blocks, on average one in ``block`` periods, and a period has the counts of the blocks over it.

An estimate of nothing.  The sums are of doubles, added in whatever order tasks end, so a draw whose estimate is 0 may come out a
last bit above or below it.  For p, an estimate is 0 where it is within ``TIE`` of the mean size of what was added up.

Permutation.  A replicate orders the units by a hash; their places are a random permutation, by which one column is
read against the other.

Hashes are MD5 of text, 32 bits a number, which any SQL engine can repeat.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.operators.statistics import average_rank

PER_HASH = 4
TIE = 1e-12


def limits(mean: float) -> list[int]:
    """32-bit numbers at which a Poisson count rises from k to k + 1."""
    out, term, total, k = [], math.exp(-mean), math.exp(-mean), 0
    while (at := round(total * 2**32)) < 2**32:
        out.append(at)
        k += 1
        term *= mean / k
        total += term
    return out


def _hashed(df: DataFrame, key: Column, draws: int, seed: int, mean: float) -> DataFrame:
    """A row for each hash, of the draws from _q * PER_HASH on: adds _q and the draws' counts _n0, _n1, ...

    Numbers stay text: hexadecimal digits of one length are in the order of what they stand for.  Each step is a projection of
    its own, so that a hash is taken once; most counts are found by the first or second comparison."""
    at, each = limits(mean), range(PER_HASH)
    df = df.withColumn("_key", F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":")))
    df = df.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // PER_HASH) - 1))))
    df = df.withColumn("_h", F.md5(F.concat("_key", F.col("_q").cast("string")).cast("binary")))
    df = df.withColumns({f"_x{k}": F.substring("_h", 1 + 8 * k, 8) for k in each})

    def count(x: Column) -> Column:
        found = F.when(x < f"{at[0]:08x}", 0.0)
        for k, limit in enumerate(at[1:], 1):
            found = found.when(x < f"{limit:08x}", float(k))
        return found.otherwise(float(len(at)))

    return df.withColumns({f"_n{k}": count(F.col(f"_x{k}")) for k in each}).drop("_key", "_h", *[f"_x{k}" for k in each])


def _by_draw(hashed: DataFrame, draws: int, of: dict[str, list[str]]) -> DataFrame:
    """A row for each draw; ``of`` names the columns that hold its values, one for each number of a hash."""
    each = [F.struct((F.col("_q") * PER_HASH + k).alias("draw"), *[F.col(c[k]).alias(v) for v, c in of.items()]) for k in range(PER_HASH)]
    own = {"_q", *[name for c in of.values() for name in c]}
    return hashed.select(*[c for c in hashed.columns if c not in own], F.inline(F.array(*each))).where(F.col("draw") < draws)


def with_counts(df: DataFrame, key: Column, draws: int, seed: int, mean: float = 1.0) -> DataFrame:
    """A row for each draw that has a count for this row: adds draw and count."""
    return _by_draw(_hashed(df, key, draws, seed, mean), draws, {"count": [f"_n{k}" for k in range(PER_HASH)]}).where("count > 0")


def cluster_sums(df: DataFrame, values: dict[str, Column], cluster: Column, by: list[str]) -> DataFrame:
    """Sums of each value per arm and cluster (column _c)."""
    return df.groupBy(*by, cluster.cast("string").alias("_c")).agg(*[F.sum(v).alias(k) for k, v in values.items()])


def draw_sums(sums: DataFrame, values: list[str], by: list[str], draws: int, seed: int) -> DataFrame:
    """(by, draw, values): the values' sums in every draw; zero where a draw has no cluster of an arm."""
    each = [(v, k) for v in values for k in range(PER_HASH)]
    hashed = _hashed(sums.select(*by, "_c", *values), F.col("_c"), draws, seed, 1.0).groupBy(*by, "_q").agg(*[F.sum(F.col(v) * F.col(f"_n{k}")).alias(f"{v}_{k}") for v, k in each])
    drawn = _by_draw(hashed, draws, {v: [f"{v}_{k}" for k in range(PER_HASH)] for v in values})
    return drawn if by else _whole(drawn, None, values, by, draws, sums.sparkSession)  # an arm with a cluster has a row for every draw


def _whole(drawn: DataFrame, arms: DataFrame | None, values: list[str], by: list[str], draws: int, spark) -> DataFrame:
    every = spark.range(draws).select(F.col("id").cast("int").alias("draw"))
    every = arms.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))) if by else every
    return every.join(drawn, [*by, "draw"], "left").fillna(0.0, values)


def block_draw_sums(sums: DataFrame, values: list[str], by: list[str], draws: int, seed: int, block: int) -> DataFrame:
    """As draw_sums, in blocks of neighbouring clusters, around the end.  Clusters are periods here: their names order
    them, and there are few, so they are numbered in one task."""
    names = sums.select("_c").distinct()
    numbered = names.withColumn("_i", (F.row_number().over(Window.orderBy("_c")) - 1).cast("int")).withColumn("_g", F.count(F.lit(1)).over(Window.partitionBy()).cast("int"))
    starts = with_counts(numbered, F.col("_i"), draws, seed, 1 / block)
    over = starts.withColumn("_o", F.explode(F.sequence(F.lit(0), F.least(F.lit(block), F.col("_g")) - 1))).select(F.pmod(F.col("_i") + F.col("_o"), F.col("_g")).alias("_i"), "draw", "count")
    counts = over.groupBy("_i", "draw").agg(F.sum("count").alias("count"))
    drawn = sums.join(numbered, "_c").join(counts, "_i").groupBy(*by, "draw").agg(*[F.sum(F.col(v) * F.col("count")).alias(v) for v in values])
    return _whole(drawn, sums.select(*by).distinct() if by else None, values, by, draws, sums.sparkSession)


def ratio(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


def intervals(drawn: DataFrame, estimate: Column, size: Column, by: list[str], level: float = 0.95, tests: int = 1) -> DataFrame:
    """(by, lo, hi, p): quantile interval, at a level shared out over ``tests`` (Bonferroni), and the two-sided add-one p.  Against
    ``size`` an estimate is told from 0."""
    tail = (1 - level) / 2 / tests
    e = drawn.withColumn("_e", estimate).withColumn("_tie", TIE * size)
    few = F.least(F.count_if(F.col("_e") <= F.col("_tie")), F.count_if(F.col("_e") >= -F.col("_tie")))
    return e.groupBy(*by).agg(F.percentile("_e", tail).alias("lo"), F.percentile("_e", 1 - tail).alias("hi"), F.least(F.lit(1.0), 2 * (few + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def bootstrap_mean(df: DataFrame, value: str, cluster: Column, by: list[str], draws: int = 2000, seed: int = 7, level: float = 0.95, block: int = 1, tests: int = 1) -> DataFrame:
    """(by, value, lo, hi, p, clusters): a mean per arm with its interval from resampled clusters."""
    sums = cluster_sums(df, {"s": F.col(value), "n": F.when(F.col(value).isNotNull(), 1.0)}, cluster, by).where("n > 0")
    sized = sums.withColumn("a", F.abs("s"))
    drawn = draw_sums(sized, ["s", "n", "a"], by, draws, seed) if block == 1 else block_draw_sums(sized, ["s", "n", "a"], by, draws, seed, block)
    seen = sums.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("value"), F.count(F.lit(1)).alias("clusters"))
    found = intervals(drawn, ratio("s", "n"), ratio("a", "n"), by, level, tests)
    return seen.join(found, by) if by else seen.crossJoin(found)  # one row each


def bootstrap_difference(arms: DataFrame, draws: int = 2000, seed: int = 7) -> DataFrame:
    """(id, left, right, diff, lo, hi, p): differences of two sides' means under shared counts.

    ``arms``: id, side (left or right), _c (cluster), s, n; a cluster that one side lacks counts there as nothing.  The
    differences are of ratios, so sides of unlike size are compared by their means."""
    parts = {f"{v}_{side}": F.sum(F.when(F.col("side") == side, F.col(v)).otherwise(0.0)).alias(f"{v}_{side}") for side in ("left", "right") for v in ("s", "n")}
    wide = arms.groupBy("id", "_c").agg(*parts.values())
    gap, size = ratio("s_left", "n_left") - ratio("s_right", "n_right"), ratio("a_left", "n_left") + ratio("a_right", "n_right")
    seen = wide.groupBy("id").agg(*[F.sum(c).alias(c) for c in parts]).select("id", "n_left", "n_right", ratio("s_left", "n_left").alias("left"), ratio("s_right", "n_right").alias("right"), gap.alias("diff"))
    sized = wide.withColumns({f"a_{side}": F.abs(f"s_{side}") for side in ("left", "right")})
    return seen.join(intervals(draw_sums(sized, [*parts, "a_left", "a_right"], ["id"], draws, seed), gap, size, ["id"]), "id")


def paired_bootstrap(df: DataFrame, value: str, side: Column, cluster: Column, draws: int = 2000, seed: int = 7) -> DataFrame:
    """One row (value, lo, hi, p, clusters): the mean over clusters of two arms' difference of totals.  ``side`` is 1 or -1."""
    sums = cluster_sums(df, {"s": side * F.col(value)}, cluster, []).withColumns({"n": F.lit(1.0), "a": F.abs("s")})
    seen = sums.agg((F.sum("s") / F.sum("n")).alias("value"), F.count(F.lit(1)).alias("clusters"))
    return seen.crossJoin(intervals(draw_sums(sums, ["s", "n", "a"], [], draws, seed), ratio("s", "n"), ratio("a", "n"), []))  # one row each


MOMENTS = ("m", "a", "b", "aa", "bb", "ab")


def correlation_of_moments() -> Column:
    m, a, b, aa, bb, ab = (F.col(c) for c in MOMENTS)
    spread = F.sqrt(F.greatest(aa / m - (a / m) * (a / m), F.lit(0.0)) * F.greatest(bb / m - (b / m) * (b / m), F.lit(0.0)))
    return F.when((m > 0) & (spread > 0), (ab / m - a / m * b / m) / spread).otherwise(0.0)


def bootstrap_spearman(ranked: DataFrame, cluster: Column, draws: int = 2000, seed: int = 7) -> DataFrame:
    """One row (value, lo, hi, p, clusters): correlation of ranks rx and ry, fixed over all rows, clusters resampled."""
    x, y = F.col("rx"), F.col("ry")
    sums = cluster_sums(ranked, {"m": F.lit(1.0), "a": x, "b": y, "aa": x * x, "bb": y * y, "ab": x * y}, cluster, [])
    seen = sums.agg(*[F.sum(c).alias(c) for c in MOMENTS], F.count(F.lit(1)).alias("clusters")).select(correlation_of_moments().alias("value"), "clusters")
    return seen.crossJoin(intervals(draw_sums(sums, list(MOMENTS), [], draws, seed), correlation_of_moments(), F.lit(1.0), []))  # one row each


def permutation_test(units: DataFrame, unit: str, x: str, y: str, by: list[str], top: int, draws: int = 10_000, seed: int = 7) -> DataFrame:
    """(by, n, top_y, all_y, bottom_y, lift_p, rho, rho_p): does x tell y?

    The lift is the mean y of the ``top`` units by x, against that of units taken at random; rho is the correlation of average
    ranks, against that of permuted ones.  Both p are one-sided and add-one.  Ties of x are taken in order of ``unit``."""
    order = lambda *c: Window.partitionBy(*by).orderBy(*c)
    live = units.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(live, x, by, "rx"), y, by, "ry").withColumn("place", F.row_number().over(order(F.desc(x), unit)))
    ranked = ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by))).select(*by, unit, "rx", "ry", "place", "n", F.col(y).cast("double").alias("y"))
    spread = F.sum((F.col("rx") - (F.col("n") + 1) / 2) * (F.col("ry") - (F.col("n") + 1) / 2))
    is_top, is_bottom = F.col("place") <= top, F.col("place") > F.col("n") - top
    seen = ranked.groupBy(*by).agg(F.max("n").alias("n"), F.avg(F.when(is_top, F.col("y"))).alias("top_y"), F.avg("y").alias("all_y"), F.avg(F.when(is_bottom, F.col("y"))).alias("bottom_y"), spread.alias("c"),
                                   (F.var_pop("rx") * F.var_pop("ry")).alias("v"))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col(unit).cast("string"))
    mixed = ranked.select(*by, unit, "ry", "y", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("h", F.md5(text.cast("binary")))
    mixed = mixed.withColumn("place", F.row_number().over(Window.partitionBy(*by, "draw").orderBy("h", unit))).drop("h")
    given = ranked.select(*by, "place", F.col("rx").alias("to_rx"), (F.col("place") <= top).alias("to_top"))
    mixed = mixed.join(given, [*by, "place"])
    each = mixed.groupBy(*by, "draw").agg(F.avg(F.when(F.col("to_top"), F.col("y"))).alias("lift"), F.sum((F.col("to_rx") - (F.col("n") + 1) / 2) * (F.col("ry") - (F.col("n") + 1) / 2)).alias("rc"))
    against = each.join(seen, by) if by else each.crossJoin(seen)  # one row
    p = lambda hit: (1 + F.count_if(hit)) / F.lit(draws + 1)
    tested = against.groupBy(*by).agg(p(F.col("lift") >= F.col("top_y") - 1e-9).alias("lift_p"), p(F.col("rc") >= F.col("c") - 1e-6).alias("rho_p"))
    out = seen.join(tested, by) if by else seen.crossJoin(tested)  # one row each
    rho = F.when(F.col("v") > 0, F.col("c") / F.col("n") / F.sqrt("v"))
    return out.select(*by, "n", "top_y", "all_y", "bottom_y", "lift_p", rho.alias("rho"), F.when(F.col("v") > 0, F.col("rho_p")).alias("rho_p"))
