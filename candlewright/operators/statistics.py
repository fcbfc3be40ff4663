"""Statistics of deals and features: cluster errors, ranks, multiple testing, ridge.

Only the ridges' product sums, one row per period, reach numpy; ``PERIODS`` bounds how many may.  Resampling has a
module of its own."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

PERIODS = 100_000


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal value."""
    return z.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or tiny)
        c = 1 + top / (c or tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_test_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def cluster_mean(df: DataFrame, value: str, cluster: list[str], by: list[str]) -> DataFrame:
    """Mean with the cluster-robust error, z, in two grouped passes; G/(G-1) is the correction."""
    sums = df.groupBy(*by, *cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    total = sums.groupBy(*by).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("g"))
    joined = sums.join(total, by) if by else sums.crossJoin(total)  # one row of totals
    residual = joined.withColumn("e", F.col("s") - F.col("n") * F.col("all_s") / F.col("all_n"))
    out = residual.groupBy(*by, "all_s", "all_n", "g").agg(F.sum(F.col("e") * F.col("e")).alias("q"))
    se = F.when(F.col("g") > 1, F.sqrt(F.col("q") * F.col("g") / (F.col("g") - 1)) / F.col("all_n"))
    mean = F.col("all_s") / F.col("all_n")
    return out.select(*by, mean.alias("mean"), F.col("all_n").alias("n"), F.col("g").alias("clusters"), se.alias("se"), F.when(se > 0, mean / se).alias("z"))


def average_rank(df: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """Rank from 1 with ties averaged."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, column))
    return df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(column)) + (ties - 1) / 2)


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null where either side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = average_rank(average_rank(pairs, x, by, "rx"), y, by, "ry")
    return ranks.groupBy(*by).agg(correlation("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def holm(tests: DataFrame, family: list[str], alpha: float = 0.05) -> DataFrame:
    """Adds holm_threshold, holm_p and rejected: step-down within a family; null p don't count."""
    live = tests.where("p IS NOT NULL")
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    order = Window.partitionBy(*family).orderBy("p", "id")
    k = F.row_number().over(order)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    df = live.withColumn("holm_threshold", alpha / (m - k + 1)).withColumn("_adj", (m - k + 1) * F.col("p"))
    return df.withColumn("holm_p", F.least(F.lit(1.0), F.max("_adj").over(run))).withColumn("rejected", F.min(F.col("p") <= F.col("holm_threshold")).over(run)).drop("_adj")


def _bounded(rows: DataFrame, order: str) -> pd.DataFrame:
    """Rows in order; refuses more than ``PERIODS`` of them."""
    rows = rows.orderBy(order).limit(PERIODS + 1).toPandas()
    if len(rows) > PERIODS:
        raise ValueError(f"over {PERIODS} periods; choose a coarser period")
    return rows


def joined_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average rank over the whole table: counts per value first, then running sums over ranges of
    values, so that no task sees all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
    return df.join(running(counts, column, "_c").withColumn(name, F.col("_before") + (F.col("_c") + 1) / 2).drop("_before", "_c"), column)


def running(counts: DataFrame, order: str, count: str, cells: int = 64) -> DataFrame:
    """Adds _before, the sum of ``count`` over all smaller values of a numeric ``order``.

    Values fall into cells between approximate quantiles, so an outlier moves no other value; cell sums are few and are run
    through in one task, values inside their cell.  The quantiles are taken when this is called."""
    cuts = sorted(set(counts.approxQuantile(order, [k / cells for k in range(1, cells)], 0.2 / cells)))
    below = F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order)) if cuts else F.array()
    placed = counts.withColumn("_cell", F.size(below))
    sums = placed.groupBy("_cell").agg(F.sum(count).alias("_sum"))
    sums = sums.select("_cell", (F.sum("_sum").over(Window.orderBy("_cell")) - F.col("_sum")).alias("_start"))
    inside = F.sum(count).over(Window.partitionBy("_cell").orderBy(order)) - F.col(count)
    return placed.join(F.broadcast(sums), "_cell").withColumn("_before", F.col("_start") + inside).drop("_cell", "_start")  # at most ``cells`` rows


def ridge(df: DataFrame, features: list[str], target: str, penalty: float) -> np.ndarray:
    """Standardised ridge from sums of products: one aggregate row, whatever the number of rows."""
    names = [*features, target]
    terms = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    row = df.dropna(subset=names).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)], *terms).first()
    n, k = row["n"], len(features)
    if n < 2:
        return np.zeros(k + 1)
    mean = np.array([row[f"s{i}"] for i in range(k + 1)]) / n
    cov = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] / n - mean[i] * mean[j] for j in range(k + 1)] for i in range(k + 1)])
    dev = np.sqrt(np.maximum(np.diag(cov)[:k], 1e-300))
    corr = cov[:k, :k] / np.outer(dev, dev)
    w = np.linalg.solve(corr * n + penalty * np.eye(k), cov[:k, k] / dev * n) / dev
    return np.append(w, mean[k] - w @ mean[:k])


def time_split(bars: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Boundaries per timeframe: the times at which 60 and 80 percent of all bars have passed.

    Counts per time are summed first, so the running sum goes over times, not bars."""
    times = bars.groupBy("timeframe", "ts").agg(F.count(F.lit(1)).alias("c"))
    seen = times.withColumn("through", F.sum("c").over(Window.partitionBy("timeframe").orderBy("ts"))).withColumn("total", F.sum("c").over(Window.partitionBy("timeframe")))
    at = lambda share: F.min(F.when(F.col("through") > F.floor(F.col("total") * share), F.col("ts")))
    return seen.groupBy("timeframe").agg(F.max("total").alias("bars"), at(train).alias("train_end"), at(round(train + validation, 9)).alias("validation_end"))


def pooled_ic(df: DataFrame, x: str, y: str, by: list[str], cluster: list[str]) -> DataFrame:
    """Rank correlation pooled over series: ranks are standardised inside each series, so the mean product
    is the mean of their correlations; its error is clustered."""
    pairs = average_rank(average_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, by, "rx"), y, by, "ry")
    g = Window.partitionBy(*by)
    z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(g), F.stddev_pop(c).over(g))
    return cluster_mean(pairs.withColumn("zz", z("rx") * z("ry")).where("zz IS NOT NULL"), "zz", cluster, [])


def sign_test(agree: Column, n: Column) -> Column:
    """Two-sided p of at least ``agree`` of ``n`` fair coins, from log factorials."""
    log_fact = lambda k: F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array(F.lit(1).cast("long"))), F.lit(0.0), lambda a, i: a + F.ln(i))
    terms = F.transform(F.sequence(agree, n), lambda k: F.exp(log_fact(n) - log_fact(k) - log_fact(n - k) - n * math.log(2)))
    return F.least(F.lit(1.0), 2 * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t, one value per group."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else t_test_p(float(a), float(b)) for a, b in zip(t, df, strict=True)], dtype=float)


def cluster_t_test(df: DataFrame, value: str, cluster: list[str], by: list[str]) -> DataFrame:
    """Cluster mean with Student's p on clusters less one degrees of freedom."""
    return cluster_mean(df, value, cluster, by).withColumn("p", student_p("z", (F.col("clusters") - 1).cast("double")))


def expanding_ridge(df: DataFrame, features: list[str], target: str, period: str, penalties: tuple[float, ...], first: int = 3, embargo: int = 1) -> DataFrame:
    """Squared error of each penalty, chosen without looking ahead: for each period from the ``first`` on,
    weights come from the periods before it, less an embargo of ``embargo`` of them, and are scored on it.

    All that leaves Spark is one row of product sums per period."""
    names = [*features, target]
    terms = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    rows = df.dropna(subset=names).groupBy(period).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)], *terms)
    rows = _bounded(rows, period)  # one row per period
    k, out = len(features), []

    def moments(part: pd.DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
        n = float(part["n"].sum())
        s = np.array([part[f"s{i}"].sum() for i in range(k + 1)])
        q = np.array([[part[f"p{min(i, j)}_{max(i, j)}"].sum() for j in range(k + 1)] for i in range(k + 1)])
        return n, s, q

    for penalty in penalties:
        error, count = 0.0, 0.0
        for at in range(first, len(rows)):
            n, s, q = moments(rows.iloc[: max(1, at - embargo)])
            mean = s / n
            cov = q / n - np.outer(mean, mean)
            dev = np.sqrt(np.maximum(np.diag(cov)[:k], 1e-300))
            w = np.linalg.solve(cov[:k, :k] / np.outer(dev, dev) * n + penalty * np.eye(k), cov[:k, k] / dev * n) / dev
            b = np.append(-w, 1.0)  # target less prediction, without the intercept
            c = mean[k] - w @ mean[:k]
            n1, s1, q1 = moments(rows.iloc[at : at + 1])
            error += b @ q1 @ b - 2 * c * (b @ s1) + c * c * n1
            count += n1
        out.append((float(penalty), float(error / count) if count else None, int(count)))
    return df.sparkSession.createDataFrame(out, "penalty double, error double, n long")
