"""Operator 11: whitening of embeddings by upper-triangle column aggregates.

Each entry c of a vector becomes the integer x = floor(64 c) + 1000000.  Statistics are taken over the
fit list, each distinct x vector once, which is written as a table:

1. one aggregation counts the list and sums every dimension, exactly in integers;
2. one aggregation of generated SQL expressions sums the centred products of every pair of dimensions, the
   upper triangle of the covariance.  The centre is the mean rounded to an integer, so products and sums
   are whole numbers (exact while a sum is under 2^53); what rounding left of the mean is taken off at the end;
3. LAPACK decomposes the d x d covariance on the driver;
4. tasks project every row on the leading components and divide by the root of their eigenvalues.

``identity_error`` is measured, not derived: the same aggregation runs over the whitened fit list.  Vectors
of many dimensions have more pairs than one plan can hold; beyond ``PAIRS`` the triangle takes several
aggregations.

Cases: rows whose vector is null, or holds null or non-finite entries, are left out; so are vectors of
another length than the most frequent one (of equals the longest), empty vectors among them.  A null vec_id
stays and gives rows with a null vec_id; each repeated row gives its own rows.  Components without variance (an
eigenvalue under d roundings of the largest) can't be whitened and give no rows: with one distinct vector the
result is empty, as it is for an empty table.  ``deviation`` is null where it is beyond a long.  An entry
whose x is beyond a long ends the run with an arithmetic error.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.common import batch, rows_of, Scratch

COMPONENTS, PAIRS, SCALE, SHIFT = 16, 4096, 64, 1_000_000
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole and finite."""
    entries = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, c -> cast(c AS double))").alias("e"))
    whole = entries.where("e IS NOT NULL AND size(e) > 0 AND forall(e, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")
    return whole.select("vec_id", F.expr(f"transform(e, c -> floor({SCALE} * c) + {SHIFT}L)").alias("x"))


def triangle(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def sums(rows: DataFrame, column: str, d: int) -> tuple[int, list]:
    """Number of rows and the sum of each entry of an array column."""
    got = rows.selectExpr("count(*) AS n", *(f"sum({column}[{i}]) AS s{i}" for i in range(d))).first()
    return got["n"], [got[f"s{i}"] for i in range(d)]


def covariance(rows: DataFrame, column: str, n: int, total: list) -> np.ndarray:
    """Covariance of an array column's entries, divisor n: every pair's centred products in one aggregation."""
    d = len(total)
    mean = [Fraction(s) / n for s in total]
    centre = [round(m) if isinstance(s, int) else float(m) for m, s in zip(mean, total, strict=True)]
    rest = [m - Fraction(c) for m, c in zip(mean, centre, strict=True)]
    entries = rows.selectExpr(*(f"cast({column}[{i}] - {c!r}{'L' if isinstance(c, int) else 'D'} AS double) AS c{i}" for i, c in enumerate(centre)))
    pairs, out = triangle(d), np.empty((d, d))
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        got = entries.selectExpr(*(f"sum(c{i} * c{j}) AS p{i}_{j}" for i, j in some)).first()
        for (i, j), value in zip(some, got, strict=True):
            out[i, j] = out[j, i] = float(Fraction(value) / n - rest[i] * rest[j])
    return out


def components(cov: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: at most ``most``, none without variance."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int(np.count_nonzero(values > len(cov) * np.finfo(float).eps * max(values[0], 0.0)))
    return values[: min(k, most)], vectors[:, : min(k, most)]


def centred(x: np.ndarray, n: int, total: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """x - S/n, and the exact sum of (n x - S)^2 of each row: null beyond a long."""
    means = total / n
    wide = n * np.abs(x).max(initial=0) >= 2.0**62
    scaled = n * x.astype(object) - total.astype(object) if wide else n * x - total
    near = ((n * (x - means)) ** 2).sum(axis=1)
    deviation: list[int | None] = [int(v) if ok else None for v, ok in zip((np.where((near < 2.0**62)[:, None], scaled, 0) ** 2).sum(axis=1), near < 2.0**62, strict=True)]
    return (scaled / n).astype(float), deviation


def whitened(vectors: DataFrame, most: int = COMPONENTS, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``vectors`` and component; see SCHEMA."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "op11")
    rows = quantised(vectors)
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], SCHEMA)
    d = size["d"]
    rows = rows.where(F.size("x") == d)
    fit = scratch.save(rows.select("x").distinct(), "fit")
    n, total = sums(fit, "x", d)
    cov = covariance(fit, "x", n, total)
    values, axes = components(cov, most)
    k = len(values)
    if not k:
        return spark.createDataFrame([], SCHEMA)
    exact, scaled, explained = np.array(total, np.int64), axes / np.sqrt(values), values / np.trace(cov)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def project_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("w", pa.list_(pa.float64()))])
        for part in rows_of(batches):
            yield batch(schema, pa.array(list(centred(matrix(part.column(0)), n, exact)[0] @ scaled), pa.list_(pa.float64())))

    fitted = scratch.save(fit.mapInArrow(project_fit, "w array<double>"), "fitted")
    error = float(np.abs(covariance(fitted, "w", *sums(fitted, "w", k)) - np.eye(k)).max())
    scratch.drop_all()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            moved, deviation = centred(matrix(part.column(1)), n, exact)
            m = part.num_rows
            of = pa.array(np.repeat(np.arange(m), k))
            yield batch(_OUT, part.column(0).take(of), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), pa.array(deviation, pa.int64()).take(of), (moved @ scaled).ravel(), np.tile(explained, m), np.full(m * k, error))

    return rows.select("vec_id", "x").mapInArrow(project, SCHEMA)
