"""Keyed writes into a partitioned Parquet table that touch only the partitions they change.

A change reads the partitions it touches, writes their new rows beside the table, claims the next version, and only
then replaces those partitions (dynamic partition overwrite).  The claim is a file that must not exist yet, so of two writers
that began from one version the second is refused before it changes anything.  All other files keep their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.sources import files

#: A change may touch so many partitions: their values, not their rows, are listed on the driver.
PARTITIONS = 10_000


class Conflict(RuntimeError):
    """Another writer has changed the table meanwhile."""


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str) -> int:
    """The number of changes so far."""
    at, fs = _path(spark, f"{path}/_versions")
    return len(fs.listStatus(at)) if fs.exists(at) else 0


def _claim(spark: SparkSession, path: str, number: int) -> None:
    at, fs = _path(spark, f"{path}/_versions/{number:08d}")
    try:
        fs.create(at, False).close()
    except Exception as e:
        raise Conflict(f"version {number} of {path} is there already") from e


def _values(touched: DataFrame) -> list[dict]:
    rows = touched.distinct().limit(PARTITIONS + 1).collect()
    if len(rows) > PARTITIONS:
        raise ValueError(f"over {PARTITIONS} partitions; write in parts")
    return [r.asDict() for r in rows]


def _any_of(values: list[dict]) -> Column:
    out = F.lit(False)
    for v in values:
        one = F.lit(True)
        for c, x in v.items():
            one = one & F.col(c).eqNullSafe(F.lit(x))
        out = out | one
    return out


def change(spark: SparkSession, path: str, by: list[str], touched: DataFrame, make: Callable[[DataFrame], DataFrame], base: int | None = None) -> int:
    """Replaces the rows of the touched partitions (distinct values of ``by``) by what ``make`` makes of them; the new version.

    ``base`` is the version that the caller has read; without it the present one."""
    base = version(spark, path) if base is None else base
    values = _values(touched.select(*by))
    if not values:
        return base
    old = spark.read.parquet(path)
    staged = f"{path}/_staged-{base + 1:08d}"
    make(old.where(_any_of(values))).select(*old.columns).write.mode("overwrite").parquet(staged)
    try:
        _claim(spark, path, base + 1)
        new = spark.read.schema(old.schema).parquet(staged)
        left = [r.asDict() for r in new.select(*by).distinct().collect()]  # at most PARTITIONS
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
        for v in values:
            if v not in left:  # no row is left in it
                at, fs = _path(spark, path + "".join(f"/{c}={x}" for c, x in v.items()))
                fs.delete(at, True)
    finally:
        at, fs = _path(spark, staged)
        fs.delete(at, True)
    return base + 1


def create(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.write.partitionBy(*by).parquet(path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], by: list[str], order: list[Column] | None = None, base: int | None = None) -> int:
    """New rows win; among new rows of a key the first in ``order``.  A key's partition must not change."""
    return change(spark, path, by, rows, lambda old: files.upsert(old, rows.select(*old.columns), keys, order), base)


def insert_missing(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], by: list[str], base: int | None = None) -> int:
    return change(spark, path, by, rows, lambda old: files.insert_missing(old, rows.select(*old.columns), keys), base)


def update_where(spark: SparkSession, path: str, condition: Column, changes: dict[str, Column], by: list[str], base: int | None = None) -> int:
    """Compare-and-set: only partitions with a row that meets the condition are written."""
    return change(spark, path, by, spark.read.parquet(path).where(condition), lambda old: files.update_where(old, condition, changes), base)


def delete_keys(spark: SparkSession, path: str, keys: DataFrame, by: list[str], base: int | None = None) -> int:
    """``keys`` has the key columns and those of ``by``."""
    return change(spark, path, by, keys, lambda old: files.delete_keys(old, keys), base)
