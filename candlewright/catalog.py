"""Named queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewright.plans import ingested, measured, research, resampled, studies  # noqa: F401  register their queries
from candlewright.plans.queries import QUERIES, Query, bollinger_outliers


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bollinger_outliers(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
