"""Shared pieces of the corpus operators: inputs, scratch tables, batch helpers.

Scratch tables are Parquet files in the folder that ``spark.checkpoint.dir`` names, which every
executor of a cluster shares.  They cut lineage and survive lost executors.  Only where the
setting is absent and all tasks run in the driver's process (tests, a laptop) is a temporary folder
of the driver used; a cluster without the setting is refused.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_live: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows that can be referred to: those without a doc_id are left out."""
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="candlewright-")
    return _own_dir


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """A folder of intermediate tables that belongs to one run of one operator.

    ``save`` writes a table and reads it back; ``drop`` frees one that is no longer read.  What the
    operator's lazy result still reads stays until ``drop_all`` or the end of the driver.  ``last`` saves
    an operator's end result and frees all other tables of the run.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _live[self.root] = spark

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, *tags: str) -> None:
        for tag in tags:
            _delete(self.spark, self.path(tag))

    def last(self, df: DataFrame) -> DataFrame:
        kept = Scratch(self.spark, "result").save(df, "rows")
        self.drop_all()
        return kept

    def drop_all(self) -> None:
        _delete(self.spark, self.root)
        _live.pop(self.root, None)


@atexit.register
def _clear() -> None:
    for root, spark in list(_live.items()):
        try:
            _delete(spark, root)
        except Exception:  # the session may have ended before the interpreter
            return


def salt(spark: SparkSession, *columns: str):
    """A number below the number of shuffle partitions, by which a hot group is dealt to all tasks."""
    return F.pmod(F.xxhash64(*columns), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def group_sizes(df: DataFrame, keys: list[str], dealt_by: list[str], scratch: Scratch, tag: str) -> DataFrame:
    """(keys, salt, n): the groups of ``df`` with over one row, once for each salt that they have rows of.

    Joined back to ``df`` by keys and salt, it tells every row the size of its group; counts are
    aggregated per salt first, so no task gets a whole group."""
    parts = scratch.save(df.groupBy(*keys, salt(df.sparkSession, *dealt_by).alias("salt")).agg(F.count(F.lit(1)).alias("c")), tag)
    total = parts.groupBy(*keys).agg(F.sum("c").alias("n")).where("n > 1")
    return parts.select(*keys, "salt").join(total, keys)


def rows_of(batches: Iterator[pa.RecordBatch], rows: int = 1024, text_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about ``text_bytes`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(rows, batch.num_rows * text_bytes // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc_mod(column, modulus: int):
    """crc32 of a value's text, modulo ``modulus``: the split into folds."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
