"""Affine recursions, v = decay * v_before + term, as block scans on column expressions.

A step is an affine map, and affine maps compose: a run of rows folds into one map, whose factor is a power of the decay and whose
constant is a weighted sum of the terms.  Inside a block a running sum of terms, each divided by its own power of the
decay, gives every row; powers stay small because blocks are short.  A block is long enough that its factor is under 1e-17, which
no double can show, so what a row takes over from before its block is the map of one whole block, weakened by its place.

For the same reason a series can be cut into chunks of ``CHUNK`` rows, which are dealt to tasks one by one, each with the
block before it as a run-up.  No series is ever in one task or in memory as a whole.  Rows are numbered from 0 without gaps
(``bar_idx``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.sources.bars import SERIES, dealt

CHUNK = 16_384


def block_rows(*decays: float) -> int:
    """Rows after which no value weighs 1e-17 any more: a power of two that serves all decays."""
    rows = 2 ** math.ceil(math.log2(max(math.log(1e-17) / math.log(d) for d in decays)))
    if rows * -math.log(min(decays)) > math.log(1e290):
        raise ValueError("these decays are too unlike for one scan")
    return rows


def in_chunks(df: DataFrame, block: int, order: str = "bar_idx", chunk: int = CHUNK) -> DataFrame:
    """Adds _chunk and _block; the last block of each chunk also comes as the run-up of the next."""
    if chunk % block:
        raise ValueError("a chunk is a whole number of blocks")
    own = F.floor(F.col(order) / chunk).cast("int")
    both = F.when(F.pmod(order, F.lit(chunk)) >= chunk - block, F.array(own, own + 1)).otherwise(F.array(own))
    return dealt(df.select("*", F.explode(both).alias("_chunk"), F.floor(F.col(order) / block).cast("int").alias("_block")), "_chunk")


def own_rows(df: DataFrame, order: str = "bar_idx", chunk: int = CHUNK) -> DataFrame:
    """Leaves the run-ups out again."""
    return df.where(F.floor(F.col(order) / chunk) == F.col("_chunk"))


def chunk_window(keys: list[str] = SERIES, order: str = "bar_idx"):
    """Rows of a chunk.  Its order names the block first, which changes nothing but that windows inside blocks need no other sort."""
    return Window.partitionBy(*keys, "_chunk").orderBy("_block", order)


def scan(df: DataFrame, recursions: dict[str, tuple[float, str]], block: int, keys: list[str] = SERIES, order: str = "bar_idx") -> DataFrame:
    """Adds the recursions, name: (decay, column of terms), to rows in chunks of such blocks.

    The recursion begins at the first row with a term, which is its first value; before that it is null.  A term that
    is missing later, or no number, adds nothing."""
    j = F.pmod(order, F.lit(block))
    inside = Window.partitionBy(*keys, "_chunk", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_{name}": F.sum(F.nanvl(term, F.lit(None)) * F.pow(F.lit(decay), -j)).over(inside) * F.pow(F.lit(decay), j) for name, (decay, term) in recursions.items()})
    found = {}
    for name, (decay, _) in recursions.items():
        here, left = F.col(f"_{name}"), F.last(F.when(j == block - 1, F.col(f"_{name}")), ignorenulls=True).over(before) * F.pow(F.lit(decay), j + 1)
        found[name] = F.coalesce(here + left, here, left)
    return df.withColumns(found)
