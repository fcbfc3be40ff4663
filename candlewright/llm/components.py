"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the same key; no neighbour list is ever gathered, so
a node with very many links is pre-aggregated before the shuffle and its rows can be split by the
adaptive skew join.  Each round is written as a table, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from candlewright.llm.common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the least such neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, component) of every node with a link; the component is its least node.

    ``edges`` has columns u and v; order, repeats and self-links don't matter.  An empty table of
    links gives an empty result.  The rounds end when one changes nothing: the number of links and
    the sum of their hashes are observed while a round is written."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    step, seen = 0, None
    while True:
        told = Observation()
        state = scratch.save(edges.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), f"{tag}-{step}")
        if step:
            scratch.drop(f"{tag}-{step - 1}")
        now = (told.get["n"], told.get["h"])
        if now == seen or not now[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, step = now, step + 1
        edges = _small(_large(state))
