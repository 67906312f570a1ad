"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralattice.llm._common import Stored, apart, release_shuffles


def _with_lowest(directed: DataFrame) -> DataFrame:
    """u, v, m: m is the smallest of u's neighbours and u itself.  A hot u is pre-aggregated, and split in the join."""
    lowest = directed.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return directed.join(lowest.select(apart(F.col("u")).alias("u"), "m"), "u")


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node goes to the smallest of the node's neighbourhood."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node itself, go to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _with_lowest(down).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, at_most: int | None = None) -> Stored:
    """u, v for every node but each component's smallest, v: that smallest node.

    ``edges`` has columns u and v, and ``at_most`` rows if that is known.  The steps end when a round leaves the edges as they are; then every
    component is a star around its smallest node.  Nothing but two counters comes to the driver.
    """
    now = Stored(edges.select("u", "v").filter("u <> v").distinct(), "edges", at_most)
    state = _state(now.df)
    while state[0]:
        following = Stored(_small(_large(now.df)), "star", state[0])  # the steps add no edges
        now.drop()
        before, now, state = state, following, _state(following.df)
        release_shuffles(edges.sparkSession)
        if state == before:
            break
    return now
