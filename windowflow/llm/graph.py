"""Connected components by alternating large-star and small-star rounds.

Every round is a minimum per node, combined before the shuffle and written down, and a join with it. Both
sides of that join are plain shuffles, so the rows of a hub with millions of neighbours are split
among tasks when the plan runs. Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour below every node that has one."""
    return durable(edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node that it reaches.

    ``edges`` has two long columns; loops and repeats are harmless, no edges give no rows.
    """
    # v < u throughout: u's edge points to a smaller node
    star = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = _state(star)
    while before[0]:
        # large star: what is larger than v moves to the least neighbour of v; where v has none below it, that is v
        low = _least(star)
        large = durable(star.join(low, star["v"] == low["k"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        # small star: what is smaller than u moves to the least of it, and so does u
        least = _least(large)
        small = large.join(least, large["u"] == least["k"]).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = durable(small.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        release(low, large, least, star)
        star, after = new, _state(new)
        if after == before:
            break
        before = after
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(star.select("v", "v").distinct())
