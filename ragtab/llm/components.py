"""Connected components of a table of links, by alternating large and small stars.

Each round replaces links by links to smaller neighbours with one aggregate and one join; both
sides of a join are stored tables, so adaptive execution can split a node that many links share.
Links never leave the cluster; what comes to the driver are a count and a sum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame, small: bool, n: int) -> DataFrame:
    """links: (u, v) with v < u, distinct; n: at least their number."""
    if small:  # all smaller neighbours of u, and u, link to the smallest
        least = stored(links.groupBy("u").agg(F.min("v").alias("m")), "star", n)
        near = links.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("x"))
    else:  # all larger neighbours of u link to the smallest neighbour of u, or to u
        both = stored(links.select(F.col("u").alias("a"), F.col("v").alias("b")).union(links.select("v", "u")), "links", 2 * n)
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")), "star", 2 * n)
        near = both.filter("b > a").join(least, "a").select(F.struct(F.col("b").alias("u"), F.least("m", "a").alias("m")).alias("x"))
    return near.select("x.u", F.col("x.m").alias("v")).filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``links`` (a, b) but the smallest of its component."""
    now = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    n, before = now.count(), None
    while n:
        now = stored(_star(stored(_star(now, False, n), "links", n), True, n), "links", 2 * n)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before, n = state, state[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
