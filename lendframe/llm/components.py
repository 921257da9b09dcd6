"""Connected components of a link table by alternating large-star and small-star
steps, with every round written to the shared folder.

A hot vertex (a group's centre may have a third of all links) only meets
aggregates that combine before the shuffle, and joins that adaptive execution
splits.  Only linked vertices take part; nothing goes to the driver but two
numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lendframe.llm.common import release, stage, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v): every vertex joins its neighbours (the
    larger ones, or the smaller ones and itself) to the smallest of them."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(low, "u")
    if large:
        # an edge comes once from either end: nothing repeats but what both ends move alike, and the small step drops that
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _staged_links(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, and their number and hash sum, observed while they are."""
    seen = Observation()
    out = stage(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links")
    return out, (seen.get["n"], seen.get["h"])


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """vertex, component (smallest vertex reachable) for every vertex of the
    links (u, v).  Self-links and repeated links are allowed."""
    edges, state = _staged_links(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds if state[0] else 0):
        old = staged()[-1:]
        previous = state
        edges, state = _staged_links(_star(_star(edges, large=True), large=False))
        release(old)
        if state == previous:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
    # now a forest of stars: every vertex but a component's smallest points at it
    members = edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def merged_components(component: DataFrame, links: DataFrame) -> DataFrame:
    """``component`` (vertex, component) after more links (u, v) of vertices, which need not be in it:
    only the components that the links touch are joined, each as one vertex."""
    home = component.select(F.col("vertex"), F.col("component"))
    ends = links.select("u", "v").join(home.select(F.col("vertex").alias("u"), F.col("component").alias("cu")), "u", "left").join(
        home.select(F.col("vertex").alias("v"), F.col("component").alias("cv")), "v", "left")
    between = ends.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    moved = stage(connected_components(between), "merged-components")
    to = moved.select(F.col("vertex").alias("component"), F.col("component").alias("to"))
    old = home.join(to, "component", "left").select("vertex", F.coalesce("to", "component").alias("component"))
    return old.unionByName(moved.join(home.select("vertex"), "vertex", "left_anti"))
