"""Connected components by alternating small-star and large-star steps.

The state is one row per vertex with its smaller neighbours.  A small-star step links
the vertex and those neighbours to the smallest of them; a large-star step links the
larger neighbours of every vertex to its smallest neighbour, as a grouped minimum and a
join, so a vertex with very many edges is neither collected nor handled by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _grouped(edges: DataFrame) -> DataFrame:
    """(a, bs): the distinct smaller neighbours of every vertex.  A vertex has few of them:
    at most as many as edges that it was given as the larger end."""
    return edges.filter("a > b").groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("bs"))


def _small_star(grouped: DataFrame) -> DataFrame:
    low = F.get("bs", F.lit(0))
    return grouped.select(low.alias("b"), F.explode(F.concat(F.array("a"), F.slice("bs", 2, F.size("bs")))).alias("a"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    linked = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionAll(low.filter("m < u").select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(vertex, component) for every vertex of an edge; the component is its smallest vertex."""
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    digest = F.struct(F.count("*"), F.sum(F.xxhash64("a", "bs").cast("decimal(38,0)")))
    seen, state = None, stored(_grouped(pairs), name)
    now = state.select(digest).first()
    while now != seen:
        seen = now
        state = stored(_grouped(_large_star(_small_star(state))), name)
        now = state.select(digest).first()
    # Stable: every vertex points at its component's smallest one.
    own = state.select(F.col("a").alias("vertex"), F.get("bs", F.lit(0)).alias("component"))
    return own.unionAll(own.select(F.col("component").alias("vertex"), "component").distinct())
