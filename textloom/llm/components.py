"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A hub's edges are spread over this many join keys, so that no task holds them all.
SALTS = 32


def _neighbour_minima(arcs: DataFrame) -> DataFrame:
    """(u, m) once for each salt: the smallest of u and its neighbours. Arcs are (u, v)."""
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _star(arcs: DataFrame, larger: bool) -> DataFrame:
    """Hang v (v > u for the large star, v <= u for the small star) under the smallest neighbour of u."""
    salted = arcs.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS)))
    joined = salted.join(_neighbour_minima(arcs), ["u", "salt"])
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        # u itself hangs under m as well; one row for each u comes from its minima.
        own = _neighbour_minima(arcs).where("salt = 0").select(F.col("u").alias("a"), F.col("m").alias("b"))
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own)
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (columns a, b) can reach.

    Nodes without an edge to another node don't appear; self loops, repeated and null-ended edges are ignored.
    An empty edge table gives an empty result. Each round is written to the shared folder, so lineage stays short.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = materialise(_star(both, larger=True), "large")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        edges = materialise(_star(down, larger=False), "small")
        # Both stars only ever move a node under a smaller one, so equal figures mean that nothing moved.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
