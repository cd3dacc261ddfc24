"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.joins import spread_join
from cairn.workspace import cut_to, let_go, remove


def _with_least(rows: DataFrame, edges: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v) with ``m``, the least v among the ``edges`` of u; no task gets all edges of a hub."""
    return spread_join(rows, edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u", "n", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = _with_least(both.where("v > u"), both, 2 * total)
    return met.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))  # what repeats there goes in the small star


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect the smaller neighbours of a node, and the node, to the smallest of them."""
    met = _with_least(edges, edges, total)
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for each node with an edge to another; component = least node reachable.

    Nodes are of any orderable type. Null ends and loops are no edges; repeated edges count once; an
    empty table gives an empty result. Each round is two equi-joins on the node, with its
    minimum pre-aggregated before the shuffle and those of hubs broadcast, and its edges are cut to the shared folder,
    where those of the round before go; rounds grow with the logarithm of the longest path, and no edge ever reaches
    the driver.
    """
    spark = edges.sparkSession
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    now, path = cut_to(pairs.where("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        larger, between = cut_to(_large_star(now, state[0]), "edges")
        following, after = cut_to(_small_star(larger, state[0]), "edges")
        remove(spark, path)
        remove(spark, between)
        now, path = following, after
        let_go(spark)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free digest; equal before and after a round means a fixed point."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())
