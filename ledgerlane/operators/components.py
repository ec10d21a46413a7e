"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.session import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.unionByName(turned)


def _stars(near: DataFrame, smaller: bool) -> DataFrame:
    """Links every neighbour to the least node around u: the larger neighbours, or the smaller ones and u itself."""
    if smaller:
        near = near.where("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    joined = near.join(least, "u")
    if smaller:
        moved = joined.select(F.col("v").alias("u"), F.col("least").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("least").alias("v")))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.where("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the least node that each node of an edge (u, v) is connected with.

    Alternates large and small stars until no edge moves, about log(nodes) rounds.  Each round is a written table in the
    shared folder: lineage is cut, nothing is collected but a count and a checksum.  A node with very many edges is a
    hot key of plain joins and of sums with a partial step only.  Self loops and repeated edges change nothing.
    """
    longs = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    now = scratch.save(longs.where("u != v"), f"{name}-0")
    before, step = None, 0
    while True:
        step += 1
        large = _stars(_both_ways(now), smaller=False)
        now = scratch.save(_stars(large, smaller=True), f"{name}-{step}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
