"""Distributed union-find: connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textora.llm._common import drop_saved, save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u > v). Large: each node hangs its larger neighbours under its smallest neighbour.
    Small: each node hangs its smaller neighbours, and itself, under the smallest of them."""
    if large:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        # an edge (u > v) serves node v, whose larger neighbour is u
        hung = edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
    else:
        hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs under one other at most, and has then nothing under it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Nulls at either end and loops are ignored (a node with loops only has no row). Nodes may be of any ordered type.
    No neighbourhood is gathered: each step is a grouped minimum, combined before its shuffle, and a join that AQE
    can split where one node has a large share of the edges. Every round is written to the shared folder.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    now = save(pairs.where("u <> v").distinct(), "cc")
    for _ in range(max_rounds):
        if _settled(now):
            break
        after = save(_star(_star(now, True), False), "cc")
        drop_saved(now)
        now = after
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
