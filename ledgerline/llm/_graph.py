"""Connected components by hooking and contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import cut


def _flattened(hop: DataFrame) -> DataFrame:
    """Pointer jumping: (node, to) with every ``to`` a root; the jumps double, so their number is a logarithm."""
    while True:
        over = hop.filter("node <> to").select(F.col("node").alias("to"), F.col("to").alias("next"))
        hop = cut(hop.join(over, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if hop.filter("moved").isEmpty():
            return hop.select("node", "to")
        hop = hop.select("node", "to")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the undirected ``edges`` (a, b); component: its smallest node.

    Every round each node hooks onto its smallest neighbour, hooks are followed
    to their roots, and edges are contracted to the roots, so each round at
    least halves the nodes that still have edges. The driver only asks whether
    any are left. A node with very many edges is reduced map-side, and in the
    joins its one row comes from a checkpoint, so a hot node's edges can be
    split over tasks. Self loops count as nodes; null ends are left out.
    """
    edges = cut(edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    live, hops = edges, []
    while not hops or not live.isEmpty():
        down = live.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(live.select(F.col("a").alias("node"), F.col("a").alias("to")))
        hops.append(_flattened(cut(down.groupBy("node").agg(F.min("to").alias("to")))))
        ends = [hops[-1].select(F.col("node").alias(x), F.col("to").alias(f"r{x}")) for x in "ab"]
        moved = live.join(ends[0], "a").select("ra", "b").join(ends[1], "b").filter("ra <> rb")
        live = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    found = hops[0].withColumnRenamed("to", "component")
    for hop in hops[1:]:
        hop = hop.select(F.col("node").alias("component"), F.col("to").alias("next"))
        found = found.join(hop, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return found
