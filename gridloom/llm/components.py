"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.session import stage


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Join every node's neighbours to the least of them (itself included).

    large: the neighbours above the node; small: those below it and the node itself.
    """
    both = edges.select("a", "b") if small else edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "node")
    moved = both.join(least, F.col("a") == F.col("node"))
    if small:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    else:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Every node has one link up or only links down: all components are stars around their least node."""
    ends = [F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down")) for c, up in (("a", 1), ("b", 0))]
    nodes = edges.select(F.inline(F.array(*ends))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max((F.col("up") > F.lit(1) - F.col("down")).cast("int"))).first()[0]


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long): root is the least node it is linked to.

    Each step sees every link once and joins by node, with the least neighbour found by partial
    aggregation; the number of steps grows with the logarithm of the longest chain.  Steps are
    written to the shared folder, so a lost executor repeats one step at most.

    ``known`` is the result for earlier links: the steps then see only links between its components,
    and its rows are renamed once.
    """
    if known is not None:
        of = lambda end: known.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        links = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        links = links.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage(edges, "links")
    if known is not None and edges.isEmpty():
        return known
    while not _settled(edges):
        edges = stage(_stars(_stars(edges, small=False), small=True), "links")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
    if known is None:
        return found
    moved = found.select(F.col("node").alias("root"), F.col("root").alias("to"))
    renamed = known.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stage(renamed.union(found.join(known, "node", "left_anti")), "roots")
