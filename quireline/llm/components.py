"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.llm.scratch import cut, drop, recorded


def _drawn(node: str, turn: int) -> Column:
    """A node behind its draw of a round: the order in which nodes are preferred, another one each round."""
    return F.struct(F.xxhash64(F.col(node), F.lit(turn)).alias("draw"), F.col(node).alias("node"))


def contractions(edges: DataFrame) -> list[DataFrame]:
    """For each round a table (a, p): the nodes that still had links, and the neighbour (or itself) that each became.

    In each round every node points to the one of least draw among itself and its neighbours, links
    are redrawn between the nodes pointed to, and links inside one such node and repeats vanish. As
    draws are made anew in each round, the nodes left fall by a constant share in the mean whatever
    the links look like (on a chain by half), so rounds grow with the logarithm of the nodes.
    Both sides of each join are tables just read, so adaptive execution can split a node with very
    many links.
    """
    spark = edges.sparkSession
    rounds: list[DataFrame] = []
    with recorded() as made:
        edges = cut(edges.select("a", "b").where("a <> b").distinct(), "links")
    while not edges.isEmpty():
        turn, before = len(rounds), made
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(_drawn("b", turn)).alias("m"))
        points = cut(least.select("a", F.least(_drawn("a", turn), F.col("m")).node.alias("p")), "points")
        left = points.select(F.col("a"), F.col("p").alias("pa"))
        right = points.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        redrawn = edges.join(left, "a").join(right, "b").where("pa <> pb")
        with recorded() as made:
            edges = cut(redrawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        drop(spark, before)
        rounds.append(points)
    drop(spark, made)
    return rounds


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges(a, b)`` that has a link to another; a component is named by its smallest node."""
    spark = edges.sparkSession
    node_type = edges.schema["a"].dataType.simpleString()
    with recorded() as made:
        roots = None  # (node, root) of the nodes of the rounds done so far, the last round first
        for points in reversed(contractions(edges)):
            named = points.select(F.col("a").alias("node"), F.col("p").alias("root"))
            if roots is not None:
                later = roots.select(F.col("node").alias("_at"), F.col("root").alias("_root"))
                named = named.join(later, named.root == later["_at"], "left").select("node", F.coalesce("_root", "root").alias("root"))
            roots = cut(named, "roots")
        if roots is not None:
            names = roots.groupBy("root").agg(F.min("node").alias("component"))
    if roots is None:
        return spark.createDataFrame([], f"node {node_type}, component {node_type}")
    out = cut(roots.join(names, "root").select("node", "component"), "components")
    drop(spark, made)
    return out
