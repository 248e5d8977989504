"""Connected components by contraction, one small job per round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import written


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is one node of the component.

    Every round gives the nodes a fresh order, by a hash of node and round. Each
    node takes the first of itself and the nodes next to it as its label, and
    the links between equal labels vanish. Under a random order the labels left
    are a constant share of the nodes, so the rounds are a logarithm of the
    longest chain, in whatever order its ids are. First nodes combine before the
    shuffle, so a node with very many links sends one row per task. Each round is
    written to the shared folder, which also cuts the lineage. An empty table
    of links gives an empty result; loops and repeated links do no harm.
    """
    edges = written(links.filter("a <> b").select("a", "b").distinct(), "links")
    rounds = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )

        def placed(name: str, turn: int = len(rounds)) -> Column:
            return F.struct(F.xxhash64(F.lit(turn), name).alias("place"), F.col(name).alias("root"))

        labels = written(
            both.groupBy("node").agg(F.min(placed("near")).alias("near"))
            .select("node", F.least(placed("node"), "near")["root"].alias("root")),
            "labels",
        )
        rounds.append(labels)
        edges = written(
            edges.join(labels.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
            .join(labels.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
            .filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def follow(later: DataFrame, earlier: DataFrame) -> DataFrame:
        end = later.select(F.col("node").alias("root"), F.col("root").alias("end"))
        return earlier.join(end, "root", "left").select("node", F.coalesce("end", "root").alias("root"))

    return reduce(follow, reversed(rounds))
