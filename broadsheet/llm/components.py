"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.scratch import Scratch


def connected(links: DataFrame) -> DataFrame:
    """``links``: a, b (bigint) -> node, root: every linked node and one common node of its component.

    Each round every node takes the smaller of itself and its least neighbour,
    looks one step further along those choices, and the links are drawn anew
    between what was chosen. A node that is not the least of its surroundings
    always goes, so at least half of the nodes with links go each round and the
    number of rounds grows with the logarithm of the longest path. All work is
    on rows of two numbers, in joins and minima combined on the map side. Null
    ends and links of a node to itself are ignored.
    """
    scratch = Scratch(links, "components")
    edges = scratch.keep(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    nodes = scratch.keep(
        edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    )
    while not edges.isEmpty():
        sides = edges.select(
            F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                              F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
        ).select("e.*")
        near = sides.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        near = scratch.keep(near)
        further = near.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        chosen = scratch.keep(near.join(further, "p").select("u", F.col("pp").alias("p")))
        moved = (
            edges.join(chosen.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a")
            .join(chosen.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
            .filter("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
        new_edges = scratch.keep(moved)
        new_nodes = scratch.keep(
            nodes.join(chosen.select(F.col("u").alias("root"), "p"), "root", "left")
            .select("node", F.coalesce("p", "root").alias("root"))
        )
        scratch.drop(near, chosen, edges, nodes)
        edges, nodes = new_edges, new_nodes
    scratch.drop(edges)
    return nodes
