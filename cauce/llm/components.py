"""Connected components of a link table by repeated contraction, without
gathering a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cauce.llm.common import staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _simple(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected ``links`` (a, b); nodes of a
    component share the label, one of its nodes.

    Each round a node moves to its smallest neighbour, links are renamed to
    the new labels and those inside a label vanish; a chain of moves stays
    connected through an extra link. Each round's tables are written to the
    shared folder.
    """
    edges = staged(_simple(links), "edges")
    found = None
    while not edges.isEmpty():
        nearest = _both_ways(edges).groupBy("a").agg(F.min("b").alias("b"))
        moves = staged(nearest.select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "moves")
        further = moves.select(F.col("node").alias("to"), F.col("to").alias("next"))
        moves = staged(moves.join(further, "to").select("node", F.col("next").alias("to"), F.col("to").alias("via")), "jumps")
        now = moves.select("node", "to")
        found = now if found is None else staged(found.join(now.select(F.col("node").alias("to"), F.col("to").alias("then")), "to", "left")
                                                 .select("node", F.coalesce("then", "to").alias("to"))
                                                 .unionByName(now.join(found, "node", "left_anti")), "labels")
        renamed = (edges.join(now.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
                   .join(now.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")))
        chains = now.join(now.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select(F.col("to").alias("a"), F.col("next").alias("b"))
        edges = staged(_simple(renamed.unionByName(chains)), "edges")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    return found.select("node", F.col("to").alias("label"))
