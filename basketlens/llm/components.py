"""Connected components of a graph whose edges are a distributed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import saved


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest id reachable.

    Roots themselves and nodes without an edge have no row. Alternating large and small
    stars: every node hands its smallest neighbour first to its larger neighbours, then
    to its smaller ones, until the edges are stars. Each round is saved, so lineage
    stays short. The minima are saved as well: a join of two scans can be split where
    one node has very many neighbours.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    now = saved(pairs.distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = saved(both.groupBy("node").agg(F.least("node", F.min("root")).alias("least")), "least")
        # Large star: every larger neighbour of a node goes to the node's minimum.
        larger = now.select(F.col("root").alias("node"), F.col("node").alias("larger"))
        large = (
            larger.join(least, "node")
            .select(F.col("larger").alias("node"), F.col("least").alias("root"))
            .distinct()
        )
        large = saved(large, "large-star")
        # Small star: a node's smaller neighbours go to the smallest of them.
        least = saved(large.groupBy("node").agg(F.min("root").alias("least")), "least")
        moved = (
            large.join(least, "node")
            .filter("root <> least")
            .select(F.col("root").alias("node"), F.col("least").alias("root"))
        )
        now = saved(moved.unionByName(least.withColumnRenamed("least", "root")).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now
