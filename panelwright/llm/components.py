"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelwright.llm.shared import stored


def _links(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v, each once."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked with the node's smallest neighbour."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("least", "u").alias("least"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    return links.join(least, "u").select(F.col("v").alias("a"), F.col("least").alias("b")).union(least.select("u", "least"))


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots; root is the smallest id of the component.

    Each step writes its links to the shared folder, so lineage stays short. A step is repeated
    until the links are stars; their number of rows never exceeds that of the edges plus the nodes.
    """
    links = stored(_links(edges))
    before = _digest(links)
    while before[0]:
        links = stored(_links(_small_star(_links(_large_star(links)))))
        after = _digest(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
