"""Connected components of a large sparse graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthbook.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node with a link to another one, and the smallest node it reaches.

    edges has two columns of one orderable type, src and dst; direction, repeats and loops
    don't matter, rows with a null end are no link. Each round replaces the links by links
    to smaller neighbours, writes them to the shared folder, and stops when a round changes
    nothing; every component is then a star. A hub's links are never gathered: minima are
    combined before the shuffle, and the join on the hub can be split by adaptive execution.
    An empty table gives an empty table.
    """
    links = edges.select(
        F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("root")
    ).where("src IS NOT NULL AND dst IS NOT NULL AND node != root").distinct()
    links = written(links, "links")
    before = _digest(links)
    while True:
        last, links = links, written(_small_star(_large_star(links)), "links")
        discard(last)
        now = _digest(links)
        if now == before:
            return links
        before = now


def _digest(links: DataFrame) -> tuple:
    return tuple(
        links.agg(
            F.count("*"), F.expr("bit_xor(xxhash64(node, root))"),
            F.sum(F.expr("xxhash64(node, root, 1)").cast("decimal(20,0)")),
        ).first()
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("root"), F.col("node")))
    least = both.groupBy("node").agg(F.min("root").alias("low"))
    return (
        both.where("root > node")
        .join(least, "node")
        .select(F.col("root").alias("node"), F.least("node", "low").alias("root"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("node").agg(F.min("root").alias("low"))
    rest = links.join(least, "node").where("root != low").select(F.col("root").alias("node"), F.col("low").alias("root"))
    return rest.union(least).distinct()
