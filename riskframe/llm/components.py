"""Connected components of a large graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import materialise


def _summary(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row.n, row.h


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    joined = both.join(least, "a").filter(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.least("least", "a").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    own = least.select("a", F.col("least").alias("b"))
    joined = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return joined.unionByName(own).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) of each node that has a link.

    ``links`` has bigint columns ``a`` and ``b`` and is read twice. Each round
    is written to the shared folder, so its lineage is one read long. The number of
    rounds grows with the logarithm of the graph; a node's neighbours are never gathered,
    only their least is, with map-side merging. NULL ends and self-links are ignored; no links give no rows.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = materialise(ordered.filter("a <> b").distinct(), "links")
    before = None
    while (now := _summary(links)) != before:
        before = now
        if now[0]:
            links = materialise(_small(_large(links)), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
