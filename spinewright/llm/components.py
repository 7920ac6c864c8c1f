"""Connected components of links between numbers, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of links (a, b), the smallest node that it is connected with.

    Each round moves every node's larger neighbours to its smallest one, then
    its smaller neighbours too; the rounds grow as the logarithm of the longest
    chain. Only minima are gathered for a node, so a node with many links
    does no harm. Self-links keep their node; empty links give no row.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars, before = written(ends, "links", short=True), None
    for _ in range(MAX_ROUNDS):
        now = stars.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == before:
            break
        before = now
        both = stars.union(stars.select("b", "a"))
        # Minima are written, so that the join deals a node with very many links anew.
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "links", short=True)
        large = both.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(stars.where(F.col("a") == F.col("b")))
        large = written(large.distinct(), "links", short=True)
        least = written(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "links", short=True)
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") > F.col("b"))
        stars = written(small.union(least.select("u", "m")).distinct(), "links", short=True)
    else:
        raise RuntimeError("the components haven't settled")
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b"))
    return nodes.groupBy("node").agg(F.min("component").alias("component"))
