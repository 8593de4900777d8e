"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.runtime import cut


def _smallest(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each node; combined before the shuffle, so a hub is no burden."""
    return pairs.groupBy("a").agg(F.min("b").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of `edges` (a, b: bigint, not null).

    Each round points every node at smaller nodes of its component and ends in stars
    after a number of rounds that grows with the logarithm of the longest chain. Stars are joined
    through their minimum, never gathered, and each round's edges are written out. Loops
    and repeated edges do no harm; no edges give no rows.
    """
    state = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    print_of = (F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    seen = state.agg(*print_of).first()
    while seen.n:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_smallest(both), "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        large = large.distinct()
        lows = _smallest(large)
        small = large.join(lows, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        state = cut(small.unionByName(lows.select("a", F.col("low").alias("b"))).distinct(), "edges")
        now = state.agg(*print_of).first()
        if now == seen:
            break
        seen = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
