"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean


def components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs); root is the component's least node.

    Each step takes minima of neighbours (combined before the shuffle) and joins them back; no
    neighbourhood is gathered in one place. The rounds grow with the logarithm of the size. They end
    when a round leaves the edges as they were; if none of ``rounds`` does, that is an error. Edges
    with a null end and loops are passed over, repeated edges count once; no edges give no rows.
    """
    hi, lo = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = edges.where("a <> b").select(hi, lo).distinct().checkpoint()
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long"))).first())
    seen = mark(edges)
    settled = not seen[0]
    for _ in range(rounds):
        if settled:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, edges = edges, small.where("u <> v").distinct().checkpoint()
        del both, least, large, small
        clean(edges.sparkSession)
        now = mark(edges)
        # marks that differ rule equality out; where they agree, sets of as many distinct edges are equal if none is missing
        settled = now == seen and before.join(edges, ["u", "v"], "left_anti").isEmpty()
        seen = now
        del before
    if not settled:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    least = edges.groupBy("u").agg(F.min("v").alias("root"))
    roots = edges.select(F.col("v").alias("node")).distinct().join(least.select(F.col("u").alias("node")), "node", "left_anti")
    return least.select(F.col("u").alias("node"), "root").union(roots.select("node", F.col("node").alias("root")))
