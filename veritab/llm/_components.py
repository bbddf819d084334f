"""Connected components of a graph that no machine could hold: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._core import released, staged


def _least(edges: DataFrame) -> DataFrame:
    """For each node u the smallest of itself and its neighbours v; combined before it is dealt out."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: longs (a, b). Rows (node, root): the smallest node reachable, for all nodes with a link."""
    n = links.count()
    edges = staged(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u > v").distinct(), "edges", n)
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # large star: each larger neighbour is tied to the smallest one
        large = both.filter("v > u").join(_least(both), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "edges", n)
        released(edges)
        # small star: a node and its smaller neighbours are tied to the smallest one
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = staged(small.filter("u > v").distinct(), "edges", n)
        released(large)
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = staged(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "components", 2 * n)
    released(edges)
    return out
