"""Connected components of links by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


#: At most so many nodes count as hot, and those only from a thousand edges on.
HOT_NODES = 5000
#: So many edges may meet in one task; below, no node is looked for that has too many.
FEW = 200_000


def _least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours; ``total`` is an upper bound of their number.

    The leasts of hot nodes are broadcast (at most ``HOT_NODES`` rows, by their number of edges), so that the edges of
    a star stay where they are; only the others are joined by a shuffle.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    if total <= FEW:
        return edges.join(least.select("u", "m"), "u")
    limit = max(1000, total // HOT_NODES)
    hot = least.where(F.col("n") >= limit).select("u", F.col("m").alias("hot"))
    marked = edges.join(F.broadcast(hot), "u", "left")
    cold = marked.where("hot is null").select("u", "v").join(least.where(F.col("n") < limit).select("u", "m"), "u")
    return cold.select("u", "v", "m").unionByName(marked.where("hot is not null").select("u", "v", F.col("hot").alias("m")))


def _round(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _least(small, 2 * total)
    return star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (the least node reachable) for every node in a link between different nodes.

    Each round writes its edges to the scratch folder. It ends when a round leaves count and checksum of the edges as
    they were, which holds once every node points at the least of its component.
    """
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        edges = written(_round(edges, now[0]), "edges")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return nodes.groupBy("node").agg(F.min("component").alias("component"))
