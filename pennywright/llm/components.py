"""Connected components of a graph that no task or driver holds whole."""

from pyspark.sql import DataFrame, functions as F

from pennywright.llm.shared import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the least of the node and its neighbours.

    Minima are combined before the shuffle; the join back is one that Spark can split where
    a node has very many neighbours.
    """
    ways = _both_ways(edges)
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return ways.filter("v > u").join(least, "u").select(
        F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its lesser neighbours to the least of them.  Here a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").filter("a <> m").select(
        F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for the nodes of edges (a, b).

    Large-star and small-star steps alternate until each component is a star around
    its least node; the number of rounds grows with the logarithm of the longest path.
    Each round is a table in the shared folder.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = written(edges.distinct(), "links")
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"),
                         F.sum(F.col("a").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            break
        seen = mark
        if not mark.n:
            break
        edges = written(_small_star(_large_star(edges)), "links")
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(edges.select(F.col("a").alias("node"), F.col("a")).distinct())
