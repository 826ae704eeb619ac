"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from tidemark.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node of `links` (a, b): root is the smallest node it reaches.

    Each round hangs neighbours on the smallest node known; a few rounds suffice,
    as distances shrink geometrically.  Every round is a table of at most as many
    rows as links, and nothing but its count and sum reaches the driver.
    """
    edges = written(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        edges = written(_small_star(_large_star(edges)), "stars")
    # All edges now lead from a node to its root.
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b"), F.col("b"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Edges lead from the larger node to the smaller.
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
