"""Connected components of an edge table, in DataFrame operations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.sources import scratch


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung on the node's smallest neighbour."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return (both.join(least, "u").where("v > u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are hung on the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", "m")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of any comparable type to one row (node, component) for each
    node on an edge between two different nodes; component is the smallest node
    reachable. Loops, repeated edges and NULL ends are ignored, no edges give no rows.

    Alternates the two star steps until the edges stand still, which takes a number
    of rounds that grows with the logarithm of the node count. The minimum of a node
    with many edges is aggregated before the shuffle, and the join that hands it out
    is one that Spark splits where it is skewed. A round's table is written to the
    shared folder and removed after the next.
    """
    spark = edges.sparkSession
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    start = edges.where("a <> b").select(a, b).distinct()
    state, path = scratch.placed(start, "edges")
    mark = _mark(state)
    while mark[0]:
        following, next_path = scratch.placed(_small_star(_large_star(state)), "edges")
        next_mark = _mark(following)
        scratch.remove(spark, path)
        state, path = following, next_path
        if next_mark == mark:
            break
        mark = next_mark
    roots = state.select(F.col("b").alias("a"), "b").distinct()
    return state.union(roots).toDF("node", "component")
