"""Connected components of an edge table by alternating large and small stars.

Each step points every node's neighbours at the smallest node it knows of; stars of depth one are left after a number of steps
that grows with the logarithm of the longest chain. Edges and labels stay distributed; hot nodes are joined, never grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import gathered, release, staged

# Edges (16 bytes) of one task, about: steps end in as many tasks as the edges need, which no step makes more.
TASK_EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b), longs: component is the smallest node that can be reached.

    Loops, repeated and reversed edges are allowed; edges with a null end are left out. A node without any edge to another
    has no row. Empty input: empty result.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, _, tasks = gathered(staged(edges), TASK_EDGES)
    while not _stars(edges, tasks):
        edges = staged(_small_star(_large_star(edges).coalesce(tasks)).coalesce(tasks))
        release(edges.sparkSession)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """Each edge (a, b) as it is and reversed, in one reading."""
    turned = F.array(F.struct("a", "b", F.lit(True).alias("up")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(False).alias("up")))
    return edges.select(F.explode(turned).alias("e")).select("e.a", "e.b", *(f"e.{name}" for name in extra))


def _stars(edges: DataFrame, tasks: int) -> bool:
    """Whether each node hangs on one other that hangs on none."""
    lower = F.when(F.col("up"), F.col("b"))
    seen = _both_ways(edges, "up").groupBy("a").agg(F.min(lower).alias("low"), F.max(lower).alias("high"), F.min("up").alias("u0"), F.max("up").alias("u1"))
    return seen.where("low <> high OR u0 <> u1").coalesce(tasks).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges that all point from a larger to a smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return hung.where("a <> b").distinct()
