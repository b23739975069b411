"""Connected components by alternating large and small stars, each step a plan of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_hot
from .storage import stored

#: Steps grow with the logarithm of the longest path; so many would do for paths beyond any table.
MOST_STEPS = 200


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """(a, b) with the least of a and its neighbours b; the minimum is taken before the shuffle and
    sent to the rows of a hub, which stay where they are."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree"))
    return join_hot(edges, least, "a", "degree", rows).select("a", "b", "m")


def _large(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * rows).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found = _with_least(down, rows)
    return found.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(found.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component. An
    error if the steps don't come to an end."""
    now = stored(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    rows, seen = now.count(), None
    for _ in range(MOST_STEPS if rows else 0):
        # a large star has an edge for each of its edges at most, a small one two
        now = stored(_small(stored(_large(now, rows), "stars"), rows), "stars")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        rows = state[0]
        if state == seen:
            break
        seen = state
    else:
        if rows:
            raise RuntimeError(f"components are not complete after {MOST_STEPS} steps")
    # roots point at themselves
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
