"""Connected components of an edge table by alternating star contractions.

Every round links the neighbours of a vertex to its smallest neighbour; the
number of rounds grows with the logarithm of the longest path, and a round is
two aggregations (partial sums on the map side, so a hub vertex is no hot key)
and two joins (whose skewed partitions AQE can split). Rounds are written to
the shared folder; no vertex or edge reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) rows of one type -> (vertex, root) for every vertex with an edge to another; root is the smallest vertex
    reachable, itself included. Loops and repeated edges do no harm; an empty table gives no rows."""
    now = stored(edges.select("u", "v").where("u != v").distinct(), "edges")
    state = _state(now)
    while True:
        now = stored(_small_star(_large_star(now)), "star")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return stored(now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(roots), "components")
