"""Connected components of an undirected graph given as a table of edges, by
alternating large-star and small-star steps.

Each step is one aggregate (a node's smallest neighbour, combined map-side)
and one join back, which AQE splits for a hot node.  The edges of each round
are written to the shared checkpoint folder.  Edges are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.llm.common import write_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root for every node of ``edges`` (columns a, b) but the
    roots themselves; the root is the smallest node of its component."""
    now = write_table(edges.where("a <> b").select("a", "b").distinct(), "cc")
    mark = None
    while True:
        now = write_table(_small_star(_large_star(now)).distinct(), "cc")
        # Stars, when no right end is also a left end; a sum of hashes tells whether a round changed anything.
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
