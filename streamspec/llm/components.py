"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamspec.llm.common import discard, materialise

#: Edges in a written partition, and partitions at least.
PART_ROWS, LEAST_PARTS = 100_000, 6


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for the nodes of edges a, b.

    Alternates two steps until nothing changes, after a number of rounds that follows the logarithm
    of the longest path: every node's larger neighbours are tied to its smallest one, then its
    smaller neighbours are. Each round is written to the shared folder. Smallest neighbours are
    aggregated in each task before they move, so a node with many neighbours is no hot key there.
    They are written before they are joined: both sides of the joins are then plain shuffles, whose
    large partitions Spark can split. Tables are written in as many files as their rows need, not
    in one for each shuffle partition: rounds on few edges are then short.
    """

    def small(df: DataFrame) -> DataFrame:
        """df in partitions for the edges that there are; no round has more than the one before."""
        return df.coalesce(max(LEAST_PARTS, mark[0] // PART_ROWS + 1))

    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, old = _mark(now), now
    while mark[0]:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(small(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))), "least")
        large = materialise(small(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()), "edges")
        low = materialise(small(large.groupBy("a").agg(F.min("b").alias("m"))), "least")
        tied = large.join(low, "a")
        now = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        last, now = old, materialise(small(now.distinct()), "edges")
        discard(last, least, large, low)  # what is kept of them is in the new edges
        old = now
        before, mark = mark, _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
