"""Connected components of a graph given by its edges, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.staging import stage


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges, larger node first."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("u", "m").alias("m")), "least")
    return _oriented(both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    least = stage(edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "least")
    ties = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(ties.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component: its least node) for each node of edges (a, b: longs); nodes alone aren't listed.

    Every round replaces the edges by as many or fewer that join the same nodes, until all point to their component's least node. A node
    with many edges is one row of minima and one join key, whose partition adaptive execution may split, as both sides come from files.
    """
    edges = stage(_oriented(edges), "edges")
    mark = None
    for _ in range(most_rounds):
        edges = stage(_small_star(stage(_large_star(edges), "large")), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
