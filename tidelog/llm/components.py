"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import settle as materialise


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Per node of an edge: id and component, the smallest id that it reaches.

    Each step hangs nodes under the smallest neighbour; minima are aggregated before the shuffle, and joins on a node
    with many neighbours can be split, so no neighbourhood is gathered anywhere. Each half of a step is stored, so plans
    stay small. Self loops and nulls are ignored."""

    def hung(rows: DataFrame, upward: bool) -> DataFrame:
        """Of rows (u, v): v under the least of u's v and u; upward: only v above u, else u as well."""
        least = rows.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        linked = rows.join(least, "u")
        if upward:
            return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        both = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        return linked.select(both).select("e.u", "e.v").where("u <> v").distinct()

    def both_ways(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")

    def stars(rows: DataFrame) -> bool:
        """Whether each u has one edge, to a v that has none itself."""
        marks = rows.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.x", "e.up")
        return not marks.groupBy("x").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n")).where("ups > 1 OR ups = 1 AND n > 1").take(1)

    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not stars(edges):
        edges = materialise(hung(materialise(hung(both_ways(edges), True)), False))
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return materialise(nodes.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
