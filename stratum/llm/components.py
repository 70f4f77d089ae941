"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import Cut


def components(edges: DataFrame, cut: Cut, name: str = "components") -> DataFrame:
    """node, component (the smallest node that can be reached) of every node of edges (a, b).

    Alternates large stars and small stars: each node's larger neighbours, then its smaller ones and itself, are
    joined to the smallest node around. The edges never grow in number, rounds are about logarithmic in the
    diameter, and every step is a minimum by key, which sums up partially, and an equi-join. Edges are written
    after each round, so lineage is short and a lost executor costs one round at most.
    """
    current = cut.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    if current.isEmpty():
        return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        current = cut.write(pairs, name)
        # Done once every node has one neighbour, and none of the neighbours has one below it.
        once = current.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        chained = current.select(F.col("u").alias("v")).distinct()
        if once.where("n > 1").isEmpty() and current.join(chained, "v", "left_semi").isEmpty():
            roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
