"""Connected components of a distributed edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.common import Tables


def components(edges: DataFrame, tables: Tables, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of each node in edges (a, b).

    Large stars link a node's larger neighbours to the smallest of its neighbourhood, small stars its smaller ones;
    the edges end as a star around each component's smallest node, which is when the rounds stop. Each round is a table
    in the shared folder, so lineage stays short. Raises rather than return unfinished work.
    """
    e = tables.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(most_rounds):
        if stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        last, e = e, tables.cut(small)
        tables.drop(last)
    raise RuntimeError("the components did not settle")


def stars(edges: DataFrame) -> bool:
    """Whether every u of the distinct edges (u, v) has one v and is no edge's v."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    return ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down")).filter("up + down > 1 and up > 0").isEmpty()
