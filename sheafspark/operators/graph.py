"""Closures over tables of edges: what can be reached, and values taken over along chains. Any number of rows, any length of chain.

Each round is one job over stored tables, so plans don't grow, a lost executor costs a
round at most, and circles end: what has been seen is not walked again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.session import Stored


def known_edges(edges: DataFrame, members: DataFrame, doc: list[str], target: str, member: str) -> DataFrame:
    """edges without those whose target is none of their document's members; one without a target stays: it points out of the document."""
    names = members.select(*doc, F.col(member).alias(target)).distinct()
    return edges.join(names, [*doc, target], "left_semi").select(*edges.columns).unionByName(edges.filter(F.col(target).isNull()))


def reachable(edges: DataFrame, seeds: DataFrame, doc: list[str], source: str, target: str, node: str) -> DataFrame:
    """doc, node and hops of all that can be reached from seeds (doc and node, hops 0), each by the fewest edges.

    Semi-naive: a round follows only the edges of what the last round found, and keeps what no round had before; it ends
    with a round that finds nothing. Rounds are the longest of the shortest ways. Edges with a null end lead nowhere.
    """
    tables = Stored(edges.sparkSession)
    both = F.col(source).isNotNull() & F.col(target).isNotNull()
    ways = tables.cut(edges.filter(both).select(*doc, F.col(source).alias("_from"), F.col(target).alias(node)).distinct())
    last = tables.cut(seeds.filter(F.col(node).isNotNull()).select(*doc, node).distinct().withColumn("hops", F.lit(0)))
    seen, hops = last, 0
    while last.limit(1).count():
        hops += 1
        step = last.select(*doc, F.col(node).alias("_from")).join(ways, [*doc, "_from"]).select(*doc, node).distinct()
        last = tables.cut(step.join(seen.select(*doc, node), [*doc, node], "left_anti").withColumn("hops", F.lit(hops)))
        now = seen.unionByName(last)
        if hops % 8 == 0:  # the union of rounds is written anew at times, so that its plan stays short
            now = tables.cut(now)
        seen = now
    return seen


def inherit(nodes: DataFrame, key: str, parent: str, value: str, doc: list[str] | None = None) -> DataFrame:
    """doc, key and value: a node's own, else the nearest of those that it is based on, however far; of a circle without one null.

    Pointer doubling: in each round a node without a value takes its pointer's value, or else its pointer's pointer. So
    rounds are the logarithm of the longest chain, and each writes only the nodes that were open. A pointer to no node ends
    a chain; of several rows of a key the one with the greatest value counts. In circles without a value pointers never
    end; after the rounds that a chain of all rows would take, such nodes have none.
    """
    doc, tables = doc or [], Stored(nodes.sparkSession)
    own = nodes.select(*doc, F.col(key).alias("_k"), F.col(parent).alias("_p"), F.col(value).alias("_v")).filter("_k is not null")
    best = own.groupBy(*doc, "_k").agg(F.max(F.struct("_v", "_p")).alias("_x"))
    state = tables.cut(best.select(*doc, "_k", F.when(F.col("_x._v").isNull(), F.col("_x._p")).alias("_p"), F.col("_x._v").alias("_v")))
    done, rest, rounds = state.filter("_p is null"), state.filter("_p is not null"), state.count().bit_length() + 1
    while rounds and rest.limit(1).count():
        rounds -= 1
        # each node that is pointed at is looked up once, however many point at it
        asked = rest.select(*doc, F.col("_p").alias("_k")).distinct()
        up = done.unionByName(rest).join(asked, [*doc, "_k"], "left_semi").select(*doc, F.col("_k").alias("_p"), F.col("_p").alias("_np"), F.col("_v").alias("_nv"))
        moved = rest.select(*doc, "_k", "_p").join(up, [*doc, "_p"], "left")
        moved = tables.cut(moved.select(*doc, "_k", F.when(F.col("_nv").isNull(), F.col("_np")).alias("_p"), F.col("_nv").alias("_v")))
        done, rest = done.unionByName(moved.filter("_p is null")), moved.filter("_p is not null")
    return done.unionByName(rest).select(*doc, F.col("_k").alias(key), F.col("_v").alias(value))
