"""Shards from a weighted hash tree of regions, racks and shards.

Each leaf draws from a hash of the key and its own name an exponential waiting
time whose rate is its weight; an inner node's draw is the least of its
subtree's, which is again exponential, with the subtree's weight as its rate. A
key descends to the region, the rack and the shard with the least draw. A
changed weight changes no other leaf's draw, so keys move only into a subtree
whose weight grew or out of one whose weight shrank; one shard more takes keys
only into itself.

Everything is DataFrame expressions. Slots number a shard's rows without gaps:
rows are dealt to buckets by a hash, numbered in a bucket, and the buckets'
counts, summed up, give each bucket its first slot; no task sees a whole shard. Rows
that are equal throughout are numbered as one with a count, and written out in parts.

A null key is a key like others. Null text has no bytes. Repeated rows have a slot each,
rows of one shard and bucket are numbered by key and hash. Of equal draws the first
shard's counts. An empty table gives an empty result; columns beyond key and text are
not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.llm.common import Tables

SHARDS, RACKS_A_REGION, SHARDS_A_RACK, OVERHEAD = 40, 2, 5, 16
#: Rows that are numbered together, about.
BUCKET_ROWS = 20_000
#: Copies of one row that are written out together.
COPIES = 4096


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int = SHARDS, weights: dict[int, float] | None = None) -> list[Leaf]:
    """Leaves 0 to shards - 1, five to a rack and two racks to a region."""
    weights = weights or {}
    return [Leaf(s // (RACKS_A_REGION * SHARDS_A_RACK), s // SHARDS_A_RACK, s, weights.get(s, 1.0)) for s in range(shards)]


def draw(key: Column, leaf: Leaf) -> Column:
    """The leaf's waiting time for the key: -ln(u) / weight with u in (0, 1] from 52 bits of a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(leaf.shard), key), 12) + F.lit(1)) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(leaf.weight)


def least(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of the key: down from the root, at each level to the child with the least draw."""
    at = F.struct(*[draw(key, x).alias(f"s{x.shard}") for x in leaves if x.weight > 0])
    live = [x for x in leaves if x.weight > 0]

    def descend(draws: Column) -> Column:
        def level(nodes: list[list[Leaf]], below) -> Column:
            values = [least([draws[f"s{x.shard}"] for x in node]) for node in nodes]
            best, out = least(values), None
            for node, value in zip(nodes[::-1], values[::-1], strict=True):
                out = below(node) if out is None else F.when(value == best, below(node)).otherwise(out)
            return out

        def children(node: list[Leaf], part: str) -> list[list[Leaf]]:
            return [[x for x in node if getattr(x, part) == v] for v in sorted({getattr(x, part) for x in node})]

        shard = lambda node: F.lit(node[0].shard)
        rack = lambda node: level(children(node, "shard"), shard)
        region = lambda node: level(children(node, "rack"), rack)
        return level(children(live, "region"), region)

    return F.transform(F.array(at), descend)[0]


def assign(docs: DataFrame, shards: int = SHARDS, weights: dict[int, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        (F.octet_length("text").cast("long") + F.lit(OVERHEAD)).alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col("doc_id"), tree(shards, weights)).cast("int").alias("shard"),
        place(F.col("doc_id"), tree(shards + 1, weights)).cast("int").alias("grown_shard"),
        F.xxhash64("doc_id", "text", F.lit(7)).alias("h"),
    )
    tables = Tables(docs.sparkSession)
    # rows that are equal throughout are counted, so that a row that a third of all repeat is one until the end
    rows = tables.cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")))
    buckets = max(1, -(-(rows.agg(F.sum("copies")).first()[0] or 0) // (BUCKET_ROWS * shards)))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    first = counts.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["first"]).drop("n")
    before = F.sum("copies").over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "h", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1))
    numbered = tables.cut(rows.withColumn("before", F.coalesce(before, F.lit(0))).join(first, ["shard", "bucket"]).withColumn("slot", F.col("first") + F.col("before")).drop("first", "before", "bucket"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
    # a row's copies are written out in parts of COPIES, which are dealt to tasks
    many = numbered.filter("copies > 1").withColumn("part", parts).repartition("h", "part")
    inner = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(COPIES), F.col("copies") - F.col("part") * COPIES) - 1))
    many = many.withColumn("inner", inner).withColumn("slot", F.col("slot") + F.col("part") * COPIES + F.col("inner")).drop("part", "inner")
    out = numbered.filter("copies = 1").unionByName(many)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
