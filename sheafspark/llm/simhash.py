"""SimHash fingerprints and the search for near ones, in DataFrame expressions only.

A text's terms are its pairs of neighbouring words; the last word stands with an
empty one, so a text of a single word has a term too. Each occurrence is hashed to 64 bits and votes, with its length up to
MOST_WEIGHT as its weight, for each bit that is set; a bit of the fingerprint is
set where more than half of all weight voted for it. Votes are counted two bits
to a long, so a row of the aggregation has 32 sums, and partial sums are made
before anything is shuffled.

near finds, for the fingerprints of a query set, all within a radius: the
fingerprint is cut into blocks, and a table for each holds that block as the key
of an equi-join, which a query meets with its own block and with all that differ
in a few bits. A pair that differs in more bits than that in every block differs
in more than the radius, so none is lost. Equal fingerprints are one row there.
The query takes NEAR_RADIUS, which holds 97 % of pairs of texts that share 0.80
to 0.85 of their five-word shingles, and more of the closer ones.

Null and empty texts have fingerprint 0. Words are runs without white space. Equal
texts have equal fingerprints, at any length; texts that no word pair tells apart (one
word of two spaces) may have as well. A bit with exactly half of the weight is not set.
Empty tables give empty results; columns beyond those asked for are not read.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIUS, BLOCKS, MOST_WEIGHT = 3, 4, 12
NEAR_RADIUS = 10
#: A long with its lowest bit and bit 32 set.
LANES = (1 << 32) | 1
WHITE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.split(F.regexp_replace(text, WHITE, " "), " ")


def votes(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, copies and fingerprint (long) of each distinct combination of keys, whose rows must have equal texts: rows that are the same are one, and copies says how many they were (their votes grow alike)."""
    w = F.col("_w")
    pairs = texts.select(*keys, words(F.coalesce(F.col(text), F.lit(""))).alias("_w")).select(*keys, F.posexplode(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(1))).alias("b"))).alias("_at", "_p")).select(*keys, "_at", "_p.a", "_p.b")
    b = F.coalesce("b", F.lit(""))
    weight = F.least(F.length("a") + F.length(b), F.lit(MOST_WEIGHT)).cast("long")
    rows = pairs.select(*keys, "_at", F.xxhash64("a", b).alias("_h"), weight.alias("_n"))
    sums = rows.groupBy(*keys).agg(F.sum((F.col("_at") == 0).cast("long")).alias("copies"), F.sum("_n").alias("_all"), *[F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(LANES)) * F.col("_n")).alias(f"_s{k}") for k in range(32)])
    out: Column = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"_s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_s{k}", 32)
        for bit, n in ((k, low), (k + 32, high)):
            out = out.bitwiseOR(F.when(n * 2 > F.col("_all"), F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, "copies", out.alias("fingerprint"))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 minus the share of bits that differ."""
    return (F.lit(64) - F.bit_count(a.bitwiseXOR(b))) / F.lit(64.0)


def _blocks(blocks: int) -> list[tuple[int, int]]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _block(fp: Column, at: int, end: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << (end - at)) - 1))


def near(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """query_fp, fp, distance: every pair of a query's and a corpus fingerprint (column fingerprint) at most radius bits apart, once."""
    # bits that may differ in each block: were there one more in each, the sum would be over the radius
    cuts = [(at, end, (radius + 1) // blocks - 1 + (i < (radius + 1) % blocks)) for i, (at, end) in enumerate(_blocks(blocks))]
    cuts = [(at, end, n) for at, end, n in cuts if n >= 0]

    def keyed(df: DataFrame, name: str, keys: list[Column]) -> DataFrame:
        """A row for each table and key: (table << 32) | block."""
        own = df.select(F.col("fingerprint").alias(name)).distinct()
        return own.select(name, F.posexplode(F.array(*keys)).alias("t", "k")).select(name, "t", F.explode("k").alias("k"))

    def masks(at: int, end: int, n: int) -> Column:
        return F.lit([sum(1 << b for b in c) for m in range(n + 1) for c in combinations(range(end - at), m)]).cast("array<long>")

    def probes(i: int, at: int, end: int, n: int) -> Column:
        own = _block(F.col("query_fp"), at, end)
        return F.transform(masks(at, end, n), lambda m: own.bitwiseXOR(m) + F.lit(i << 32))

    q = keyed(queries, "query_fp", [probes(i, *c) for i, c in enumerate(cuts)])
    c = keyed(corpus, "fp", [F.array(_block(F.col("fp"), at, end) + F.lit(i << 32)) for i, (at, end, _) in enumerate(cuts)]).drop("t")
    differ = F.col("query_fp").bitwiseXOR(F.col("fp"))
    first = F.lit(True)  # a pair comes from the first table in which it meets
    for i, (at, end, n) in enumerate(cuts[:-1]):
        first &= (F.col("t") <= i) | (F.bit_count(_block(differ, at, end)) > n)
    q, c = q.hint("merge").alias("q"), c.alias("c")  # a table is many times its fingerprints, by whose size a broadcast would be chosen
    return q.join(c, (F.col("q.k") == F.col("c.k")) & (F.bit_count(differ) <= radius) & first).select("query_fp", "fp", F.bit_count(differ).alias("distance"))


#: Parts that the rows of one key are dealt to where a key alone fills a range.
PARTS = 64


def ranges(keys: DataFrame, n: int, bucket_rows: int, most_buckets: int) -> list[tuple[int, bool]]:
    """Starts of ranges of the long column _k with about bucket_rows rows each, from quantiles of a sample (20 keys a range, 400,000 at most), and whether a range holds one key alone, which filled a range of the sample."""
    want = min(most_buckets, -(-n // bucket_rows))
    if want < 2:
        return []
    got = keys.filter("_k is not null").sample(False, min(1.0, 20 * want / n), 3).limit(40 * want).toArrow()["_k"].to_pylist()
    got.sort()
    cuts = [got[len(got) * i // want] for i in range(1, want)] if got else []
    starts = {c: False for c in cuts}
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            starts[a] = True
            starts.setdefault(a + 1, False)
    return sorted(starts.items())


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = 2000, most_buckets: int = 20_000) -> DataFrame:
    """key, text (null: empty) and next_text of each row: the next in ascending order of key (a null key first), of equal keys by a hash of the text, then the text; after the last the first.

    Rows are dealt to ranges of the order by quantiles of their keys, so no task sees all, however the keys lie; a key that
    fills a range alone is dealt to PARTS ranges by the hash. Only numbers of ranges meet in one task (most_buckets * PARTS at most);
    the row after a range's last is the first of the next range that has rows. Rows that are equal throughout stay together.
    """
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    n = rows.count()
    starts = ranges(rows.select("_k"), n, bucket_rows, most_buckets)
    part = F.pmod(F.xxhash64("_t"), F.lit(PARTS))
    at = F.lit(-1).cast("long")
    if starts:
        # the number of starts that are not over the key, by halving: one literal holds them all
        bounds = F.from_json(F.lit(json.dumps([s for s, _ in starts])), "array<long>")
        steps = F.lit([1 << i for i in range(len(starts).bit_length() - 1, -1, -1)])
        at = F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.coalesce(F.get(bounds, i + s - 1) <= F.col("_k"), F.lit(False)), i + s).otherwise(i)).cast("long")
    alone = [i + 1 for i, (_, one) in enumerate(starts) if one]
    rows = rows.withColumn("_p", part).withColumn("_a", F.when(F.col("_k").isNull(), F.lit(-1)).otherwise(at))
    deal = F.col("_p") if not alone else F.when(F.array_contains(F.from_json(F.lit(json.dumps(alone)), "array<long>"), F.col("_a")), F.col("_p")).otherwise(0)
    rows = rows.withColumn("_b", F.col("_a") * PARTS + (deal if alone else F.lit(0)))
    order = Window.partitionBy("_b").orderBy("_k", "_p", "_t")
    inner = rows.select("_k", "_t", "_b", F.lead("_t").over(order).alias("_nt"))
    heads = rows.groupBy("_b").agg(F.min(F.struct("_k", "_p", "_t")).alias("_first")).select("_b", F.col("_first._t").alias("_f"))
    ring = Window.orderBy("_b")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = rows.select("_b").distinct().select("_b", F.coalesce(F.lead("_b").over(ring), F.first("_b").over(whole)).alias("_nb"))
    following = after.join(heads.withColumnRenamed("_b", "_nb"), "_nb").select("_b", "_f")
    joined = inner.join(following, "_b")
    return joined.select(F.col("_k").alias(key), F.col("_t").alias("text"), F.coalesce("_nt", "_f").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many, or all, of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def repeated(rows: DataFrame, copies: str) -> DataFrame:
    """Each row as often as its column copies says, without that column; no array is longer than the root of it, about."""
    many = F.sequence(F.lit(1), F.floor((F.col(copies) + 4095) / 4096))
    rows = rows.withColumn("_i", F.explode(many)).withColumn("_left", F.least(F.lit(4096), F.col(copies) - (F.col("_i") - 1) * 4096))
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_left")))).drop("_i", "_left", copies)
