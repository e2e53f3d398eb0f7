"""Exact n-gram Jaccard join with grouped prefixes, as linked components.

A document's set is its distinct shingles of WORDS words, as 64-bit hashes; with
fewer words the whole sequence is one. Two documents link when
100 * |A and B| >= PERCENT * |A or B|; the result is each document's component.

1. Documents with equal sets are one node, named by a hash of the set.
2. Every linked pair shares at least l shingles among each side's n - ceil(0.8 n) + l
   lowest-hashed ones (l about n / 10). Those are counted: a shingle that only one
   node has there shows by least = greatest node. Nodes with too few shared ones
   have no partner and leave. This holds for the whole input, with no cap.
3. The rest, rarest shingle first, give each node its prefix. Nodes with equal
   prefixes and sizes are one group.
4. Groups meet in buckets (prefix shingle, size band). Pairs are not all emitted:
   in a bucket one pivot (first the one with the fewest shingles of its own,
   the likely original) is compared with every member of another component;
   components grow, buckets of a single component are done, and after ROUNDS
   pivots whatever cross-component pairs remain are all verified. So a group of
   copies costs its size, not its square, and no link between components is lost.
5. Components grow by alternating stars over the links between those that there are.

Null, empty and wordless texts have size 0 and are components of their own.
Repeated rows are documents like others. A row without a key links like others and is
never the smallest of its component: alone, or among such rows only, its component is
null. An empty table gives an empty result; columns beyond key and text are not read,
whatever their names; whole texts count at any length. There are no ties: a component
is named by its smallest key. Hashes of 64 bits stand for shingles; words are hashed
eight bytes a step under a key, and in a set of m distinct shingles two meet with
probability about m^2 / 2^65.

Keys that hold very many rows (a text of which a third of all rows are copies, a
component of as many nodes, a shingle that most nodes have) are joined by
``join_counted``, which doesn't deal them to one task. In the remainder (step 4) a bucket
of k groups can ask for k^2 / 2 pairs of groups, less those that sizes, places and
settled components rule out; that is what prefix filtering itself can't decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.common import ASCII_LOWER, Tables, join_counted, map_arrow, mix, spans_of, utf8, word_hash
from sheafspark.llm.components import components

WORDS, PERCENT, ROUNDS = 5, 80, 4
#: Bytes of keys up to which the list of remaining documents is broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 16 << 20

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_Q = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text."""
    data, offsets = utf8(texts)
    rows = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.int64)] * rows
    data = ASCII_LOWER[data]
    start, end, row = spans_of(_WORD[data], offsets)
    h = word_hash(data, start, end)
    counts = np.bincount(row, minlength=rows)
    first = np.cumsum(counts) - counts
    full = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        full = full * _Q + h[k : k + len(full)]
    full = mix(full).view(np.int64)
    out = []
    for a, n in zip(first.tolist(), counts.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(full[a : a + n - words + 1]))
        elif n:
            whole = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in h[a : a + n]:
                    whole = whole * _Q + x
            out.append(mix(np.array([whole], np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def signature(own: np.ndarray) -> int:
    """A hash of the whole set, whatever its order."""
    return int(mix(mix(own.view(np.uint64) + np.uint64(len(own))).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0])


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares with any partner, at least."""
    return -(-n * percent // 100)


def shared_needed(n: int, percent: int = PERCENT) -> int:
    """Shared ones that must show among the lowest-hashed: a partner may be as small as the least overlap."""
    return max(1, least_overlap(n, percent) // 10)


def lowest(n: int, percent: int = PERCENT) -> int:
    return min(n, n - least_overlap(n, percent) + max(1, n // 10))


def _sets(docs: DataFrame, words: int, percent: int, whole: bool) -> DataFrame:
    def make():
        def step(part):
            own = shingle_sets(part.column("_text"), words)
            cut = [s if whole else s[: lowest(len(s), percent)] for s in own]
            return {
                "doc_id": part.column("doc_id"),
                "text_hash": part.column("text_hash"),
                "n": [len(s) for s in own],
                "node": [signature(s) if len(s) else None for s in own],
                "shingles": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cut)]), pa.int32()), pa.array(np.concatenate(cut))),
            }

        return step

    return map_arrow(docs, make, "doc_id long, text_hash long, n long, node long, shingles array<long>")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, rounds: int = ROUNDS, detail: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs; with ``detail`` also text_hash (xxhash64 of its text) and component, which names its component even where keys are null or repeated (null where it has no words)."""
    tables = Tables(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")).withColumn("text_hash", F.xxhash64("_text"))
    low = tables.cut(_sets(docs, words, percent, False))
    of_doc = low.select("doc_id", "text_hash", "n", "node")
    # 2. nodes with enough shared shingles
    seen = low.select("node", F.explode("shingles").alias("h")).groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    alone = seen.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("alone"))
    # the Python rules lowest() and shared_needed() again, as expressions
    n = F.col("n")
    overlap = F.floor((n * percent + 99) / 100)
    head = F.least(n, n - overlap + F.greatest(F.lit(1), F.floor(n / 10)))
    nodes = of_doc.filter("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"))
    alive = tables.cut(nodes.join(alone, "node", "left").filter(head - F.coalesce("alone", F.lit(0)) >= F.greatest(F.lit(1), F.floor(overlap / 10))).select("doc_id"))
    links = None
    count = alive.count()
    if count:
        small = count * 8 <= BROADCAST_BYTES
        alive = alive.withColumnRenamed("doc_id", "_alive")
        chosen = docs.join(F.broadcast(alive) if small else alive, F.col("doc_id").eqNullSafe(F.col("_alive")), "left_semi")
        sets = tables.cut(_sets(chosen, words, percent, True).filter("n > 0").dropDuplicates(["node"]).select("node", "n", "shingles"))
        links = _links(sets, tables, percent, rounds)
    # 5. each document's component
    least = of_doc.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("m"), F.count("*").alias("docs"))
    if links is None:
        named = least.select("node", F.col("node").alias("component"), F.col("m").alias("component_id"), "docs")
    else:
        comp = tables.cut(least.join(links, "node", "left").withColumn("component", F.coalesce("component", "node")))
        first = comp.groupBy("component").agg(F.min("m").alias("component_id"), F.count("*").alias("nodes"))
        named = tables.cut(join_counted(comp.select("node", "component", "docs"), first, "component", "nodes"))
    # a document without words has no node
    found = join_counted(of_doc, named, "node", "docs", "left")
    out = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "component")
    return out if detail else out.drop("text_hash", "component")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stay where one of each component does: the one with the smallest key (no key comes last, of equal keys the smaller hash of the text); a row that is repeated stays once. Rows without words are all kept."""
    found = join(docs, key, text, detail=True, **options)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = found.filter("component is not null").groupBy("component").agg(F.min(order).alias("b")).select("component", "b.doc_id", "b.text_hash")
    copies = found.filter("component is not null").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("component", "doc_id", "text_hash")]
    kept = best.alias("b").join(copies.alias("c"), same).select(F.col("b.doc_id").alias("_k"), F.col("b.text_hash").alias("_h"), "copies")
    bare = found.filter("component is null").select(F.col("doc_id").alias("_k"), F.col("text_hash").alias("_h"), F.lit(0).cast("long").alias("copies")).distinct()
    kept = Tables(docs.sparkSession).cut(kept.union(bare))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("h"))
    rows = whole.join(kept, F.col("k").eqNullSafe(F.col("_k")) & (F.col("h") == F.col("_h")))
    once, more = rows.filter("copies < 2"), rows.filter("copies > 1").dropDuplicates(["k", "h"])
    return once.union(more).select("row.*")


def _links(sets: DataFrame, tables: Tables, percent: int, rounds: int) -> DataFrame:
    """node and component of the nodes that may link with another."""
    rows = sets.select("node", "n", F.explode("shingles").alias("h"))
    counted = rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    shared = join_counted(rows, counted.withColumn("rows", F.col("df")), "h", "rows").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))
    n = F.col("n")
    length = n - F.floor((n * percent + 99) / 100) + 1 - (n - F.size("s"))  # the prefix less those that nobody shares
    prefixes = tables.cut(shared.withColumn("k", length.cast("int")).filter("k > 0").select("node", "n", F.transform(F.slice("s", F.lit(1), F.col("k")), lambda x: x["h"]).alias("prefix")))
    lone = n - F.floor((n * percent + 99) / 100) + 1 - F.size("prefix")  # shingles that stand before the prefix: nobody shares them
    grouped = prefixes.withColumn("lone", lone).withColumn("g", F.xxhash64("n", "prefix"))
    groups = grouped.groupBy("g", "n", "lone").agg(F.min("node").alias("head"), F.first("prefix").alias("prefix"))
    members = tables.cut(grouped.join(groups.select("g", F.col("n").alias("gn"), "head"), "g").filter("n = gn").select("node", "n", "lone", F.col("head").alias("grp")))
    # partners' sizes differ by a factor of 100 / percent at most: they share a band or stand in neighbouring ones
    band = F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent + 1e-9)))
    tokens = groups.select(F.col("head").alias("grp"), n.alias("gn"), "lone", band.alias("b"), F.posexplode("prefix").alias("at", "h"))
    rest = (F.col("gn") - F.col("lone") - F.col("at")).alias("rest")  # shingles from this one on
    buckets = tables.cut(tokens.select("grp", "gn", rest, F.explode(F.array(F.xxhash64("h", "b"), F.xxhash64("h", F.col("b") + 1))).alias("bucket")))
    # a group's verified members have its head's component: stars already
    near = _verify(members.filter("node <> grp").select(F.col("grp").alias("a"), F.col("node").alias("b")), sets, percent)
    now = tables.cut(members.join(near.select(F.col("b").alias("node"), F.col("a").alias("c")), "node", "left").select("node", "n", "lone", "grp", F.coalesce("c", "node").alias("c")))
    for r in range(rounds + 1):
        state = now.groupBy("grp").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct(pivot_order(r).alias("o"), F.xxhash64("c", F.lit(r)).alias("x"), "node", "n", "c")).alias("p"))
        open_ = tables.cut(buckets.join(state, "grp").groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("p").alias("p")).filter("lo < hi").select("bucket", "p"))
        if open_.isEmpty():
            break
        inside = buckets.join(open_, "bucket")
        if r < rounds:
            met = inside.select("grp", F.col("p.node").alias("a"), F.col("p.n").alias("an"), F.col("p.c").alias("ac")).distinct()
            pairs = met.join(now, "grp").filter("c <> ac").select("a", "an", "ac", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("c").alias("bc"))
        else:  # the remainder: every pair of members of different components
            # components are told apart before members are listed, so that a group's size isn't squared
            kept = inside.join(state.select("grp", "lo", "hi"), "grp")
            one = kept.select("bucket", F.col("grp").alias("g1"), F.col("gn").alias("n1"), F.col("rest").alias("r1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
            two = kept.select("bucket", F.col("grp").alias("g2"), F.col("gn").alias("n2"), F.col("rest").alias("r2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
            # from its first common shingle on, a pair has at least the overlap that its sizes ask for
            apart = f"g1 <= g2 and least(lo1, lo2) < greatest(hi1, hi2) and {100 + percent} * least(r1, r2) >= {percent} * (n1 + n2) and 100 * least(n1, n2) >= {percent} * greatest(n1, n2)"
            pair = one.join(two, "bucket").filter(apart).select("g1", "g2").distinct()
            kinds = now.select("grp", "c").distinct()
            k1, k2 = (kinds.select(F.col("grp").alias(f"g{i}"), F.col("c").alias(f"c{i}")) for i in (1, 2))
            crossing = pair.join(k1, "g1").join(k2, "g2").filter("c1 <> c2 and (g1 < g2 or c1 < c2)")
            x = now.select(F.col("grp").alias("g1"), F.col("c").alias("c1"), F.col("node").alias("a"), F.col("n").alias("an"))
            y = now.select(F.col("grp").alias("g2"), F.col("c").alias("c2"), F.col("node").alias("b"), F.col("n").alias("bn"))
            pairs = crossing.join(x, ["g1", "c1"]).join(y, ["g2", "c2"]).select("a", "an", F.col("c1").alias("ac"), "b", "bn", F.col("c2").alias("bc"))
        fit = pairs.filter(f"100 * least(an, bn) >= {percent} * greatest(an, bn)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("ac", "bc").alias("ac"), F.greatest("ac", "bc").alias("bc")).distinct()
        # links between the components so far; what is inside one is settled
        links = tables.cut(_verify(fit, sets, percent, "ac", "bc").select(F.col("ac").alias("a"), F.col("bc").alias("b")).distinct())
        if not links.isEmpty():
            found = components(links, tables).withColumnRenamed("node", "c")
            last, now = now, tables.cut(now.join(found, "c", "left").select("node", "n", "lone", "grp", F.coalesce("component", "c").alias("c")))
            tables.drop(last)
    return now.select("node", F.col("c").alias("component"))


def pivot_order(r: int):
    """First the node with the fewest shingles of its own, which others are copies of, then any component."""
    return F.col("lone") / F.col("n") if r == 0 else F.lit(0.0)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, *keep: str) -> DataFrame:
    """Those of pairs (a, b) whose sets link, with the columns to keep."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").withColumn("i", both).filter(F.lit(100) * F.col("i") >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b", *keep)
