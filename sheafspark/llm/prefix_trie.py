"""The trie of conversations' prefixes, as a table of its nodes.

A conversation's prefix is known by two lanes of 64 bits, the exclusive or of hashes
that each turn has with its place, so prefixes add up over blocks of turns. The least
conversation that has a prefix owns its node; who owns a prefix owns the longer ones of
its own as well, so the owned depths are a stretch that reaches to the end, its chain.
Where it begins is found by halving: each round joins every block's middle depth with
the minima of prefixes that several conversations share. A block has BLOCK turns and is
searched by itself, so rounds don't grow with a conversation and no task gets one whole.

Chains hang on one another: a chain's first node has the owner of the depth above as its
parent. Totals of subtrees go up that tree by doubling: after k rounds a chain has the
totals of all chains less than 2^k links below it, so rounds are the logarithm of the
tree's height. Along a chain they are sums over blocks, then within them.

Rows without a conversation's number are left out: they are of no conversation. Turns are
in ascending order, null first, of equal ones by role, then the text's MD5; null role or
text is empty. Equal rows are turns. Turns are numbered in blocks of the turn column's
values, so a conversation of any length is dealt to many tasks unless one value of turn
has most of it. An empty table gives an empty result; columns beyond those named are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.llm.common import Tables, join_counted

#: Conversations that share their first turns with the first of their hundred, and how many turns fewer than.
GROUP, SHARED = 100, 6
#: Turns of a block of the search, and values of the turn column of a block of the numbering.
BLOCK, VALUES = 64, 1024
#: Bytes of one piece of a node's list of conversations.
PIECE_BYTES = 1 << 16


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place (from 1) in their conversation, and a row for each conversation: its turns, the turns it takes from the first of its group, and how many those are."""
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.floor(F.col("turn") / VALUES).alias("part"),
        F.coalesce("role", F.lit("")).alias("role"), F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("text"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
    ).withColumn("part", F.coalesce("part", F.lit(-(1 << 62))))
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    each = counts.groupBy("conv_id").agg(F.sum("n").alias("own"))
    first = each.select(F.col("conv_id").alias("host"), F.col("own").alias("host_own"))
    least = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % SHARED
    convs = each.withColumn("host", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", least).join(first, "host", "left")
    convs = convs.withColumn("taken", F.least(F.col("h"), F.coalesce("host_own", F.lit(0))).cast("long")).withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.withColumn("before", before).join(convs.select("conv_id", "h", "taken"), "conv_id").select("conv_id", "part", "before", "h", "taken")
    own = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", F.hex("text"))
    placed = rows.join(parts, ["conv_id", "part"]).withColumn("place", F.row_number().over(own) + F.col("before"))
    return placed, convs.select("conv_id", "host", "h", "taken", "length")


def rebuilt(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), role, text, chars of the turns of rebuilt conversations."""
    what = ["role", "text", "chars"]
    own = placed.filter("place > h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), *what)
    heads = placed.filter((F.col("conv_id") % GROUP == 0) & (F.col("place") < SHARED)).select(F.col("conv_id").alias("host"), F.col("place").alias("depth"), *what)
    return own.unionByName(convs.filter("taken > 0").join(heads, "host").filter("depth <= taken").select("conv_id", "depth", *what))


def _block(depth: Column) -> Column:
    return F.floor(depth / BLOCK)


def prefixes(turns: DataFrame, tables: Tables) -> DataFrame:
    """conv_id, block, start (the block's first depth), items: depth, the prefix's two lanes and the last turn's characters of each depth of the block."""
    a, b = F.xxhash64("depth", "role", "text"), F.xxhash64(F.lit(1), "text", "depth", "role")
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.withColumn("block", _block(F.col("depth"))).withColumn("a", a).withColumn("b", b)
    rows = rows.withColumn("a", F.bit_xor("a").over(within)).withColumn("b", F.bit_xor("b").over(within))
    item = F.struct("depth", "a", "b", "chars")
    blocks = tables.cut(rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(item)).alias("items")))  # at most BLOCK of them
    last = F.element_at("items", -1)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.select("conv_id", "block", last["a"].alias("a"), last["b"].alias("b"))
    carry = totals.select("conv_id", "block", F.bit_xor("a").over(earlier).alias("ca"), F.bit_xor("b").over(earlier).alias("cb")).filter("ca is not null")
    whole = blocks.join(carry, ["conv_id", "block"], "left").withColumn("ca", F.coalesce("ca", F.lit(0))).withColumn("cb", F.coalesce("cb", F.lit(0)))
    moved = F.transform("items", lambda x: F.struct(x["depth"].alias("depth"), x["a"].bitwiseXOR(F.col("ca")).alias("a"), x["b"].bitwiseXOR(F.col("cb")).alias("b"), x["chars"].alias("chars")))
    out = tables.cut(whole.select("conv_id", "block", F.get("items", F.lit(0))["depth"].alias("start"), moved.alias("items")))
    tables.drop(blocks)
    return out


def shared(blocks: DataFrame) -> DataFrame:
    """depth, a, b, owner, n: the prefixes that several conversations have, the least of them and their number."""
    rows = blocks.select("conv_id", F.explode("items").alias("i")).select("conv_id", "i.depth", "i.a", "i.b")
    return rows.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n")).filter("n > 1")


def first_owned(blocks: DataFrame, minima: DataFrame, most: int) -> DataFrame:
    """blocks with low, the first depth of the block that the conversation owns (one past its end for none), and above, the owner of the depth before low where that is another."""
    end = F.col("start") + F.size("items")
    state = blocks.withColumn("low", F.col("start")).withColumn("high", end).withColumn("above", F.lit(None).cast("long"))
    known = minima.select(F.col("depth").alias("md"), F.col("a").alias("ma"), F.col("b").alias("mb"), "owner")
    for _ in range(int(most).bit_length()):
        state = state.withColumn("mid", F.when(F.col("low") < F.col("high"), F.floor((F.col("low") + F.col("high")) / 2)))
        item = F.get("items", (F.col("mid") - F.col("start")).cast("int"))
        # a block that is done asks for no depth, and is dealt by its conversation so that such rows don't meet
        state = state.withColumn("pa", F.coalesce(item["a"], "conv_id")).withColumn("pb", item["b"])
        state = state.join(known.hint("merge"), (F.col("mid") == F.col("md")) & (F.col("pa") == F.col("ma")) & (F.col("pb") == F.col("mb")), "left")
        other = F.col("owner") != F.col("conv_id")
        state = state.select(
            "conv_id", "block", "start", "items",
            F.when(F.col("mid").isNotNull() & F.coalesce(other, F.lit(False)), F.col("mid") + 1).otherwise(F.col("low")).alias("low"),
            F.when(F.col("mid").isNotNull() & ~F.coalesce(other, F.lit(False)), F.col("mid")).otherwise(F.col("high")).alias("high"),
            F.when(other, F.col("owner")).otherwise(F.col("above")).alias("above"),
        )
    return state.select("conv_id", "block", "start", F.transform("items", lambda x: x["chars"]).alias("chars"), "low", "above")


def chains(found: DataFrame, convs: DataFrame, root: int | None) -> DataFrame:
    """conv_id, length, top (the first depth that it owns, over its length for none) and above, the owner of the depth before."""
    least = F.lit(root).cast("long")
    own = found.groupBy("conv_id").agg(
        F.min(F.when(F.col("low") < F.col("start") + F.size("chars"), F.col("low"))).alias("low"),
        F.max(F.when(F.col("above").isNotNull(), F.struct("block", "above"))).alias("last"),
    )
    rows = convs.select("conv_id", "length").join(own, "conv_id", "left")
    first = F.col("conv_id") == least
    return rows.select("conv_id", "length", F.when(first, 0).otherwise(F.coalesce("low", F.col("length") + 1)).cast("long").alias("top"), F.when(~first, F.coalesce("last.above", least)).alias("above"))


def subtree_totals(links: DataFrame, values: list[str], tables: Tables) -> DataFrame:
    """links (conv_id, above and values) with each value summed over the chain and all that hang on it, directly or not."""
    state = tables.cut(links.select("conv_id", "above", *values))
    while state.filter("above is not null").limit(1).count():
        sent = state.filter("above is not null").groupBy("above").agg(*[F.sum(v).alias(f"_{v}") for v in values], F.count("*").alias("rows"))
        sent = tables.cut(sent)
        up = sent.select("above", "rows").join(state.select(F.col("conv_id").alias("above"), F.col("above").alias("next")), "above")
        moved = join_counted(state.filter("above is not null").drop(*values), up, "above", "rows").select("conv_id", F.col("next").alias("above"))
        own = state.select("conv_id", *values).join(sent.drop("rows").withColumnRenamed("above", "conv_id"), "conv_id", "left").join(moved, "conv_id", "left")
        after = tables.cut(own.select("conv_id", "above", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]))
        tables.drop(state, sent)
        state = after
    return state


def ends_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256: the SHA-256 of each node's conversations (column conv_id), ascending, comma-joined.

    Rows are dealt to ranges of (node, conversation), so a node of very many is joined to pieces of PIECE_BYTES by many
    tasks; the pieces of a node then pass one task in their order, which holds one of them at a time.
    """
    dealt = ends.repartitionByRange("owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id")

    def pieces(batches):
        names = ["owner", "depth", "first", "ids"]
        node, first, held, size = None, None, [], 0
        for batch in batches:
            owner, depth, conv = (batch.column(c).to_numpy() for c in ("owner", "depth", "conv_id"))
            cuts = np.flatnonzero((np.diff(owner) != 0) | (np.diff(depth) != 0)) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(owner)], strict=True):
                if a == b:
                    continue
                own = (int(owner[a]), int(depth[a]))
                for at in range(a, b, PIECE_BYTES // 16):
                    part = conv[at : min(b, at + PIECE_BYTES // 16)].tolist()
                    if held and (own != node or size > PIECE_BYTES // 16):
                        out.append((*node, first, ",".join(held)))
                        held, size = [], 0
                    if not held:
                        node, first = own, part[0]
                    held.append(",".join(map(str, part)))
                    size += len(part)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=kind)
        if held:
            yield pa.RecordBatch.from_pydict(dict(zip(names, ([node[0]], [node[1]], [first], [",".join(held)]), strict=True)), schema=kind)

    kind = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    joined = dealt.mapInArrow(pieces, "owner long, depth long, first long, ids string")

    def hashes(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for owner, depth, ids in zip(batch.column("owner").to_pylist(), batch.column("depth").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node != (owner, depth):
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (owner, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(done.names, map(list, zip(*out, strict=True)), strict=True)), schema=done)
        if node:
            yield pa.RecordBatch.from_pydict(dict(zip(done.names, ([node[0]], [node[1]], [state.hexdigest()]), strict=True)), schema=done)

    done = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    return joined.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(hashes, "owner long, depth long, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node, from the root."""
    tables = Tables(conversations.sparkSession)
    placed, convs = numbered(conversations.select("conv_id", "turn", "role", "text"))
    convs = tables.cut(convs)
    root, everyone = convs.agg(F.min("conv_id"), F.count("*")).first()
    blocks = prefixes(rebuilt(placed, convs), tables)
    minima = tables.cut(shared(blocks))
    most = blocks.agg(F.max(F.size("items"))).first()[0] or 0
    found = tables.cut(first_owned(blocks, minima, most))
    tables.drop(blocks)
    chain = tables.cut(chains(found, convs, root))
    # nodes with how many have them; the root is the least conversation's
    at = F.explode(F.sequence(F.col("low"), F.col("start") + F.size("chars") - 1))
    own = found.filter(F.col("low") < F.col("start") + F.size("chars")).select("conv_id", "start", "chars", at.alias("depth")).select("conv_id", "depth", F.get("chars", (F.col("depth") - F.col("start")).cast("int")).alias("chars"))
    many = minima.select(F.col("owner").alias("conv_id"), "depth", "n")
    rows = own.join(many, ["conv_id", "depth"], "left").select("conv_id", "depth", F.coalesce("n", F.lit(1)).alias("n_convs"), ((F.coalesce("n", F.lit(1)) - 1) * F.col("chars")).alias("own_saved"))
    top = convs.filter(F.col("conv_id") == F.lit(root).cast("long")).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(everyone).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("own_saved"))
    rows = tables.cut(rows.unionByName(top))
    # chains and the totals of what hangs on them
    owning = chain.filter("top <= length")
    hung = owning.filter("above is not null").select(F.col("above").alias("conv_id"), (F.col("top") - 1).alias("length")).distinct().withColumn("inner", F.lit(1))
    base = owning.join(hung, ["conv_id", "length"], "left").join(rows.groupBy("conv_id").agg(F.sum("own_saved").alias("saved")), "conv_id", "left")
    links = base.select("conv_id", "above", F.when(F.col("inner").isNull(), 1).otherwise(0).cast("long").alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    totals = subtree_totals(links, ["leaves", "saved"], tables).drop("above")
    hanging = owning.filter("above is not null").join(totals, "conv_id").groupBy(F.col("above").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.count("*").alias("hung"), F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    tops = owning.select("conv_id", F.col("top").alias("depth"), F.lit(True).alias("is_top"), "above")
    last = owning.select("conv_id", F.col("length").alias("depth"), F.lit(True).alias("is_last"))
    owner = F.when(F.col("top") <= F.col("length"), F.col("conv_id")).otherwise(F.col("above"))
    ends = ends_digests(chain.select(owner.alias("owner"), F.col("length").alias("depth"), "conv_id")).withColumnRenamed("owner", "conv_id")
    key = ["conv_id", "depth"]
    rows = rows.join(hanging, key, "left").join(tops, key, "left").join(last, key, "left").join(ends, key, "left")
    hung_here = F.coalesce("hung", F.lit(0))
    rows = rows.select(
        *key, _block(F.col("depth")).alias("block"), "n_convs", "ends_sha256",
        F.when(F.col("is_top"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        (hung_here + F.when(F.col("is_last"), 0).otherwise(1)).cast("long").alias("n_children"),
        (F.coalesce("hung_leaves", F.lit(0)) + F.when(F.col("is_last") & (hung_here == 0), 1).otherwise(0)).alias("leaves"),
        (F.col("own_saved") + F.coalesce("hung_saved", F.lit(0))).alias("saved"),
    )
    rows = tables.cut(rows)
    # along a chain: sums of the deeper blocks, then of the deeper nodes of the block
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    carry = sums.select("conv_id", "block", F.sum("l").over(deeper).alias("below_leaves"), F.sum("s").over(deeper).alias("below_saved")).filter("below_leaves is not null")
    inner = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(carry, ["conv_id", "block"], "left")
    below = lambda v: (F.sum(v).over(inner) + F.coalesce(f"below_{v}", F.lit(0))).cast("long")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", below("leaves").alias("n_leaves"), below("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
