"""The operators on small tables: nulls, empty and repeated rows, clashing names, empty tables."""

import hashlib
import random
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sheafspark.llm import components, flac, jaccard_join, packing, queries, sharding, simhash, toxicity
from sheafspark.llm.common import Tables, sampled

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim".split()
LONG = " ".join(f"{a}{b}" for a in WORDS for b in WORDS[:3])
ROWS = [(1, LONG), (2, LONG + " tail"), (3, None), (4, ""), (5, "one two"), (6, "one two"), (6, "one two"), (9, "ONE two"), (12, "x " * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, 5, "clash") for i, t in ROWS], "doc_id long, text string, lang string, source string, n long, node string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_jaccard_join(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()}
    assert {(i, c) for i, _, c in got} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5), (9, 5), (12, 12)}
    assert {n for i, n, _ in got if i in (3, 4)} == {0}
    assert jaccard_join.join(none).count() == 0


def test_jaccard_join_remainder(docs):
    """A hot group of near copies, bridges between groups and strangers: with no pivot rounds the remainder finds what brute force does."""
    base = [[f"{g}w{i}" for i in range(60)] for g in range(3)]
    texts = [base[0][:40] + [f"x{k}"] + base[0][40:] for k in range(25)]  # one inner word differs
    texts += [base[1] + [f"y{k}"] * (k % 7) for k in range(25)]  # tails of other lengths
    texts += [base[2][k:] for k in range(0, 30, 3)]  # a chain: only neighbours link
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in enumerate(texts)}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    want = {(i, len(sets[i]), least[i]) for i in sets}
    table = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    for rounds in (0, jaccard_join.ROUNDS):
        assert {tuple(r) for r in jaccard_join.join(table, rounds=rounds).collect()} == want


def test_toxicity_fit(docs):
    """The sample's terms come from the executors; the model is that of the plain function. Null and repeated rows are rows."""
    rows = [(i, None if i % 10 == 3 else f"you {'awful' if i % 3 == 0 else 'pleasant'} neighbour {i}", int(i % 3 == 0)) for i in range(150)]
    rows += rows[:5]
    table = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, toxic int")
    rows.sort(key=lambda r: (r[0], r[2]))
    a, b = toxicity.fit(table), toxicity.train([r[1] for r in rows], [r[2] for r in rows])
    assert (a.weight == b.weight).all() and (a.factor == b.factor).all() and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)
    blank = toxicity.fit(table.filter("false"))
    assert toxicity.predict(blank, pa.array(["you awful", "", None])).tolist() == [0, 0, 0]


def test_simhash(docs, none):
    def plain(t):
        w = " ".join((t or "").split(" ")).split(" ")
        votes, total = [0] * 64, 0
        for a, b in zip(w, w[1:] + [""], strict=True):
            h = xxhash.xxh64(b.encode(), xxhash.xxh64(a.encode(), 42).intdigest()).intdigest()
            n = min(len(a) + len(b), simhash.MOST_WEIGHT)
            total += n
            for k in range(64):
                votes[k] += n * (h >> k & 1)
        return sum(1 << k for k in range(64) if 2 * votes[k] > total)

    ids = [t for _, t in ROWS if t is None or not t.endswith(" ")]
    table = docs.sparkSession.createDataFrame(list(enumerate(ids)), "k int, text string")
    for r in simhash.votes(table, ["k"]).select("k", simhash.hexadecimal(F.col("fingerprint")).alias("f")).collect():
        assert int(r.f, 16) == plain(ids[r.k])
    assert simhash.with_next(none).count() == 0
    order = sorted((i, t or "") for i, t in ROWS)
    got = sorted((r.doc_id, r.text, r.next_text) for r in simhash.with_next(docs, bucket_rows=2).collect())
    assert got == sorted((*a, b) for a, (_, b) in zip(order, order[1:] + order[:1], strict=True))
    fps = docs.sparkSession.createDataFrame([(v,) for v in (0, 1, 7, 15, -1, 1 << 62)], "fingerprint long")
    near = {(r.query_fp, r.fp, r.distance) for r in simhash.near(fps, fps).collect()}
    values = (0, 1, 7, 15, -1, 1 << 62)
    assert near == {(a, b, d) for a in values for b in values if (d := bin((a ^ b) & (2**64 - 1)).count("1")) <= 3}


def test_simhash_near_is_whole(spark, tmp_path):
    """All near pairs of a wide radius; a query row names the other queries near it, copies share a group."""
    r = random.Random(6)
    values = [r.getrandbits(64) for _ in range(30)]
    values += [v ^ sum(1 << b for b in r.sample(range(64), n)) for v in values for n in range(1, 13)]
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint long")
    for radius, blocks in ((10, 4), (10, 3), (3, 4), (3, 5), (0, 4)):
        got = [(a % (1 << 64), b % (1 << 64), d) for a, b, d in simhash.near(table, table, radius, blocks).collect()]
        assert sorted(got) == sorted((a, b, d) for a in set(values) for b in set(values) if (d := (a ^ b).bit_count()) <= radius)
    words = [f"{a}{b}" for a in WORDS for b in WORDS]
    texts = {0: words, 100: words[:9] + ["other"] + words[10:], 200: words, 300: words[::-1], 7: words, 8: words[:-1]}
    spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x.doc_id: x for x in queries.op2_simhash(spark, str(tmp_path)).collect()}
    near = {i: {q.query_id: q.distance for q in x.near_queries} for i, x in rows.items()}
    prints = {i: int(x.fingerprint, 16) for i, x in rows.items()}
    assert {i: x.query_group for i, x in rows.items()} == {0: 0, 100: 100, 200: 0, 300: 300, 7: None, 8: None} and prints[0] != prints[100]
    assert near == {i: {q: d for q in (0, 100, 300) if q != i and (d := (prints[i] ^ prints[q]).bit_count()) <= simhash.NEAR_RADIUS} for i in texts}
    assert 100 in near[0] and near[200][0] == near[7][0] == 0


def test_sharding(docs, none):
    rows = sharding.assign(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = dict((i, t or "") for i, t in ROWS)
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 16, zlib.crc32(text[r.doc_id].encode())) for r in rows)
    assert sharding.assign(none).count() == 0
    ids = docs.sparkSession.range(4000).select(sharding.place(F.col("id"), sharding.tree(41)).alias("a"), sharding.place(F.col("id"), sharding.tree(42)).alias("b"), sharding.place(F.col("id"), sharding.tree(41, {7: 3.0})).alias("w"))
    got = ids.collect()
    assert all(r.b in (r.a, 41) for r in got) and all(r.w in (r.a, 7) for r in got)
    n = [sum(r.a == s for r in got) for s in range(41)]
    assert min(n) > 50 and sum(r.w == 7 for r in got) > 2 * n[7]


def test_packing(docs, none):
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r.start == 0 for r in rows) == len(ROWS)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
    assert packing.pack_documents(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_flac(docs, none):
    rows = flac.digest(flac.store(docs)).collect()
    for r, (_, t) in zip(sorted(rows, key=lambda r: r.doc_id), sorted(ROWS, key=lambda x: x[0]), strict=True):
        own = flac.payload(t)[0]
        assert r.payload_sha256 == hashlib.sha256(own).hexdigest() and r.tail_crc32 == zlib.crc32(own[-16:])
    blocks = flac.pcm_blocks(flac.store(docs.filter("doc_id = 12")), frames_a_block=4).orderBy("first_sample").collect()
    assert b"".join(b.pcm for b in blocks) == flac.payload("x " * 3000)[0] and [b.first_sample for b in blocks] == [768 * i for i in range(len(blocks))]
    assert flac.digest(flac.store(none)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Tables(spark)).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


def test_sample_of_many_rare_values(spark):
    """A share of its own for each of a thousand rare values: the expression's depth was their number, which overflowed the stack."""
    rows = spark.range(4000).select("id", F.concat(F.lit("l"), F.col("id") % 1000).alias("l"))
    assert sampled(rows, ["id"], 10, "l", 5).count() == 4000
