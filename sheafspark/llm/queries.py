"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.llm import byte_bpe, fill_middle, flac, jaccard_join, language_id, main_text, packing, pii, prefix_trie, sharding, simhash, token_counts, toxicity
from sheafspark.llm.common import Tables, join_counted, read_table


@lru_cache(1)
def labeller() -> main_text.Labeller:
    return main_text.train()


@lru_cache(1)
def network() -> pii.Network:
    return pii.train()


def remainder(key: str, by: int):
    return F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(by))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read_table(spark, sf_dir, "pages"), labeller())


def near_queries(groups: DataFrame, corpus: DataFrame) -> DataFrame:
    """fingerprint and near of corpus: the (query_id, distance) of all query fingerprints (columns fingerprint and query_group) within NEAR_RADIUS, nearest first."""
    found = simhash.near(groups, corpus, simhash.NEAR_RADIUS).join(groups.withColumnRenamed("fingerprint", "query_fp"), "query_fp")
    each = F.struct(F.col("distance").cast("int").alias("distance"), F.col("query_group").alias("query_id"))
    near = found.groupBy(F.col("fp").alias("fingerprint")).agg(F.array_sort(F.collect_list(each)).alias("near"))
    return near.select("fingerprint", F.transform("near", lambda x: F.struct(x["query_id"].alias("query_id"), x["distance"].alias("distance"))).alias("near"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents. A row is known by its key, its text and the next one's (two hashes each), null key or not; rows that are equal in all of them are computed once and given back as often as they were."""
    tables, name = Tables(spark), lambda x: [F.xxhash64(x).alias(f"{x}_1"), F.xxhash64(F.lit(1), x).alias(f"{x}_2")]
    own, nxt = ["text_1", "text_2"], ["next_text_1", "next_text_2"]
    rows = simhash.with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.select("doc_id", *name("text"), *name("next_text"), "text", simhash.edited(F.col("text"), F.col("next_text")).alias("edited"))
    one = ["doc_id", *own, *nxt]
    version = lambda i, c: F.struct(F.lit(i).alias("v"), F.col(c).alias("text"), (F.sha2(F.encode(F.col(c), "UTF-8"), 256) if i else F.lit(None).cast("string")).alias("sha"), F.length(c).cast("long").alias("n"))
    versions = rows.select(*one, F.explode(F.array(version(0, "text"), version(1, "edited"))).alias("e")).select(*one, "e.*")
    prints = simhash.votes(versions, [*one, "v", "sha", "n"])
    when = lambda v, c: F.max(F.when(F.col("v") == v, F.col(c)))
    prints = tables.cut(prints.groupBy(*one).agg(F.max("copies").alias("copies"), when(0, "n").alias("n_chars"), when(0, "fingerprint").alias("fingerprint"), when(1, "sha").alias("edited_sha256"), when(1, "fingerprint").alias("edited_fp")))
    # the next document's fingerprint, by its text; a text that many rows have is a hot key
    following = prints.groupBy(*own).agg(F.max("fingerprint").alias("next_fp"))
    asked = prints.groupBy(F.col("next_text_1").alias("text_1"), F.col("next_text_2").alias("text_2")).agg(F.count("*").alias("rows"))
    key = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b")).alias("next")
    following = asked.join(following, own).select(key(*own), "next_fp", "rows")
    joined = join_counted(prints.select("doc_id", "copies", "n_chars", "fingerprint", "edited_sha256", "edited_fp", key(*nxt)), following, "next", "rows").drop("next")
    # near queries, by distinct fingerprint
    fps = prints.groupBy("fingerprint").agg(F.count("*").alias("rows"), F.min(F.when(F.col("doc_id") % 100 == 0, F.col("doc_id"))).alias("query_group"))
    near = near_queries(fps.filter("query_group is not null").select("fingerprint", "query_group"), fps.select("fingerprint"))
    joined = join_counted(joined, fps.join(near, "fingerprint", "left").select("fingerprint", "query_group", "near", "rows"), "fingerprint", "rows")
    others = F.coalesce(F.filter("near", lambda x: x["query_id"] != F.coalesce("doc_id", F.lit(-1))), F.array().cast("array<struct<query_id:bigint,distance:int>>"))  # nothing is near itself
    out = joined.select(
        "doc_id", "n_chars", "edited_sha256", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), simhash.hexadecimal(F.col("edited_fp")).alias("edited_fingerprint"),
        simhash.likeness(F.col("fingerprint"), F.col("edited_fp")).alias("near_edited"), simhash.likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.col("query_group")).alias("query_group"), F.size(others).alias("n_near_queries"), others.alias("near_queries"), "copies",
    )
    return simhash.repeated(out, "copies")


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digest(Tables(spark).cut(flac.store(read_table(spark, sf_dir, "documents"))))


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.fit(docs.filter(remainder("doc_id", 5) != 0))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = docs.select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    return language_id.identify(held, language_model(docs), ("doc_id", "held_out"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = read_table(spark, sf_dir, "labels").filter(remainder("doc_id", 4) != 2).select("doc_id", "toxic")
    return toxicity.fit(read_table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out"))
    return toxicity.score(docs, toxicity_model(spark, sf_dir), ("doc_id", "held_out"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read_table(spark, sf_dir, "documents"), network())
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256", "spans")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(read_table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call has a cache of its own, so all there is to encode is encoded."""
    cache = token_counts.Cache(spark, f"{Tables(spark).base}/counts")
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(read_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_main_text, op2_simhash, op3_flac, op4_hash_tree, op5_byte_bpe, op6_language, op7_toxicity, op8_jaccard_join, op9_best_fit, op10_pii, op11_fill_middle, op12_token_counts, op13_prefix_trie)}

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), reps AS (
  SELECT list_sort(s) AS s, min(doc_id) AS r, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL
), sh AS (
  SELECT r, n, unnest(s) AS g FROM reps
), inter AS (
  SELECT a.r AS a, b.r AS b, a.n AS an, b.n AS bn, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.r < b.r GROUP BY ALL
), link AS (
  SELECT a, b FROM inter WHERE 100 * i >= 80 * (an + bn - i)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link UNION SELECT r, r FROM reps
), reach(x, y) AS (
  SELECT a, b FROM edge UNION SELECT reach.x, edge.b FROM reach JOIN edge ON reach.y = edge.a
), comp AS (
  SELECT x, min(y) AS c FROM reach GROUP BY x
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(comp.c, sets.doc_id) AS component_id
FROM sets LEFT JOIN reps ON list_sort(sets.s) = reps.s LEFT JOIN comp ON comp.x = reps.r
"""

FILL_MIDDLE_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS g FROM documents
), h AS (
  SELECT doc_id, t, w, len(w) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(g, i, 8))::BIGINT) AS h FROM u
), f AS (
  SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM h
), c AS (
  SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""

TRIE_SQL = r"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL
), sums AS (
  SELECT c, count(*) AS n, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda r, x: list_reduce(list_prepend(xor(r, x), range(8)), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)) AS r FROM own GROUP BY c
), convs AS (
  SELECT s.c, s.n, xor(s.r, 4294967295) % 6 AS h, s.c - s.c % 100 AS host, least(xor(s.r, 4294967295) % 6, coalesce(t.n, 0)) AS taken FROM sums s LEFT JOIN sums t ON t.c = s.c - s.c % 100
), turns AS (
  SELECT convs.c, taken + pos - h AS depth, role, text FROM convs JOIN own USING (c) WHERE pos > h
  UNION ALL SELECT convs.c, pos, role, text FROM convs JOIN own ON own.c = host WHERE pos <= taken
), pref AS (
  SELECT c, depth, string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY c ORDER BY depth) AS k, length(text) AS chars FROM turns UNION ALL SELECT c, 0, '', 0 FROM convs
), lens AS (
  SELECT c, max(depth) AS len FROM pref GROUP BY c
), node AS (
  SELECT k, depth, min(c) AS c, count(*) AS n, (count(*) - 1) * max(chars) AS saved FROM pref GROUP BY k, depth
), kids AS (
  SELECT left(k, 32 * (depth - 1)) AS k, count(*) AS kids FROM node WHERE depth > 0 GROUP BY 1
), one AS (
  SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (k)
), up AS (
  SELECT p.k, sum(CASE WHEN one.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum(one.saved) AS saved FROM one JOIN pref p ON p.c = one.c AND p.depth <= one.depth GROUP BY p.k
), ends AS (
  SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM pref JOIN lens USING (c) WHERE depth = len GROUP BY k
)
SELECT one.c AS conv_id, CAST(one.depth AS BIGINT) AS depth, par.c AS parent_conv_id, one.n AS n_convs, one.kids AS n_children, CAST(up.leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM one JOIN up USING (k) LEFT JOIN ends USING (k) LEFT JOIN node par ON one.depth > 0 AND par.k = left(one.k, 32 * (one.depth - 1))
"""

ORACLE_SQL = {"op8_jaccard_join": JACCARD_SQL, "op11_fill_middle": FILL_MIDDLE_SQL, "op13_prefix_trie": TRIE_SQL}
