"""Queries over order: numbering, lists, runs, captions, promotion, pairing, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.operators import documents as D
from sheafspark.operators import graph
from sheafspark.operators import sequences as S
from sheafspark.plans.common import Register, table

register = Register()


@register("""WITH h AS (SELECT r_regionkey AS r, -1 AS n, r_name AS t, 1 AS level FROM region UNION ALL SELECT n_regionkey, n_nationkey, n_name, 2 FROM nation), w AS (SELECT *, dense_rank() OVER (ORDER BY r) AS a, row_number() OVER (PARTITION BY r ORDER BY n) - 1 AS b FROM h)
SELECT r, t AS title, CASE WHEN level = 1 THEN a::VARCHAR ELSE a || '.' || b END AS number FROM w""")
def section_numbers(spark, d) -> DataFrame:
    heads = table(spark, d, "region").select(F.lit(0).alias("doc"), F.col("r_regionkey").alias("r"), F.lit(-1).alias("n"), F.col("r_name").alias("title"), F.lit(1).alias("level"))
    rows = heads.unionByName(table(spark, d, "nation").select(F.lit(0).alias("doc"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), F.col("n_name").alias("title"), F.lit(2).alias("level")))
    return S.section_numbers(rows, ["doc"], ["r", "n"], "level").select("r", "title", "number")


@register("""WITH i AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS lvl FROM orders), p AS (SELECT *, sum(CASE WHEN lvl = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS par FROM i)
SELECT o_custkey, o_orderkey, lvl, CAST(row_number() OVER (PARTITION BY o_custkey, lvl, CASE WHEN lvl = 0 THEN 0 ELSE par END ORDER BY o_orderkey) AS INT) AS number FROM p""")
def list_counters(spark, d) -> DataFrame:
    items = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("lvl"))
    return S.list_counters(items, ["o_custkey"], "o_orderkey", "lvl", 2).select("o_custkey", "o_orderkey", "lvl", "number")


@register("""WITH i AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey * 7 // 5 AS INT) % 3 AS lvl FROM orders)
SELECT a.o_custkey, a.o_orderkey, a.lvl, (SELECT max(b.o_orderkey) FROM i b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey < a.o_orderkey AND b.lvl < a.lvl) AS parent FROM i a""")
def list_parents(spark, d) -> DataFrame:
    items = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.floor(F.col("o_orderkey") * 7 / 5).cast("int") % 3).alias("lvl"))
    return S.list_parents(items, ["o_custkey"], "o_orderkey", "lvl", 3).select("o_custkey", "o_orderkey", "lvl", "parent")


@register("""WITH b AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'P' AS brk FROM orders) SELECT o_custkey, o_orderkey, CAST(1 + coalesce(sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page FROM b""")
def section_pages(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "P").alias("brk"))
    return S.split_pages(rows, ["o_custkey"], "o_orderkey", "brk").select("o_custkey", "o_orderkey", "page")


@register("WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, arg_min(p_size, (-n, p_size)) AS size FROM c GROUP BY 1")
def mode_tie_small(spark, d) -> DataFrame:
    return S.mode_small(table(spark, d, "part"), ["p_brand"], "p_size").select("p_brand", F.col("mode").alias("size"))


@register("""WITH r AS (SELECT p_brand, p_partkey, p_size, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS k, count(*) OVER (PARTITION BY p_brand, p_size) AS n, max(p_size) OVER (PARTITION BY p_brand) AS top FROM part), s AS (SELECT p_brand, max(p_size) FILTER (WHERE k = 2) AS nxt FROM r GROUP BY 1)
SELECT p_partkey, k = 1 AND n = 1 AND p_size >= 44 AND (nxt IS NULL OR p_size - nxt >= 2) AS title FROM r JOIN s USING (p_brand)""")
def title_promotion(spark, d) -> DataFrame:
    blocks = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("pt"), F.lit(True).alias("bold"), F.lit(40.0).alias("body"))
    return S.promote(blocks, ["p_brand"], "pt", "bold", "body").select("p_partkey", (F.coalesce(F.col("title_level"), F.lit(0)) == 2).alias("title"))


@register("""WITH g AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS isle FROM events), n AS (SELECT user_id, event_type, isle, count(*) AS n FROM g GROUP BY ALL) SELECT user_id, max(n) AS longest FROM n GROUP BY 1""")
def runs_longest(spark, d) -> DataFrame:
    runs = S.runs(table(spark, d, "events"), ["user_id"], "event_id", ["event_type"])
    return runs.groupBy("user_id", "run").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@register("""WITH g AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS isle FROM events)
SELECT user_id, event_type, min(event_id) AS first_id, string_agg(event_id::VARCHAR, '' ORDER BY event_id) AS merged FROM g GROUP BY user_id, event_type, isle""")
def run_merge(spark, d) -> DataFrame:
    own = table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("event_id").cast("string").alias("text"))
    return S.merge_runs(own, ["user_id"], "event_id", ["event_type"], "text").select("user_id", "event_type", F.col("first").alias("first_id"), F.col("text").alias("merged"))


@register("""WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx FROM events), c AS (SELECT * FROM o WHERE event_type = 'click'), b AS (SELECT * FROM o WHERE event_type = 'view'),
g AS (SELECT c.user_id, c.event_id AS caption, b.event_id AS body, b.idx AS bi, abs(c.idx - b.idx) - (SELECT count(*) FROM c x WHERE x.user_id = c.user_id AND x.idx > least(c.idx, b.idx) AND x.idx < greatest(c.idx, b.idx)) AS gap FROM c JOIN b USING (user_id))
SELECT caption, arg_min(body, (gap, bi)) AS body FROM g GROUP BY caption""")
def caption_nearest(spark, d) -> DataFrame:
    own = table(spark, d, "events").select("user_id", "event_id", "event_type")
    own = own.withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return S.nearest_body(own, ["user_id"], "idx", "event_id", F.col("event_type") == "click", F.col("event_type") == "view").select("caption", "body")


@register("""WITH o AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'table' WHEN 'purchase' THEN 'image' ELSE 'text' END AS type, event_type = 'click' AS cap FROM events), p AS (SELECT *, lag(type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, lag(cap) OVER (PARTITION BY user_id ORDER BY event_id) AS pc FROM o)
SELECT event_id, CASE WHEN type = 'text' AND cap AND prev IN ('table', 'image') THEN prev || '_caption' ELSE type END AS type FROM p""")
def caption_types(spark, d) -> DataFrame:
    own = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "table").when(F.col("event_type") == "purchase", "image").otherwise("text")
    return S.following_captions(own.select("user_id", "event_id", kind.alias("type"), (F.col("event_type") == "click").alias("cap")), ["user_id"], "event_id").select("event_id", "type")


@register("""SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) THEN p_partkey END AS anchor FROM part""")
def toc_anchors(spark, d) -> DataFrame:
    body = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("anchor"))
    toc = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("anchor"))
    return S.keep_known_anchors(toc, body, "anchor").select("p_partkey", "anchor")


@register("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unused_parts(spark, d) -> DataFrame:
    used = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return D.unused(table(spark, d, "part"), used, "p_partkey").select("p_partkey")


@register("""SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS page_no, o_custkey, o_orderkey FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey""")
def spine_manifest(spark, d) -> DataFrame:
    manifest = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return D.listed(table(spark, d, "orders"), manifest, ["o_custkey"], "o_orderkey", "o_orderkey").select("page_no", "o_custkey", "o_orderkey")


@register("SELECT 'nation' AS kind, n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def block_union(spark, d) -> DataFrame:
    parts = {t: table(spark, d, t).select(F.col(k).alias("id"), F.col(n).alias("name")) for t, k, n in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"), ("supplier", "s_suppkey", "s_name"))}
    return D.one_kind_after_another(parts, {"id": "long", "name": "string"})


@register("SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS headers FROM orders GROUP BY 1")
def distinct_headers(spark, d) -> DataFrame:
    return D.distinct_texts(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "headers")


@register("""WITH RECURSIVE c AS (SELECT n_nationkey AS s, n_nationkey AS x, 0 AS depth FROM nation UNION ALL SELECT s, x // 2, depth + 1 FROM c WHERE x > 0), v AS (SELECT s, depth, CASE WHEN x % 3 = 1 THEN x % 2 = 0 END AS bold FROM c)
SELECT s, arg_min(bold, depth) FILTER (WHERE bold IS NOT NULL) AS bold FROM v GROUP BY s""")
def style_chain(spark, d) -> DataFrame:
    styles = table(spark, d, "nation").select(F.col("n_nationkey").alias("style"), F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 2).cast("int")).alias("based_on"), F.when(F.col("n_nationkey") % 3 == 1, F.col("n_nationkey") % 2 == 0).alias("bold"))
    return graph.inherit(styles, "style", "based_on", "bold").select(F.col("style").alias("s"), "bold")


@register("""WITH t AS (SELECT l_orderkey, list(l_linenumber % 3 ORDER BY l_linenumber) AS x FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_filter(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN x[i] <> 0 AND (i = 1 OR x[i] <> x[i - 1]) THEN x[i] END), lambda v: v IS NOT NULL) AS symbols FROM t""")
def ctc_decode(spark, d) -> DataFrame:
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x % 3).alias("x"))
    return own.select("l_orderkey", S.ctc(F.col("x")).alias("symbols"))


@register("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN '# ' || text WHEN role = 'user' THEN text ELSE '- ' || text END AS markdown FROM conversations WHERE length(text) > 0""")
def block_markdown(spark, d) -> DataFrame:
    from sheafspark.plans import render

    kind = F.when(F.col("role") == "system", "title").when(F.col("role") == "user", "text").otherwise("list_item")
    blocks = table(spark, d, "conversations").select("conv_id", "turn", kind.alias("type"), F.col("text").alias("content"), F.when(F.col("role") == "system", 1).otherwise(0).alias("level"), F.lit(None).cast("string").alias("anchor"))
    return render.markdown_blocks(blocks.filter(F.length("content") > 0)).select("conv_id", "turn", "markdown")
