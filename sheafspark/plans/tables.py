"""Queries over table rules: null rows, chunks, pipe and HTML tables, charts, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.functions import geometry as G
from sheafspark.functions import tables as TB
from sheafspark.operators import cells, regions
from sheafspark.plans.common import Register, table

register = Register()


@register("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier)
SELECT s_suppkey, coalesce(name, '') AS name, coalesce(nation, '') AS nation FROM s WHERE name IS NOT NULL OR nation IS NOT NULL""")
def row_null_drop_fill(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    rows = s.select(k, F.when(k % 3 != 0, F.col("s_name")).alias("name"), F.when((k % 3 != 0) & (k % 4 != 0), F.col("s_nationkey").cast("string")).alias("nation"))
    return cells.filled_rows(rows, ["name", "nation"])


@register("SELECT c_nationkey, c_custkey, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 7 + 1 AS INT) AS chunk_id FROM customer")
def csv_chunks(spark, d) -> DataFrame:
    return cells.chunks(table(spark, d, "customer"), ["c_nationkey"], "c_custkey", 7).select("c_nationkey", "c_custkey", "chunk_id")


@register("""WITH n AS (SELECT n_regionkey, n_nationkey, CAST(n_nationkey AS VARCHAR) AS k, n_name AS v FROM nation), w AS (SELECT n_regionkey, greatest(max(length(k)), 11) AS wk, greatest(max(length(v)), 6) AS wv FROM n GROUP BY 1)
SELECT n_regionkey, '| ' || lpad('n_nationkey', any_value(wk)::INT, ' ') || ' | ' || rpad('n_name', any_value(wv)::INT, ' ') || ' |' || chr(10) || '|' || repeat('-', any_value(wk)::INT + 1) || ':|:' || repeat('-', any_value(wv)::INT + 1) || '|' || chr(10)
|| string_agg('| ' || lpad(k, wk::INT, ' ') || ' | ' || rpad(v, wv::INT, ' ') || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM n JOIN w USING (n_regionkey) GROUP BY n_regionkey""")
def pipe_table(spark, d) -> DataFrame:
    return TB.pipe_tables(table(spark, d, "nation"), ["n_regionkey"], ["n_nationkey", "n_name"], ["n_nationkey"])


@register("""SELECT o_custkey, '<table><tr><th>o_orderkey</th><th>o_orderpriority</th></tr>' || string_agg('<tr><td>' || o_orderkey || '</td><td>' || o_orderpriority || '</td></tr>', '' ORDER BY o_orderkey) || '</table>' AS html FROM orders GROUP BY o_custkey""")
def html_table(spark, d) -> DataFrame:
    return TB.html_tables(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey", "o_orderpriority"], ["o_orderkey"])


@register("""WITH m AS (SELECT o_custkey, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS c, list(o_orderpriority ORDER BY o_orderkey) AS s FROM orders GROUP BY 1)
SELECT o_custkey, '<table><thead><tr><th>order</th><th>priority</th></tr></thead><tbody>' || array_to_string(list_transform(range(1, len(c) + 1), lambda i: '<tr><td>' || c[i] || '</td><td>' || s[i] || '</td></tr>'), '') || '</tbody></table>' AS html FROM m""")
def chart_table(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("p"))
    cols = F.array(F.transform("p", lambda x: x["o_orderkey"].cast("string")), F.transform("p", lambda x: x["o_orderpriority"]))
    return rows.select("o_custkey", TB.chart_html(F.array(F.lit("order"), F.lit("priority")), cols).alias("html"))


@register("""WITH p AS (SELECT l_orderkey, max(l_linenumber) AS m, list(l_linenumber) FILTER (WHERE l_linenumber % 2 = 1) AS have FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_transform(range(0, m + 1), lambda i: CASE WHEN list_contains(have, i::INT) THEN 'v' || i ELSE '' END) AS dense FROM p""")
def cache_points(spark, d) -> DataFrame:
    text = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("v"), "l_linenumber")).otherwise("")
    points = F.map_from_entries(F.collect_set(F.struct("l_linenumber", text)))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(TB.dense(points).alias("dense"))


@register("""WITH s AS (SELECT l_orderkey, count(*) AS w FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, w, count(*) AS n, min(o_orderkey) AS f FROM orders JOIN s ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT o_custkey, arg_min(w, (-n, f)) AS width FROM o GROUP BY 1""")
def modal_width(spark, d) -> DataFrame:
    sizes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("w"))
    return cells.modal_width(table(spark, d, "orders").join(sizes, "o_orderkey"), ["o_custkey"], "w", "o_orderkey")


@register("""SELECT l_suppkey, min(l_linenumber) AS top, max(l_linenumber) AS bottom, min(l_quantity) AS left_edge, max(l_quantity) AS right_edge FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""")
def data_bounds(spark, d) -> DataFrame:
    return cells.bounds(table(spark, d, "lineitem").filter("l_returnflag <> 'N'"), ["l_suppkey"], "l_linenumber", "l_quantity")


@register("""WITH m AS (SELECT l_orderkey AS sheet, l_linenumber AS r1, l_linenumber + 1 AS r2 FROM lineitem WHERE l_linenumber % 3 = 1)
SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM m WHERE sheet = l_orderkey AND l_linenumber BETWEEN r1 AND r2) AS merged FROM lineitem""")
def merged_cell_lookup(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    merges = line.filter("l_linenumber % 3 = 1").select("l_orderkey", F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + 1).alias("b"))
    return cells.in_intervals(line, merges, ["l_orderkey"], "l_linenumber", "a", "b", "merged").select("l_orderkey", "l_linenumber", "merged")


@register("""WITH t AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_linenumber % 4))) AS s, o_custkey AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_custkey)
SELECT k FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE a.c = b.c AND len(a.s) < len(b.s) AND list_has_all(b.s, a.s))""")
def subset_tables(spark, d) -> DataFrame:
    # the set of an order's remainders as bits, from -3 (bit 0) to 3; orders come to the lines of each order at once
    bits = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.bit_or(F.expr("shiftleft(1, CAST(l_linenumber % 4 + 3 AS INT))")).alias("b"))
    rows = bits.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")), "k").groupBy("k", "c").agg(F.coalesce(F.bit_or("b"), F.lit(0)).alias("b"))
    sets = rows.select("k", "c", F.filter(F.array(*map(F.lit, range(-3, 4))), lambda x: F.col("b").bitwiseAND(F.call_function("shiftleft", F.lit(1), x + 3)) != 0).alias("s"))
    return cells.without_subsets(sets, "c", "k", "s").select("k")


@register("""WITH c AS (SELECT p_brand, p_size % 3 AS tol, CAST(sum(p_size) % 3 AS BIGINT) AS severe, avg(p_size) / 100 AS line_ratio, avg(p_retailprice) / 1000 AS penalty FROM part GROUP BY ALL), b AS (SELECT *, min(penalty) OVER (PARTITION BY p_brand) AS least FROM c)
SELECT p_brand, arg_min(tol, (severe, CASE tol WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, line_ratio, penalty)) AS tol FROM b WHERE penalty <= least + 0.15 GROUP BY 1""")
def gap_top1(spark, d) -> DataFrame:
    c = table(spark, d, "part").groupBy("p_brand", (F.col("p_size") % 3).alias("tol")).agg((F.sum("p_size") % 3).alias("severe"), (F.avg("p_size") / 100).alias("line_ratio"), (F.avg("p_retailprice") / 1000).alias("penalty"))
    return cells.best_gaps(c, ["p_brand"], "tol")


@register("""SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN u > 0 THEN i / u ELSE 0.0 END AS iou FROM
(SELECT vec_id, vec_id // 8 AS page, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS y1, embedding[1]::DOUBLE + 0.1 + abs(embedding[3]::DOUBLE) AS x2, embedding[2]::DOUBLE + 0.1 + abs(embedding[4]::DOUBLE) AS y2 FROM embeddings) a JOIN
(SELECT vec_id, vec_id // 8 AS page, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS y1, embedding[1]::DOUBLE + 0.1 + abs(embedding[3]::DOUBLE) AS x2, embedding[2]::DOUBLE + 0.1 + abs(embedding[4]::DOUBLE) AS y2 FROM embeddings) b ON a.page = b.page AND a.vec_id < b.vec_id,
LATERAL (SELECT greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i), LATERAL (SELECT (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i AS u)""")
def box_iou(spark, d) -> DataFrame:
    boxes = embedded_boxes(spark, d)
    a = boxes.select("page", F.col("vec_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = boxes.select("page", F.col("vec_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    return a.join(b, "page").filter("a < b").select("a", "b", G.iou(G.box("a_"), G.box("b_")).alias("iou"))


def embedded_boxes(spark, d) -> DataFrame:
    """Boxes from four components of each vector, eight to a page."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 8).alias("page"), e[0].alias("x1"), e[1].alias("y1"), (e[0] + 0.1 + F.abs(e[2])).alias("x2"), (e[1] + 0.1 + F.abs(e[3])).alias("y2"), "label")


@register("""WITH b AS (SELECT vec_id, vec_id // 8 AS page, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS y1, embedding[1]::DOUBLE + 0.1 + abs(embedding[3]::DOUBLE) AS x2, embedding[2]::DOUBLE + 0.1 + abs(embedding[4]::DOUBLE) AS y2 FROM embeddings)
SELECT vec_id FROM b a WHERE NOT EXISTS (SELECT 1 FROM b c WHERE a.page = c.page AND a.vec_id <> c.vec_id AND greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1)) >= 0.8)""")
def box_containment(spark, d) -> DataFrame:
    from sheafspark.operators import boxes

    return boxes.not_contained(embedded_boxes(spark, d), ["page"], "vec_id").select("vec_id")


_BOXES = """SELECT vec_id, vec_id // 8 AS page, label, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS y1, embedding[1]::DOUBLE + 0.1 + abs(embedding[3]::DOUBLE) AS x2, embedding[2]::DOUBLE + 0.1 + abs(embedding[4]::DOUBLE) AS y2 FROM embeddings"""
_NMS = f"""WITH RECURSIVE e AS ({_BOXES}), b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY vec_id % 97 DESC, vec_id) AS rn FROM e),
n AS (SELECT page, 0::BIGINT AS rn, []::STRUCT(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, l INT, id BIGINT)[] AS kept FROM (SELECT DISTINCT page FROM b)
UNION ALL SELECT b.page, b.rn, CASE WHEN len(list_filter(n.kept, lambda k: greatest(0, least(b.x2, k.c) - greatest(b.x1, k.a) + 1) * greatest(0, least(b.y2, k.d) - greatest(b.y1, k.b) + 1) / ((b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) + (k.c - k.a + 1) * (k.d - k.b + 1) - greatest(0, least(b.x2, k.c) - greatest(b.x1, k.a) + 1) * greatest(0, least(b.y2, k.d) - greatest(b.y1, k.b) + 1)) >= CASE WHEN k.l = b.label THEN 0.6 ELSE 0.98 END)) > 0 THEN n.kept
ELSE list_append(n.kept, {{'a': b.x1, 'b': b.y1, 'c': b.x2, 'd': b.y2, 'l': b.label, 'id': b.vec_id}}) END FROM n JOIN b ON b.page = n.page AND b.rn = n.rn + 1),
s AS (SELECT page, unnest(kept, recursive := true) FROM n QUALIFY row_number() OVER (PARTITION BY page ORDER BY rn DESC) = 1), kept AS (SELECT e.* FROM e JOIN s ON s.id = e.vec_id)"""


@register(_NMS + " SELECT page, vec_id FROM kept")
def nms(spark, d) -> DataFrame:
    from sheafspark.operators import boxes

    own = embedded_boxes(spark, d).withColumn("score", F.col("vec_id") % 97 / 97.0).withColumnRenamed("label", "cls")
    return boxes.nms(own, ["page"], "vec_id").select("page", "vec_id")


@register(_NMS + """, l AS (SELECT *, (x2 - x1) * (y2 - y1) > 0.93 AS large, count(*) OVER (PARTITION BY page) AS n FROM kept), m AS (SELECT *, sum(CASE WHEN large THEN 0 ELSE 1 END) OVER (PARTITION BY page) AS rest FROM l), f AS (SELECT * FROM m WHERE NOT large OR n = 1 OR rest = 0)
SELECT page, vec_id, CAST(row_number() OVER (PARTITION BY page ORDER BY y1, x1, vec_id) - 1 AS INT) AS order_id FROM f a WHERE NOT EXISTS (SELECT 1 FROM f c WHERE a.page = c.page AND a.vec_id <> c.vec_id AND greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1)) >= 0.8)""")
def layout_post(spark, d) -> DataFrame:
    from sheafspark.operators import boxes

    own = embedded_boxes(spark, d).withColumn("score", F.col("vec_id") % 97 / 97.0).withColumnRenamed("label", "cls")
    return boxes.layout(own, ["page"], "vec_id", F.lit(1.0), F.lit(1.0)).select("page", "vec_id", "order_id")


def _sql_gap(boxes: str, low: str, high: str) -> str:
    """The widest gap between each low edge and the furthest high one before it, of several the first."""
    own = f"list_sort(list_transform({boxes}, lambda v, i: {{'l': v.{low}, 'i': i, 'h': v.{high}}}))"
    before = f"list_max(list_transform(({own})[1:i - 1], lambda u: u.h))"
    gaps = f"list_transform(range(2, len({boxes}) + 1), lambda i: {{'g': ({own})[i].l - {before}, 'o': -i, 'at': (({own})[i].l + {before}) / 2}})"
    return f"coalesce(list_sort(list_filter({gaps}, lambda q: q.g > 0), 'DESC')[1], {{'g': 0.0, 'o': 0, 'at': 0.0}})"


_FIRST = "CASE WHEN gx.g >= gy.g THEN (v.x1 + v.x2) / 2 < gx.at ELSE (v.y1 + v.y2) / 2 < gy.at END"
# regions of a page are cut in two until none has a gap of 5 or more, or all boxes' middles lie on one side of it
_CUTS = f"""WITH RECURSIVE e AS ({_BOXES}), r AS (SELECT page, '' AS path, list({{'id': vec_id, 'x1': x1 * 1000, 'y1': y1 * 1000, 'x2': x2 * 1000, 'y2': y2 * 1000}} ORDER BY vec_id) AS b, false AS leaf FROM e GROUP BY page
UNION ALL SELECT page, path || s.s, CASE WHEN ends THEN b ELSE list_filter(b, lambda v: ({_FIRST}) = (s.s = '0')) END, ends FROM (SELECT *, greatest(gx.g, gy.g) < 5 OR n = 0 OR n = len(b) AS ends FROM (SELECT *, len(list_filter(b, lambda v: {_FIRST})) AS n FROM (
SELECT page, path, b, CASE WHEN ga.g < 5 AND len(b) > 2 AND len(w) > 1 AND len(w) < len(b) THEN gw ELSE ga END AS gx, gy FROM (SELECT page, path, b, w, {_sql_gap('b', 'x1', 'x2')} AS ga, {_sql_gap('w', 'x1', 'x2')} AS gw, {_sql_gap('b', 'y1', 'y2')} AS gy FROM
(SELECT page, path, b, list_filter(b, lambda v: v.x2 - v.x1 >= 0.1 * (list_max(list_transform(b, lambda u: u.x2)) - list_min(list_transform(b, lambda u: u.x1)))) AS w FROM r WHERE NOT leaf))))) t, (SELECT unnest(['0', '1']) AS s) s WHERE s.s = '0' OR NOT ends)
SELECT page, v.id AS vec_id, CAST(row_number() OVER (PARTITION BY page ORDER BY path, v.y1, v.x1, v.id) - 1 AS INT) AS position FROM (SELECT page, path, unnest(b) AS v FROM r WHERE leaf)"""


@register(_CUTS)
def xycut_order(spark, d) -> DataFrame:
    from sheafspark.operators import boxes

    own = embedded_boxes(spark, d)
    scaled = own.select("page", "vec_id", *[(F.col(c) * 1000).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return boxes.reading_order(scaled, ["page"], "vec_id").select("page", "vec_id", "position")


@register(f"""WITH RECURSIVE e AS ({_BOXES}), b AS (SELECT page, vec_id, (y1 + y2) / 2 AS y, row_number() OVER (PARTITION BY page ORDER BY (y1 + y2) / 2, x1, vec_id) AS rn FROM e), n AS (SELECT page, vec_id, rn, 0 AS line_no, y AS first FROM b WHERE rn = 1
UNION ALL SELECT b.page, b.vec_id, b.rn, CASE WHEN b.y - n.first >= 0.1 THEN n.line_no + 1 ELSE n.line_no END, CASE WHEN b.y - n.first >= 0.1 THEN b.y ELSE n.first END FROM n JOIN b ON b.page = n.page AND b.rn = n.rn + 1) SELECT page, vec_id, line_no FROM n""")
def line_cluster(spark, d) -> DataFrame:
    from sheafspark.operators import boxes

    return boxes.lines(embedded_boxes(spark, d), ["page"], "vec_id", 0.1).select("page", "vec_id", "line_no")


@register("""WITH RECURSIVE c AS (SELECT DISTINCT user_id AS sheet, CAST(event_id % 37 AS INT) AS r, CAST(event_id % 11 AS INT) AS c FROM events), e AS (SELECT a.sheet, a.r AS r1, a.c AS c1, b.r AS r2, b.c AS c2 FROM c a JOIN c b ON a.sheet = b.sheet AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
reach(sheet, r, c, rr, cc) AS (SELECT sheet, r, c, r, c FROM c UNION SELECT reach.sheet, reach.r, reach.c, e.r2, e.c2 FROM reach JOIN e ON e.sheet = reach.sheet AND e.r1 = reach.rr AND e.c1 = reach.cc), k AS (SELECT sheet, r, c, min(rr * 100 + cc) AS root FROM reach GROUP BY ALL)
SELECT sheet, CAST(row_number() OVER (PARTITION BY sheet ORDER BY root) AS INT) AS table_id, min(r) AS top, min(c) AS "left", max(r) AS bottom, max(c) AS "right" FROM k GROUP BY sheet, root""")
def flood_fill(spark, d) -> DataFrame:
    own = table(spark, d, "events").select(F.col("user_id").alias("sheet"), (F.col("event_id") % 37).cast("int").alias("row"), (F.col("event_id") % 11).cast("int").alias("col")).distinct()
    return regions.detect_tables(own, ["sheet"], 0)


@register("""WITH g AS (SELECT l_suppkey, CAST(l_linenumber AS BIGINT) AS r, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0 AS blank FROM lineitem GROUP BY ALL), i AS (SELECT *, r - row_number() OVER (PARTITION BY l_suppkey, blank ORDER BY r) AS isle FROM g), n AS (SELECT l_suppkey, isle, count(*) AS n FROM i WHERE blank GROUP BY ALL)
SELECT s.l_suppkey, coalesce(max(n.n), 0) AS longest_blank, any_value(s.ratio) AS blank_ratio FROM (SELECT l_suppkey, avg(CASE WHEN blank THEN 1.0 ELSE 0.0 END) AS ratio FROM g GROUP BY 1) s LEFT JOIN n ON n.l_suppkey = s.l_suppkey GROUP BY s.l_suppkey""")
def gap_summary(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").cast("long").alias("r")).agg((F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)) == 0).alias("blank"))
    return cells.blank_runs(rows, ["l_suppkey"], "r", "blank")


@register("""SELECT l_suppkey, sum(l_quantity * l_discount) / ((max(l_quantity) - min(l_quantity) + 1) * (max(l_discount) - min(l_discount) + 1)) > 1 AS dense FROM lineitem GROUP BY 1""")
def density(spark, d) -> DataFrame:
    q, c = F.col("l_quantity"), F.col("l_discount")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.sum(q * c) / ((F.max(q) - F.min(q) + 1) * (F.max(c) - F.min(c) + 1)) > 1).alias("dense"))


@register("SELECT l_suppkey, y, count(*) AS n FROM (SELECT l_suppkey, unnest(range(CAST(l_linenumber AS BIGINT), CAST(l_linenumber AS BIGINT) + CAST(l_quantity AS BIGINT) % 5)) AS y FROM lineitem) GROUP BY ALL")
def projection_profile(spark, d) -> DataFrame:
    from sheafspark.operators import boxes

    line = table(spark, d, "lineitem").select("l_suppkey", F.col("l_linenumber").cast("long").alias("a"), (F.col("l_linenumber") + F.col("l_quantity").cast("long") % 5).cast("long").alias("b"))
    return boxes.profile(line, ["l_suppkey"], "a", "b").select("l_suppkey", F.col("at").alias("y"), "n")
