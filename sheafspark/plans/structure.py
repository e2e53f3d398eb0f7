"""Queries over files, blocks and pages: readers of packages, content lists, numbering, captions, lists, sheets, engines."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.operators import boxes as B
from sheafspark.operators import cells as C
from sheafspark.operators import graph, regions
from sheafspark.operators import sequences as S
from sheafspark.plans.common import Register, table

register = Register()


def files(spark, d, kind: str, suffix: str | None = None) -> DataFrame:
    """A file for each region, with its nations: path, suffix, content."""
    rows = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    own = rows.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))

    @F.pandas_udf("binary")
    def made(title: pd.Series, rows: pd.Series) -> pd.Series:
        from sheafspark.plans.packages import MAKERS

        return pd.Series([MAKERS[kind](t, [(int(x["n_nationkey"]), x["n_name"]) for x in r]) for t, r in zip(title, rows, strict=True)])

    return own.select(F.concat(F.lit("f"), F.col("r_regionkey").cast("string"), F.lit(f".{suffix or kind}")).alias("path"), F.lit(suffix or kind).alias("suffix"), made("r_name", "rows").alias("content"))


def read(spark, d, kind: str) -> DataFrame:
    from sheafspark.sources import packages

    return packages.read(files(spark, d, kind)).withColumn("r_regionkey", F.regexp_extract("path", r"f(\d+)\.", 1).cast("int"))


_N = "(SELECT r_regionkey, r_name, list(n_nationkey ORDER BY n_nationkey) AS ks, list(n_name ORDER BY n_nationkey) AS ns FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL)"
_NL = "chr(10)"


@register(f"""WITH r AS {_N} SELECT r_regionkey, 1 AS page_id, '# ' || r_name || {_NL} || {_NL} || array_to_string(list_transform(range(1, len(ns) + 1), lambda i: i || '. ' || replace(ns[i], '_', chr(92) || '_')), {_NL}) || {_NL} || {_NL} || '<table>' || array_to_string(list_transform(range(1, len(ns) + 1), lambda i: '<tr><td>' || ks[i] || '</td><td>' || ns[i] || '</td></tr>'), '') || '</table>' AS content FROM r
UNION ALL SELECT r_regionkey, 2, 'second section' FROM r""")
def docx_pages(spark, d) -> DataFrame:
    """Word packages as pages of Markdown: a heading, a numbered list and a table, a page for each section."""
    return read(spark, d, "docx").select("r_regionkey", "page_id", "content")


@register(f"""WITH r AS {_N} SELECT r_regionkey, '## ' || r_name || {_NL} || {_NL} || array_to_string(list_transform(ns, lambda n: '- ' || replace(n, '_', chr(92) || '_')), {_NL}) AS content, 'notes of ' || r_name AS notes FROM r""")
def pptx_pages(spark, d) -> DataFrame:
    """Slides as Markdown, and their notes, which are only in content lists."""
    note = F.get_json_object(F.col("extras")["blocks"], "$.discarded_blocks[0].spans[0].content")
    return read(spark, d, "pptx").select("r_regionkey", "content", note.alias("notes"))


@register(f"""WITH r AS {_N} SELECT r_regionkey, r_name AS title, '## ' || r_name || {_NL} || {_NL} || '<table><tr><th>key</th><th>name</th></tr>' || array_to_string(list_transform(range(1, len(ns) + 1), lambda i: '<tr><td>' || ks[i] || '</td><td>' || ns[i] || '</td></tr>'), '') || '</table>' AS content FROM r""")
def xlsx_pages(spark, d) -> DataFrame:
    """Visible sheets as Markdown with HTML tables."""
    return read(spark, d, "xlsx").select("r_regionkey", "title", "content")


@register(f"""SELECT r_regionkey, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS INT) AS page_id, '# ' || n_name || {_NL} || 'of ' || r_name || {_NL} || '[x]' AS content FROM region JOIN nation ON r_regionkey = n_regionkey""")
def epub_pages(spark, d) -> DataFrame:
    """Chapters of e-books in the order of their spines; those that the manifest lacks and empty ones are left out."""
    return read(spark, d, "epub").select("r_regionkey", "page_id", "content")


@register(f"""WITH r AS {_N} SELECT r_regionkey, r_name AS title, '## ' || r_name || {_NL} || array_to_string(ns, {_NL}) AS content, replace(r_name, ' ', '.') || '@x.org' AS message_id, '2024-01-01T00:00:00+00:00' AS sent_date, list_transform(ks, lambda k: 'n' || k || '@x.org') AS sent_to, ['A <a@x.org>'] AS sender FROM r""")
def email_pages(spark, d) -> DataFrame:
    """Mails: headers, dates in UTC, addresses, and the HTML body rather than the plain one."""
    x, arr = F.col("extras"), "array<string>"
    return read(spark, d, "eml").select("r_regionkey", "title", "content", x["message_id"].alias("message_id"), x["sent_date"].alias("sent_date"), F.from_json(x["to"], arr).alias("sent_to"), F.from_json(x["from"], arr).alias("sender"))


@register(f"""WITH r AS {_N}, w AS (SELECT *, greatest(3, list_max(list_transform(ks, lambda k: length(CAST(k AS VARCHAR))))) AS wk, greatest(4, list_max(list_transform(ns, lambda n: length(n)))) AS wn FROM r)
SELECT r_regionkey, '| ' || lpad('key', wk::INT, ' ') || ' | ' || rpad('name', wn::INT, ' ') || ' |' || {_NL} || '|' || repeat('-', wk::INT + 1) || ':|:' || repeat('-', wn::INT + 1) || '|' || {_NL} || array_to_string(list_transform(range(1, len(ns) + 1), lambda i: '| ' || lpad(CAST(ks[i] AS VARCHAR), wk::INT, ' ') || ' | ' || rpad(ns[i], wn::INT, ' ') || ' |'), {_NL}) AS content FROM w""")
def csv_pages(spark, d) -> DataFrame:
    """Separated files as pipe tables, their separator found, rows without a value left out."""
    return read(spark, d, "csv").select("r_regionkey", "content")


@register(f"""WITH r AS {_N} SELECT r_regionkey, page_id, CASE page_id WHEN 1 THEN '# ' || r_name WHEN 2 THEN '```python' || {_NL} || 'x = ' || len(ns) || {_NL} || 'x' || {_NL} || '```' ELSE '```' || {_NL} || 'end' || {_NL} || '```' END AS content, CASE page_id WHEN 3 THEN '3' ELSE CAST(page_id - 1 AS VARCHAR) END AS cell_idx FROM r, (SELECT unnest([1, 2, 3])::INT AS page_id)""")
def ipynb_pages(spark, d) -> DataFrame:
    """Cells of notebooks: sources as text or lists, empty ones left out, places kept."""
    return read(spark, d, "ipynb").select("r_regionkey", "page_id", "content", F.col("extras")["cell_idx"].alias("cell_idx"))


@register(f"""WITH r AS {_N} SELECT r_regionkey, '# ' || r_name || {_NL} || ns[1] || ':' || {_NL} || '```' || {_NL} || 'code' || {_NL} || '```' || {_NL} || '[l](http://x)' AS content FROM r""")
def rst_pages(spark, d) -> DataFrame:
    return read(spark, d, "rst").select("r_regionkey", "content")


@register(f"""WITH r AS {_N} SELECT 'f' || r_regionkey || '.' || s AS path, CASE s WHEN 'zip' THEN 'ValueError' WHEN 'docx' THEN 'BadZipFile' END AS error, CASE s WHEN 'md' THEN 'key;name' || {_NL} || array_to_string(list_transform(range(1, len(ns) + 1), lambda i: ks[i] || ';' || ns[i]), {_NL}) || {_NL} || ';' || {_NL} END AS content FROM r, (SELECT unnest(['zip', 'docx', 'md']) AS s)""")
def failed_files(spark, d) -> DataFrame:
    """Files that can't be read have a row with their error, and the others go on."""
    from sheafspark.sources import packages

    own = files(spark, d, "csv")
    rows = own.withColumn("suffix", F.explode(F.array(*map(F.lit, ("zip", "docx", "md"))))).withColumn("path", F.concat(F.regexp_replace("path", "csv$", ""), "suffix"))
    return packages.read(rows).select("path", F.regexp_extract("error", r"^(\w+)", 1).alias("error"), "content").withColumn("error", F.nullif("error", F.lit("")))


@register("""WITH m AS (SELECT o_custkey, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS c, list(o_orderpriority ORDER BY o_orderkey) AS s FROM orders GROUP BY 1)
SELECT o_custkey, '<table><thead><tr><th>order</th><th>total</th></tr></thead><tbody>' || array_to_string(list_transform(range(1, len(c) + 1), lambda i: '<tr><td>' || c[i] || '</td><td>' || s[i] || '</td></tr>'), '') || '</tbody></table>' AS html FROM m""")
def chart_parts(spark, d) -> DataFrame:
    """Chart parts of office files as tables of their cached points."""

    @F.pandas_udf("string")
    def grid(rows: pd.Series) -> pd.Series:
        from sheafspark.functions import charts
        from sheafspark.plans.packages import chart

        return rows.map(lambda r: charts.chart_html(chart([x["o_orderkey"] for x in r], [x["o_orderpriority"] for x in r])))

    own = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("r"))
    return own.select("o_custkey", grid("r").alias("html"))


# Blocks ------------------------------------------------------------------------------

_KINDS = ("title", "text", "list", "table", "header")


def _block(rows: pd.DataFrame) -> list[dict]:
    span = lambda t: [{"type": "text", "content": t}]
    out = []
    for k, name, size in rows.itertuples(index=False):
        kind = _KINDS[size % 5]
        more = {"title": {"spans": span(name), "level": 1 + size % 3, "is_numbered": True}, "list": {"attribute": "ordered", "start": 3, "blocks": [{"type": "text", "spans": span(name)}, {"type": "list", "ilevel": 1, "blocks": [{"type": "text", "spans": span("deeper")}]}]}, "table": {"html": f"<table><tr><td>{name}</td></tr></table>", "captions": [{"type": "text", "spans": span("Table " + str(size))}]}}
        out.append({"type": kind, "index": int(k), **more.get(kind, {"spans": span(name)})})
    return out


def _documents(spark, d, schema: str, make) -> DataFrame:
    """make(document) of each brand's parts as blocks, one page."""
    from sheafspark.functions import blocks

    def run(own: pd.DataFrame) -> pd.DataFrame:
        page = blocks.document([_block(own.sort_values("p_partkey")[["p_partkey", "p_name", "p_size"]])])
        return pd.DataFrame(make(own["p_brand"].iloc[0], page))

    return table(spark, d, "part").select("p_brand", "p_partkey", "p_name", "p_size").groupBy("p_brand").applyInPandas(run, schema)


_NUMBERED = """WITH RECURSIVE b AS (SELECT p_brand, p_partkey, p_name, p_size, p_size % 5 AS kind, 1 + p_size % 3 AS level, row_number() OVER (PARTITION BY p_brand, p_size % 5 = 0 ORDER BY p_partkey) AS rn FROM part),
t AS (SELECT * FROM b WHERE kind = 0), n AS (SELECT p_brand, 0::BIGINT AS rn, 0 AS a, 0 AS b, 0 AS c FROM (SELECT DISTINCT p_brand FROM t)
UNION ALL SELECT t.p_brand, t.rn, CASE WHEN level = 1 THEN n.a + 1 ELSE greatest(n.a, 1) END, CASE level WHEN 1 THEN 0 WHEN 2 THEN n.b + 1 ELSE greatest(n.b, 1) END, CASE WHEN level = 3 THEN n.c + 1 ELSE 0 END FROM n JOIN t ON t.p_brand = n.p_brand AND t.rn = n.rn + 1),
x AS (SELECT b.*, CASE WHEN kind = 0 THEN CASE level WHEN 1 THEN n.a::VARCHAR WHEN 2 THEN n.a || '.' || n.b ELSE n.a || '.' || n.b || '.' || n.c END || ' ' ELSE '' END AS num FROM b LEFT JOIN n ON b.p_brand = n.p_brand AND b.rn = n.rn AND b.kind = 0)"""


@register(f"""{_NUMBERED}, m AS (SELECT p_brand, p_partkey, kind, CASE kind WHEN 0 THEN repeat('#', level) || ' ' || num || p_name WHEN 1 THEN p_name WHEN 2 THEN '3. ' || p_name || chr(10) || '    - deeper' WHEN 3 THEN '<table><tr><td>' || p_name || '</td></tr></table>  ' || chr(10) || 'Table ' || p_size END AS md FROM x WHERE kind < 4)
SELECT p_brand, string_agg(md, chr(10) || chr(10) ORDER BY p_partkey) AS mm_markdown, string_agg(md, chr(10) || chr(10) ORDER BY p_partkey) FILTER (WHERE kind < 3) AS nlp_markdown FROM m GROUP BY 1""")
def markdown_modes(spark, d) -> DataFrame:
    """Blocks of a document as Markdown with and without tables; titles are numbered."""
    from sheafspark.functions import blocks

    return _documents(spark, d, "p_brand string, mm_markdown string, nlp_markdown string", lambda k, p: {"p_brand": [k], "mm_markdown": [blocks.make(p)], "nlp_markdown": [blocks.make(p, "nlp_markdown")]})


@register(f"""{_NUMBERED} SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY kind = 4, p_partkey) AS INT) AS pos, CASE kind WHEN 0 THEN 'text' WHEN 1 THEN 'text' WHEN 2 THEN 'list' WHEN 3 THEN 'table' ELSE 'header' END AS type, CASE WHEN kind IN (0, 1, 4) THEN num || p_name END AS text, CASE WHEN kind = 0 THEN level END::INT AS text_level,
CASE WHEN kind = 2 THEN ['3. ' || p_name, '    - deeper'] END AS list_items, CASE WHEN kind = 3 THEN ['Table ' || p_size] END AS table_caption, CASE WHEN kind = 3 THEN '<table><tr><td>' || p_name || '</td></tr></table>' END AS table_body, 0 AS page_idx FROM x""")
def content_list_v1(spark, d) -> DataFrame:
    """The flat list of a document's blocks; headers come last."""
    from sheafspark.functions import blocks

    kind = "array<struct<type string, text string, text_level int, list_items array<string>, table_caption array<string>, table_body string, page_idx int>>"
    rows = _documents(spark, d, "p_brand string, j string", lambda k, p: {"p_brand": [k], "j": [json.dumps(blocks.make(p, "content_list"))]})
    return rows.select("p_brand", F.posexplode(F.from_json("j", kind.replace(" ", ":").replace(",:", ",")))).select("p_brand", (F.col("pos") + 1).alias("pos"), "col.*")


@register(f"""{_NUMBERED} SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY kind = 4, p_partkey) AS INT) AS pos, ['title', 'paragraph', 'list', 'table', 'page_header'][kind + 1] AS type, CASE WHEN kind = 0 THEN level END::INT AS level, CASE WHEN kind = 0 THEN [num, p_name] WHEN kind IN (1, 4) THEN [p_name] END AS spans,
CASE WHEN kind = 2 THEN ['3.', '    -'] END AS prefixes, CASE WHEN kind = 3 THEN 'simple_table' END AS table_type FROM x""")
def content_list_v2(spark, d) -> DataFrame:
    """The typed list of each page's blocks: titles with numbers as spans, list items with prefixes, kinds of tables."""
    from sheafspark.functions import blocks

    def flat(k: str, pages: list) -> dict:
        items = blocks.make(pages, "content_list_v2")[0]
        get = lambda c: next((v for n in ("title_content", "paragraph_content", "page_header_content") if (v := c.get(n)) is not None), None)
        return {
            "p_brand": [k] * len(items), "pos": range(1, len(items) + 1), "type": [i["type"] for i in items], "level": pd.array([i["content"].get("level") for i in items], "Int32"), "spans": [None if get(i["content"]) is None else [s["content"] for s in get(i["content"])] for i in items],
            "prefixes": [[x["prefix"] for x in i["content"]["list_items"]] if "list_items" in i["content"] else None for i in items], "table_type": [i["content"].get("table_type", "").replace("complex", "complex") or None for i in items],
        }

    return _documents(spark, d, "p_brand string, pos int, type string, level int, spans array<string>, prefixes array<string>, table_type string", flat)


@register("""WITH RECURSIVE t AS (SELECT o_custkey, o_orderkey, CAST(1 + o_orderkey % 2 AS INT) AS level, o_orderkey % 3 <> 0 AS numbered, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 7)::VARCHAR ELSE (o_orderkey % 5) || '.' || (o_orderkey % 4) END AS lead, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
n AS (SELECT o_custkey, 0::BIGINT AS rn, 0::BIGINT AS a, 0::BIGINT AS b FROM (SELECT DISTINCT o_custkey FROM t) UNION ALL SELECT t.o_custkey, t.rn, CASE WHEN numbered THEN CASE WHEN level = 1 THEN n.a + 1 ELSE CASE WHEN n.a = 0 THEN 1 ELSE n.a END END WHEN level = 1 THEN o_orderkey % 7 ELSE o_orderkey % 5 END, CASE WHEN level = 1 THEN 0 WHEN numbered THEN n.b + 1 ELSE o_orderkey % 4 END FROM n JOIN t ON t.o_custkey = n.o_custkey AND t.rn = n.rn + 1)
SELECT t.o_orderkey, CASE WHEN numbered THEN CASE WHEN level = 1 THEN n.a::VARCHAR ELSE n.a || '.' || n.b END END AS section_number FROM t JOIN n ON t.o_custkey = n.o_custkey AND t.rn = n.rn""")
def section_resync(spark, d) -> DataFrame:
    """Section numbers that take over the numbers which titles without one begin with."""
    k = F.col("o_orderkey")
    lead = F.when(k % 2 == 0, (k % 7).cast("string")).otherwise(F.concat((k % 5).cast("string"), F.lit("."), (k % 4).cast("string")))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (k % 2 + 1).cast("int").alias("level"), (k % 3 != 0).alias("numbered"), F.concat(lead, F.lit(" Title")).alias("text"))
    return S.numbered_titles(rows, ["o_custkey"], "o_orderkey", "level", "numbered", "text").select("o_orderkey", "section_number")


_BLOCKS = "SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'table' WHEN 'purchase' THEN 'image' WHEN 'error' THEN 'caption' ELSE 'text' END AS type, CASE WHEN event_id % 2 = 0 THEN 'Table ' ELSE 'Figure ' END || event_id AS content FROM events"


@register(f"""WITH b AS ({_BLOCKS}), p AS (SELECT *, lag(type) OVER w AS prev FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), k AS (SELECT *, CASE WHEN type = 'text' AND ((prev = 'table' AND content LIKE 'Table%') OR (prev = 'image' AND content LIKE 'Fig%')) THEN 'caption' ELSE type END AS kind FROM p),
o AS (SELECT *, last_value(CASE WHEN kind <> 'caption' THEN kind END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, first_value(CASE WHEN kind <> 'caption' THEN kind END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM k)
SELECT event_id, CASE WHEN kind <> 'caption' THEN kind WHEN l IN ('table', 'image', 'chart') THEN l || '_caption' WHEN f IN ('table', 'image', 'chart') THEN f || '_caption' ELSE 'text' END AS type FROM o""")
def captions_classified(spark, d) -> DataFrame:
    """Captions by the table, picture or chart that they go with."""
    kind = F.when(F.col("event_type") == "view", "table").when(F.col("event_type") == "purchase", "image").when(F.col("event_type") == "error", "caption").otherwise("text")
    content = F.concat(F.when(F.col("event_id") % 2 == 0, "Table ").otherwise("Figure "), F.col("event_id").cast("string"))
    return S.captions(table(spark, d, "events").select("user_id", "event_id", kind.alias("type"), content.alias("content")), ["user_id"], "event_id").select("event_id", "type")


@register("""WITH t AS (SELECT DISTINCT l_orderkey, CAST(4 AS INT) AS body, l_linenumber AS caption FROM lineitem WHERE l_linenumber <> 4 AND l_quantity > 15), s AS (SELECT *, lag(caption) OVER (PARTITION BY l_orderkey ORDER BY caption DESC) - caption AS step FROM t),
g AS (SELECT *, sum(CASE WHEN step IS NULL OR step = 1 OR (step = 2 AND body = caption + 1) THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY caption DESC) AS gaps FROM s)
SELECT l_orderkey, list(caption ORDER BY caption) FILTER (WHERE gaps = 0) AS captions, count(*) FILTER (WHERE gaps > 0) AS texts FROM g GROUP BY 1""")
def captions_contiguous(spark, d) -> DataFrame:
    """Captions that stay with their body, counted back from the last; those beyond a gap are texts."""
    ties = table(spark, d, "lineitem").filter("l_linenumber <> 4 and l_quantity > 15").select("l_orderkey", F.lit(4).alias("body"), F.col("l_linenumber").alias("caption")).distinct()
    own = S.contiguous_captions(ties, ["l_orderkey"], "body", "caption")
    bodies = own.groupBy("l_orderkey", "body").agg(F.count_if(~F.col("stays")).alias("texts"))
    return S.with_captions(bodies, own.filter("stays").withColumn("text", F.col("caption")).select("l_orderkey", "body", "caption", F.col("caption").cast("string").alias("text")), ["l_orderkey"], "body", "caption", "text").select("l_orderkey", F.col("captions").cast("array<int>").alias("captions"), "texts")


@register("""WITH i AS (SELECT o_custkey, o_orderkey, o_orderstatus <> 'P' AS item, CAST(o_orderkey % 4 AS INT) AS lvl FROM orders), r AS (SELECT *, sum(CASE WHEN item THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM i)
SELECT o_orderkey, CASE WHEN item THEN greatest(lvl - first_value(CASE WHEN item THEN lvl END IGNORE NULLS) OVER (PARTITION BY o_custkey, run ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) END AS depth FROM r""")
def list_levels(spark, d) -> DataFrame:
    """Items' levels over the first item's of their run."""
    items = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") != "P").alias("item"), (F.col("o_orderkey") % 4).cast("int").alias("lvl"))
    return S.list_levels(items, ["o_custkey"], "o_orderkey", "item", "lvl").select("o_orderkey", "depth")


@register("""WITH RECURSIVE i AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 5 + 1 AS INT) END AS start, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
n AS (SELECT o_custkey, o_orderkey, rn, 1 AS list_no, coalesce(start, 1) AS number FROM i WHERE rn = 1 UNION ALL SELECT i.o_custkey, i.o_orderkey, i.rn, CASE WHEN start IS NOT NULL AND start <> number + 1 THEN list_no + 1 ELSE list_no END, CASE WHEN start IS NOT NULL AND start <> number + 1 THEN start ELSE number + 1 END FROM n JOIN i ON i.o_custkey = n.o_custkey AND i.rn = n.rn + 1)
SELECT o_orderkey, list_no, number FROM n""")
def list_restarts(spark, d) -> DataFrame:
    """Ordered items' numbers; a start that isn't the next number begins a new list."""
    start = F.when(F.col("o_orderkey") % 7 == 0, (F.col("o_orderkey") % 5 + 1).cast("int"))
    items = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit(0).alias("lvl"), F.lit(True).alias("ordered"), start.alias("start"))
    return S.list_numbers(items, ["o_custkey"], "o_orderkey", "lvl", "ordered", "start").select("o_orderkey", "list_no", "number")


@register("""WITH i AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS num, o_orderkey % 2 AS lvl, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders)
SELECT o_custkey, num FROM i WHERE num IS NOT NULL GROUP BY ALL HAVING count(DISTINCT lvl) > 1 AND max(t) > min(t)""")
def heading_lists(spark, d) -> DataFrame:
    """Lists of several levels that body text interrupts: their items are headings."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("num"), (F.col("o_orderkey") % 2).alias("lvl"), (F.col("o_orderstatus") == "P").alias("text"))
    return S.heading_lists(rows, ["o_custkey"], "o_orderkey", "num", "lvl", "text")


@register("""WITH g AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS isle FROM events), r AS (SELECT user_id, min(event_id) AS f, string_agg(event_type || event_id, chr(10) ORDER BY event_id) AS t FROM g GROUP BY user_id, event_type, isle)
SELECT user_id, string_agg(t, chr(10) || chr(10) ORDER BY f) AS content FROM r GROUP BY 1""")
def part_groups(spark, d) -> DataFrame:
    """A slide's parts, those of a kind in a row without an empty line between."""
    own = table(spark, d, "events").select("user_id", "event_id", "event_type", F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    return S.grouped_parts(own, ["user_id"], "event_id", "event_type", "text")


@register("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN l_quantity > 45 END AS own, 'c' || l_partkey % 3 AS ch, 'p' || l_suppkey % 3 AS pa FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(own, CASE ch WHEN 'c0' THEN true WHEN 'c1' THEN NULL ELSE NULL END, CASE pa WHEN 'p0' THEN false WHEN 'p1' THEN true END, false) AS bold FROM r""")
def style_toggles(spark, d) -> DataFrame:
    """Whether runs are bold: their own setting, their character style's (links' aside), their paragraph style's."""
    style = "doc int, style string, based_on string, bold boolean"
    chars = spark.createDataFrame([(0, "c0", "base", None), (0, "base", None, True), (0, "c1", "c1", None), (0, "c2", None, True)], style)
    paras = spark.createDataFrame([(0, "p0", None, False), (0, "p1", "p3", None), (0, "p3", "p4", None), (0, "p4", None, True), (0, "p2", "p2", None)], style)
    own = table(spark, d, "lineitem").select(F.lit(0).alias("doc"), "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 40, F.col("l_quantity") > 45).alias("own"), F.concat(F.lit("c"), (F.col("l_partkey") % 3).cast("string")).alias("ch"), F.concat(F.lit("p"), (F.col("l_suppkey") % 3).cast("string")).alias("pa"))
    up = lambda t: graph.inherit(t, "style", "based_on", "bold", ["doc"])
    return S.toggles(own, up(chars), up(paras), ["doc"], "own", "ch", "pa", "bold", ("c2",)).select("l_orderkey", "l_linenumber", "bold")


# Sheets ------------------------------------------------------------------------------

_CELLS = "SELECT l_orderkey, CAST(l_linenumber - 1 AS INT) AS r, CAST(l_partkey % 6 AS INT) AS c, CAST(1 + l_suppkey % 2 AS INT) AS rs, CAST(1 + l_suppkey % 3 AS INT) AS cs FROM lineitem WHERE l_returnflag <> 'R'"


@register(f"""WITH c AS ({_CELLS}), m AS (SELECT DISTINCT l_orderkey, y, x FROM (SELECT l_orderkey, unnest(range(r, least(r + rs, 7))) AS y, c, cs FROM c), LATERAL (SELECT unnest(range(c, least(c + cs, 6))) AS x)), a AS (SELECT l_orderkey, count(*) AS content_area FROM m GROUP BY 1),
br AS (SELECT l_orderkey, y FROM (SELECT DISTINCT l_orderkey FROM m), (SELECT unnest(range(1, 6)) AS y) EXCEPT SELECT l_orderkey, y FROM m), bc AS (SELECT l_orderkey, x FROM (SELECT DISTINCT l_orderkey FROM m), (SELECT unnest(range(1, 5)) AS x) EXCEPT SELECT l_orderkey, x FROM m),
rr AS (SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, y - row_number() OVER (PARTITION BY l_orderkey ORDER BY y) AS i FROM br) GROUP BY l_orderkey, i), rc AS (SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, x - row_number() OVER (PARTITION BY l_orderkey ORDER BY x) AS i FROM bc) GROUP BY l_orderkey, i)
SELECT a.l_orderkey, content_area, 1 - content_area / 42 AS blank_ratio, (SELECT count(*) FROM br WHERE br.l_orderkey = a.l_orderkey) AS blank_rows, (SELECT count(*) FROM bc WHERE bc.l_orderkey = a.l_orderkey) AS blank_cols, greatest(coalesce((SELECT max(n) FROM rr WHERE rr.l_orderkey = a.l_orderkey), 0), coalesce((SELECT max(n) FROM rc WHERE rc.l_orderkey = a.l_orderkey), 0)) AS longest_blank FROM a""")
def table_masks(spark, d) -> DataFrame:
    """Tables' cells with their spans: what is covered, what is blank, and the longest run of blank lines."""
    n = F.col("l_suppkey")
    cells = table(spark, d, "lineitem").filter("l_returnflag <> 'R'").select("l_orderkey", (F.col("l_linenumber") - 1).alias("row"), (F.col("l_partkey") % 6).cast("int").alias("col"), (n % 2 + 1).cast("int").alias("row_span"), (n % 3 + 1).cast("int").alias("col_span"), F.lit(True).alias("full"), F.lit(7).alias("num_rows"), F.lit(6).alias("num_cols"))
    mask = C.content_mask(cells, ["l_orderkey"], "num_rows", "num_cols", "full")
    tables = cells.select("l_orderkey", "num_rows", "num_cols").distinct()
    return C.table_summaries(tables, mask, ["l_orderkey"]).select("l_orderkey", "content_area", "blank_ratio", "blank_rows", "blank_cols", "longest_blank")


@register("""WITH t AS (SELECT p_brand, p_size % 3 AS gap, 1 + p_size % 9 AS h, 1 + p_size % 7 AS w, 1 + p_partkey % 4 AS top, p_size % 4 AS lb, p_size % 2 AS br, (1 + p_size % 9) * (1 + p_size % 7) // 2 AS ca FROM part), s AS (SELECT p_brand, gap, count(*) AS n, sum(CASE WHEN h = 1 AND w = 1 THEN 1 ELSE 0 END) AS single, sum(CASE WHEN lb >= 2 THEN 1 ELSE 0 END) AS severe, sum(CASE WHEN h * w >= 6 AND 1 - ca / (h * w) > 0.35 THEN 1 ELSE 0 END) AS sparse, sum(h * w) AS area, sum(h * w - ca) AS blank, sum(br) AS lines, sum(greatest(h - 2, 0) + greatest(w - 2, 0)) AS inn FROM t GROUP BY ALL),
o AS (SELECT p_brand, gap, sum(k - 1) / count(*) AS overlap FROM (SELECT p_brand, gap, y, count(*) AS k FROM (SELECT p_brand, gap, unnest(range(top, top + h)) AS y FROM t) GROUP BY ALL) GROUP BY ALL)
SELECT s.p_brand, s.gap, CAST(severe AS BIGINT) AS severe, round(6.0 * severe + 2.5 * (lines / greatest(inn, 1)) + 1.5 * (sparse / greatest(n, 1)) + single / greatest(n, 1) + 0.5 * (blank / greatest(area, 1)) + overlap, 6)::DOUBLE AS penalty FROM s JOIN o ON s.p_brand = o.p_brand AND s.gap = o.gap""")
def gap_candidates(spark, d) -> DataFrame:
    """Penalties of ways to cut a sheet into tables."""
    size, ca = F.col("p_size"), F.floor((F.col("p_size") % 9 + 1) * (F.col("p_size") % 7 + 1) / 2)
    t = table(spark, d, "part").select("p_brand", (size % 3).alias("gap"), (size % 9 + 1).alias("num_rows"), (size % 7 + 1).alias("num_cols"), (F.col("p_partkey") % 4 + 1).cast("int").alias("top"), (size % 4).alias("longest_blank"), (size % 2).alias("blank_rows"), F.lit(0).alias("blank_cols"), ca.alias("content_area"))
    t = t.withColumn("area", F.col("num_rows") * F.col("num_cols")).withColumn("blank_ratio", 1 - F.col("content_area") / F.col("area")).withColumn("is_single", (F.col("num_rows") == 1) & (F.col("num_cols") == 1))
    return C.candidate_summaries(t, ["p_brand", "gap"]).select("p_brand", "gap", F.col("severe").cast("long").alias("severe"), F.round("penalty", 6).alias("penalty"))


# Layout ------------------------------------------------------------------------------

_INT_BOXES = "SELECT user_id, event_id AS k, CAST(event_id % 17 AS DOUBLE) AS x1, CAST(event_id * 7 % 13 AS DOUBLE) AS y1, event_id % 17 + 1.0 + event_id % 5 AS x2, event_id * 7 % 13 + 1.0 + event_id % 4 AS y2, CASE WHEN event_type = 'view' THEN 'picture' ELSE 'text' END AS kind FROM events"


def _int_boxes(spark, d) -> DataFrame:
    k = F.col("event_id")
    x, y = (k % 17).cast("double"), (k * 7 % 13).cast("double")
    return table(spark, d, "events").select("user_id", k.alias("k"), x.alias("x1"), y.alias("y1"), (x + 1 + k % 5).alias("x2"), (y + 1 + k % 4).alias("y2"), F.when(F.col("event_type") == "view", "picture").otherwise("text").alias("kind"))


@register(f"""WITH b AS ({_INT_BOXES}), p AS (SELECT DISTINCT user_id, x, y FROM (SELECT user_id, unnest(range(x1::BIGINT, x2::BIGINT)) AS x, y1, y2 FROM b), LATERAL (SELECT unnest(range(y1::BIGINT, y2::BIGINT)) AS y)) SELECT user_id, count(*)::DOUBLE AS area FROM p GROUP BY 1""")
def union_area(spark, d) -> DataFrame:
    """What boxes cover together."""
    return regions.union_areas(_int_boxes(spark, d), ["user_id"])


@register(f"""WITH b AS ({_INT_BOXES}), c AS (SELECT DISTINCT a.user_id, a.k, x, y FROM (SELECT * FROM b WHERE kind = 'picture') a JOIN (SELECT * FROM b WHERE kind = 'text') t ON a.user_id = t.user_id AND t.k > a.k AND t.x1 < a.x2 AND a.x1 < t.x2 AND t.y1 < a.y2 AND a.y1 < t.y2, LATERAL (SELECT unnest(range(greatest(a.x1, t.x1)::BIGINT, least(a.x2, t.x2)::BIGINT)) AS x) v, LATERAL (SELECT unnest(range(greatest(a.y1, t.y1)::BIGINT, least(a.y2, t.y2)::BIGINT)) AS y) w)
SELECT c.user_id, c.k FROM c JOIN b ON b.user_id = c.user_id AND b.k = c.k GROUP BY c.user_id, c.k HAVING count(*) >= 0.1 * any_value((x2 - x1) * (y2 - y1))""")
def background_pictures(spark, d) -> DataFrame:
    """Pictures behind later texts."""
    return B.background_pictures(_int_boxes(spark, d), ["user_id"], "k")


@register(f"""WITH b AS ({_INT_BOXES}) SELECT k FROM b a WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.user_id = a.user_id AND o.k <> a.k AND a.x1 >= o.x1 AND a.y1 >= o.y1 AND a.x2 <= o.x2 AND a.y2 <= o.y2)""")
def boxes_outside(spark, d) -> DataFrame:
    """Boxes that lie in no other."""
    return B.without_inside(_int_boxes(spark, d), ["user_id"], "k").select("k")


@register(f"""WITH b AS ({_INT_BOXES}) SELECT a.k, (SELECT min(o.k) FROM b o WHERE o.user_id = a.user_id AND o.kind = 'picture' AND abs(o.x1 - a.x1) <= 1 AND abs(o.y1 - a.y1) <= 1 AND abs(o.x2 - a.x2) <= 1 AND abs(o.y2 - a.y2) <= 1) AS other FROM b a""")
def boxes_matched(spark, d) -> DataFrame:
    """For each box the first picture whose edges are within one of its own."""
    own = _int_boxes(spark, d)
    return B.matched(own, own.filter("kind = 'picture'").withColumnRenamed("k", "other"), ["user_id"], "k", "other").select("k", "other")


@register("""WITH p AS (SELECT l_suppkey, y, count(*) AS n FROM (SELECT l_suppkey, unnest(range(CAST(l_partkey % 300 AS BIGINT), CAST(l_partkey % 300 AS BIGINT) + 3)) AS y FROM lineitem) GROUP BY ALL), g AS (SELECT *, y - lag(y) OVER (PARTITION BY l_suppkey ORDER BY y) > 2 AS new FROM p WHERE n > 1), r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY y) AS run FROM g)
SELECT l_suppkey, min(y) AS run_start, max(y) + 1 AS run_end FROM r GROUP BY l_suppkey, run""")
def profile_splits(spark, d) -> DataFrame:
    """Stretches of a coverage profile, cut at its gaps."""
    at = F.col("l_partkey") % 300
    rows = table(spark, d, "lineitem").select("l_suppkey", at.alias("a"), (at + 3).alias("b"))
    return B.profile_runs(rows, ["l_suppkey"], "a", "b", 1, 2)


@register("""WITH b AS (SELECT vec_id, vec_id // 8 AS page, CAST(vec_id % 8 AS INT) AS k, ['text', 'doc_title', 'formula', 'footer', 'image'][CAST(label % 5 AS INT) + 1] AS label FROM embeddings), t AS (SELECT page, k, CASE label WHEN 'doc_title' THEN '# t' || vec_id WHEN 'formula' THEN '$$' || chr(10) || 't' || vec_id || chr(10) || '$$' ELSE 't' || vec_id END AS txt FROM b WHERE label <> 'footer')
SELECT CAST(p.page AS VARCHAR) AS doc_id, coalesce(string_agg(txt, chr(10) ORDER BY t.k DESC), '') AS content FROM (SELECT DISTINCT page FROM b) p LEFT JOIN t ON t.page = p.page GROUP BY p.page""")
def engine_pages(spark, d) -> DataFrame:
    """Images through an engine: layout, rules for boxes, texts in their labels' formats, a page's texts in order. The stub engine answers from the images' bytes."""
    from sheafspark.operators import ocr

    k, lit = (F.col("vec_id") % 8).cast("int"), F.lit
    label = F.element_at(F.array(*map(lit, ("text", "doc_title", "formula", "footer", "image"))), (F.col("label") % 5 + 1).cast("int"))
    x, y = (k % 2) * 300, F.floor(k / 2) * 200
    block = F.struct(k.alias("k"), F.to_json(F.array(label, lit("0.9"), x.cast("string"), y.cast("string"), (x + 250).cast("string"), (y + 150).cast("string"), (lit(9) - k).cast("string"), F.concat(lit("t"), F.col("vec_id").cast("string")))).alias("j"))
    own = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 8).alias("page")).agg(F.array_sort(F.collect_list(block)).alias("b"))
    body = F.concat(lit('{"width": 600, "height": 800, "blocks": ['), F.array_join(F.transform("b", lambda z: F.regexp_replace(z["j"], r'"(-?\d+(?:\.\d+)?)"', "$1")), ","), lit("]}"))
    images = own.select(F.col("page").cast("string").alias("path"), lit("image").alias("category"), F.encode(body, "UTF-8").alias("content"))
    return ocr.read(images, ocr.Stub, drop=("footer",)).select("doc_id", "content")
