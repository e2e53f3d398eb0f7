"""Queries over graphs, ranges, packages and streams with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.operators import graph, regions
from sheafspark.plans.common import Register, table
from sheafspark.session import Stored

register = Register()


@register("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_id, text AS content, false AS is_end, NULL::BIGINT AS n_pages FROM conversations
UNION ALL SELECT conv_id, NULL, NULL, true, count(*) FROM conversations GROUP BY conv_id""")
def stream_pages(spark, d) -> DataFrame:
    """Turns as pages of their conversations, streamed from files that cut every conversation in several micro-batches, each conversation closed by an end row."""
    from sheafspark.streaming import paged

    tables = Stored(spark)
    own = table(spark, d, "conversations").select("conv_id", "turn", "text", F.count("*").over(Window.partitionBy("conv_id")).alias("n_pages"))
    source, target, checkpoint = (tables.folder() for _ in range(3))
    own.repartitionByRange(4, "turn").write.parquet(source)
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(source)
    pages = paged.page_stream(stream, "conv_id", "turn", "text", "n_pages")
    paged.run(pages, target, checkpoint)
    return spark.read.schema(pages.schema).parquet(target).select("conv_id", "page_id", "content", "is_end", "n_pages")


@register("""SELECT 'site' || page_id % 7 || '/p' || page_id || '.html' AS name, strlen(html) AS size_bytes, md5(html) AS md5 FROM pages WHERE page_id % 3 = 0 AND strlen(html) > 2000""")
def member_scan(spark, d) -> DataFrame:
    """Members of packages that hold all pages, by suffix and size: neither is read from a member that the filters leave out."""
    from sheafspark.sources import members

    members.register(spark)
    folder = Stored(spark).folder()
    ends = F.array(F.lit(".html"), F.lit(".TXT"), F.lit(""))[(F.col("page_id") % 3).cast("int")]
    name = F.concat(F.lit("site"), F.col("page_id") % 7, F.lit("/p"), "page_id", ends)
    table(spark, d, "pages").select(name.alias("name"), F.encode("html", "UTF-8").alias("content")).repartition(8, "name").write.format("members").mode("append").option("path", folder).save()
    found = spark.read.format("members").schema("name string, suffix string, size_bytes long, content binary").option("splitBytes", 1 << 16).load(folder)
    return found.filter("suffix = 'html' AND size_bytes > 2000").select("name", "size_bytes", F.md5("content").alias("md5"))


_EDGES = """WITH o AS (SELECT o_custkey, o_orderkey AS k, o_orderstatus AS s, left(o_orderpriority, 1) AS p FROM orders),
n AS (SELECT *, lead(k) OVER w AS k1, lead(s) OVER w AS s1, lead(k, 2) OVER w AS k2, lead(p, 2) OVER w AS p2 FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY k)),
e AS (SELECT o_custkey, k AS source, k1 AS target FROM n WHERE s = s1 UNION ALL SELECT o_custkey, k, k2 FROM n WHERE p = p2)"""


@register(_EDGES.replace("WITH", "WITH RECURSIVE", 1) + """, r AS (SELECT o_custkey, min(k) AS k, 0 AS hops FROM o GROUP BY 1 UNION SELECT r.o_custkey, e.target, r.hops + 1 FROM r JOIN e ON e.o_custkey = r.o_custkey AND e.source = r.k)
SELECT o_custkey, k AS o_orderkey, min(hops) AS hops FROM r GROUP BY ALL""")
def part_reachability(spark, d) -> DataFrame:
    """Orders as a package's members: those that a customer's first leads to, over relations to members that there are."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    own = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("s"), F.left("o_orderpriority", F.lit(1)).alias("p"))
    near = own.select("o_custkey", F.col("o_orderkey").alias("source"), F.when(F.col("s") == F.lead("s").over(w), F.lead("o_orderkey").over(w)).alias("a"), F.when(F.col("p") == F.lead("p", 2).over(w), F.lead("o_orderkey", 2).over(w)).alias("b"))
    # every fifth order points to a member that isn't there
    gone = F.when(F.col("source") % 5 == 0, -F.col("source"))
    edges = near.select("o_custkey", "source", F.explode(F.array_compact(F.array("a", "b", gone))).alias("target"))
    edges = graph.known_edges(edges, own, ["o_custkey"], "target", "o_orderkey")
    seeds = own.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return graph.reachable(edges, seeds, ["o_custkey"], "source", "target", "o_orderkey")


_CELLS = "c AS (SELECT user_id, (event_id % 53)::INT AS r, (event_id % 29)::INT AS c, min(event_id) AS id FROM events GROUP BY ALL)"
_MERGES = "m AS (SELECT user_id, (event_id % 53)::INT AS t, (event_id % 29)::INT AS l, (event_id % 53 + event_id % 5)::INT AS b, (event_id % 29 + event_id % 3)::INT AS g FROM events WHERE event_id % 7 = 0)"


def _cells(spark, d) -> DataFrame:
    row, col = (F.col("event_id") % 53).cast("int"), (F.col("event_id") % 29).cast("int")
    return table(spark, d, "events").groupBy("user_id", row.alias("row"), col.alias("col")).agg(F.min("event_id").alias("id"))


@register(f"""WITH {_CELLS}, {_MERGES} SELECT c.user_id, c.r AS row, c.c AS col, count(m.t) > 0 AS merged, coalesce(bool_or(m.t <> c.r OR m.l <> c.c), false) AS hidden
FROM c LEFT JOIN m ON m.user_id = c.user_id AND c.r BETWEEN m.t AND m.b AND c.c BETWEEN m.l AND m.g GROUP BY c.user_id, c.r, c.c""")
def merged_cells_2d(spark, d) -> DataFrame:
    """Cells in merged ranges of several rows and columns, and those that such a range hides."""
    e = F.col("event_id")
    merges = table(spark, d, "events").filter(e % 7 == 0).select("user_id", *[x.cast("int").alias(n) for n, x in zip(regions.BOX, (e % 53, e % 29, e % 53 + e % 5, e % 29 + e % 3), strict=True)])
    return regions.covered_cells(_cells(spark, d), merges, ["user_id"]).select("user_id", "row", "col", "merged", "hidden")


@register(f"""WITH {_CELLS}, f AS (SELECT user_id, event_id AS formula, (event_id % 53)::INT AS t, (event_id % 29)::INT AS l, CASE WHEN event_id % 3 = 1 THEN 0 ELSE (event_id % 17)::INT END AS h, CASE WHEN event_id % 3 = 2 THEN 0 ELSE (event_id % 13)::INT END AS w FROM events WHERE event_id % 11 = 0)
SELECT f.user_id, formula, c.r - f.t + c.c - f.l + 1 AS place, c.id FROM f JOIN c ON c.user_id = f.user_id AND c.r BETWEEN f.t AND f.t + f.h AND c.c BETWEEN f.l AND f.l + f.w WHERE f.h = 0 OR f.w = 0""")
def chart_ranges(spark, d) -> DataFrame:
    """Cells of the ranges that charts' formulas name, along them."""
    e = F.col("event_id")
    high, wide = F.when(e % 3 == 1, 0).otherwise(e % 17), F.when(e % 3 == 2, 0).otherwise(e % 13)
    formulas = table(spark, d, "events").filter(e % 11 == 0).select("user_id", e.alias("formula"), *[x.cast("int").alias(n) for n, x in zip(regions.BOX, (e % 53, e % 29, e % 53 + high, e % 29 + wide), strict=True)])
    return regions.vector_cells(_cells(spark, d), formulas, ["user_id"], "formula").select("user_id", "formula", "place", "id")


_TABLES = """w AS (SELECT o_custkey, o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE replace(o_orderpriority, ' ', '') || o_orderstatus END AS t, o_orderkey % 4 AS r, o_orderkey % 6 AS c, o_orderkey % 2 AS m FROM orders),
h AS (SELECT o_custkey, k, CASE WHEN k % 3 = 0 AND t <> '' THEN left(t, length(t) - 1) ELSE t END AS t, CASE WHEN k % 11 = 0 THEN r + 1 ELSE r END AS r, c, m FROM w WHERE k % 5 <> 0)"""


@register(f"""WITH RECURSIVE {_TABLES}, x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS rn FROM w),
l AS (SELECT o_custkey, list({{'i': k, 't': t, 'r': r, 'c': c, 'm': m}} ORDER BY k) AS hs FROM h GROUP BY 1),
y AS (SELECT x.*, list_filter(coalesce(hs, []), lambda o: CASE WHEN x.t <> '' OR o.t <> '' THEN x.t <> '' AND o.t <> '' AND (starts_with(x.t, o.t) OR starts_with(o.t, x.t)) AND (x.r = o.r OR x.c = o.c) ELSE x.r = o.r AND x.c = o.c AND x.m = o.m END) AS fits FROM x LEFT JOIN l USING (o_custkey)),
s AS (SELECT o_custkey, 0::BIGINT AS rn, NULL::BIGINT AS k, -1::BIGINT AS at, NULL::BIGINT AS found FROM (SELECT DISTINCT o_custkey FROM w) UNION ALL
SELECT y.o_custkey, y.rn, y.k, coalesce(list_filter(fits, lambda o: o.i > s.at)[1].i, s.at), list_filter(fits, lambda o: o.i > s.at)[1].i FROM s JOIN y ON y.o_custkey = s.o_custkey AND y.rn = s.rn + 1)
SELECT o_custkey, k AS o_orderkey, found AS offered FROM s WHERE rn > 0""")
def table_alignment(spark, d) -> DataFrame:
    """Tables of a document beside those of another rendering of it, which lacks some, has others changed, and cuts texts."""
    from sheafspark.operators import alignment

    k = F.col("o_orderkey")
    full = F.when(k % 9 == 0, "").otherwise(F.concat("o_orderpriority", F.lit(" "), "o_orderstatus"))
    wanted = table(spark, d, "orders").select("o_custkey", "o_orderkey", full.alias("t"), (k % 4).alias("r"), (k % 6).alias("c"), (k % 2).alias("m"))
    cut = F.when((k % 3 == 0) & (F.length("t") > 0), F.substring("t", F.lit(1), F.length("t") - 1)).otherwise(F.col("t"))
    offered = wanted.filter(k % 5 != 0).withColumn("t", cut).withColumn("r", F.when(k % 11 == 0, F.col("r") + 1).otherwise(F.col("r"))).withColumn("offered", k)
    return alignment.aligned(wanted, offered, ["o_custkey"], "o_orderkey", "t", "r", "c", "m", "offered")


_FORMULAS = "SELECT conv_id, turn, list_transform(string_split(coalesce(text, ''), ' '), lambda w, i: CASE WHEN i % 4 = 0 THEN '<eq>' || w || '</eq>' ELSE w END) AS ws, string_split(coalesce(text, ''), ' ') AS raw FROM conversations"


def _formulas(spark, d) -> DataFrame:
    """Turns in which every fourth word is a formula."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    marked = F.transform(words, lambda w, i: F.when(i % 4 == 3, F.concat(F.lit("<eq>"), w, F.lit("</eq>"))).otherwise(w))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(marked, " ").alias("text"))


@register(f"""WITH t AS ({_FORMULAS}), u AS (SELECT conv_id, turn, array_to_string(ws, ' ') AS text FROM t),
p AS (SELECT *, string_split(regexp_replace(text, '(<eq>[^\\n]*?</eq>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS ps FROM u)
SELECT conv_id, turn, array_to_string(list_transform(ps, lambda x, i: CASE WHEN i % 2 = 1 AND instr(x, 'th') > 0 THEN left(x, instr(x, 'th') - 1) || '[TH]' || substr(x, instr(x, 'th') + 2) ELSE x END), '') AS text FROM p""")
def masked_substitution(spark, d) -> DataFrame:
    """The first "th" between formulas replaced, formulas left alone."""
    from sheafspark.operators import substitution

    return _formulas(spark, d).select("conv_id", "turn", substitution.replace_outside(F.col("text"), F.lit("th"), F.lit("[TH]")).alias("text"))


@register(f"WITH t AS ({_FORMULAS}) SELECT conv_id, turn, array_to_string(list_filter(ws, lambda w, i: i % 4 <> 0 OR w <> '<eq></eq>'), ' ') AS text FROM t WHERE NOT list_contains(raw, '') AND NOT contains(array_to_string(raw, ''), chr(10))")
def formula_merge(spark, d) -> DataFrame:
    """Texts without their formulas, and all pieces in order: the formulas are back in their places. Turns with line breaks or double blanks are other cases' (tests)."""
    from sheafspark.operators import substitution

    words = F.split("text", " ")
    rows = table(spark, d, "conversations").filter(~F.array_contains(words, "") & ~F.contains("text", F.lit("\n")))
    last = lambda i: i == F.size(words) - 1
    piece = lambda w, i: F.when(i % 4 == 3, F.array(F.struct(F.concat(F.lit("<eq>"), w, F.lit("</eq>")).alias("content"), F.lit(True).alias("is_formula")), F.struct(F.when(last(i), "").otherwise(" ").alias("content"), F.lit(False).alias("is_formula")))).otherwise(F.array(F.struct(F.concat(w, F.when(last(i), "").otherwise(" ")).alias("content"), F.lit(False).alias("is_formula"))))
    pieces = F.flatten(F.transform(words, piece))
    plain = F.array_join(F.transform(F.filter(pieces, lambda p: ~p["is_formula"]), lambda p: p["content"]), "")
    return rows.select("conv_id", "turn", substitution.merge_formulas(plain, pieces).alias("text"))


@register(f"""WITH t AS ({_FORMULAS}), v AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(array_to_string(ws, ' '), '(<eq>[^\\n]*?</eq>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x, i: i % 2 = 1) AS ps FROM t),
q AS (SELECT *, array_to_string(ps, '') AS plain, list_transform(range(1, len(ps)), lambda i: length(array_to_string(ps[1:i], ''))) AS cuts FROM v), r AS (SELECT *, unnest(range(0, (length(plain) + 9) // 10)) AS run FROM q WHERE plain <> ''),
s AS (SELECT *, list_sort(list_distinct(list_concat([run * 10, least(run * 10 + 10, length(plain))], list_filter(cuts, lambda b: b > run * 10 AND b < least(run * 10 + 10, length(plain)))))) AS es FROM r), f AS (SELECT *, unnest(range(1, len(es))) AS i FROM s)
SELECT conv_id, turn, CAST(run AS INT) AS run, CAST(i - 1 AS INT) AS fragment, substr(plain, es[i] + 1, es[i + 1] - es[i]) AS content FROM f""")
def run_splits(spark, d) -> DataFrame:
    """Runs of ten characters cut where formulas stand."""
    from sheafspark.operators import substitution

    texts = _formulas(spark, d)
    plain = texts.withColumn("plain", F.array_join(substitution.plain_parts(F.col("text")), "")).filter("plain <> ''")
    runs = plain.select("conv_id", "turn", "plain", F.explode(F.sequence(F.lit(0), F.floor((F.length("plain") + 9) / 10).cast("int") - 1)).alias("run"))
    runs = runs.select("conv_id", "turn", "run", F.substring("plain", F.col("run") * 10 + 1, F.lit(10)).alias("content"))
    return substitution.split_runs(runs, texts, ["conv_id", "turn"], "run", "content", "text").select("conv_id", "turn", "run", "fragment", "content")


@register("""WITH w AS (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS ws FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(ws, lambda w, i: CASE WHEN i % 3 <> 0 THEN w WHEN length(w) % 4 = 0 THEN '![](pic' || length(w) || ')' WHEN length(w) % 4 = 1 THEN '' ELSE 'text ![](pic4) of ' || length(w) END), ' ') AS content FROM w""")
def picture_texts(spark, d) -> DataFrame:
    """Pictures in texts replaced by what was read in them; unknown ones stay, and what is put in isn't searched again."""
    from sheafspark.operators import substitution

    words = F.split(F.coalesce("text", F.lit("")), " ")
    marked = F.transform(words, lambda w, i: F.when(i % 3 == 2, F.concat(F.lit("![](pic"), F.length(w).cast("string"), F.lit(")"))).otherwise(w))
    contents = table(spark, d, "conversations").select("conv_id", "turn", F.array_join(marked, " ").alias("content"))
    sizes = table(spark, d, "conversations").select(F.explode(F.transform(words, lambda w: F.length(w))).alias("n")).distinct().filter("n % 4 <> 0")
    found = sizes.select(F.concat(F.lit("pic"), "n").alias("uri"), F.when(F.col("n") % 4 != 1, F.concat(F.lit("text ![](pic4) of "), "n")).alias("text"))
    return substitution.replace_pictures(contents, found, ["conv_id", "turn"], "content", "uri", "text")


@register("""WITH RECURSIVE b AS (SELECT user_id, event_id AS k, (event_id * 37 % 60)::DOUBLE AS x1, (event_id * 53 % 900)::DOUBLE AS y1, (event_id * 37 % 60 + 10 + event_id % 50)::DOUBLE AS x2, (event_id * 53 % 900 + 9)::DOUBLE AS y2, CASE WHEN event_id % 5 = 0 THEN 'page 7' ELSE 'words' END AS t FROM events),
o AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n, lag(y2) OVER w AS py FROM b WINDOW w AS (PARTITION BY user_id ORDER BY y1, x1, k)),
s AS (SELECT *, CASE WHEN n > 1 AND rn = n THEN CASE WHEN y1 > py AND x1 < 50 AND x2 > 50 THEN 2 WHEN x2 > 50 OR t = 'page 7' THEN 1 ELSE 0 END WHEN x1 < 25 AND x2 < 75 THEN 0 WHEN x1 > 25 AND x2 > 50 THEN CASE WHEN x1 < 47.5 THEN 0 ELSE 1 END ELSE 2 END AS side FROM o),
g AS (SELECT user_id, rn, k, side, CAST(0 AS BIGINT) AS band FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.rn, s.k, s.side, g.band + CASE WHEN g.side = 2 THEN 1 ELSE 0 END FROM g JOIN s ON s.user_id = g.user_id AND s.rn = g.rn + 1)
SELECT user_id, k, CAST(row_number() OVER (PARTITION BY user_id ORDER BY band, side, rn) - 1 AS INT) AS position FROM g""")
def two_column_order(spark, d) -> DataFrame:
    """Boxes of pages in two columns in their reading order."""
    from sheafspark.operators import boxes

    e = F.col("event_id")
    x1, y1 = e * 37 % 60, e * 53 % 900
    own = table(spark, d, "events").select("user_id", e.alias("k"), *[c.cast("double").alias(n) for n, c in (("x1", x1), ("y1", y1), ("x2", x1 + 10 + e % 50), ("y2", y1 + 9))], F.when(e % 5 == 0, "page 7").otherwise("words").alias("text"))
    return boxes.columns_order(own, ["user_id"], "k", F.lit(100.0)).select("user_id", "k", "position")


@register(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 4 AS k FROM documents), n AS (SELECT *, regexp_full_match(text, '[\x{00}-\x{FF}]*') AND k = 3 AS one_byte, regexp_full_match(text, '[\x{01}-\x{7F}]*') AS ascii FROM t)
SELECT doc_id, CASE WHEN k = 1 AND text <> '' THEN 'utf-16-le' WHEN k = 2 AND text <> '' THEN 'utf-16-be' WHEN one_byte AND NOT ascii THEN 'latin-1' ELSE 'utf-8' END AS encoding, md5(text) AS md5 FROM n""")
def encoding_confusion(spark, d) -> DataFrame:
    """Texts written in four encodings without a mark, and read again in the one that the statistics of their bytes say."""
    from sheafspark.operators import texts

    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    one_byte = (k == 3) & text.rlike(r"\A[\x{00}-\x{FF}]*+\z")
    # a row is only written in the encoding that is its own: Latin-1 can't write all
    raw = F.when(k == 1, F.encode(text, "UTF-16LE")).when(k == 2, F.encode(text, "UTF-16BE")).when(one_byte, F.encode(F.when(one_byte, text), "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    found = texts.decoded(table(spark, d, "documents").select("doc_id", raw.alias("content")), ["doc_id"], "content")
    return found.select("doc_id", "encoding", F.md5(F.encode("text", "UTF-8")).alias("md5"))


@register("""SELECT conv_id, turn, sha256(coalesce(text, '')) || '.bin' AS file, strlen(coalesce(text, '')) AS size_bytes, md5(coalesce(text, '')) AS md5 FROM conversations""")
def picture_files(spark, d) -> DataFrame:
    """Bytes as files by their content, and what is in the files."""
    from sheafspark.sources import pictures

    folder = Stored(spark).folder()
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    stored = pictures.store(rows, "content", folder)
    read = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.md5("content").alias("md5"))
    return stored.join(read, "file").select("conv_id", "turn", "file", "size_bytes", "md5")


@register(r"""WITH f AS (SELECT doc_id, coalesce(text, '') AS text, ['txt', 'md', 'pdf', 'csv', 'docx', 'htm'][CAST(doc_id % 6 AS INT) + 1] AS suffix FROM documents)
SELECT doc_id, suffix, CASE suffix WHEN 'txt' THEN 'text' WHEN 'md' THEN 'markdown' WHEN 'htm' THEN 'html' ELSE suffix END AS category, CASE WHEN suffix IN ('txt', 'md', 'csv', 'htm') THEN CASE WHEN text <> '' AND doc_id % 2 = 0 THEN 'utf-16-le' ELSE 'utf-8' END END AS encoding FROM f""")
def file_encodings(spark, d) -> DataFrame:
    """Encodings of files whose kind needs one; the others' bytes aren't looked at."""
    from sheafspark.operators import texts
    from sheafspark.sources import formats

    ends = F.array(*map(F.lit, ("txt", "md", "pdf", "csv", "docx", "htm")))[(F.col("doc_id") % 6).cast("int")]
    text = F.coalesce("text", F.lit(""))
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode(text, "UTF-16LE")).otherwise(F.encode(text, "UTF-8"))
    files = formats.dispatch(table(spark, d, "documents").select("doc_id", F.concat(F.lit("a/b."), ends).alias("path"), raw.alias("content")), "path")
    needs = formats.needs_encoding(F.col("category"))
    found = texts.decoded(files.filter(needs), ["doc_id", "suffix", "category"], "content").select("doc_id", "suffix", "category", "encoding")
    return found.unionByName(files.filter(~needs).select("doc_id", "suffix", "category", F.lit(None).cast("string").alias("encoding")))
