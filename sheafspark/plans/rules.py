"""Queries over single rules: text, links, geometry, formulas, HTML fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.functions import geometry as G
from sheafspark.functions import text as T
from sheafspark.plans.common import Register, spread, table

register = Register()


@register(r"""SELECT p_partkey, p_brand AS unit, chr(92) || '___' AS rule, '$x$ ' || p_name AS equation, '<img alt="" src="f/' || p_name || '.png"><img src="data:x">' AS image, 'intro ' || p_name AS entry, 'body' AS fenced, 'a_' || p_size AS math,
'f%28' || p_size || '%29' AS url, '&lt;b&gt;' || p_name || '<br>' || p_size AS cell, 'Heading' AS style_name, 1 + p_size % 9 AS style_level, p_size % 2 = 0 OR p_size % 3 = 1 AS token, [p_name, p_brand, ''] AS dense, [p_name, '', p_brand] AS trimmed FROM part""")
def text_rules(spark, d) -> DataFrame:
    """Rules that readers and writers share, each on a text of a part."""
    from sheafspark.functions import tables as TB

    n, size, lit = F.col("p_name"), F.col("p_size").cast("string"), F.lit
    name, level = T.heading_style(F.concat(lit("Heading "), (lit(1) + F.col("p_size") % 9).cast("string")))
    token = F.when(F.col("p_size") % 2 == 0, size).when(F.col("p_size") % 3 == 1, lit("xiv")).otherwise(lit("x-1"))
    unit = F.concat(F.col("p_brand"), F.col("p_brand"), F.col("p_brand"))
    points = F.map_from_arrays(F.array(lit(0), lit(1), lit(2)), F.array(n, F.col("p_brand"), lit("")))
    return table(spark, d, "part").select(
        "p_partkey", T.repeat_unit(unit).alias("unit"), T.escape_rule(lit("___")).alias("rule"), T.equation_tags(F.concat(lit("<eq>x</eq> "), n)).alias("equation"),
        T.image_prefix(F.concat(lit('<img alt="" src="'), n, lit('.png"><img src="data:x">')), "f").alias("image"), T.strip_page_tail(F.concat(lit("intro\t"), n, lit("\t"), size)).alias("entry"),
        T.strip_fence(lit("```py\nbody\n```")).alias("fenced"), T.strip_math(F.concat(lit("$$a_"), size, lit("$$"))).alias("math"), T.escape_parentheses(F.concat(lit("f("), size, lit(")"))).alias("url"),
        T.escape_with_breaks(F.concat(lit("<b>"), n, lit("\n"), size)).alias("cell"), name.alias("style_name"), level.alias("style_level"), T.page_token(token).alias("token"),
        TB.dense(points).alias("dense"), TB.trim_empty(F.array(n, lit(""), F.col("p_brand"), lit(""), lit(""))).alias("trimmed"),
    )


_PAIR = """SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS ax1, CAST(l_quantity AS DOUBLE) AS ay1, l_linenumber + 10.0 AS ax2, l_quantity + 8.0 AS ay2,
CAST(l_suppkey % 20 AS DOUBLE) AS bx1, CAST(l_partkey % 50 AS DOUBLE) AS by1, l_suppkey % 20 + 6.0 AS bx2, l_partkey % 50 + 12.0 AS by2 FROM lineitem"""


def _pairs(spark, d) -> DataFrame:
    k, q, s, p = (F.col(c).cast("double") for c in ("l_linenumber", "l_quantity", "l_suppkey", "l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", k.alias("ax1"), q.alias("ay1"), (k + 10).alias("ax2"), (q + 8).alias("ay2"), (s % 20).alias("bx1"), (p % 50).alias("by1"), (s % 20 + 6).alias("bx2"), (p % 50 + 12).alias("by2"))


@register(f"""WITH p AS ({_PAIR}), o AS (SELECT *, greatest(0.0, least(ax2, bx2) - greatest(ax1, bx1)) AS w, greatest(0.0, least(ay2, by2) - greatest(ay1, by1)) AS h, greatest(0.0, least(ax2, bx2) - greatest(ax1, bx1) + 1) * greatest(0.0, least(ay2, by2) - greatest(ay1, by1) + 1) AS pix FROM p)
SELECT l_orderkey, l_linenumber, pix / (11.0 * 9 + 7.0 * 13 - pix) AS pixel_iou, w * h / 80.0 AS in_first, w * h / 72.0 AS in_smaller, w / 10.0 AS across, w / 6.0 AS narrower, w * h / 80.0 >= 0.8 AS held, bx2 < ax1 AS is_left, ax2 < bx1 AS is_right, by2 < ay1 AS is_above, ay2 < by1 AS is_below,
pow(greatest(0.0, ax1 - bx2, bx1 - ax2), 2) + pow(greatest(0.0, ay1 - by2, by1 - ay2), 2) AS edge2, pow((ax1 + ax2 - bx1 - bx2) / 2, 2) + pow((ay1 + ay2 - by1 - by2) / 2, 2) AS centre2,
[ax1 - 5, ay1 - 4, ax1 + 15, ay1 + 12] AS grown, [ax1, ay1, 10.0, 8.0] AS sized, [ax1, ay1, ax2, ay2] AS back, [ax1, ay1, ax2, ay1, ax2, ay2, ax1, ay2] AS points, [0.0, ay1, ax2, ay2] AS floored, [ax1 * 2 + 3, ay1 * 4 + 5, ax2 * 2 + 3, ay2 * 4 + 5] AS moved, [6.0, 12.0, 13.0, 29.0]::DOUBLE[] AS composed FROM o""")
def box_measures(spark, d) -> DataFrame:
    """Measures of two boxes: overlaps, distances (squared), places, growth, forms and transforms."""
    a, b, lit = G.box("a"), G.box("b"), F.lit
    where, arr = G.relative(a, b), lambda x: F.array(*x)
    square = lambda x: F.bround(x * x, 6)
    moved = G.affine(a, lit(2.0), lit(4.0), lit(3.0), lit(5.0))
    return _pairs(spark, d).select(
        "l_orderkey", "l_linenumber", G.iou(a, b, 1).alias("pixel_iou"), G.share_of(a, b).alias("in_first"), G.smaller_share(a, b).alias("in_smaller"), G.horizontal_share(a, b).alias("across"), G.narrower_share(a, b).alias("narrower"),
        G.contained(a, b).alias("held"), where["left"].alias("is_left"), where["right"].alias("is_right"), where["top"].alias("is_above"), where["bottom"].alias("is_below"), square(G.edge_distance(a, b)).alias("edge2"), square(G.center_distance(a, b)).alias("centre2"),
        arr(G.unclip(a, 2.0)).alias("grown"), arr(G.to_xywh(a)).alias("sized"), arr(G.to_xyxy(G.to_xywh(a))).alias("back"), G.corners(a).alias("points"), arr(G.of_points(F.array(a[0] - 100, a[2]), F.array(a[1], a[3]))).alias("floored"), arr(moved).alias("moved"),
        arr(G.compose((lit(2.0), lit(4.0), lit(3.0), lit(5.0)), (lit(3.0), lit(3.0), lit(5.0), lit(6.0)))).alias("composed"),
    )


@register("""WITH s AS (SELECT p_partkey, p_size * 40 AS w, 20 + p_size * 23 AS h FROM part), m AS (SELECT *, greatest(w, h) AS side FROM s)
SELECT p_partkey, CASE WHEN side > 1124 THEN w * 1124 // side ELSE w END AS fit_w, CASE WHEN side > 1124 THEN h * 1124 // side ELSE h END AS fit_h, [w * 100 // 1000, h * 200 // 1000, w * 600 // 1000, h * 800 // 1000] AS crop,
w * 0.5 < 100 OR h < 80 OR w * 0.5 * h < 8000 AS small FROM m""")
def picture_sizes(spark, d) -> DataFrame:
    """Sizes of pictures: brought to a longest side, a region given in thousandths, whether a picture is small on its slide."""
    part = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40).alias("w"), (F.col("p_size") * 23 + 20).alias("h"))
    fit = G.fitted(F.col("w"), F.col("h"), 1124)
    box = (F.lit(0.0), F.lit(0.0), F.col("w") * 0.5, F.col("h").cast("double"))
    return part.select("p_partkey", fit[0].alias("fit_w"), fit[1].alias("fit_h"), F.array(*G.region(F.col("w"), F.col("h"), (100, 200, 600, 800))).alias("crop"), G.small_picture(box, F.lit(1000.0), F.lit(800.0)).alias("small"))


_OMML = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def _run(x) -> F.Column:
    return F.concat(F.lit("<m:r><m:t>"), x if isinstance(x, F.Column) else F.lit(x), F.lit("</m:t></m:r>"))


def _tag(name: str, *inner) -> F.Column:
    return F.concat(F.lit(f"<m:{name}>"), *[x if isinstance(x, F.Column) else F.lit(x) for x in inner], F.lit(f"</m:{name}>"))


@register(r"""WITH s AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS n FROM part)
SELECT p_partkey, '\frac{' || n || '}{3}' AS fraction, '\sqrt[' || n || ']{x}' AS root, '{x}_{' || n || '}' AS sub, '{x}^{' || n || '}' AS sup, '{x}_{1}^{' || n || '}' AS both, '\sum_{i}^{' || n || '} i' AS total, '\int_{0}^{' || n || '} x' AS integral, '\left( ' || n || ' \right)' AS round, '\left[ ' || n || ' \right]' AS square,
'\begin{matrix}1 & ' || n || ' \\ 3 & 4\end{matrix}' AS matrix, '\sin ' || n AS func, '\hat{x}' AS accent, '\overline{' || n || '}' AS bar, '\underbrace{' || n || '}' AS grouped, '\lim_{n\to ' || n || '}' AS low, '\max^{' || n || '}' AS upp, '\begin{array}{l}a=' || n || ' \\ b=2\end{array}' AS rows, 'a=' || n || '\tag{3}' AS tagged, '\alpha \leq \beta \infty' AS symbols FROM s""")
def omml_formulas(spark, d) -> DataFrame:
    """Formulas of office files as LaTeX, one of each kind for each part."""
    from sheafspark.operators import texts

    n = _run(F.col("p_size").cast("string"))
    num, e = (lambda x: _tag("num", x)), (lambda x: _tag("e", x))
    made = {
        "fraction": _tag("f", num(n), _tag("den", _run("3"))), "root": _tag("rad", _tag("deg", n), e(_run("x"))), "sub": _tag("sSub", e(_run("x")), _tag("sub", n)), "sup": _tag("sSup", e(_run("x")), _tag("sup", n)),
        "both": _tag("sSubSup", e(_run("x")), _tag("sub", _run("1")), _tag("sup", n)), "total": _tag("nary", "<m:naryPr><m:chr m:val='∑'/></m:naryPr>", _tag("sub", _run("i")), _tag("sup", n), e(_run("i"))),
        "integral": _tag("nary", _tag("sub", _run("0")), _tag("sup", n), e(_run("x"))), "round": _tag("d", e(n)), "square": _tag("d", "<m:dPr><m:begChr m:val='['/><m:endChr m:val=']'/></m:dPr>", e(n)),
        "matrix": _tag("m", _tag("mr", e(_run("1")), e(n)), _tag("mr", e(_run("3")), e(_run("4")))), "func": _tag("func", _tag("fName", _run("sin")), e(n)), "accent": _tag("acc", "<m:accPr><m:chr m:val='̂'/></m:accPr>", e(_run("x"))),
        "bar": _tag("bar", "<m:barPr><m:pos m:val='top'/></m:barPr>", e(n)), "grouped": _tag("groupChr", "<m:groupChrPr><m:chr m:val='⏟'/></m:groupChrPr>", e(n)), "low": _tag("limLow", e(_run("lim")), _tag("lim", _run(F.concat(F.lit("n→"), F.col("p_size").cast("string"))))),
        "upp": _tag("limUpp", e(_run("max")), _tag("lim", n)), "rows": _tag("eqArr", e(_run(F.concat(F.lit("a="), F.col("p_size").cast("string")))), e(_run("b=2"))), "tagged": _tag("eqArr", e(_run(F.concat(F.lit("a="), F.col("p_size").cast("string"), F.lit("#(3)"))))), "symbols": _run("α≤β∞"),
    }
    return spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", *[texts.latex(F.concat(F.lit(f"<m:oMath {_OMML}>"), x, F.lit("</m:oMath>"))).alias(k) for k, x in made.items()])


@register(r"""SELECT p_partkey, '## ' || p_name || chr(10) || 'x [l](/u%20v) <http://x.y> j' AS heading, '![' || p_name || '](a.png "T")' AS picture, '- ' || p_name || chr(10) || '  - b' || chr(10) || '1. x' || chr(10) || '2. y' AS lists,
'```' || chr(10) || p_name || chr(10) || '```' || chr(10) || '> q' || chr(10) || '---' || chr(10) || '`z`' AS quoted, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | 2 |' AS grid, '*' || p_name || '* **s** **b** *i*' AS marks FROM part""")
def html_fragments(spark, d) -> DataFrame:
    """HTML of parts as Markdown: headings, links, pictures, lists, quotes, tables, emphasis."""
    from sheafspark.sources import html

    n, lit = F.col("p_name"), F.lit
    made = {
        "heading": F.concat(lit("<h2>"), n, lit('</h2><p>x <a href="/u v">l</a> <a href="http://x.y">http://x.y</a> <a href="javascript:1">j</a></p>')), "picture": F.concat(lit('<p><img src="a.png" alt="'), n, lit('" title="T"></p>')),
        "lists": F.concat(lit("<ul><li>"), n, lit("<ul><li>b</li></ul></li></ul><ol><li>x</li><li>y</li></ol>")), "quoted": F.concat(lit("<pre>"), n, lit("</pre><blockquote>q</blockquote><hr><code>z</code>")),
        "grid": F.concat(lit("<table><tr><th>a</th><th>b</th></tr><tr><td>"), n, lit("</td><td>2</td></tr></table>")), "marks": F.concat(lit("<p><em>"), n, lit("</em> <strong>s</strong> <b>b</b> <i>i</i></p>")),
    }
    return spread(table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", *[html.markdown(x).alias(k) for k, x in made.items()])


@register(r"""SELECT p_partkey, '<table><tr><td colspan="2">' || p_name || '</td><td><a href="http://x">l</a><a>j</a></td></tr></table>' AS cleaned, '<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td colspan="2">' || p_name || '</td></tr></table>' AS even FROM part""")
def table_html_rules(spark, d) -> DataFrame:
    """Tables cleaned to what is kept, and spans cut to what most rows have."""
    from sheafspark.operators import texts

    n, lit = F.col("p_name"), F.lit
    dirty = F.concat(lit('<TABLE class="x"><TR><TD colspan="2" style="y">'), n, lit('</TD><td><a href="http://x" onclick="z">l</a><a href="javascript:1">j</a></td></TR></TABLE>'))
    wide = F.concat(lit("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td colspan=\"4\">"), n, lit("</td></tr></table>"))
    return table(spark, d, "part").select("p_partkey", texts.clean_table(dirty).alias("cleaned"), texts.even_spans(wide).alias("even"))


@register(r"""WITH s AS (SELECT *, p_size % 4 AS m FROM part)
SELECT p_partkey, CASE m WHEN 0 THEN 'a **' || p_name || '.** b' WHEN 1 THEN 'a <u>' || p_name || '</u><em>i</em>&lt;' WHEN 2 THEN 'a $x$  [**' || p_name || '**](http://l)' ELSE chr(92) || '- ' || p_name END AS markdown,
CASE m WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 4 ELSE 1 END AS n_spans, CASE m WHEN 1 THEN 'html' ELSE 'markdown' END AS syntax FROM s""")
def inline_spans(spark, d) -> DataFrame:
    """Marked text to spans and from there to Markdown, or HTML where a block's styles need it."""
    from sheafspark.operators import texts

    n, lit, m = F.col("p_name"), F.lit, F.col("p_size") % 4
    source = F.when(m == 0, F.concat(lit('a <text style="bold">'), n, lit(".</text>b"))).when(m == 1, F.concat(lit('a <text style="underline">'), n, lit('</text><text style="italic">i</text><'))).when(m == 2, F.concat(lit('a <eq>x</eq> <hyperlink><text style="bold">'), n, lit("</text><url>http://l</url></hyperlink>"))).otherwise(F.concat(lit("- "), n))
    got = texts.inline(source)
    return table(spark, d, "part").select("p_partkey", got.alias("g")).select("p_partkey", "g.markdown", "g.n_spans", "g.syntax")


@register(r"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '<text style="bold">' || p_name || p_brand || '</text> tail' WHEN 1 THEN '<hyperlink><text>' || p_name || '</text><text style="italic">' || p_brand || '</text><url>http://l</url></hyperlink>' ELSE '<text style="underline"> </text>' || p_name END AS marked FROM part""")
def rich_runs(spark, d) -> DataFrame:
    """Runs of a paragraph as marked text: neighbours joined, links grouped, ends trimmed unless they show."""
    from sheafspark.operators import texts

    seg = lambda t, s="", u=None: F.struct(F.lit(t).alias("text") if not isinstance(t, F.Column) else t.alias("text"), F.lit(s).alias("style"), F.lit(u).cast("string").alias("url"))
    n, b, m = F.col("p_name"), F.col("p_brand"), F.col("p_size") % 3
    runs = F.when(m == 0, F.array(seg("  "), seg(n, "bold"), seg(b, "bold"), seg(" tail "))).when(m == 1, F.array(seg(n, "", "http://l"), seg(b, "italic", "http://l"), seg(" "))).otherwise(F.array(seg(" ", "underline"), seg(n)))
    return table(spark, d, "part").select("p_partkey", texts.rich(runs).alias("marked"))


@register(r"""WITH t AS (SELECT p_partkey, p_size % 3 AS m, 20 + p_size AS n, p_name || '. ' AS u FROM part)
SELECT p_partkey, CASE m WHEN 0 THEN 'lead ' || p_partkey || ':' || repeat(' over and over', CAST(n % (n // 5) AS INT)) WHEN 1 THEN 'ab' ELSE rtrim(u) END AS content FROM t""")
def repeat_built(spark, d) -> DataFrame:
    """Runaway repetition of each kind, cut to what is not repeated."""
    from sheafspark.operators import texts

    n, u, m = F.col("p_size") + 20, F.concat("p_name", F.lit(". ")), F.col("p_size") % 3
    text = F.when(m == 0, F.concat(F.lit("lead "), F.col("p_partkey").cast("string"), F.lit(":"), F.repeat(F.lit(" over and over"), n))).when(m == 1, F.repeat(F.lit("ab"), F.lit(40))).otherwise(F.repeat(F.concat(u, F.lit("\n")), n))
    return texts.truncated(table(spark, d, "part").select("p_partkey", text.alias("t")), ["p_partkey"], "t")


@register(r"""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '$$' || chr(10) || 'x' || chr(10) || '$$' WHEN 2 THEN '$$' || chr(10) || '$ x $' || chr(10) || '$$' WHEN 3 THEN '<table><tr><td>' || p_name || '</td></tr></table>' ELSE p_name END AS vl, CASE p_size % 5 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '$$' || chr(10) || 'x' || chr(10) || '$$' WHEN 2 THEN '$$' || chr(10) || '\(x\)' || chr(10) || '$$' WHEN 3 THEN '<fcel>' || p_name || '<nl>' ELSE p_name END AS glm,
CASE p_size % 5 WHEN 0 THEN 'OCR:' WHEN 1 THEN 'Formula Recognition:' WHEN 2 THEN 'Formula Recognition:' WHEN 3 THEN 'Table Recognition:' ELSE 'Seal Recognition:' END AS prompt FROM part""")
def recognised_texts(spark, d) -> DataFrame:
    """Engines' texts in their labels' formats, and the labels' prompts."""
    from sheafspark.operators import texts

    m, n, lit = F.col("p_size") % 5, F.col("p_name"), F.lit
    label = F.element_at(F.array(*map(lit, ("doc_title", "formula", "formula", "table", "seal"))), (m + 1).cast("int"))
    raw = F.when(m == 1, "x").when(m == 2, r"\(x\)").when(m == 3, F.concat(lit("<fcel>"), n, lit("<nl>"))).otherwise(n)
    rows = table(spark, d, "part").select("p_partkey", label.alias("label"), raw.alias("raw"))
    return rows.select("p_partkey", texts.recognised("vl")("raw", "label").alias("vl"), texts.recognised("glm")("raw", "label").alias("glm"), texts.prompts("label").alias("prompt"))

@register("SELECT doc_id, 'data:text/plain;base64,' || base64(encode(text)) AS uri, text AS back, CAST(NULL AS VARCHAR) AS broken, 0.75::DOUBLE AS sure FROM documents")
def data_uris(spark, d) -> DataFrame:
    """Bytes as data URIs and back; what can't be decoded is null; the mean of scores."""
    from sheafspark.operators import ocr

    uri = ocr.data_uri(F.encode("text", "UTF-8"), F.lit("text/plain"))
    rows = table(spark, d, "documents").select("doc_id", uri.alias("uri"))
    return rows.select("doc_id", "uri", F.decode(ocr.from_data_uri(F.col("uri")), "UTF-8").alias("back"), F.decode(ocr.from_data_uri(F.lit("data:x;base64,*")), "UTF-8").alias("broken"), ocr.score(F.array(F.lit(0.5), F.lit(1.0))).alias("sure"))
