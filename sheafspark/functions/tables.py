"""Tables as text: pipe tables and HTML from cell rows, chart grids, and OTSL marks."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafspark.functions.text import html_escape


def pipe_tables(df: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """keys and markdown: a pipe table of each group's rows in order, columns padded to their widest cell, numbers right.

    Nulls are empty. Two passes: widths by group, then rows; a group's rows meet only in its string.
    """
    kinds = dict(df.dtypes)
    right = {c: not kinds[c].startswith(("string", "boolean", "date", "timestamp")) for c in columns}
    text = df.select(*keys, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns if c not in keys], *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k_{c}") for c in columns if c in keys])
    cell = {c: F.col(f"_k_{c}") if c in keys else F.col(c) for c in columns}
    cells = F.array(*[cell[c] for c in columns])
    widths = text.groupBy(*keys).agg(F.array(*[F.greatest(F.max(F.length(cell[c])), F.lit(max(3, len(c)))) for c in columns]).alias("_w"))
    pad = lambda x, w, r: F.when(F.lit(r), F.lpad(x, w, " ")).otherwise(F.rpad(x, w, " "))

    def line(values: list[Column], width: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.array(*[(F.lpad if right[c] else F.rpad)(v, width[i], " ") for i, (c, v) in enumerate(zip(columns, values, strict=True))]), " | "), F.lit(" |"))

    rows = text.withColumn("_cells", cells).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[f"_o{i}" for i in range(len(order))], "_cells"))).alias("_rows"))
    w = F.col("_w")
    head = line([F.lit(c) for c in columns], w)
    rule = F.concat(F.lit("|"), F.array_join(F.array(*[F.concat(F.repeat(F.lit("-"), w[i] + 1), F.lit(":")) if right[c] else F.concat(F.lit(":"), F.repeat(F.lit("-"), w[i] + 1)) for i, c in enumerate(columns)]), "|"), F.lit("|"))
    body = F.transform("_rows", lambda r: line([r["_cells"][i] for i in range(len(columns))], w))
    return rows.join(widths, keys).select(*keys, F.array_join(F.concat(F.array(head, rule), body), "\n").alias("markdown"))


def html_row(values: list[Column], tag: str = "td") -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), html_escape(F.coalesce(v.cast("string"), F.lit(""))), F.lit(f"</{tag}>")) for v in values], F.lit("</tr>"))


def html_tables(df: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """keys and html: a table of each group's rows in order under a header row."""
    head = "<tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in columns) + "</tr>"
    rows = df.select(*keys, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], html_row([F.col(c) for c in columns]).alias("_r"))
    own = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[f"_o{i}" for i in range(len(order))], "_r"))).alias("_rows"))
    return own.select(*keys, F.concat(F.lit("<table>" + head), F.array_join(F.transform("_rows", lambda r: r["_r"]), ""), F.lit("</table>")).alias("html"))


def cells_to_html(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys and html from cell rows (row, col, row_span, col_span, text, is_html): the first row is a header, covered cells are skipped."""
    covering = cells.filter((F.col("row_span") > 1) | (F.col("col_span") > 1)).select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("row"), "col", "col_span")
    covered = covering.select(*keys, "_r", "_c", "row", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("col")).filter("row <> _r or col <> _c").select(*keys, "row", "col").distinct()
    shown = cells.join(covered, [*keys, "row", "col"], "left_anti")
    first = shown.groupBy(*keys).agg(F.min("row").alias("_first"))
    tag = F.when(F.col("row") == F.col("_first"), "th").otherwise("td")
    span = F.concat(F.when(F.col("col_span") > 1, F.concat(F.lit(' colspan="'), F.col("col_span"), F.lit('"'))).otherwise(""), F.when(F.col("row_span") > 1, F.concat(F.lit(' rowspan="'), F.col("row_span"), F.lit('"'))).otherwise(""))
    inner = F.when(F.col("is_html"), F.col("text")).otherwise(F.replace(html_escape(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit("<br>")))
    one = shown.join(first, keys).withColumn("_x", F.concat(F.lit("<"), tag, span, F.lit(">"), inner, F.lit("</"), tag, F.lit(">")))
    lines = one.groupBy(*keys, "row").agg(F.concat(F.lit("<tr>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "_x"))), lambda c: c["_x"]), ""), F.lit("</tr>")).alias("_x"))
    return lines.groupBy(*keys).agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "_x"))), lambda r: r["_x"]), ""), F.lit("</table>")).alias("html"))


def chart_html(headers: Column, columns: Column) -> Column:
    """A table of an array of columns (arrays of text); short columns are padded with empty cells."""
    n = F.array_max(F.transform(columns, lambda c: F.size(c)))
    head = F.array_join(F.transform(headers, lambda h: F.concat(F.lit("<th>"), html_escape(h), F.lit("</th>"))), "")
    row = lambda i: F.concat(F.lit("<tr>"), F.array_join(F.transform(columns, lambda c: F.concat(F.lit("<td>"), html_escape(F.coalesce(F.get(c, i), F.lit(""))), F.lit("</td>"))), ""), F.lit("</tr>"))
    body = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), row), "")).otherwise("")
    return F.concat(F.lit("<table><thead><tr>"), head, F.lit("</tr></thead><tbody>"), body, F.lit("</tbody></table>"))


def dense(points: Column) -> Column:
    """An array from a map of index (from 0) to text, gaps and nulls empty; of any length, in one pass over the sorted points."""
    own = F.array_sort(F.map_entries(points))
    keys = F.array_sort(F.map_keys(points))
    before = F.concat(F.array(F.lit(-1)), F.slice(keys, 1, F.size(keys) - 1))  # the index before each point's
    gap = lambda z: F.array_repeat(F.lit(""), (z["x"]["key"] - z["b"] - 1).cast("int"))
    filled = F.flatten(F.transform(F.arrays_zip(own.alias("x"), before.alias("b")), lambda z: F.concat(gap(z), F.array(F.coalesce(z["x"]["value"], F.lit(""))))))
    return F.when(F.size(points) > 0, filled).otherwise(F.array().cast("array<string>"))


def trim_empty(values: Column) -> Column:
    """values without the empty ones at its end."""
    last = F.array_max(F.transform(F.filter(F.arrays_zip(values.alias("v"), F.sequence(F.lit(1), F.size(values)).alias("i")), lambda z: z["v"] != ""), lambda z: z["i"]))
    return F.when(F.size(values) > 0, F.slice(values, F.lit(1), F.coalesce(last, F.lit(0)))).otherwise(values)


# OTSL: marks for full, empty, left-merged, up-merged and both-merged cells, and line ends ----

OTSL = re.compile(r"<(fcel|ecel|lcel|ucel|xcel|nl)>")


def otsl_rows(source: str) -> list[list[tuple[str, str]]]:
    """Rows of (mark, text)."""
    parts, rows, row = OTSL.split(source), [], []
    for mark, text in zip(parts[1::2], parts[2::2], strict=True):
        if mark == "nl":
            rows.append(row)
            row = []
        else:
            row.append((mark, text.strip()))
    if row:
        rows.append(row)
    return [r for r in rows if r]


def otsl_square(rows: list[list[tuple[str, str]]]) -> list[list[tuple[str, str]]]:
    """Rows of one width: between the longest row's filled part and its whole the width that changes the fewest cells."""
    if not rows:
        return []
    used = [max((i + 1 for i, (m, _) in enumerate(r) if m != "ecel"), default=0) for r in rows]
    low, high = max(1, max(used)), max(map(len, rows))
    width = min(range(low, high + 1), key=lambda w: (sum(abs(len(r) - w) for r in rows), w))
    return [(r + [("ecel", "")] * width)[:width] for r in rows]


def otsl_padded(source: str) -> str:
    return "".join("".join(f"<{m}>{t}" for m, t in r) + "<nl>" for r in otsl_square(otsl_rows(source)))


def otsl_cells(source: str) -> list[tuple[int, int, int, int, str]]:
    """(row, col, row_span, col_span, text) of each cell that isn't merged into another."""
    grid = otsl_square(otsl_rows(source))
    out = []
    for r, row in enumerate(grid):
        for c, (mark, text) in enumerate(row):
            if mark in ("fcel", "ecel"):
                wide = tall = 1
                while c + wide < len(row) and row[c + wide][0] in ("lcel", "xcel"):
                    wide += 1
                while r + tall < len(grid) and grid[r + tall][c][0] in ("ucel", "xcel"):
                    tall += 1
                out.append((r, c, tall, wide, text))
    return out


def otsl_html(source: str | None) -> str:
    if not source or not OTSL.search(source):
        return ""
    lines: dict[int, list[str]] = {}
    for r, _, tall, wide, text in otsl_cells(source):
        span = (f' colspan="{wide}"' if wide > 1 else "") + (f' rowspan="{tall}"' if tall > 1 else "")
        lines.setdefault(r, []).append(f"<td{span}>{html.escape(text)}</td>")
    n = len(otsl_square(otsl_rows(source)))
    return "<table>" + "".join("<tr>" + "".join(lines.get(r, [])) + "</tr>" for r in range(n)) + "</table>"


# HTML tables ---------------------------------------------------------------------

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^>]*)>")
_ATTR = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+))""")
#: Attributes that a table keeps.
KEPT = {"td": ("colspan", "rowspan"), "th": ("colspan", "rowspan"), "img": ("src", "alt", "width", "height"), "a": ("href",)}


def href_ok(url: str) -> bool:
    m = re.match(r"\s*([A-Za-z][A-Za-z0-9+.-]*):", url)
    return not m or m[1].lower() in ("http", "https", "mailto", "ftp")


def clean_table(source: str) -> str:
    """Lower-case tags, only the attributes in KEPT, links only where safe."""

    def one(m: re.Match) -> str:
        tag = m[2].lower()
        if m[1]:
            return f"</{tag}>"
        kept = ""
        for a in _ATTR.finditer(m[3]):
            name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if name in KEPT.get(tag, ()) and (name != "href" or href_ok(value)):
                kept += f' {name}="{value}"'
        return f"<{tag}{kept}>"

    return _TAG.sub(one, source)


def modal_colspans(source: str) -> str:
    """Colspans that make a row wider than most rows are cut; tables with row spans stay as they are."""
    if re.search(r"rowspan\s*=\s*[\"']?(?!1\b)\d", source):
        return source
    rows = re.findall(r"(?is)<tr\b.*?</tr>", source)
    span = lambda cell: int((re.search(r'colspan\s*=\s*["\']?(\d+)', cell) or [0, 1])[1])
    width = lambda r: sum(span(c) for c in re.findall(r"(?i)<t[dh]\b[^>]*>", r))
    widths = [width(r) for r in rows]
    if not widths:
        return source
    mode = max(dict.fromkeys(widths), key=widths.count)
    for r, w in zip(rows, widths, strict=True):
        over = w - mode
        if over > 0:
            def cut(m: re.Match) -> str:
                nonlocal over
                have = span(m[0])
                less = min(over, have - 1)
                over -= less
                return re.sub(r'\s*colspan\s*=\s*["\']?\d+["\']?', f' colspan="{have - less}"' if have - less > 1 else "", m[0]) if less else m[0]

            source = source.replace(r, re.sub(r"(?i)<t[dh]\b[^>]*>", cut, r), 1)
    return source
