"""Charts of office files as tables: from the workbook that they name, from their cached points, or from an embedded sheet."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from xml.etree import ElementTree

from sheafspark.functions.xml import attr, child, named, parse_xml, text_of

#: Plots that are read, and the kinds of those with an axis of numbers.
PLOTS = frozenset("area3DChart areaChart bar3DChart barChart bubbleChart doughnutChart line3DChart lineChart ofPieChart pie3DChart pieChart radarChart scatterChart stockChart surface3DChart surfaceChart".split())
KINDS = {"scatterChart": "scatter", "bubbleChart": "bubble"}
#: Fixed value: points that a cache may span; one that claims more isn't read.
MOST_POINTS = 100_000

#: Reads the values of a sheet's range (sheet, top, left, bottom, right), or null where there is no such sheet.
Reader = Callable[[str, int, int, int, int], list | None]


@dataclass
class Reference:
    formula: str | None = None
    cached: list[str] = field(default_factory=list)


@dataclass
class Series:
    name: Reference
    literal: str | None
    x: Reference
    y: Reference
    size: Reference


@dataclass
class Chart:
    kind: str  # category, date, scatter or bubble
    title: str = ""
    axis: str = ""
    value_axis: str = ""
    dates: bool = False
    date_1904: bool = False
    series: list[Series] = field(default_factory=list)


def title_text(e) -> str:
    return "" if e is None else "".join(t.text or "" for t in e.iter() if named(t) == "t").strip()


def serial_date(serial: float, date_1904: bool = False) -> str | None:
    """ISO text of a serial: a date alone at midnight, else with a blank before the time; null for what is no date."""
    if not math.isfinite(serial):
        return None
    try:
        day = serial if date_1904 else serial + 1 if 0 < serial < 60 else serial
        at = (datetime(1904, 1, 1) if date_1904 else datetime(1899, 12, 30)) + timedelta(seconds=round(day * 86400))
    except OverflowError:
        return None
    return at.strftime("%Y-%m-%d") if at.time() == datetime.min.time() else at.strftime("%Y-%m-%d %H:%M:%S")


def value_text(value, dates: bool = False, date_1904: bool = False) -> str:
    """A cell's value as text: whole numbers without a point, serials as dates where the axis has dates, null as nothing."""
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        return str(value)
    if dates and isinstance(value, (int, float)):
        return serial_date(float(value), date_1904) or str(value)
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def dense(points: dict[int, str]) -> list[str]:
    """Values by index, gaps empty; none where they'd span more than MOST_POINTS."""
    n = max(points, default=-1) + 1
    return [points.get(i, "") for i in range(n)] if n <= MOST_POINTS else []


def points_of(e, dates: bool = False, date_1904: bool = False) -> dict[int, str]:
    out = {}
    for p in e if e is not None else []:
        if named(p) == "pt" and re.fullmatch(r"\d+", attr(p, "idx", "") or ""):
            raw = text_of(child(p, "v"))
            try:
                out[int(attr(p, "idx"))] = (serial_date(float(raw), date_1904) or raw) if dates and raw else raw
            except ValueError:
                out[int(attr(p, "idx"))] = raw
    return out


def reference(e, dates: bool = False, date_1904: bool = False) -> Reference:
    """The formula and cached values of a reference; of several levels those of each point with " / " between."""
    ref = next((r for n in ("strRef", "numRef", "multiLvlStrRef") if (r := child(e, n)) is not None), None)
    if ref is None:
        return Reference()
    formula = text_of(child(ref, "f")).strip() or None
    if named(ref) == "multiLvlStrRef":
        levels = [points_of(v) for c in ref if named(c) == "multiLvlStrCache" for v in c if named(v) == "lvl"]
        n = max((k for v in levels for k in v), default=-1) + 1
        return Reference(formula, [" / ".join(v[i] for v in levels if v.get(i)) for i in range(n)] if n <= MOST_POINTS else [])
    cache = child(ref, "strCache")
    return Reference(formula, dense(points_of(child(ref, "numCache") if cache is None else cache, dates, date_1904)))


def parse(raw: bytes) -> Chart | None:
    """A chart part; null where it isn't one, has no plot that is read, or mixes kinds."""
    try:
        root = parse_xml(raw)
    except (ElementTree.ParseError, ValueError):
        return None
    area = next((e for e in root.iter() if named(e) == "plotArea"), None)
    plots = [e for e in area if named(e) in PLOTS] if area is not None else []
    kinds = {KINDS.get(named(p), "category") for p in plots}
    if len(kinds) != 1:
        return None
    chart, dates, old = child(root, "chart"), child(area, "dateAx"), attr(child(root, "date1904"), "val") == "1"
    out = Chart(*kinds, title=title_text(child(chart, "title")), date_1904=old)
    own = dates if dates is not None else child(area, "catAx")
    out.axis = title_text(child(own, "title"))
    values = [(attr(child(a, "axPos"), "val"), title_text(child(a, "title"))) for a in area if named(a) == "valAx"]
    if out.kind == "category":
        out.dates, out.value_axis = dates is not None, values[0][1] if values else ""
        out.kind = "date" if out.dates else out.kind
    else:
        out.axis = next((t for p, t in values if p == "b" and t), out.axis)
        out.value_axis = next((t for p, t in values if p == "l" and t), "")
    for s in (s for p in plots for s in p if named(s) == "ser"):
        tx = child(s, "tx")
        name = reference(tx)
        literal = (name.cached[0] if name.cached else None) if child(tx, "strRef") is not None else text_of(child(tx, "v")).strip() or None
        x = reference(child(s, "xVal")) if out.kind in ("scatter", "bubble") else reference(child(s, "cat"), out.dates, old)
        y = child(s, "val")
        out.series.append(Series(name, literal, x, reference(child(s, "yVal") if y is None else y), reference(child(s, "bubbleSize"))))
    return out


def range_of(formula: str | None) -> tuple[str, int, int, int, int] | None:
    """(sheet, top, left, bottom, right) of a formula that names a closed range of a sheet."""
    m = re.fullmatch(r"=?(?:'((?:[^']|'')+)'|([^'!]+))!\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?", (formula or "").strip())
    if m is None:
        return None
    col = lambda x: sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(x.upper())))
    a, b = (int(m[4]), col(m[3])), (int(m[6] or m[4]), col(m[5] or m[3]))
    return (m[1] or m[2]).replace("''", "'"), min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])


def vector(read: Reader, formula: str | None) -> list | None:
    """The values of a range of one row or column; null for others."""
    where = range_of(formula)
    if where is None or where[1] != where[3] and where[2] != where[4]:
        return None
    return read(*where)


def series_name(s: Series, n: int, read: Reader | None = None) -> str:
    """The workbook's name, else the cached or literal one, else its number."""
    got = vector(read, s.name.formula) if read else None
    return (value_text(got[0]) if got else "") or s.literal or f"Series{n}"


def grid(headers: list[str], columns: list[list[str]]) -> str:
    """A table of columns under headers; short ones are filled up, and without a row there is none."""
    n = max(map(len, columns), default=0)
    if not n:
        return ""
    cell = lambda tag, x: f"<{tag}>{html.escape(x)}</{tag}>"
    rows = "".join("<tr>" + "".join(cell("td", c[i] if i < len(c) else "") for c in columns) + "</tr>" for i in range(n))
    return f"<table><thead><tr>{''.join(cell('th', h) for h in headers)}</tr></thead><tbody>{rows}</tbody></table>"


def table(chart: Chart, read: Reader | None = None) -> str:
    """A chart's table: from the workbook that read opens (all series or nothing), else from the cached points (of scatter and bubble charts all or nothing)."""
    names = [series_name(s, i, read) for i, s in enumerate(chart.series, 1)]
    if not names:
        return ""
    get = lambda r: vector(read, r.formula) if read else r.cached
    ys = [get(s.y) for s in chart.series]
    if chart.kind in ("category", "date"):
        first = next((s.x for s in chart.series if (s.x.formula if read else s.x.cached)), None)
        cats = get(first) if first else []
        if read and (cats is None or None in ys):
            return ""
        return grid([chart.axis, *names], [[value_text(v, chart.dates and read is not None, chart.date_1904) for v in cats], *[list(map(value_text, y)) for y in ys]])
    xs, sizes = [get(s.x) for s in chart.series], [get(s.size) for s in chart.series] if chart.kind == "bubble" else None
    if any(v is None or not read and not v for v in [*xs, *ys, *(sizes or [])]):
        return ""
    text = lambda v: list(map(value_text, v))
    tail = lambda i: [(names[i], text(ys[i]))] + ([(f"{names[i]} size", text(sizes[i]))] if sizes else [])
    if all(text(x) == text(xs[0]) for x in xs):
        pairs = [(chart.axis, text(xs[0]))] + [p for i in range(len(names)) for p in tail(i)]
    else:
        pairs = [p for i, n in enumerate(names) for p in [(f"{n} X", text(xs[i])), (f"{n} Y", text(ys[i])), *tail(i)[1:]]]
    return grid([h for h, _ in pairs], [c for _, c in pairs])


def trimmed(rows: list[list[str]]) -> list[list[str]]:
    """Rows of one width, without empty ones at the head and foot and empty cells at their ends."""
    full = [i for i, r in enumerate(rows) if any(r)]
    own = [r[: max((i + 1 for i, x in enumerate(r) if x), default=0)] for r in rows[full[0] : full[-1] + 1]] if full else []
    width = max(map(len, own), default=0)
    return [r + [""] * (width - len(r)) for r in own]


def sheet_table(sheets: list[list[list[str]]]) -> str:
    """The first sheet that isn't empty as a table, its first row the header."""
    rows = next((t for s in sheets if (t := trimmed(s))), [])
    line = lambda tag, r: "<tr>" + "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in r) + "</tr>"
    return f"<table><thead>{line('th', rows[0])}</thead><tbody>{''.join(line('td', r) for r in rows[1:])}</tbody></table>" if rows else ""


def chart_html(raw: bytes, workbook: Reader | None = None, sheets: list[list[list[str]]] | None = None) -> str:
    """A chart part's table: from its workbook, else its cache, else the workbook's first sheet."""
    chart = parse(raw)
    if chart is None or not chart.series:
        return sheet_table(sheets or [])
    return (table(chart, workbook) if workbook else "") or table(chart) or sheet_table(sheets or [])
