"""Small packages written from rows, for queries that read them back."""

from __future__ import annotations

import io
import json
import zipfile
from email.message import EmailMessage
from xml.sax.saxutils import escape

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DML, PML, CHART = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/chart"


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def relations(*rows: tuple[str, str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="x/{k}" Target="{t}"/>' for i, k, t in rows) + "</Relationships>"


def docx(title: str, rows: list[tuple[int, str]]) -> bytes:
    """A heading, a numbered list of the rows, a table of them, and a second section."""
    p = lambda t, style="", num="": f"<w:p><w:pPr>{f'<w:pStyle w:val={chr(34)}{style}{chr(34)}/>' if style else ''}{f'<w:numPr><w:ilvl w:val={chr(34)}0{chr(34)}/><w:numId w:val={chr(34)}{num}{chr(34)}/></w:numPr>' if num else ''}</w:pPr><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    cells = "".join(f"<w:tr><w:tc>{p(str(k))}</w:tc><w:tc>{p(v)}</w:tc></w:tr>" for k, v in rows)
    body = p(title, "H1") + "".join(p(v, num="1") for _, v in rows) + f"<w:tbl>{cells}</w:tbl><w:p><w:pPr><w:sectPr/></w:pPr></w:p>" + p("second section")
    return zipped({
        "word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>', "word/styles.xml": f'<w:styles xmlns:w="{W}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering xmlns:w="{W}"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
    })


def pptx(title: str, rows: list[tuple[int, str]]) -> bytes:
    """A slide with a title, bullets of the rows and notes."""
    sp = lambda y, paras, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/><a:ext cx="400" cy="100"/></a:xfrm></p:spPr><p:txBody>{paras}</p:txBody></p:sp>'
    line = lambda t, props="": f"<a:p>{props}<a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
    items = "".join(line(v, '<a:pPr lvl="0"><a:buChar char="-"/></a:pPr>') for _, v in rows)
    ns = f'xmlns:a="{DML}" xmlns:p="{PML}" xmlns:r="{REL}"'
    return zipped({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst><p:sldSz cx="1000" cy="900"/></p:presentation>', "ppt/_rels/presentation.xml.rels": relations(("r1", "slide", "slides/s1.xml")),
        "ppt/slides/s1.xml": f"<p:sld {ns}><p:cSld><p:spTree>{sp(300, items)}{sp(10, line(title), '<p:ph type=' + chr(34) + 'title' + chr(34) + '/>')}</p:spTree></p:cSld></p:sld>",
        "ppt/slides/_rels/s1.xml.rels": relations(("n", "notesSlide", "../notesSlides/n1.xml")), "ppt/notesSlides/n1.xml": f"<p:notes {ns}>{sp(0, line('notes of ' + title))}</p:notes>",
    })


def sheet_xml(rows: list[list]) -> str:
    def cell(r: int, c: int, v) -> str:
        ref = f"{chr(64 + c)}{r}"
        return f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    return "<worksheet><sheetData>" + "".join("<row>" + "".join(cell(i, j, v) for j, v in enumerate(r, 1)) + "</row>" for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>"


def xlsx(title: str, rows: list[tuple[int, str]]) -> bytes:
    """A sheet with a header and the rows, and a hidden one."""
    book = f'<workbook xmlns:r="{REL}"><sheets><sheet name="{escape(title)}" r:id="r1"/><sheet name="no" state="hidden" r:id="r1"/></sheets></workbook>'
    return zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": relations(("r1", "worksheet", "worksheets/s1.xml")), "xl/worksheets/s1.xml": sheet_xml([["key", "name"], *map(list, rows)])})


def epub(title: str, rows: list[tuple[int, str]]) -> bytes:
    """A chapter for each row, one that the manifest lacks and an empty one."""
    items = "".join(f'<item id="c{k}" href="c%20{k}.html"/>' for k, _ in rows) + '<item id="empty" href="empty.html"/>'
    spine = '<itemref idref="gone"/><itemref idref="empty"/>' + "".join(f'<itemref idref="c{k}"/>' for k, _ in rows)
    opf = f"<package><metadata><dc:title xmlns:dc='d'>{escape(title)}</dc:title></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>"
    return zipped({"META-INF/container.xml": '<container><rootfile full-path="in/p.opf"/></container>', "in/p.opf": opf, "in/empty.html": "<body></body>"} | {f"in/c {k}.html": f"<h1>{escape(v)}</h1><p>of {escape(title)}</p><input type=checkbox checked>" for k, v in rows})


def eml(title: str, rows: list[tuple[int, str]]) -> bytes:
    """A mail to all of the rows, plain and HTML."""
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Message-ID"], m["Date"] = title, "A <a@x.org>", ", ".join(f"n{k}@x.org" for k, _ in rows), f"<{title.replace(' ', '.')}@x.org>", "Mon, 01 Jan 2024 02:00:00 +0200"
    m.set_content("plain")
    m.add_alternative("<h2>" + escape(title) + "</h2>" + "".join(f"<p>{escape(v)}</p>" for _, v in rows), subtype="html")
    return m.as_bytes()


def csv(title: str, rows: list[tuple[int, str]]) -> bytes:
    return ("key;name\n" + "".join(f"{k};{v}\n" for k, v in rows) + ";\n").encode()


def ipynb(title: str, rows: list[tuple[int, str]]) -> bytes:
    cells = [{"cell_type": "markdown", "source": f"# {title}"}, {"cell_type": "code", "source": [f"x = {len(rows)}\n", "x"]}, {"cell_type": "raw", "source": ""}, {"cell_type": "raw", "source": "end"}]
    return json.dumps({"cells": cells}).encode()


def rst(title: str, rows: list[tuple[int, str]]) -> bytes:
    return f"{title}\n{'=' * len(title)}\n\n{rows[0][1]}::\n\n  code\n\n`l <http://x>`_\n".encode()


def chart(names: list[str], values: list[float]) -> bytes:
    """A bar chart with cached points alone."""
    points = lambda own: "".join(f'<c:pt idx="{i}"><c:v>{escape(str(v))}</c:v></c:pt>' for i, v in enumerate(own))
    ser = f"<c:ser><c:tx><c:v>total</c:v></c:tx><c:cat><c:strRef><c:strCache>{points(names)}</c:strCache></c:strRef></c:cat><c:val><c:numRef><c:numCache>{points(values)}</c:numCache></c:numRef></c:val></c:ser>"
    return f'<c:chartSpace xmlns:c="{CHART}" xmlns:a="{DML}"><c:chart><c:plotArea><c:barChart>{ser}</c:barChart><c:catAx><c:title><a:t>order</a:t></c:title></c:catAx></c:plotArea></c:chart></c:chartSpace>'.encode()


MAKERS = {f.__name__: f for f in (docx, pptx, xlsx, epub, eml, csv, ipynb, rst)}
