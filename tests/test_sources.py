"""Readers over files made here, in batch and as a stream."""

import io
import json
import zipfile

import pytest

from sheafspark.sources import office
from sheafspark.sources import packages as P

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">%s</Relationships>'


def zipped(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def p(text: str, style: str = "", num: str = "", lvl: int = 0) -> str:
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{lvl}"/><w:numId w:val="{num}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def docx() -> bytes:
    body = p("Top", "H1") + p("one", num="1") + p("sub", num="1", lvl=1) + p("two", num="1") + "<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr>" + p("wide") + "</w:tc></w:tr></w:tbl>"
    body += "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>no</w:t></w:r></w:p>"
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    levels = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="decimal"/></w:lvl>' for i in range(2))
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="7">{levels}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
    return zipped(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "word/numbering.xml": numbering})


def xlsx() -> bytes:
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = "<worksheet><sheetData><row>" + cell("A1", "h") + cell("B1", "k") + "</row><row>" + cell("A2", "a") + '<c r="B2"><v>3</v></c></row><row>' + cell("E9", "alone") + "</row></sheetData></worksheet>"
    book = f'<workbook {R}><sheets><sheet name="S" r:id="r1"/><sheet name="H" state="hidden" r:id="r1"/></sheets></workbook>'
    return zipped(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": RELS % '<Relationship Id="r1" Type="x/worksheet" Target="worksheets/s.xml"/>', "xl/worksheets/s.xml": sheet})


def pptx() -> bytes:
    A, Q = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"', 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    sp = lambda x, t, props="", ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="10"/><a:ext cx="40" cy="50"/></a:xfrm></p:spPr><p:txBody><a:p>{props}<a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f'<p:sld {A} {Q}><p:cSld><p:spTree>{sp(60, "right")}{sp(0, "left", ph=chr(60) + "p:ph type=" + chr(34) + "title" + chr(34) + "/>")}</p:spTree></p:cSld></p:sld>'
    show = f'<p:presentation {Q} {R}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>'
    return zipped(**{"ppt/presentation.xml": show, "ppt/_rels/presentation.xml.rels": RELS % '<Relationship Id="r1" Type="x/slide" Target="slides/s1.xml"/>', "ppt/slides/s1.xml": slide})


def epub() -> bytes:
    opf = '<package><metadata><dc:title xmlns:dc="d">T</dc:title></metadata><manifest><item id="a" href="a%20b.html"/><item id="e" href="e.html"/></manifest><spine><itemref idref="gone"/><itemref idref="a"/><itemref idref="e"/></spine></package>'
    return zipped(**{"META-INF/container.xml": '<container><rootfile full-path="in/p.opf"/></container>', "in/p.opf": opf, "in/a b.html": "<h1>Hi</h1><input type=checkbox checked>x", "in/e.html": "<body></body>"})


def test_office():
    assert P.read_docx(docx())[0]["content"] == "# Top\n\n1. one\n    1. sub\n2. two\n\n<table><tr><td colspan=\"2\">wide</td></tr></table>\n\n**bold**"
    (sheet,) = P.read_xlsx(xlsx())
    assert sheet["content"] == "## S\n\n<table><tr><th>h</th><th>k</th></tr><tr><td>a</td><td>3</td></tr></table>\n\nalone"
    assert P.read_pptx(pptx())[0]["content"] == "## left\n\nright"
    (page,) = P.read_epub(epub())
    assert page["content"].startswith("# Hi") and "[x]" in page["content"] and page["epub_idx"] == "1"


def test_plain_formats():
    assert P.read_text("﻿a\n\n\nb".encode("utf-16"))[0]["content"].endswith("a\nb")
    assert P.decode("中文内容".encode("gbk"))[1] == "gb18030"
    assert P.read_csv(b"a,b\n1,\n,\n3,4\n")[0]["content"] == "|   a |   b |\n|----:|----:|\n|   1 |     |\n|   3 |   4 |"
    assert P.read_csv(b'a;b\n"x|y";"1\n2"\n')[0]["content"] == "| a    | b      |\n|:-----|:-------|\n| x\\|y | 1<br>2 |"
    assert len(P.read_csv(b"a\n1\n2\n3\n", chunk_size=2)) == 2
    nb = json.dumps({"cells": [{"cell_type": "code", "source": ["x\n", "y"]}, {"cell_type": "markdown", "source": ""}, {"cell_type": "raw", "source": "r"}]}).encode()
    assert [c["content"] for c in P.read_notebook(nb)] == ["```python\nx\ny\n```", "```\nr\n```"]
    mail = b"Subject: S\nFrom: A <a@x.y>\nTo: b@x.y, c@x.y\nDate: Mon, 01 Jan 2024 02:00:00 +0200\nMessage-ID: <i@d>\nContent-Type: text/html; charset=latin-1\n\n<p>caf\xe9</p>"
    (page,) = P.read_email(mail)
    assert page["content"] == "café" and page["sent_date"] == "2024-01-01T00:00:00+00:00" and page["message_id"] == "i@d" and len(json.loads(page["to"])) == 2
    assert P.read_rst(b"Title\n=====\n\nx::\n\n  code\n")[0]["content"] == "# Title\nx:\n```\ncode\n```"


def test_refusals():
    with pytest.raises(ValueError):
        P.parse_xml(b"<!DOCTYPE x><x/>")
    with pytest.raises(ValueError):
        office.Package(bytes.fromhex("d0cf11e0a1b11ae1"))


def test_batch_and_stream(spark, tmp_path):
    from sheafspark.sources import formats
    from sheafspark.streaming import pages

    for name, raw in {"a.txt": b"x\n\n\ny", "b.docx": docx(), "c.xlsx": b"broken", "d.zzz": b"?"}.items():
        (tmp_path / name).write_bytes(raw)
    batch = P.read(formats.scan(spark, str(tmp_path)))
    rows = {(r.path.rsplit("/")[-1], r.page_id): r for r in batch.collect()}
    assert set(rows) == {("a.txt", 1), ("b.docx", 1), ("c.xlsx", None)} and rows["c.xlsx", None].error
    assert {r.page_count for r in P.documents(batch).collect()} == {1}
    streamed = pages.drained(spark, pages.file_stream(spark, str(tmp_path)), P.PAGES)
    key = lambda df: sorted((r.path, r.page_id or 0, r.content or "") for r in df.collect())
    assert key(streamed) == key(batch)
