"""Office packages made here: what their blocks, Markdown and content lists say."""

import base64
import json

import pytest

from sheafspark.functions import blocks, charts, inline
from sheafspark.sources import flat, office
from sheafspark.sources import packages as P
from tests.test_sources import RELS, R, W, p, zipped

M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
C = 'xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"'
Q = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
PNG = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg==")
URI = "data:image/png;base64," + base64.b64encode(PNG).decode()


def rel(rid: str, kind: str, target: str, outside: bool = False) -> str:
    return f'<Relationship Id="{rid}" Type="x/{kind}" Target="{target}"{" TargetMode=" + chr(34) + "External" + chr(34) if outside else ""}/>'


def points(*values) -> str:
    return "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in values)


def chart(plot: str = "barChart", axes: str = "", series: str | None = None) -> str:
    own = series or f'<c:ser><c:tx><c:strRef><c:f>S!$B$1</c:f><c:strCache>{points((0, "cached"))}</c:strCache></c:strRef></c:tx><c:cat><c:strRef><c:f>S!$A$2:$A$4</c:f><c:strCache>{points((0, "x"), (2, "z"))}</c:strCache></c:strRef></c:cat><c:val><c:numRef><c:f>S!$B$2:$B$4</c:f><c:numCache>{points((0, 1), (1, 2.5))}</c:numCache></c:numRef></c:val></c:ser>'
    return f"<c:chartSpace {C} {A}><c:chart><c:plotArea><c:{plot}>{own}</c:{plot}>{axes}</c:plotArea></c:chart></c:chartSpace>"


def sheet(*rows: str, more: str = "") -> str:
    return f"<worksheet {R}><sheetData>{''.join(rows)}</sheetData>{more}</worksheet>"


def c(ref: str, v, style: int | None = None) -> str:
    s = "" if style is None else f' s="{style}"'
    return f'<c r="{ref}"{s}><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"{s}><is><t>{v}</t></is></c>'


def book(sheets: dict[str, str], **more: str) -> bytes:
    listed = "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets))
    parts = {f"xl/worksheets/s{i}.xml": x for i, x in enumerate(sheets.values())}
    return zipped(**{"xl/workbook.xml": f"<workbook {R}>{more.pop('props', '')}<sheets>{listed}</sheets></workbook>", "xl/_rels/workbook.xml.rels": RELS % "".join(rel(f"r{i}", "worksheet", f"worksheets/s{i}.xml") for i in range(len(sheets))), **parts, **more})


def test_charts():
    table = "<table><thead><tr><th></th><th>cached</th></tr></thead><tbody><tr><td>x</td><td>1</td></tr><tr><td></td><td>2.5</td></tr><tr><td>z</td><td></td></tr></tbody></table>"
    assert charts.chart_html(chart().encode()) == table
    data = {("S", 1, 2, 1, 2): ["named"], ("S", 2, 1, 4, 1): ["a", "b", "c"], ("S", 2, 2, 4, 2): [1, 2.0, None]}
    read = lambda *where: data.get(where)
    assert charts.chart_html(chart().encode(), read) == table.replace("cached", "named").replace("<td>x</td>", "<td>a</td>").replace("<td></td><td>2.5</td>", "<td>b</td><td>2</td>").replace("<td>z</td>", "<td>c</td>")
    assert charts.chart_html(chart().encode(), lambda *w: None) == table  # a workbook without the sheet
    assert charts.chart_html(b"<x/>", None, [[["", ""]], [["", ""], ["h", "k", ""], ["1"], []]]) == "<table><thead><tr><th>h</th><th>k</th></tr></thead><tbody><tr><td>1</td><td></td></tr></tbody></table>"
    assert charts.parse(b"<!DOCTYPE x><x/>") is None and charts.chart_html(b"broken") == ""
    ser = lambda n, xs, ys, size="": f"<c:ser><c:tx><c:v>{n}</c:v></c:tx><c:xVal><c:numRef><c:numCache>{points(*enumerate(xs))}</c:numCache></c:numRef></c:xVal><c:yVal><c:numRef><c:numCache>{points(*enumerate(ys))}</c:numCache></c:numRef></c:yVal>{size}</c:ser>"
    axes = f'<c:valAx><c:axPos val="b"/><c:title><a:t {A}>time</a:t></c:title></c:valAx>'
    same = charts.parse(chart("scatterChart", axes, ser("p", [1, 2], [3, 4]) + ser("q", [1, 2], [5])).encode())
    assert charts.table(same) == charts.grid(["time", "p", "q"], [["1", "2"], ["3", "4"], ["5"]])
    apart = charts.parse(chart("scatterChart", axes, ser("p", [1], [3]) + ser("q", [2], [5])).encode())
    assert charts.table(apart) == charts.grid(["p X", "p Y", "q X", "q Y"], [["1"], ["3"], ["2"], ["5"]])
    size = f"<c:bubbleSize><c:numRef><c:numCache>{points((0, 9))}</c:numCache></c:numRef></c:bubbleSize>"
    assert charts.table(charts.parse(chart("bubbleChart", axes, ser("p", [1], [3], size)).encode())) == charts.grid(["time", "p", "p size"], [["1"], ["3"], ["9"]])
    dated = f"<c:ser><c:cat><c:numRef><c:numCache>{points((0, 45292), (1, 45292.5))}</c:numCache></c:numRef></c:cat><c:val><c:numRef><c:numCache>{points((0, 1), (1, 2))}</c:numCache></c:numRef></c:val></c:ser>"
    assert charts.table(charts.parse(chart("lineChart", "<c:dateAx/>", dated).encode())) == charts.grid(["", "Series1"], [["2024-01-01", "2024-01-01 12:00:00"], ["1", "2"]])
    levels = f"<c:x {C}><c:multiLvlStrRef><c:f>S!A1:B2</c:f><c:multiLvlStrCache><c:lvl>{points((0, 'a'), (1, 'b'))}</c:lvl><c:lvl>{points((0, 'Q'))}</c:lvl></c:multiLvlStrCache></c:multiLvlStrRef></c:x>"
    assert charts.reference(charts.parse_xml(levels)) == charts.Reference("S!A1:B2", ["a / Q", "b"])
    assert charts.range_of("='It''s'!$B$2:$B$4") == ("It's", 2, 2, 4, 2) and charts.range_of("S!A:A") is None and charts.dense({200_000: "x"}) == []
    assert charts.vector(lambda *w: [1], "S!A1:B2") is None


def test_docx():
    toc = lambda n, t, a: f'<w:p><w:pPr><w:pStyle w:val="TOC{n}"/></w:pPr><w:hyperlink w:anchor="{a}"><w:r><w:t>{t}</w:t></w:r></w:hyperlink></w:p>'
    drawing = f'<w:drawing><a:graphic {A}><c:chart {C} {R} r:id="c1"/></a:graphic></w:drawing>'
    picture = f'<w:drawing><a:blip {A} {R} r:embed="i1"/></w:drawing>'
    body = toc(1, "1 Top&#9;2", "_Toc1") + toc(2, "1.1 Gone&#9;3", "_Toc9")
    body += '<w:p><w:pPr><w:pStyle w:val="H1"/><w:numPr><w:numId w:val="2"/></w:numPr></w:pPr><w:bookmarkStart w:name="_Toc1"/><w:r><w:t>Top</w:t></w:r></w:p>'
    body += p("3.4 Foo", "H2") + p("Bar", "H2", "2", 1)
    body += p("one", num="1") + p("sub", num="1", lvl=1) + p("between") + p("two", num="1")
    body += f'<w:p><w:r><w:t>if </w:t></w:r><m:oMath {M}><m:r><m:t>x</m:t></m:r></m:oMath><w:r><w:t> then </w:t></w:r><w:hyperlink r:id="l1"><w:r><w:rPr><w:b/></w:rPr><w:t>go</w:t></w:r></w:hyperlink></w:p>'
    body += '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>HYPERLINK "http://f.org"</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>field</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>'
    body += f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc><w:tcPr><w:vMerge w:val='restart'/></w:tcPr>{p('b &lt; c')}</w:tc></w:tr><w:tr><w:tc><w:p><m:oMath {M}><m:r><m:t>y</m:t></m:r></m:oMath></w:p></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr>{p('')}</w:tc></w:tr></w:tbl>"
    body += p("Table 1 says") + f"<w:p><w:r>{drawing}</w:r></w:p>" + f"<w:p><w:r>{picture}{picture}</w:r></w:p>" + '<w:p><w:r><w:instrText> SEQ Figure </w:instrText></w:r><w:r><w:t>Figure one</w:t></w:r></w:p>'
    body += f"<w:p><w:r><w:pict><w:txbxContent>{p('boxed')}{p('boxed')}</w:txbxContent></w:pict></w:r></w:p>"
    body += '<w:p><w:r><w:rPr><w:rStyle w:val="Strong"/></w:rPr><w:t>style</w:t></w:r><w:r><w:rPr><w:rStyle w:val="Strong"/><w:b w:val="0"/></w:rPr><w:t xml:space="preserve"> off</w:t></w:r></w:p>'
    body += "<w:p><w:pPr><w:sectPr/></w:pPr><w:r><w:t>end</w:t></w:r></w:p>" + p("next page")
    body += "<w:p><w:pPr><w:sectPr><w:type w:val='continuous'/></w:sectPr></w:pPr></w:p>" + p("same page")
    named = lambda i, n, more="": f'<w:style w:styleId="{i}"><w:name w:val="{n}"/>{more}</w:style>'
    styles = f'<w:styles {W}>{named("H1", "heading 1")}{named("H2", "heading 2")}{named("TOC1", "toc 1")}{named("TOC2", "toc 2")}{named("Base", "base", "<w:rPr><w:b/></w:rPr>")}{named("Strong", "strong", "<w:basedOn w:val=" + chr(34) + "Base" + chr(34) + "/>")}</w:styles>'
    levels = lambda i: f'<w:abstractNum w:abstractNumId="{i}">' + "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="decimal"/></w:lvl>' for k in range(3)) + "</w:abstractNum>"
    bullets = '<w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="4"/><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>'
    numbering = f'<w:numbering {W}>{bullets}{levels(8)}<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num></w:numbering>'
    embedded = book({"S": sheet("<row>" + c("B1", "named") + "</row>", *(f"<row>{c(f'A{i}', 'abc'[i - 2])}{c(f'B{i}', i)}</row>" for i in (2, 3, 4)))})
    raw = zipped(**{
        "word/document.xml": f"<w:document {W} {R}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "word/numbering.xml": numbering, "word/charts/c.xml": chart(), "word/charts/_rels/c.xml.rels": RELS % rel("e", "package", "../embeddings/e.xlsx"),
        "word/embeddings/e.xlsx": embedded, "word/media/i.png": PNG, "word/header1.xml": f"<w:hdr {W}>{p('Head')}{p('12')}{p('Head')}</w:hdr>",
        "word/_rels/document.xml.rels": RELS % (rel("c1", "chart", "charts/c.xml") + rel("i1", "image", "media/i.png") + rel("l1", "hyperlink", "http://l.org", True) + rel("h1", "header", "header1.xml") + rel("gone", "image", "media/gone.png")),
    })
    first, second = P.read_docx(raw)
    grid = charts.grid(["", "named"], [["a", "b", "c"], ["2", "3", "4"]])
    assert first["content"].split("\n\n") == [
        "- [1 Top](#_Toc1)\n    - 1.1 Gone", '<a id="_Toc1"></a>\n# 1 Top', "## 3.4 Foo", "## 3.5 Bar", "4. one\n    - sub", "between", "5. two", "if $x$  then [**go**](http://l.org)", "[field](http://f.org)",
        '<table><tr><td>a</td><td rowspan="2">b &lt; c</td></tr><tr><td> $y$ </td></tr></table>  \nTable 1 says', grid, f"![]({URI})  \nFigure one", "boxed", "**style** off", "end",
    ]
    assert second["content"] == "next page\n\nsame page"
    assert P.read_docx(raw, True)[0]["content"].startswith("Head\n\n- [1 Top]")
    page = json.loads(P.read_docx(raw, True)[0]["blocks"])
    made = blocks.make([page], "content_list")
    assert made[-1] == {"type": "header", "text": "Head", "page_idx": 0} and made[1] == {"type": "text", "text": "1 Top", "text_level": 1, "page_idx": 0, "anchor": "_Toc1"}
    typed = blocks.make([page], "content_list_v2")[0]
    assert typed[0]["content"]["list_items"][0] == {"item_type": "text", "ilevel": 0, "prefix": "-", "item_content": [{"type": "text", "content": "1 Top\t2"}], "anchor": "_Toc1"}
    assert [t["content"]["table_type"] for t in typed if t["type"] == "table"] == ["complex_table"] and typed[-1]["type"] == "page_header"
    assert "<table" not in blocks.make([page], "nlp_markdown")


def test_heading_lists_and_legacy():
    item = lambda t, lvl=0: p(t, num="1", lvl=lvl)
    levels = "".join(f'<w:lvl w:ilvl="{k}"><w:numFmt w:val="decimal"/></w:lvl>' for k in range(2))
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="7">{levels}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
    body = item("Part") + p("text") + item("Inner", 1) + p("more") + item("Last")
    raw = zipped(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/numbering.xml": numbering})
    assert P.read_docx(raw)[0]["content"] == "# 1 Part\n\ntext\n\n## 1.1 Inner\n\nmore\n\n# 2 Last"
    with pytest.raises(ValueError):
        P.read_docx(zipped(**{"word/document.xml": f"<w:document {W}/>"}))


def test_xlsx():
    fonts = '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><fonts><font/><font><b/></font></fonts><cellXfs><xf numFmtId="0"/><xf numFmtId="0" fontId="1"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    strings = "<sst><si><r><t>plain </t></r><r><rPr><i/></rPr><t>slanted</t></r></si></sst>"
    rows = ["<row>" + c("A1", "h", 1) + c("B1", "k") + "</row>", "<row>" + c("A2", "a") + c("B2", 3) + "</row>", "<row>" + c("A3", 45292, 2) + '<c r="B3" t="s"><v>0</v></c></row>', "<row>" + c("A4", "wide") + "</row>", "<row>" + c("E9", "alone") + "</row>"]
    more = '<mergeCells><mergeCell ref="A4:B4"/></mergeCells><hyperlinks><hyperlink ref="A2" r:id="l"/><hyperlink ref="B2" location="S!A1"/></hyperlinks>'
    anchor = lambda r, col, x: f"<a><from><col>{col}</col><row>{r}</row></from>{x}</a>"
    drawing = f'<d {A} {R}>{anchor(1, 1, "<a:blip r:embed=" + chr(34) + "i" + chr(34) + "/>")}{anchor(20, 0, "<a:blip r:embed=" + chr(34) + "i" + chr(34) + "/>")}{anchor(12, 0, f"<c:chart {C} r:id=" + chr(34) + "c" + chr(34) + "/>")}</d>'
    parts = {"xl/styles.xml": fonts, "xl/sharedStrings.xml": strings, "xl/drawings/d.xml": drawing, "xl/charts/c.xml": chart(), "xl/media/i.png": PNG, "xl/worksheets/_rels/s0.xml.rels": RELS % (rel("l", "hyperlink", "http://l.org", True) + rel("d", "drawing", "../drawings/d.xml")), "xl/drawings/_rels/d.xml.rels": RELS % (rel("i", "image", "../media/i.png") + rel("c", "chart", "../charts/c.xml"))}
    raw = book({"S": sheet(*rows, more=more), "Empty": sheet()}, **parts)
    (page,) = P.read_xlsx(raw, gap=0)
    got = page["content"].split("\n\n")
    assert got[:2] == ["## S", f'<table><tr><th><strong>h</strong></th><th>k</th></tr><tr><td><a href="http://l.org">a</a></td><td><a href="#S!A1">3</a><img src="{URI}"></td></tr><tr><td>2024-01-01</td><td>plain <em>slanted</em></td></tr><tr><td colspan="2">wide</td></tr></table>']
    assert got[2] == "alone" and "<th>k</th>" in got[3] and got[-1] == f'<table><tr><th><img src="{URI}"></th></tr></table>'
    (old,) = P.read_xlsx(book({"T": sheet("<row>" + c("A1", 0.5, 2) + c("B1", 1, 2) + "</row>")}, props='<workbookPr date1904="1"/>', **{"xl/styles.xml": fonts}), gap=0)
    assert "<th>1904-01-01T12:00:00</th><th>1904-01-02</th>" in old["content"]
    # far merges cost nothing
    (far,) = P.read_xlsx(book({"T": sheet("<row>" + c("A1", "x") + c("C5", "y") + "</row>", more='<mergeCells><mergeCell ref="A1:A1048576"/></mergeCells>')}), gap=0)
    assert "x" in far["content"] and "y" in far["content"]
    assert office.letters(28) == "AB" and office.position("$AB$3") == (3, 28)


def test_pptx():
    run = lambda t, more="", inner="": f"<a:r><a:rPr {more}>{inner}</a:rPr><a:t>{t}</a:t></a:r>"
    para = lambda inner, props="": f"<a:p>{props}{inner}</a:p>"
    sp = lambda x, y, paras, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="400" cy="50"/></a:xfrm></p:spPr><p:txBody>{paras}</p:txBody></p:sp>'
    bullet = lambda lvl=0, inner="<a:buChar char='-'/>": f'<a:pPr lvl="{lvl}">{inner}</a:pPr>'
    auto = lambda start="": f"<a:buAutoNum type='arabicPeriod'{start}/>"
    link = '<a:hlinkClick r:id="l"/>'
    pic = lambda x, y, w, h: f'<p:pic><p:blipFill><a:blip r:embed="i"/></p:blipFill><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></a:xfrm></p:spPr></p:pic>'
    frame = f'<p:graphicFrame><p:xfrm><a:off x="0" y="800"/><a:ext cx="300" cy="50"/></p:xfrm><a:graphic><c:chart {C} r:id="c"/></a:graphic></p:graphicFrame>'
    table = '<p:graphicFrame><p:xfrm><a:off x="0" y="700"/><a:ext cx="300" cy="50"/></p:xfrm><a:tbl><a:tr><a:tc gridSpan="2"><a:p><a:r><a:t>h</a:t></a:r></a:p></a:tc><a:tc hMerge="1"/></a:tr></a:tbl></p:graphicFrame>'
    text = sp(0, 100, para(run("Large", 'sz="3200" b="1"'))) + sp(0, 200, para(run("Under", 'sz="2600" b="1"'))) + sp(0, 300, para(run("body ", 'sz="1800"') + run("linked", 'sz="1800"', link)))
    lists = sp(0, 400, para(run("a"), bullet(1)) + para(run("b"), bullet(2)) + para(run("c"), bullet(1)) + para(run("d"), bullet(1, auto(" startAt='3'"))) + para(run("e"), bullet(1, auto())) + para(run("none"), bullet(0, "<a:buNone/>")))
    held = sp(0, 600, para(run("from master")), '<p:ph type="body" idx="1"/>')
    slide = f"<p:sld {A} {Q} {R}><p:cSld><p:spTree>{text}{lists}{held}{table}{frame}{pic(600, 0, 50, 50)}{pic(500, 100, 300, 300)}</p:spTree></p:cSld></p:sld>"
    notes = f'<p:notes {A} {Q}><p:sp><p:nvSpPr><p:nvPr><p:ph type="sldNum"/></p:nvPr></p:nvSpPr><p:txBody>{para(run("7"))}</p:txBody></p:sp><p:sp><p:txBody>{para(run("say this"))}</p:txBody></p:sp></p:notes>'
    layout = f'<p:sldLayout {A} {Q}><p:sp><p:nvSpPr><p:nvPr><p:ph type="body" idx="1"/></p:nvPr></p:nvSpPr></p:sp></p:sldLayout>'
    master = f'<p:sldMaster {A} {Q}><p:txStyles><p:bodyStyle><a:lvl1pPr><a:buChar char="*"/></a:lvl1pPr></p:bodyStyle></p:txStyles></p:sldMaster>'
    raw = zipped(**{
        "ppt/presentation.xml": f'<p:presentation {Q} {R}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst><p:sldSz cx="1000" cy="900"/></p:presentation>', "ppt/_rels/presentation.xml.rels": RELS % rel("r1", "slide", "slides/s1.xml"),
        "ppt/slides/s1.xml": slide, "ppt/notesSlides/n.xml": notes, "ppt/slideLayouts/l.xml": layout, "ppt/slideMasters/m.xml": master, "ppt/charts/c.xml": chart(), "ppt/media/i.png": PNG,
        "ppt/slides/_rels/s1.xml.rels": RELS % (rel("l", "hyperlink", "http://l.org", True) + rel("n", "notesSlide", "../notesSlides/n.xml") + rel("y", "slideLayout", "../slideLayouts/l.xml") + rel("c", "chart", "../charts/c.xml") + rel("i", "image", "../media/i.png")),
        "ppt/slideLayouts/_rels/l.xml.rels": RELS % rel("m", "slideMaster", "../slideMasters/m.xml"),
    })
    (page,) = P.read_pptx(raw)
    own = json.loads(page["blocks"])
    # the picture of a twentieth of the slide's width is left out, the other stands right of the texts
    assert [b["type"] for b in own["para_blocks"]].count("image") == 1
    rest = blocks.make([{**own, "para_blocks": [b for b in own["para_blocks"] if b["type"] != "image"]}]).split("\n\n")
    assert rest == ["## **Large**", "### **Under**", "body [linked](http://l.org)", "- a\n    - b\n- c", "3. d\n4. e", "none", "- from master", '<table><tr><th colspan="2">h</th></tr></table>', charts.chart_html(chart().encode())]
    assert own["discarded_blocks"][0]["spans"] == [{"type": "text", "content": "say this"}] and "say this" not in page["content"]


def test_inline():
    t = lambda x, *style: {"type": "text", "content": x, "style": list(style)}
    para = lambda *spans, kind="text", **more: inline.paragraph({"type": kind, "spans": list(spans), **more})
    assert para(t("a "), t("b.", "bold"), t("c")) == "a **b.** c" and para(t("b", "bold"), t("c")) == "**b**c"
    assert para(t("a", "bold"), t("b", "bold", "italic"), t("<")) == "<strong>a</strong><em><strong>b</strong></em>&lt;"
    assert para(t("a_b*c"), t(" ", "underline")) == "a\\_b\\*c_" and para(t("x  ", "strikethrough")) == "~~x--~~"
    assert para(t("___")) == "\\_\\_\\_" and para(t("---")) == "\\---" and para(t("- no")) == "\\- no" and para(t("#5")) == "#5"
    eq = {"type": "inline_equation", "content": "x"}
    assert para(t("a"), eq, t("b")) == "a $x$ b" and para(t("a "), eq) == "a $x$"
    link = {"type": "hyperlink", "content": "l", "url": "u?a=1&b", "style": ["bold"]}
    assert para(link) == "[**l**](u?a=1&b)" and para(link, t("s", "superscript")) == '<a href="u?a=1&amp;b"><strong>l</strong></a><sup>s</sup>'
    assert para({**link, "children": [t("l", "bold"), t("m")]}) == '<a href="u?a=1&amp;b"><strong>l</strong>m</a>'
    assert para(t("T"), kind="title", is_numbered=True, section_number="1.2") == "1.2 T"
    marks = '<text style="bold">b</text> and <eq>x</eq><hyperlink><text>l</text><text style="italic">m</text><url>u</url></hyperlink>'
    assert inline.rich_text([("b", "bold", None), (" and ", "", None), ("<eq>x</eq>", "", None), ("l", "", "u"), ("m", "italic", "u")]) == marks
    spans = inline.parse_spans(marks)
    assert [s["type"] for s in spans] == ["text", "text", "inline_equation", "hyperlink"] and spans[3]["children"][1] == {"type": "text", "content": "m", "style": ["italic"]}
    assert inline.parse_spans("a <text>open") == [{"type": "text", "content": "a "}, {"type": "text", "content": "<text>open"}] or inline.parse_spans("a <text>open") == [{"type": "text", "content": "a <text>open"}]
    assert inline.rich_text([(" ", "underline", None), (" x ", "", None), ("  ", "", None)], True) == '<text style="underline"> </text> x'
    look = inline.Look(bold=True, underline=True, words_only=True)
    assert inline.look_for(look, " ") is None and inline.look_for(look, "x") == look and inline.style_text(look) == "bold,underline"
    assert inline.kept(" ", inline.Look(strikethrough=True)) and not inline.kept(" ", inline.Look(bold=True)) and not inline.target_ok(".")


def test_packages_are_repaired():
    raw = bytearray(zipped(**{"word/document.xml": f"<w:document {W}><w:body>{p('kept')}</w:body></w:document>".replace("http://schemas.openxmlformats.org/", "http://purl.oclc.org/ooxml/"), "word/media/i.png": b"x" * 50}))
    at = raw.index(b"x" * 50)
    raw[at] ^= 1  # a picture that can't be read any more
    assert P.read_docx(bytes(raw))[0]["content"] == "kept" and office.Package(bytes(raw)).bytes("word/media/i.png") is None
    root = office.parse_xml('<r><AlternateContent><Choice><contentPart/></Choice><Fallback><sp/></Fallback></AlternateContent><AlternateContent><Choice><a/></Choice><Fallback><b/></Fallback></AlternateContent></r>')
    office.alternate(root)
    assert [e.tag for e in root] == ["sp", "a"]


def test_flat_writers():
    run = lambda t, props="": f"<w:r><w:rPr>{props}</w:rPr><w:t xml:space='preserve'>{t}</w:t></w:r>"
    para = lambda inner, props="": f"<w:p><w:pPr>{props}</w:pPr>{inner}</w:p>"
    code = run("x = 1", "<w:rFonts w:ascii='Consolas'/>")
    body = para(run("Big", "<w:sz w:val='60'/>"), "<w:jc w:val='center'/>") + para(run("body", "<w:sz w:val='24'/>")) + para(run("more", "<w:sz w:val='24'/>")) + para(run("一、section")) + para(code) + para(code)
    body += para(run("b", "<w:b/>") + run("old") + run("  ", "<w:u w:val='single'/>") + run("s", "<w:strike/><w:i/>")) + p("one", num="1") + p("two", num="1")
    body += '<w:p><w:pPr><w:pStyle w:val="TOC2"/></w:pPr><w:hyperlink w:anchor="_Toc1"><w:r><w:t>Entry&#9;3</w:t></w:r></w:hyperlink></w:p>' + f"<w:tbl><w:tr><w:tc>{p('c')}</w:tc></w:tr></w:tbl>"
    body += f'<w:p><w:r><w:drawing><c:chart {C} {R} r:id="c1"/></w:drawing></w:r></w:p>'
    styles = f'<w:styles {W}><w:style w:styleId="TOC2"><w:name w:val="toc 2"/></w:style></w:styles>'
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
    axis = f"<c:valAx><c:title><a:t {A}>amount</a:t></c:title></c:valAx>"
    raw = zipped(**{"word/document.xml": f"<w:document {W} {R}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "word/numbering.xml": numbering, "word/charts/c.xml": chart(axes=axis), "word/_rels/document.xml.rels": RELS % rel("c1", "chart", "charts/c.xml")})
    (page,) = flat.read_docx(raw)
    assert page["content"].split("\n\n") == [
        "# Big", "body", "more", "## 一、section", "```\nx = 1\nx = 1\n```", "**b**\u200bold<u>\u00a0\u00a0</u>*~~s~~*", "1. one\n2. two", "  - [Entry](#_Toc1)", "<table><tr><td>c</td></tr></table>",
        "<table><thead><tr><th></th><th>amount</th></tr></thead><tbody><tr><td>x</td><td>1</td></tr><tr><td>z</td><td>2.5</td></tr></tbody></table>",
    ]
    assert flat.runs_html([("a", "bold,underline", "u"), ("b", "", None)]) == '<a href="u"><u><b>a</b></u></a>b' and flat.with_url("x", "a(b)") == "[x](a%28b%29)"
    rows = ["<row>" + c("B2", "h") + "</row>", "<row>" + c("B3", "x") + c("C3", 5) + "</row>", "<row>" + c("B9", "late") + "</row>"]
    (sheet_page,) = flat.read_xlsx(book({"S": sheet(*rows, more='<mergeCells><mergeCell ref="B2:C2"/></mergeCells>')}), max_rows=4)
    assert sheet_page["content"] == '<table><tr><td colspan="2">h</td></tr><tr><td>x</td><td>5</td></tr></table>'
    sp = lambda t, ph="", props="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p>{props}<a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    bullet = '<a:pPr lvl="1"><a:buChar char="-"/></a:pPr>'
    slide = f"<p:sld {A} {Q}><p:cSld><p:spTree>{sp('T', '<p:ph type=' + chr(34) + 'title' + chr(34) + '/>')}{sp('i', '', bullet)}{sp('j', '', bullet)}{sp('end')}</p:spTree></p:cSld></p:sld>"
    show = zipped(**{"ppt/presentation.xml": f'<p:presentation {Q} {R}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": RELS % rel("r1", "slide", "slides/s1.xml"), "ppt/slides/s1.xml": slide, "ppt/slides/_rels/s1.xml.rels": RELS % rel("n", "notesSlide", "../notesSlides/n.xml"), "ppt/notesSlides/n.xml": f"<p:notes {A} {Q}>{sp('note')}</p:notes>"})
    (page,) = flat.read_pptx(show)
    assert page["content"] == "## T\n\n  - i\n  - j\n\nend\n\n> **Notes**: note"
