"""The worked cases, and rules held against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from sheafspark.functions import latex, markup, repetition, tables
from sheafspark.functions import text as T
from sheafspark.operators import boxes, cells

NS = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def test_text_columns(spark):
    row = spark.range(1).select(
        T.collapse_newlines(F.lit("\n a\n\n\nb \n")).alias("a"),
        F.array(*[T.size_label(F.lit(n).cast("long")) for n in (None, 0, 1023, 1024, 1536, 1048576)]).alias("b"),
        F.array(*[T.safe_href(F.lit(u)) for u in ("javascript:x", "mailto:a@b", "/rel", "gopher://x")]).alias("c"),
        T.excel_date(F.lit(45292.0)).alias("d"), T.excel_date(F.lit(0.5), True).alias("e"), T.repeat_unit(F.lit("ababab")).alias("f"),
    ).first()
    assert row.a == "a\nb"
    assert row.b == ["0.0/MB", "0.00/B", "1023.00/B", "1.00/KB", "1.50/KB", "1.00/MB"]
    assert row.c == ["", "mailto:a@b", "/rel", ""]
    assert (row.d, row.e, row.f) == ("2024-01-01", "1904-01-01T12:00:00", "ab")


def test_repetition():
    assert repetition.truncate("\n".join(["abcde"] * 12), 50) == "abcde"
    assert repetition.truncate("ab" * 30, 50) == "ab"
    assert repetition.truncate("ab" * 30) == "ab" * 30  # too short to look at
    assert repetition.truncate("a lead: " + "hello world " * 40, 50) == "a lead:"
    r = random.Random(1)
    for _ in range(2000):  # against plain versions
        unit = "".join(r.choice("ab") for _ in range(r.randint(1, 12)))
        text = "".join(r.choice("ab") for _ in range(r.randint(0, 30))) + unit * r.randint(1, 12)
        sizes = [k for k in range(8, len(text) // 5 + 1) if text.endswith(text[-k:] * 5)]
        got = repetition.tail_unit(text)
        assert (got is None) == (not sizes) and (not got or len(got[0]) == max(sizes) and text.endswith(got[0] * got[1]) and not text.endswith(got[0] * (got[1] + 1)))
        assert repetition.whole_unit(text) == next((text[:k] for k in range(1, len(text)) if len(text) % k == 0 and text[:k] * (len(text) // k) == text), None)
    assert repetition.truncate("short") == "short"
    assert repetition.truncate(None) is None
    assert repetition.escape_markdown(r"a*b\*c") == r"a\*b\*c"
    assert repetition.ctc([1, 1, 0, 1, 2, 2]) == [1, 1, 2]


def test_otsl():
    source = "<fcel>a<fcel>b<nl><fcel>c<nl>"
    assert tables.otsl_padded(source) == "<fcel>a<fcel>b<nl><fcel>c<ecel><nl>"
    assert tables.otsl_html(source) == "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td></td></tr></table>"
    assert 'colspan="2"' in tables.otsl_html("<fcel>a<lcel><nl><fcel>b<fcel>c<nl>")
    assert tables.otsl_html("") == tables.otsl_html(None) == ""


def test_nms_and_order():
    import numpy as np

    b = np.array([[0, 0, 9, 9], [0, 0, 9, 9], [0, 0, 9, 9], [0, 0, 9, 8]], float)
    assert sorted(boxes.kept_by_nms(b, np.array([0.9, 0.8, 0.7, 0.6]), np.array([1, 1, 2, 2]))) == [0, 3]
    assert boxes.xy_cut([(0, 0, 100, 10), (0, 20, 45, 100), (55, 20, 100, 100)]) == [0, 1, 2]
    assert boxes.lines_of(np.array([0.0, 10, 20]), np.zeros(3), 15).tolist() == [0, 0, 1]
    r = random.Random(1)
    own = [(x := r.random() * 500, y := r.random() * 500, x + 20, y + 20) for _ in range(60)]
    assert sorted(boxes.xy_cut(own)) == list(range(60))


def test_flood_fill():
    assert cells.table_bounds({(1, 1), (1, 2), (2, 1), (5, 5)}) == [(1, 1, 2, 2), (5, 5, 5, 5)]
    assert cells.table_bounds({(1, 1), (1, 3)}, 1) == [(1, 1, 1, 3)]
    assert cells.table_bounds(set()) == []


def test_markdown():
    page = '<html><head><title>t</title></head><body><script>var x="</p>"</script><h1>A  b</h1><p><b>one<br><p>two <a href="/x y">l</a></p><ul><li>i<li>j</ul><a href="javascript:1">k</a></body></html>'
    out = markup.to_markdown(page)
    assert out.startswith("# A b\n**one**") and "[l](/x%20y)" in out and "- i" in out and "javascript" not in out and "var x" not in out
    assert markup.to_markdown(None) == markup.to_markdown("") == ""
    assert markup.title_of(page) == "t"
    assert markup.to_markdown("<b>" * 5000 + "deep") == "deep"


@pytest.mark.parametrize(
    ("xml", "out"),
    [
        ("<m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>α</m:t></m:r></m:den></m:f>", r"\frac{1}{\alpha}"),
        ("<m:rad><m:deg/><m:e><m:r><m:t>x</m:t></m:r></m:e></m:rad>", r"\sqrt{x}"),
        ("<m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup>", "{x}^{2}"),
        ('<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub><m:r><m:t>i</m:t></m:r></m:sub><m:sup/><m:e><m:r><m:t>i</m:t></m:r></m:e></m:nary>', r"\sum_{i} i"),
    ],
)
def test_latex(xml, out):
    assert latex.omml_to_latex(f"<m:oMath {NS}>{xml}</m:oMath>") == out


def test_latex_refuses_document_types():
    with pytest.raises(ValueError):
        latex.omml_to_latex("<!DOCTYPE x><x/>")
