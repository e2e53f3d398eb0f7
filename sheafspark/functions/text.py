"""Text rules as Column -> Column functions; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that a strip takes away.
WHITE = r"\x09-\x0D\x1C-\x20\x85\xA0  -     　"


def strip(x: Column) -> Column:
    """x without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(x, rf"\A[{WHITE}]+", ""), rf"[{WHITE}]+\z", "")


def collapse_newlines(x: Column) -> Column:
    """Runs of newlines become one; then strip."""
    return strip(F.regexp_replace(x, "\n{2,}", "\n"))


def hundredths(value: Column, unit: int) -> Column:
    """value / unit with two decimals, halves to even, from integers alone."""
    scaled = value.cast("decimal(30,0)") * 100
    whole = F.floor(scaled / unit).cast("long")
    left = (scaled - whole.cast("decimal(30,0)") * unit).cast("long") * 2
    rounded = whole + F.when((left > unit) | ((left == unit) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(rounded / 100).cast("string"), F.lit("."), F.lpad((rounded % 100).cast("string"), 2, "0"))


def size_label(size: Column) -> Column:
    """"value/UNIT" in steps of 1024 up to TB; null is "0.0/MB"."""
    out = F.concat(hundredths(size, 1 << 40), F.lit("/TB"))
    for power, unit in ((30, "GB"), (20, "MB"), (10, "KB"), (0, "B")):
        out = F.when(size < (1 << (power + 10)), F.concat(hundredths(size, 1 << power), F.lit(f"/{unit}"))).otherwise(out)
    return F.when(size.isNull(), F.lit("0.0/MB")).otherwise(out)


def markdown_images(x: Column) -> Column:
    """Targets of all ![alt](target) in x."""
    return F.regexp_extract_all(x, F.lit(r"!\[[^\]]*\]\(([^)]*)\)"), F.lit(1))


def repeat_unit(x: Column) -> Column:
    """The shortest unit whose repetition is x; null where there is none."""
    unit = F.regexp_extract(x, r"(?s)\A(.+?)\1+\z", 1)
    return F.when(unit != "", unit)


def escape_leading_marker(x: Column) -> Column:
    """A backslash before a heading or bullet marker that opens x (after three spaces at most)."""
    return F.regexp_replace(x, r"\A( {0,3})(#{1,6}|[-+*])(?=[ \t]|\z)", r"$1\\$2")


def escape_rule(x: Column) -> Column:
    """A backslash before a text of underscores or dashes only."""
    return F.when(x.rlike(r"\A\s*(_{3,}|-{3,})\s*\z"), F.concat(F.lit("\\"), x)).otherwise(x)


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_with_breaks(x: Column) -> Column:
    return F.replace(html_escape(x), F.lit("\n"), F.lit("<br>"))


def markdown_style(x: Column, style: Column) -> Column:
    """bold, italic, strike and bold with italic; anything else as it is."""
    wrap = lambda mark: F.concat(F.lit(mark), x, F.lit(mark))
    both = F.array_contains(style, "bold") & F.array_contains(style, "italic")
    return F.when(both, wrap("***")).when(F.array_contains(style, "bold"), wrap("**")).when(F.array_contains(style, "italic"), wrap("*")).when(F.array_contains(style, "strikethrough"), wrap("~~")).otherwise(x)


def html_style(x: Column, style: Column) -> Column:
    """Tags from the inside out: superscript or subscript, underline, bold, italic, strike."""
    for name, tag in (("superscript", "sup"), ("subscript", "sub"), ("underline", "u"), ("bold", "strong"), ("italic", "em"), ("strikethrough", "s")):
        x = F.when(F.array_contains(style, name), F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))).otherwise(x)
    return x


def link(text: Column, url: Column, syntax: str = "markdown") -> Column:
    if syntax == "html":
        return F.concat(F.lit('<a href="'), url, F.lit('">'), text, F.lit("</a>"))
    return F.concat(F.lit("["), text, F.lit("]("), url, F.lit(")"))


def safe_href(url: Column) -> Column:
    """url where its scheme is http, https, mailto or ftp or it has none; else empty."""
    scheme = F.lower(F.regexp_extract(url, r"\A\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(url.isNull(), F.lit("")).when((scheme == "") | scheme.isin("http", "https", "mailto", "ftp"), url).otherwise(F.lit(""))


def escape_parentheses(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def equation_tags(x: Column) -> Column:
    """<eq>...</eq> as $...$."""
    return F.regexp_replace(x, r"(?s)<eq>(.*?)</eq>", r"\$$1\$")


def image_prefix(x: Column, prefix: str) -> Column:
    """prefix before each image source that isn't a data URI."""
    return F.regexp_replace(x, r'(<img\b[^>]*\bsrc=")(?!data:)', rf"$1{prefix}/")


def section_parts(x: Column, level: Column) -> Column:
    """The leading dotted number's parts where there are as many as level says; else null."""
    parts = F.split(F.regexp_extract(x, r"\A\s*(\d+(?:\.\d+)*)\.?(?=\s|\z)", 1), r"\.").cast("array<int>")
    return F.when(F.size(parts) == level, parts)


def heading_style(x: Column) -> tuple[Column, Column]:
    """A style name's text and number."""
    return F.trim(F.regexp_extract(x, r"\A(\D*)", 1)), F.try_to_number(F.regexp_extract(x, r"(\d+)", 1), F.lit("999")).cast("int")


def page_token(x: Column) -> Column:
    """Digits, roman numerals or a single letter."""
    return x.rlike(r"\A(\d{1,12}|[ivxlcdmIVXLCDM]{1,12}|[A-Za-z])\z")


def strip_page_tail(x: Column) -> Column:
    """Without a tab and page token at the end; other tabs are spaces."""
    return F.replace(F.regexp_replace(x, r"\t+(\d{1,12}|[ivxlcdmIVXLCDM]{1,12}|[A-Za-z])\s*\z", ""), F.lit("\t"), F.lit(" "))


def strip_fence(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\A```[^\n]*\n", ""), r"\n?```\s*\z", "")


def strip_math(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(x), r"\A(?:\$\$|\$|\\\[|\\\()|(?:\$\$|\$|\\\]|\\\))\z", ""))


def control_characters(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"))


def text_class(n_visible: Column, n_odd: Column, n_all: Column, least: int = 50, most_odd: float = 0.03) -> Column:
    """"ocr" where too little is visible or too much is odd; else "txt"."""
    return F.when(n_visible < least, "ocr").when(n_odd >= F.lit(most_odd) * n_all, "ocr").otherwise("txt")


def column_index(letters: Column) -> Column:
    """A spreadsheet column's number from its letters."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def column_letters(n: Column) -> Column:
    """A spreadsheet column's letters from its number, from 1."""
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("x"))
    step = lambda a, _: F.when(a["n"] > 0, F.struct(F.floor((a["n"] - 1) / 26).alias("n"), F.concat(F.char(F.lit(65) + (a["n"] - 1) % 26), a["x"]).alias("x"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["x"])


def excel_date(serial: Column, date_1904: bool = False) -> Column:
    """ISO text of a serial: the date alone at midnight. In the 1900 system days from 60 on count a day that never was."""
    day = F.floor(serial).cast("int")
    second = F.bround((serial - F.floor(serial)) * 86400).cast("int")
    day, second = day + F.floor(second / 86400).cast("int"), second % 86400
    first = F.lit("1904-01-01").cast("date") if date_1904 else F.lit("1899-12-30").cast("date")
    date = F.date_add(first, day if date_1904 else F.when(day < 60, day + 1).otherwise(day))
    text = F.date_format(date, "yyyy-MM-dd")
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600).cast("int"), (F.floor(second / 60) % 60).cast("int"), (second % 60).cast("int"))
    return F.when(second == 0, text).otherwise(F.concat(text, F.lit("T"), clock))
