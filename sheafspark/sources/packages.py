"""Readers of single files, over the standard library: text, CSV, e-mail, e-books and office packages.

Each is a function (bytes) -> list of pages, a page being a dict of title and
content and, where it has them, other fields as text. ``read`` runs them over a
table of files and puts an error in a column of its own; nothing fails silently.
"""

from __future__ import annotations

import csv
import email
import email.policy
import email.utils
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable
from datetime import UTC
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.functions import blocks, encodings, markup
from sheafspark.functions.xml import attr, child, named, parse_xml
from sheafspark.sources import office

Page = dict[str, str]


def decode(raw: bytes) -> tuple[str, str]:
    """Text and the encoding that it is most surely in."""
    return encodings.decoded(raw)


def tidy(text: str) -> str:
    return re.sub("\n{2,}", "\n", text.replace("\r\n", "\n")).strip()


def read_text(raw: bytes) -> list[Page]:
    return [{"content": tidy(decode(raw)[0])}]


def read_markdown(raw: bytes) -> list[Page]:
    return [{"content": re.sub("\n{2,}", "\n", decode(raw)[0].replace("\r\n", "\n"))}]


def read_rst(raw: bytes) -> list[Page]:
    """Headings, literal blocks, emphasis, links and lists of reStructuredText as Markdown."""
    lines, out, levels, i = decode(raw)[0].splitlines(), [], [], 0
    while i < len(lines):
        line, under = lines[i], lines[i + 1] if i + 1 < len(lines) else ""
        if line.strip() and re.fullmatch(r"([=\-~^\"'#*+.:])\1{2,}", under) and len(under) >= len(line.rstrip()):
            if under[0] not in levels:
                levels.append(under[0])
            out.append("#" * (levels.index(under[0]) + 1) + " " + line.strip())
            i += 2
            continue
        if re.fullmatch(r"([=\-~^\"'#*+.:])\1{2,}", line):
            i += 1
            continue
        if line.rstrip().endswith("::"):
            body, i = [], i + 1
            if line.strip() != "::":
                out.append(line.rstrip()[:-1])
            while i < len(lines) and (not lines[i].strip() or lines[i].startswith((" ", "\t"))):
                body.append(lines[i].strip())
                i += 1
            out += ["```", *[b for b in body if b], "```"]
            continue
        line = re.sub(r"``([^`]+)``", r"`\1`", line)
        out.append(re.sub(r"`([^`<]+) <([^>]+)>`_", r"[\1](\2)", line))
        i += 1
    return [{"content": tidy("\n".join(out))}]


def read_html(raw: bytes) -> list[Page]:
    source = decode(raw)[0]
    return [{"content": markup.to_markdown(source), "title": markup.title_of(source) or ""}]


_NUMBER = re.compile(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?")


def pipe(rows: list[list[str]]) -> str:
    """Rows as a pipe table, the first as its head: columns as wide as their widest cell (three at least), those of numbers to the right; bars are escaped and line ends become br."""
    if not rows:
        return ""
    n = max(map(len, rows))
    own = [[x.replace("|", "\\|").replace("\r\n", "<br>").replace("\n", "<br>") for x in r] + [""] * (n - len(r)) for r in rows]
    wide = [max(3, *(len(r[i]) for r in own)) for i in range(n)]
    right = [any(r[i] for r in own[1:]) and all(_NUMBER.fullmatch(r[i]) for r in own[1:] if r[i]) for i in range(n)]
    line = lambda r: "| " + " | ".join(x.rjust(w) if k else x.ljust(w) for x, w, k in zip(r, wide, right, strict=True)) + " |"
    rule = "|" + "|".join("-" * (w + 1) + ":" if k else ":" + "-" * (w + 1) for w, k in zip(wide, right, strict=True)) + "|"
    return "\n".join([line(own[0]), rule, *map(line, own[1:])])


def sniff(text: str, default: str) -> str:
    """The separator of the first ten lines, or the default."""
    try:
        return csv.Sniffer().sniff("\n".join(text.splitlines()[:10]), ",;\t|").delimiter
    except csv.Error:
        return default


def read_csv(raw: bytes, separator: str = ",", chunk_size: int | None = None, sniffed: bool = True) -> list[Page]:
    """Rows without the all-empty ones as a pipe table; with a chunk size a page for each so many source rows."""
    text = decode(raw)[0]
    rows = list(csv.reader(io.StringIO(text), delimiter=sniff(text, separator) if sniffed else separator))
    if not rows:
        return [{"content": ""}]
    head, body = rows[0], rows[1:]
    size = chunk_size or max(1, len(body))
    out = []
    for k, a in enumerate(range(0, max(1, len(body)), size)):
        own = [r for r in body[a : a + size] if any(x != "" for x in r)]
        page = {"content": pipe([head, *own])}
        out.append(page | ({"chunk_id": str(k + 1), "chunk_size": str(size)} if chunk_size else {}))
    return out


def read_tsv(raw: bytes) -> list[Page]:
    return read_csv(raw, "\t")


def read_notebook(raw: bytes) -> list[Page]:
    out = []
    for i, cell in enumerate(json.loads(decode(raw)[0]).get("cells", [])):
        source = cell.get("source", "")
        source = "".join(source) if isinstance(source, list) else source
        if source:
            kind = cell.get("cell_type")
            out.append({"content": {"markdown": source, "code": f"```python\n{source}\n```", "raw": f"```\n{source}\n```"}.get(kind, ""), "cell_idx": str(i)})
    return out


def read_email(raw: bytes) -> list[Page]:
    """Subject as title, header fields, and the body: HTML rather than plain, in its part's charset."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    people = lambda h: json.dumps([email.utils.formataddr(a) for a in email.utils.getaddresses([str(v) for v in m.get_all(h, [])])], ensure_ascii=False)
    try:
        sent = email.utils.parsedate_to_datetime(str(m["date"]))
        date = (sent if sent.tzinfo else sent.replace(tzinfo=UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S+00:00")
    except (TypeError, ValueError):
        date = ""
    part = m.get_body(("html", "plain"))
    content = ""
    if part is not None:
        data = part.get_payload(decode=True) or b""
        try:
            content = data.decode(part.get_content_charset() or "utf-8")
        except (LookupError, UnicodeDecodeError):
            content = data.decode("utf-8", "replace")
        if part.get_content_subtype() == "html":
            content = markup.to_markdown(content)
    return [{"content": tidy(content), "title": str(m["subject"] or ""), "message_id": str(m["message-id"] or "").strip().strip("<>"), "sent_date": date, **{h: people(h) for h in ("from", "to", "cc", "bcc")}}]


def read_epub(raw: bytes) -> list[Page]:
    """A page for each spine item with text; items that the manifest lacks are left out."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    container = parse_xml(z.read("META-INF/container.xml"))
    opf = next(attr(e, "full-path") for e in container.iter() if named(e) == "rootfile")
    root, base = parse_xml(z.read(opf)), posixpath.dirname(opf)
    meta: dict[str, list[str]] = {}
    for e in child(root, "metadata") if child(root, "metadata") is not None else []:
        if e.text and e.text.strip():
            meta.setdefault(named(e), []).append(e.text.strip())
    manifest = {attr(e, "id"): attr(e, "href") for e in root.iter() if named(e) == "item"}
    out, names = [], set(z.namelist())
    for i, ref in enumerate(e for e in root.iter() if named(e) == "itemref"):
        href = manifest.get(attr(ref, "idref"))
        path = posixpath.normpath(posixpath.join(base, unquote(href))) if href else None
        if path in names:
            source = decode(z.read(path))[0]
            content = markup.to_markdown(source, markup.Options(keep_data_uris=False, checkboxes=True))
            if content:
                out.append({"content": content, "epub_idx": str(i), "title": json.dumps(meta, ensure_ascii=False)})
    return out


# Office packages -----------------------------------------------------------------


def read_docx(raw: bytes, headers: bool = False, mode: str = "mm_markdown") -> list[Page]:
    """A page for each section with content; headers and footers are in content lists and, asked for, before the first page."""
    own = office.Docx(raw).pages(headers)
    made = blocks.document(own)
    lead = [blocks.paragraph(b) for p in made for b in p["discarded_blocks"]] if headers else []
    out = []
    for i, p in enumerate(made):
        text = "\n\n".join(x for x in [*(lead if not i else []), blocks.page_markdown(p["para_blocks"], mode)] if x)
        if text:
            out.append({"content": text, "blocks": json.dumps(p, ensure_ascii=False)})
    return out


def read_xlsx(raw: bytes, max_rows: int | None = None, gap: int | None = None, mode: str = "mm_markdown") -> list[Page]:
    """A page for each visible sheet with content; without a gap the best tolerance is found for each sheet."""
    out = []
    for name, i, own in office.Xlsx(raw).pages(max_rows, gap):
        page = blocks.page_info(own, i)
        out.append({"content": blocks.page_markdown(page["para_blocks"], mode), "title": name, "sheet_name": name, "sheet_idx": str(i), "blocks": json.dumps(page, ensure_ascii=False)})
    return out


def read_pptx(raw: bytes, mode: str = "mm_markdown") -> list[Page]:
    """A page for each slide; notes are in content lists, not in Markdown."""
    made = blocks.document(office.Pptx(raw).pages())
    return [{"content": blocks.page_markdown(p["para_blocks"], mode), "slide_idx": str(i), "blocks": json.dumps(p, ensure_ascii=False)} for i, p in enumerate(made)]


READERS: dict[str, Callable[[bytes], list[Page]]] = {
    "txt": read_text, "md": read_markdown, "rst": read_rst, "html": read_html, "htm": read_html, "csv": read_csv, "tsv": read_tsv, "ipynb": read_notebook,
    "eml": read_email, "epub": read_epub, "docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx, "xlsm": read_xlsx,
}

PAGES = "path string, page_id int, title string, content string, extras map<string,string>, error string"


def register_reader(suffix: str, reader: Callable[[bytes], list[Page]]) -> None:
    """Adds or replaces the reader of a suffix."""
    READERS[suffix] = reader


def read(files: DataFrame) -> DataFrame:
    """Pages of a table of files (path, suffix, content): numbered from 1; a file that can't be read has one row with its error."""
    readers = dict(READERS)

    def run(batches):
        for b in batches:
            rows = []
            for path, suffix, raw in zip(b["path"], b["suffix"], b["content"], strict=True):
                try:
                    if suffix not in readers:
                        raise ValueError(f"no reader for {suffix!r}")
                    for i, page in enumerate(readers[suffix](bytes(raw)), 1):
                        rest = {k: v for k, v in page.items() if k not in ("title", "content")}
                        rows.append((path, i, page.get("title", ""), page["content"], rest, None))
                except Exception as e:  # noqa: BLE001: whatever a broken file raises is its row's error
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_id", "title", "content", "extras", "error"]).astype({"page_id": "Int32"})

    return files.select("path", "suffix", "content").mapInPandas(run, PAGES)


def documents(pages: DataFrame) -> DataFrame:
    """A row for each file: its pages' contents in order, a newline between, and how many there are."""
    own = F.array_sort(F.collect_list(F.struct("page_id", "content")))
    return pages.filter("error is null").groupBy("path").agg(F.array_join(F.transform(own, lambda p: p["content"]), "\n").alias("content"), F.count("*").alias("page_count"))
