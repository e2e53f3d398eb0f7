"""Word, PowerPoint and Excel packages as pages of blocks (see functions.blocks), over the standard library.

A reader walks a package's parts and says what it finds: titles with level, anchor and numbering, texts with styled
spans, nested lists, indexes, tables, charts, pictures as data URIs, captions, headers and footers, slide notes. What
becomes of them, numbering, links of indexes, captions, Markdown and content lists, is for functions.blocks.
"""

from __future__ import annotations

import base64
import html
import io
import itertools
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

from sheafspark.functions import charts, inline, latex
from sheafspark.functions.xml import attr, child, named, parse_xml, text_of

#: Media types by suffix; pictures that only a drawing program can show are named, not shown.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff"}
VECTOR = ("wmf", "emf")
#: Number formats that make a list ordered.
ORDERED = frozenset("decimal lowerRoman upperRoman lowerLetter upperLetter decimalZero".split())
#: Fixed value: members that may be left out of a package where they can't be read.
SPARE = re.compile(r"(?i)(^|/)(media|embeddings)/|\.(png|jpe?g|gif|bmp|wmf|emf|tiff?|xlsx|xlsm|docx|pptx|bin)$")


class Package:
    """A zip of XML parts, repaired as it is read: strict addresses become the usual ones, spare members that can't be read and relationships to missing parts are left out, and alternate content that nothing here can draw gives way to its fallback. A legacy binary file is refused."""

    def __init__(self, raw: bytes):
        if raw[:8] == bytes.fromhex("d0cf11e0a1b11ae1"):
            raise ValueError("a legacy binary file")
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        self.names = set(self.zip.namelist())
        self._rels: dict[str, dict[str, tuple[str, str]]] = {}

    def bytes(self, name: str) -> bytes | None:
        """A member's bytes; null for one that is missing, or spare and damaged."""
        if name not in self.names:
            return None
        try:
            return self.zip.read(name)
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError):
            if SPARE.search(name) or name not in self.reachable():
                return None
            raise

    def xml(self, name: str) -> ElementTree.Element | None:
        raw = self.bytes(name)
        if raw is None:
            return None
        # strict files name the same things by other addresses
        root = parse_xml(raw.replace(b"http://purl.oclc.org/ooxml/", b"http://schemas.openxmlformats.org/"))
        if b"AlternateContent" in raw:
            alternate(root)
        return root

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Target and type of each relationship id of a part; external ones and those whose target is there."""
        if part not in self._rels:
            folder, _, name = part.rpartition("/")
            where = f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"
            out = {}
            for r in parse_xml(self.zip.read(where)) if where in self.names else []:
                target, kind = attr(r, "Target", ""), attr(r, "Type", "").rpartition("/")[2]
                if attr(r, "TargetMode") != "External":
                    target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                    if target not in self.names:
                        continue
                out[attr(r, "Id")] = (target, kind)
            self._rels[part] = out
        return self._rels[part]

    def reachable(self) -> set[str]:
        """Members that relationships lead to from the package's root."""
        seen, todo = set(), [""]
        while todo:
            part = todo.pop()
            new = {t for t, _ in self.relations(part).values()} & self.names - seen
            seen |= new
            todo += new
        return seen

    def related(self, part: str, kind: str) -> list[str]:
        return [t for t, k in self.relations(part).values() if k == kind]

    def picture(self, part: str, rid: str | None) -> str:
        """A related picture as a data URI; of a vector drawing its name, of one that can't be read nothing."""
        target = self.relations(part).get(rid or "", ("", ""))[0]
        suffix = target.rpartition(".")[2].lower()
        if suffix in VECTOR:
            return f"data:image/svg+xml,{posixpath.basename(target)}"
        raw = self.bytes(target) if suffix in MEDIA else None
        return f"data:{MEDIA[suffix]};base64,{base64.b64encode(raw).decode()}" if raw else ""

    def chart(self, part: str, rid: str | None) -> str:
        """A related chart's table; its embedded workbook is asked first."""
        target = self.relations(part).get(rid or "", ("", ""))[0]
        raw = self.bytes(target)
        if raw is None:
            return ""
        book = next((b for t, k in self.relations(target).values() if k in ("package", "embeddings") and (b := self.bytes(t))), None)
        try:
            sheets = Xlsx(book) if book else None
        except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
            sheets = None
        return charts.chart_html(raw, sheets.vector if sheets else None, sheets.grids() if sheets else None)


def alternate(root: ElementTree.Element) -> None:
    """Alternate content in place of its chosen part: the choice, or the fallback where the choice holds a content part and the fallback has shapes."""
    for e in list(root.iter()):
        for i, c in enumerate(list(e)):
            if named(c) == "AlternateContent":
                choice, fallback = child(c, "Choice"), child(c, "Fallback")
                odd = choice is None or any(named(x) == "contentPart" for x in choice.iter()) and fallback is not None and len(fallback)
                own = fallback if odd else choice
                e.remove(c)
                for k, x in enumerate(own if own is not None else []):
                    e.insert(i + k, x)


def on(props, name: str) -> bool | None:
    e = child(props, name)
    return None if e is None else attr(e, "val", "1") not in ("0", "false", "none")


def text_block(markup: str, **more) -> dict:
    return {"type": "text", "spans": inline.parse_spans(markup), **more}


def cell_html(spans: str) -> str:
    """Marked text inside a table: styles as tags, links where safe, formulas as they are marked, line ends as br."""
    out = ""
    for s in inline.parse_spans(spans):
        if s["type"] == "inline_equation":
            out += f"<eq>{html.escape(s['content'], quote=False)}</eq>"
            continue
        pieces = inline.children_of(s) or [s]
        text = "".join(inline.styled(html.escape(p["content"], quote=False).replace("\n", "<br>"), p.get("style"), inline.HTML) for p in pieces)
        url = s.get("url", "")
        out += f'<a href="{html.escape(url)}">{text}</a>' if url and safe(url) else text
    return out


def safe(url: str) -> bool:
    m = re.match(r"\s*([A-Za-z][A-Za-z0-9+.-]*):", url)
    return not m or m[1].lower() in ("http", "https", "mailto", "ftp")


def table_html(rows: list[list[tuple[str, int, int]]], head: bool = False) -> str:
    """Rows of (inner HTML, columns, rows) as a table; the first row's cells are headers with ``head``."""
    def cell(tag: str, x: str, wide: int, tall: int) -> str:
        return f"<{tag}" + (f' colspan="{wide}"' if wide > 1 else "") + (f' rowspan="{tall}"' if tall > 1 else "") + f">{x}</{tag}>"

    return "<table>" + "".join("<tr>" + "".join(cell("th" if head and not i else "td", *c) for c in r) + "</tr>" for i, r in enumerate(rows)) + "</table>"


def nested(items: list[tuple[int, bool, int, dict]], kind: str = "list") -> dict:
    """A list block of (level, ordered, start, leaf) items in a row: deeper ones in a list of their own within."""
    level, ordered, start, _ = items[0]
    out = {"type": kind, "ilevel": level, "attribute": "ordered" if ordered else "unordered", "start": start, "blocks": []}
    at = 0
    while at < len(items):
        if items[at][0] <= level:
            out["blocks"].append(items[at][3])
            at += 1
            continue
        end = next((k for k in range(at, len(items)) if items[k][0] <= level), len(items))
        # within it another kind of list begins a new one
        same = [list(g) for _, g in itertools.groupby(items[at:end], key=lambda x: x[1] if x[0] == min(y[0] for y in items[at:end]) else None)]
        merged: list[list] = []
        for g in same:
            if merged and g[0][0] > merged[-1][0][0]:
                merged[-1] += g
            else:
                merged.append(g)
        out["blocks"] += [nested(g, kind) for g in merged]
        at = end
    return out


class Docx:
    def __init__(self, raw: bytes):
        self.p, self.part = Package(raw), "word/document.xml"
        root = self.p.xml("word/styles.xml")
        self.styles = {attr(s, "styleId"): s for s in (root if root is not None else []) if named(s) == "style"}
        self.numbering = self.read_numbering()
        self.body = child(self.p.xml(self.part), "body")
        if self.body is None:
            raise ValueError("a document without a body")
        self.titles = self.heading_lists()
        self.toc_anchors = {a for e in self.body.iter() if named(e) == "hyperlink" and (a := attr(e, "anchor", "")).startswith("_Toc")}
        self.toc_anchors |= {m[1] for e in self.body.iter() if named(e) == "instrText" and (m := re.search(r"(_Toc\w+)", e.text or ""))}

    def read_numbering(self) -> dict[str, dict[int, tuple[str, int, str | None]]]:
        """Format, start and linked style of each level of each list; a list that names a style takes that style's levels."""
        root = self.p.xml("word/numbering.xml")
        kinds, links, out = {}, {}, {}
        for a in root if root is not None else []:
            if named(a) == "abstractNum":
                key = attr(a, "abstractNumId")
                kinds[key] = {int(attr(v, "ilvl", "0")): (attr(child(v, "numFmt"), "val", "bullet"), int(attr(child(v, "start"), "val", "1")), attr(child(v, "pStyle"), "val")) for v in a if named(v) == "lvl"}
                if child(a, "styleLink") is not None:
                    links[attr(child(a, "styleLink"), "val")] = key
        for a in root if root is not None else []:
            if named(a) == "abstractNum" and child(a, "numStyleLink") is not None:
                kinds[attr(a, "abstractNumId")] = kinds.get(links.get(attr(child(a, "numStyleLink"), "val")), {})
        for n in root if root is not None else []:
            if named(n) == "num":
                levels = dict(kinds.get(attr(child(n, "abstractNumId"), "val"), {}))
                for o in n:
                    if named(o) == "lvlOverride" and child(o, "startOverride") is not None:
                        k = int(attr(o, "ilvl", "0"))
                        levels[k] = (levels.get(k, ("decimal",))[0], int(attr(child(o, "startOverride"), "val", "1")), None)
                out[attr(n, "numId")] = levels
        return out

    def chain(self, style: str | None) -> Iterator[ElementTree.Element]:
        seen: set[str] = set()
        while style and style in self.styles and style not in seen:
            seen.add(style)
            yield self.styles[style]
            style = attr(child(self.styles[style], "basedOn"), "val")

    def style_names(self, p) -> list[str]:
        return [(attr(child(s, "name"), "val") or attr(s, "styleId") or "") for s in self.chain(attr(child(p, "pPr", "pStyle"), "val"))]

    def toggle(self, run, p, name: str) -> bool:
        """A run's own setting, else its character style's (links' aside), else its paragraph style's, else off."""
        own = on(child(run, "rPr"), name)
        char = list(self.chain(attr(child(run, "rPr", "rStyle"), "val")))
        if char and (attr(child(char[0], "name"), "val") or "").lower() in ("hyperlink", "followedhyperlink"):
            char = []
        for s in ([] if own is not None else [*char, *self.chain(attr(child(p, "pPr", "pStyle"), "val"))]):
            own = on(child(s, "rPr"), name)
            if own is not None:
                break
        return bool(own)

    def look(self, run, p) -> inline.Look:
        props = child(run, "rPr")
        line, script = attr(child(props, "u"), "val", "none" if child(props, "u") is None else "single"), attr(child(props, "vertAlign"), "val", "")
        return inline.Look(
            self.toggle(run, p, "b"), self.toggle(run, p, "i"), line not in ("none", "0"), attr(child(props, "em"), "val", "none") != "none",
            self.toggle(run, p, "strike") or self.toggle(run, p, "dstrike"), {"superscript": "superscript", "subscript": "subscript"}.get(script, ""), line == "words",
        )

    def numbered(self, p) -> tuple[str, int, str, int] | None:
        """List, level, format and start of a paragraph, from itself or its style; list 0 switches numbering off, and a style's level is the one that is linked with it."""
        props = child(p, "pPr")
        own, chain = child(props, "numPr"), list(self.chain(attr(child(props, "pStyle"), "val")))
        for source in [own, *(child(s, "pPr", "numPr") for s in chain)]:
            num = attr(child(source, "numId"), "val")
            if num is None:
                continue
            if num == "0" or num not in self.numbering:
                return None
            level = attr(child(source, "ilvl"), "val")
            if level is None:
                ids = [attr(s, "styleId") for s in chain]
                level = next((k for k, (_, _, linked) in sorted(self.numbering[num].items()) if linked in ids), 0)
            kind, start, _ = self.numbering[num].get(int(level), ("bullet", 1, None))
            return num, int(level), kind, start
        return None

    def heading_lists(self) -> set[str]:
        """Lists with items of several levels between which body text stands: their items are headings."""
        seen: dict[str, tuple[set[int], set[int]]] = {}
        texts = 0
        for p in (x for x in self.body if named(x) == "p"):
            got = self.numbered(p)
            if got is None:
                texts += any(t.text for t in p.iter() if named(t) == "t")
            elif got[2] in ORDERED:
                levels, at = seen.setdefault(got[0], (set(), set()))
                levels.add(got[1])
                at.add(texts)
        return {n for n, (levels, at) in seen.items() if len(levels) > 1 and len(at) > 1}

    def level(self, p) -> int | None:
        """A heading's level: by its style's name or its outline level."""
        for n in self.style_names(p):
            if m := re.fullmatch(r"(?i)heading\s*(\d+)", n):
                return int(m[1])
            if n.lower() == "title":
                return 1
        for x in [child(p, "pPr"), *(child(s, "pPr") for s in self.chain(attr(child(p, "pPr", "pStyle"), "val")))]:
            if child(x, "outlineLvl") is not None:
                k = int(attr(child(x, "outlineLvl"), "val", "9"))
                return k + 1 if k < 9 else None
        return None

    def toc_level(self, p) -> int | None:
        return next((int(m[1]) - 1 for n in self.style_names(p) if (m := re.match(r"(?i)toc\s*(\d+)", n))), None)

    def bookmark(self, p) -> str | None:
        """A paragraph's anchor: the bookmark of the index, else the first of its own."""
        names = [n for e in p.iter() if named(e) == "bookmarkStart" and (n := attr(e, "name", "")) and n != "_GoBack"]
        return next((n for n in names if n in self.toc_anchors or n.startswith("_Toc")), names[0] if names else None)

    def segments(self, p, whole=None) -> list[tuple[str, str, str | None]]:
        """(text, style, target) of a paragraph's runs, hidden ones left out, formulas marked; fields and links give targets."""
        whole = p if whole is None else whole
        out: list[tuple[str, str, str | None]] = []
        rels = self.p.relations(self.part)
        field: list[list] = []  # of open fields: instruction, whether its result has begun

        def target() -> str | None:
            for code, begun in reversed(field):
                m = re.match(r'\s*HYPERLINK\s+(\\l\s+)?"([^"]*)"', code)
                if begun and m:
                    return ("#" if m[1] else "") + m[2]
            return None

        def walk(e, url: str | None) -> None:
            for c in e:
                n = named(c)
                if n == "r":
                    if on(child(c, "rPr"), "vanish"):
                        continue
                    text = ""
                    for x in c:
                        k = named(x)
                        if k == "fldChar":
                            kind = attr(x, "fldCharType")
                            if kind == "begin":
                                field.append(["", False])
                            elif field and kind == "separate":
                                field[-1][1] = True
                            elif field and kind == "end":
                                field.pop()
                        elif k == "instrText" and field:
                            field[-1][0] += x.text or ""
                        elif not field or field[-1][1]:
                            text += text_of(x) if k == "t" else {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}.get(k, "")
                    if text:
                        out.append((text, inline.style_text(inline.look_for(self.look(c, whole), text)), url or target()))
                elif n == "hyperlink":
                    own = rels.get(attr(c, "id") or "", (None,))[0] or (f"#{attr(c, 'anchor')}" if attr(c, "anchor") else None)
                    walk(c, own or url)
                elif n in ("oMath", "oMathPara"):
                    out.append((f"<eq>{latex.omml_to_latex(c)}</eq>", "", None))
                elif n in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple", "moveTo"):
                    walk(c, url)

        walk(p, None)
        return out

    def marked(self, p) -> str:
        """A paragraph as marked text, blank ends trimmed."""
        return inline.rich_text(self.segments(p), True)

    def is_caption(self, p) -> bool:
        """Whether a paragraph counts itself with a SEQ field, or has the caption style."""
        codes = [e.text or "" for e in p.iter() if named(e) == "instrText"] + [attr(e, "instr", "") for e in p.iter() if named(e) == "fldSimple"]
        return any(re.match(r"\s*SEQ\b", c) for c in codes) or any(n.lower() == "caption" for n in self.style_names(p))

    def drawings(self, p) -> list[dict]:
        """Charts, pictures and text boxes of a paragraph, each once."""
        out, seen = [], set()
        for e in p.iter():
            n = named(e)
            if n == "chart" and attr(e, "id"):
                out.append({"type": "chart", "content": self.p.chart(self.part, attr(e, "id"))})
            elif n in ("blip", "imagedata"):
                rid = attr(e, "embed") or attr(e, "id")
                if rid and rid not in seen and (uri := self.p.picture(self.part, rid)):
                    out.append({"type": "image", "image": uri})
                seen.add(rid)
            elif n == "txbxContent":
                texts = list(dict.fromkeys(self.marked(x) for x in e.iter() if named(x) == "p"))
                out += [text_block(t) for t in texts if t]
        return out

    def table(self, t) -> str:
        rows: list[list[list]] = []
        open_: dict[int, list] = {}
        for r in (x for x in t if named(x) == "tr"):
            row, col = [], int(attr(child(r, "trPr", "gridBefore"), "val", "0"))
            for c in (x for e in r for x in (e.iter() if named(e) == "sdt" else [e]) if named(x) == "tc"):
                props = child(c, "tcPr")
                span, merge = int(attr(child(props, "gridSpan"), "val", "1")), child(props, "vMerge")
                if merge is not None and attr(merge, "val", "continue") == "continue" and col in open_:
                    open_[col][2] += 1
                else:
                    inner = [self.table(x) if named(x) == "tbl" else cell_html(self.marked(x)) + "".join(f'<img src="{d["image"]}">' for d in self.drawings(x) if d["type"] == "image") for x in c if named(x) in ("p", "tbl")]
                    cell = ["<br>".join(x for x in inner if x), span, 1]
                    row.append(cell)
                    open_.pop(col, None)
                    if merge is not None:
                        open_[col] = cell
                col += span
            rows.append(row)
        return table_html([[tuple(c) for c in r] for r in rows])

    def paragraph(self, p) -> list[tuple[str, object]]:
        """What a paragraph gives: ("item" | "toc", (level, ordered, start, leaf, list)) or ("block", block)."""
        shown = [e for e in p if named(e) != "pPr"]
        drawn = [("block", d) for d in self.drawings(p)]
        text = self.marked(p)
        if not text:
            return drawn
        math = [e for e in shown if named(e) in ("oMathPara", "oMath")]
        level, num, toc = self.level(p), self.numbered(p), self.toc_level(p)
        anchor = {"anchor": b} if (b := self.bookmark(p)) else {}
        if toc is not None:
            target = next((a for e in p.iter() if named(e) == "hyperlink" and (a := attr(e, "anchor", "")).startswith("_Toc")), None)
            dotted = re.match(r"\s*(\d+(?:\.\d+)*)", re.sub("<[^>]*>", "", text))
            depth = min(toc, dotted[1].count(".")) if dotted else toc
            leaf = text_block(re.sub(r"</?hyperlink>|<url>.*?</url>", "", text), **({"anchor": target} if target else {}))
            return [*drawn, ("toc", (depth, False, 1, leaf, "toc"))]
        if level or num and num[0] in self.titles:
            return [*drawn, ("block", {"type": "title", "level": level or num[1] + 1, "is_numbered": bool(num and num[2] in ORDERED), "spans": inline.parse_spans(text), **anchor})]
        if num:
            return [*drawn, ("item", (num[1], num[2] in ORDERED, num[3], text_block(text, **anchor), num[0]))]
        if math and not any(t.strip() for t, _, _ in self.segments(p) if not t.startswith("<eq>")):
            return [*drawn, ("block", {"type": "interline_equation", "spans": [{"type": "interline_equation", "content": "".join(re.findall(r"<eq>(.*?)</eq>", text, re.DOTALL))}]})]
        if self.is_caption(p):
            return [*drawn, ("block", {"type": "caption", "spans": inline.parse_spans(text)})]
        return [*drawn, ("block", text_block(text, **anchor))]

    def layout_only(self, sect) -> bool:
        """Whether a section break changes no page: a continuous one, or one of no size."""
        return attr(child(sect, "type"), "val", "nextPage") == "continuous"

    def pages(self, headers: bool = False) -> list[list[dict]]:
        pages: list[list] = [[]]
        pending: list[tuple[str, tuple]] = []
        done: dict[str, dict[int, int]] = {}  # items so far of each list and level

        def flush() -> None:
            for kind, group in itertools.groupby(pending, key=lambda x: (x[0], x[1][4])):
                items = []
                for _, (depth, ordered, start, leaf, num) in group:
                    count = done.setdefault(num, {})
                    for k in [k for k in count if k > depth]:
                        del count[k]
                    items.append((depth, ordered, count.get(depth, start), leaf))
                    count[depth] = count.get(depth, start) + 1
                if kind[0] == "toc":
                    index = {"type": "index", "ilevel": 0, "blocks": []}
                    for depth, _, _, leaf in items:
                        at = index
                        for k in range(1, depth + 1):
                            if not (at["blocks"] and at["blocks"][-1]["type"] == "index"):
                                at["blocks"].append({"type": "index", "ilevel": k, "blocks": []})
                            at = at["blocks"][-1]
                        at["blocks"].append(leaf)
                    pages[-1].append(index)
                else:
                    pages[-1].append(nested(items))
            pending.clear()

        def walk(e) -> None:
            for c in e:
                n = named(c)
                if n == "p":
                    for kind, what in self.paragraph(c):
                        if kind == "block":
                            flush()
                            pages[-1].append(what)
                        else:
                            pending.append((kind, what))
                    sect = child(c, "pPr", "sectPr")
                    if sect is not None and not self.layout_only(sect):
                        flush()
                        pages.append([])
                elif n == "tbl":
                    flush()
                    pages[-1].append({"type": "table", "html": self.table(c)})
                elif n in ("sdt", "sdtContent"):
                    walk(c)

        walk(self.body)
        flush()
        pages = [with_captions(p) for p in pages]
        if headers:
            pages[0] = self.headers() + pages[0]
        return [[{**b, "index": i} for i, b in enumerate(p)] for p in pages]

    def headers(self) -> list[dict]:
        """Headers and footers of all kinds (first, odd, even), each text once; page numbers alone are left out."""
        out, main = [], self.part
        for kind in ("header", "footer"):
            texts = {}
            for part in sorted(self.p.related(main, kind)):
                self.part = part
                for x in self.p.xml(part).iter():
                    if named(x) == "p" and (t := self.marked(x)) and not re.fullmatch(r"\d+", t):
                        texts[t] = None
            self.part = main
            out += [{"type": kind, "spans": inline.parse_spans(t)} for t in sorted(texts)]
        return out


def with_captions(blocks: list[dict]) -> list[dict]:
    """Blocks whose captions stand in the table, picture or chart that they go with: the one before, captions between not counted, else the one after; other captions are texts."""
    starts = {"table": ("表", "table"), "image": ("图", "fig"), "chart": ("图", "fig", "chart")}
    plain = lambda b: "".join(s.get("content", "") for s in b.get("spans", [])).strip().lower()
    kinds = [b["type"] for b in blocks]
    for i, b in enumerate(blocks):
        if b["type"] == "text" and i and kinds[i - 1] in starts and plain(b).startswith(starts[kinds[i - 1]]):
            kinds[i] = "caption"
    owner: dict[int, int] = {}
    for i, k in enumerate(kinds):
        if k == "caption":
            back = next((j for j in range(i - 1, -1, -1) if kinds[j] != "caption"), None)
            on_ = next((j for j in range(i + 1, len(kinds)) if kinds[j] != "caption"), None)
            owner[i] = next((j for j in (back, on_) if j is not None and kinds[j] in starts), -1)
    out = []
    for i, b in enumerate(blocks):
        if i in owner:
            if owner[i] < 0:
                out.append({**b, "type": "text"})
        elif own := [{**blocks[j], "type": "text"} for j in sorted(owner) if owner[j] == i]:
            out.append({**b, "captions": own})
        else:
            out.append(b)
    return out


class Pptx:
    def __init__(self, raw: bytes):
        self.p, self.part = Package(raw), ""
        size = child(self.p.xml("ppt/presentation.xml"), "sldSz")
        self.size = (float(attr(size, "cx", "0")), float(attr(size, "cy", "0")))

    def slides(self) -> Iterator[tuple[str, ElementTree.Element]]:
        rels = self.p.relations("ppt/presentation.xml")
        listed = child(self.p.xml("ppt/presentation.xml"), "sldIdLst")
        for s in listed if listed is not None else []:
            # the id of the relationship, not that of the slide, has a namespace
            rid = next((v for k, v in s.attrib.items() if k.endswith("}id")), None)
            if rid in rels:
                yield rels[rid][0], self.p.xml(rels[rid][0])

    def shapes(self, tree, move=(1.0, 1.0, 0.0, 0.0)) -> Iterator[tuple[ElementTree.Element, tuple[float, float, float, float] | None]]:
        """Shapes in order with their boxes on the slide, groups dissolved."""
        for e in tree:
            n = named(e)
            xfrm = child(e, "spPr", "xfrm") if n != "graphicFrame" else child(e, "xfrm")
            if n == "grpSp":
                g, own = child(e, "grpSpPr", "xfrm"), move
                if g is not None:
                    num = lambda part, k: float(attr(child(g, part), k, "0"))  # noqa: B023, E731
                    if min(num("chExt", "cx"), num("chExt", "cy"), num("ext", "cx"), num("ext", "cy")) > 0:
                        sx, sy = num("ext", "cx") / num("chExt", "cx"), num("ext", "cy") / num("chExt", "cy")
                        tx, ty = num("off", "x") - num("chOff", "x") * sx, num("off", "y") - num("chOff", "y") * sy
                        own = (move[0] * sx, move[1] * sy, move[0] * tx + move[2], move[1] * ty + move[3])
                yield from self.shapes(e, own)
            elif n in ("sp", "pic", "graphicFrame"):
                box = None
                if xfrm is not None and child(xfrm, "off") is not None and child(xfrm, "ext") is not None:
                    x, y, w, h = (float(attr(child(xfrm, a), k, "0")) for a, k in (("off", "x"), ("off", "y"), ("ext", "cx"), ("ext", "cy")))
                    if w > 0 and h > 0:
                        box = (x * move[0] + move[2], y * move[1] + move[3], (x + w) * move[0] + move[2], (y + h) * move[1] + move[3])
                yield e, box

    def layers(self) -> list[ElementTree.Element]:
        """The slide's layout and its master, where they are there."""
        layout = next(iter(self.p.related(self.part, "slideLayout")), None)
        master = next(iter(self.p.related(layout, "slideMaster")), None) if layout else None
        return [self.p.xml(x) for x in (layout, master) if x]

    def inherited(self, sp, level: int) -> list[ElementTree.Element]:
        """Paragraph properties for a level that a shape takes over: from its own list style, its placeholder in the layout, and the master's styles for titles, bodies and others."""
        ph = child(sp, "nvSpPr", "nvPr", "ph")
        out = [child(sp, "txBody", "lstStyle", f"lvl{level + 1}pPr")]
        if ph is not None:
            same = lambda x: x is not None and (attr(x, "idx") == attr(ph, "idx") if attr(ph, "idx") else attr(x, "type") == attr(ph, "type"))
            for layer in self.layers():
                own = next((s for s in layer.iter() if named(s) == "sp" and same(child(s, "nvSpPr", "nvPr", "ph"))), None)
                out.append(child(own, "txBody", "lstStyle", f"lvl{level + 1}pPr"))
                bucket = "titleStyle" if attr(ph, "type") in ("title", "ctrTitle") else "bodyStyle" if attr(ph, "type") in (None, "body", "subTitle", "obj") else "otherStyle"
                out.append(child(layer, "txStyles", bucket, f"lvl{level + 1}pPr"))
        return [x for x in out if x is not None]

    @staticmethod
    def bullet(props) -> tuple[bool, bool, int | None] | None:
        """(listed, ordered, start) that paragraph properties say; null where they say nothing."""
        if props is None:
            return None
        for e in props:
            if named(e) == "buNone":
                return False, False, None
            if named(e) == "buAutoNum":
                return True, True, int(attr(e, "startAt")) if attr(e, "startAt") else None
            if named(e) in ("buChar", "buBlip"):
                return True, False, None
        return None

    def segments(self, sp, p) -> list[tuple[str, str, str | None]]:
        out: list[tuple[str, str, str | None]] = []
        yes = lambda x: x in ("1", "true")
        for r in p:
            n = named(r)
            if n in ("r", "fld"):
                props, text = child(r, "rPr"), text_of(child(r, "t"))
                base = int(attr(props, "baseline", "0") or 0)
                look = inline.Look(yes(attr(props, "b")), yes(attr(props, "i")), attr(props, "u", "none") != "none", False, attr(props, "strike", "noStrike") != "noStrike", "superscript" if base > 0 else "subscript" if base < 0 else "")
                link = child(props, "hlinkClick")
                url = self.p.relations(self.part).get(attr(link, "id") or "", (None, ""))
                out.append((text, inline.style_text(inline.look_for(look, text)), url[0] if url[1] == "hyperlink" else None))
            elif n == "br":
                out.append(("\n", "", None))
            elif n in ("m", "oMath", "oMathPara"):
                math = next((x for x in r.iter() if named(x) == "oMath"), None)
                if math is not None:
                    out.append((f"<eq>{latex.omml_to_latex(math)}</eq>", "", None))
        return out

    def marked(self, sp, p) -> str:
        return inline.rich_text(self.segments(sp, p), True)

    def font(self, sp, p, level: int) -> tuple[float | None, bool]:
        """A paragraph's size in points and whether all of its text is bold, taken over from list styles where runs say nothing."""
        runs = [r for r in p if named(r) in ("r", "fld") and text_of(child(r, "t")).strip()]
        base = [child(x, "defRPr") for x in self.inherited(sp, level)]
        get = lambda r, k: next((v for x in [child(r, "rPr"), *base] if (v := attr(x, k)) is not None), None)
        sizes = [int(s) / 100 for r in runs if (s := get(r, "sz"))]
        return max(sizes, default=None), bool(runs) and all(get(r, "b") in ("1", "true") for r in runs)

    def texts(self, sp) -> list[dict]:
        """A text shape's blocks: titles of title placeholders, lists of paragraphs in a row that have bullets, texts."""
        kind = attr(child(sp, "nvSpPr", "nvPr", "ph"), "type")
        out, items = [], []

        def flush() -> None:
            if items:
                base = items[0][0]
                for group in split_items([(max(a - base, 0), o, s, leaf) for a, o, s, leaf in items]):
                    out.append(nested(group))
            items.clear()

        for p in (x for x in (child(sp, "txBody") if child(sp, "txBody") is not None else []) if named(x) == "p"):
            text = self.marked(sp, p)
            if not text:
                continue
            props = child(p, "pPr")
            level = int(attr(props, "lvl", "0"))
            found = next((b for x in [props, *self.inherited(sp, level)] if (b := self.bullet(x)) is not None), None)
            listed, ordered, start = found if found is not None else (level > 0, False, None)
            if kind in ("title", "ctrTitle"):
                flush()
                out.append({"type": "title", "level": 2, "spans": inline.parse_spans(text)})
            elif listed:
                items.append((level, ordered, start, text_block(text)))
            else:
                flush()
                size, bold = self.font(sp, p, level)
                out.append(text_block(text, size=size, bold=bold))
        flush()
        return out

    def table(self, frame) -> str:
        rows = []
        for r in (x for x in next(x for x in frame.iter() if named(x) == "tbl") if named(x) == "tr"):
            cells = [c for c in r if named(c) == "tc" and attr(c, "hMerge") not in ("1", "true") and attr(c, "vMerge") not in ("1", "true")]
            rows.append([("<br>".join(cell_html(self.marked(frame, p)) for p in c.iter() if named(p) == "p"), int(attr(c, "gridSpan", "1")), int(attr(c, "rowSpan", "1"))) for c in cells])
        return table_html(rows, True)

    def shape_blocks(self, e) -> list[dict]:
        n = named(e)
        if n == "sp":
            return self.texts(e)
        if n == "pic":
            uri = self.p.picture(self.part, attr(child(e, "blipFill", "blip"), "embed"))
            return [{"type": "image", "image": uri}] if uri else []
        if any(named(x) == "tbl" for x in e.iter()):
            return [{"type": "table", "html": self.table(e)}]
        rid = next((attr(x, "id") for x in e.iter() if named(x) == "chart"), None)
        content = self.p.chart(self.part, rid) if rid else ""
        return [{"type": "chart", "content": content}] if content else []

    def spare(self, i: int, shapes: list) -> bool:
        """Whether a picture is small (under a tenth of the slide's width or height, or a hundredth of its area) or lies behind later texts that cover a tenth of it."""
        from sheafspark.operators.boxes import union_area

        e, box, _ = shapes[i]
        if named(e) != "pic" or not box:
            return False
        w, h, (sw, sh) = box[2] - box[0], box[3] - box[1], self.size
        if sw > 0 and sh > 0 and (w < sw / 10 or h < sh / 10 or w * h < sw * sh / 100):
            return True
        cut = [(max(b[0], box[0]), max(b[1], box[1]), min(b[2], box[2]), min(b[3], box[3])) for x, b, own in shapes[i + 1 :] if named(x) == "sp" and b and own]
        return union_area([c for c in cut if c[0] < c[2] and c[1] < c[3]]) >= 0.1 * w * h

    def notes(self) -> list[dict]:
        """A slide's notes, without its picture, number, date and footer."""
        out = []
        for part in self.p.related(self.part, "notesSlide"):
            for sp in (x for x in self.p.xml(part).iter() if named(x) == "sp"):
                if attr(child(sp, "nvSpPr", "nvPr", "ph"), "type") not in ("sldImg", "sldNum", "dt", "ftr", "hdr"):
                    text = "\n".join(t for p in sp.iter() if named(p) == "p" and (t := self.marked(sp, p)))
                    out += [{"type": "page_footnote", "spans": inline.parse_spans(text)}] if text else []
        return out

    def pages(self) -> list[list[dict]]:
        from sheafspark.operators.boxes import xy_cut

        slides = []
        for self.part, slide in self.slides():
            shapes = [(e, box, self.shape_blocks(e)) for e, box in self.shapes(child(slide, "cSld", "spTree"))]
            shapes = [s for i, s in enumerate(shapes) if s[2] and not self.spare(i, shapes)]
            placed = [s for s in shapes if s[1]]
            blocks = [b for k in xy_cut([s[1] for s in placed]) for b in placed[k][2]] + [b for s in shapes if not s[1] for b in s[2]]
            slides.append(with_captions(blocks) + self.notes())
        sizes = [b["size"] for s in slides for b in s if b.get("size")]
        body = min(set(sizes), key=lambda x: (-sizes.count(x), x)) if sizes else 0.0
        return [[{k: v for k, v in {**b, "index": i}.items() if k not in ("size", "bold")} for i, b in enumerate(promoted(s, body))] for s in slides]


def split_items(items: list[tuple[int, bool, int | None, dict]]) -> list[list[tuple[int, bool, int, dict]]]:
    """Items of one shape as lists: at its outermost level another kind, or a start that isn't the next number, begins a new list."""
    from sheafspark.operators.sequences import numbers

    got = numbers([(a, o, s) for a, o, s, _ in items])
    top = min(a for a, *_ in items)
    out: list[list] = []
    last = None
    for (a, o, s, leaf), (no, n) in zip(items, got, strict=True):
        if not out or a == top and no != last:
            out.append([])
        last = no if a == top else last
        out[-1].append((a, o, n or 1, leaf))
    return out


def promoted(blocks: list[dict], body: float) -> list[dict]:
    """A slide's blocks with bold texts that stand out as titles: the single largest, 4 points over the body and 2 over the next, at level 2; the next size, 2 points over the body and clear of both, at level 3."""
    sizes = sorted({b["size"] for b in blocks if b.get("bold") and b.get("size")}, reverse=True)
    count = lambda x: sum(b.get("bold") is True and b.get("size") == x for b in blocks)
    level = {}
    if sizes and any(b["type"] == "title" for b in blocks) is False and count(sizes[0]) == 1 and sizes[0] >= body + 4 and (len(sizes) == 1 or sizes[0] - sizes[1] >= 2):
        level[sizes[0]] = 2
    if len(sizes) > 1 and sizes[1] >= body + 2 and sizes[0] - sizes[1] >= 2 and (len(sizes) == 2 or sizes[1] - sizes[2] >= 2):
        level[sizes[1]] = 3
    return [{**b, "type": "title", "level": level[b["size"]]} if b["type"] == "text" and b.get("bold") and b.get("size") in level else b for b in blocks]


class Xlsx:
    def __init__(self, raw: bytes):
        self.p = Package(raw)
        strings = self.p.xml("xl/sharedStrings.xml")
        self.strings = [self.rich(s) for s in strings if named(s) == "si"] if strings is not None else []
        book = self.p.xml("xl/workbook.xml")
        self.date_1904 = attr(child(book, "workbookPr"), "date1904") in ("1", "true")
        self.listed = [(attr(s, "name"), attr(s, "state", "visible") == "visible", self.p.relations("xl/workbook.xml")[attr(s, "id")][0]) for s in (child(book, "sheets") if child(book, "sheets") is not None else []) if attr(s, "id") in self.p.relations("xl/workbook.xml")]
        self.read_styles()

    def read_styles(self) -> None:
        root = self.p.xml("xl/styles.xml")
        own = {attr(f, "numFmtId"): attr(f, "formatCode", "") for f in root.iter() if named(f) == "numFmt"} if root is not None else {}
        dated = lambda i: 14 <= int(i) <= 22 or 45 <= int(i) <= 47 or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(i, "")).lower()))
        fonts = [self.font(f) for f in child(root, "fonts")] if child(root, "fonts") is not None else []
        xfs = list(child(root, "cellXfs")) if child(root, "cellXfs") is not None else []
        self.dates = [dated(attr(x, "numFmtId", "0")) for x in xfs]
        self.fonts = [fonts[k] if (k := int(attr(x, "fontId", "0"))) < len(fonts) else "" for x in xfs]

    @staticmethod
    def font(e) -> str:
        """A font's styles. A blank underline is a single one."""
        flag = lambda n: attr(child(e, n), "val", "1") not in ("0", "false", "none") if child(e, n) is not None else False
        return inline.style_text(inline.Look(flag("b"), flag("i"), flag("u"), False, flag("strike"), {"superscript": "superscript", "subscript": "subscript"}.get(attr(child(e, "vertAlign"), "val", ""), "")))

    def rich(self, s) -> tuple[str, str]:
        """A string's text and, where its runs have styles, its marked text."""
        runs = [(text_of(child(r, "t")), self.font(child(r, "rPr")) if child(r, "rPr") is not None else "", None) for r in s if named(r) == "r"]
        text = "".join(t for t, _, _ in runs) if runs else "".join(t.text or "" for t in s if named(t) == "t")
        return text, inline.rich_text(runs) if any(x for _, x, _ in runs) else ""

    def value(self, c) -> tuple[object, str]:
        """A cell's value and, of rich text, its marked text."""
        kind, v = attr(c, "t", "n"), child(c, "v")
        if kind == "inlineStr":
            return self.rich(child(c, "is")) if child(c, "is") is not None else ("", "")
        if v is None or v.text is None:
            return "", ""
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return ("TRUE" if v.text == "1" else "FALSE"), ""
        if kind == "n":
            x, style = float(v.text), int(attr(c, "s", "0"))
            if style < len(self.dates) and self.dates[style]:
                return serial_iso(x, self.date_1904), ""
            return (int(x) if x.is_integer() else x), ""
        return v.text, ""

    def sheet(self, part: str, max_rows: int | None = None) -> dict:
        """cells {(row, col): text}, marked {(row, col): marked text}, merges, links and formulas of a sheet."""
        root, rels = self.p.xml(part), self.p.relations(part)
        cells, marked, merges, links = {}, {}, [], {}
        for e in root.iter():
            n = named(e)
            if n == "c":
                at = position(attr(e, "r"))
                value, rich = self.value(e)
                text = str(value) if not isinstance(value, float) else repr(value)
                if text != "" and (max_rows is None or at[0] <= max_rows):
                    cells[at] = text
                    style = int(attr(e, "s", "0"))
                    marked[at] = rich or inline.tagged(text, self.fonts[style] if style < len(self.fonts) else "")
            elif n == "mergeCell":
                a, _, b = attr(e, "ref").partition(":")
                merges.append((*position(a), *position(b or a)))
            elif n == "hyperlink":
                a, _, b = attr(e, "ref").partition(":")
                target = rels.get(attr(e, "id") or "", (None,))[0] or (f"#{attr(e, 'location')}" if attr(e, "location") else None)
                (r1, c1), (r2, c2) = position(a), position(b or a)
                for at in [k for k in cells if r1 <= k[0] <= r2 and c1 <= k[1] <= c2] if target else []:
                    links[at] = target
        return {"cells": cells, "marked": marked, "merges": merges, "links": links}

    def drawings(self, part: str) -> list[tuple[tuple[int, int] | None, str, str]]:
        """(anchor cell, kind, content) of a sheet's pictures, charts and formulas."""
        out = []
        for drawing in self.p.related(part, "drawing"):
            root = self.p.xml(drawing)
            for a in root if root is not None else []:
                start = child(a, "from")
                at = (int(text_of(child(start, "row"))) + 1, int(text_of(child(start, "col"))) + 1) if start is not None else None
                for e in a.iter():
                    if named(e) == "blip" and (uri := self.p.picture(drawing, attr(e, "embed"))):
                        out.append((at, "image", uri))
                    elif named(e) == "chart" and attr(e, "id"):
                        target = self.p.relations(drawing).get(attr(e, "id"), ("",))[0]
                        raw = self.p.bytes(target)
                        if raw and (content := charts.chart_html(raw, self.vector)):
                            out.append((at, "chart", content))
                    elif named(e) == "oMath":
                        out.append((at, "formula", latex.omml_to_latex(e)))
        return out

    def vector(self, sheet: str, top: int, left: int, bottom: int, right: int) -> list | None:
        part = next((p for n, _, p in self.listed if n == sheet), None)
        if part is None:
            return None
        values = {position(attr(c, "r")): self.value(c)[0] for c in self.p.xml(part).iter() if named(c) == "c"}
        return [values.get((r, c), "") for r in range(top, bottom + 1) for c in range(left, right + 1)]

    def grids(self) -> list[list[list[str]]]:
        """The sheets' texts as rows, up to their last cells."""
        out = []
        for _, _, part in self.listed:
            cells = self.sheet(part)["cells"]
            rows, cols = max((r for r, _ in cells), default=0), max((c for _, c in cells), default=0)
            out.append([[cells.get((r, c), "") for c in range(1, cols + 1)] for r in range(1, rows + 1)])
        return out

    def pages(self, max_rows: int | None = None, gap: int | None = None, hidden: bool = False) -> list[tuple[str, int, list[dict]]]:
        """(name, number, blocks) of each visible sheet with content: its name as a title, then tables and charts by their places, then pictures that no table holds."""
        out = []
        for i, (name, shown, part) in enumerate(self.listed):
            if shown or hidden:
                body = self.sheet_blocks(part, max_rows, gap)
                if body:
                    blocks = [{"type": "title", "level": 2, "spans": [{"type": "text", "content": name}]}, *body]
                    out.append((name, i, [{**b, "index": k} for k, b in enumerate(blocks)]))
        return out

    def sheet_blocks(self, part: str, max_rows: int | None, gap: int | None) -> list[dict]:
        from sheafspark.operators.cells import best_gap, table_bounds

        s = self.sheet(part, max_rows)
        drawn = self.drawings(part)
        media: dict[tuple[int, int], list[str]] = {}
        for at, kind, content in drawn:
            if at and kind != "chart":
                media.setdefault(at, []).append(f'<img src="{content}">' if kind == "image" else f"<eq>{html.escape(content, quote=False)}</eq>")
        span = {(a, b): (x - a + 1, y - b + 1) for a, b, x, y in s["merges"]}
        anchors = sorted({*s["cells"], *media})
        # a merge counts by its corners and, along its edges, no more often than tables could step over
        filled = set(anchors)
        for a, b, x, y in s["merges"]:
            if (a, b) in s["cells"] or (a, b) in media:
                x, y = min(x, max((r for r, _ in anchors), default=a) + 1), min(y, max((c for _, c in anchors), default=b) + 1)
                span[a, b] = (x - a + 1, y - b + 1)
                filled |= {(r, c) for r in range(a, x + 1) for c in (b, y)} | {(r, c) for r in (a, x) for c in range(b, y + 1)}
        boxes = table_bounds(filled, gap) if gap is not None else best_gap(filled)[1] if filled else []
        placed, used = [], set()
        merges = sorted((a, b, a + h - 1, b + w - 1) for (a, b), (h, w) in span.items())
        covered = lambda r, c: any(a <= r <= x and b <= c <= y and (r, c) != (a, b) for a, b, x, y in merges)
        for top, left, bottom, right in boxes:
            inside = [k for k in anchors if top <= k[0] <= bottom and left <= k[1] <= right]
            used.update(inside)
            cell = lambda at: self.cell(at, s) + "".join(media.get(at, []))
            if len(inside) == 1 and (top, left) == (bottom, right) and inside[0] not in media:
                placed.append(((top, left, 0), text_block(s["marked"][inside[0]])))
                continue
            rows = [[(cell((r, c)), span.get((r, c), (1, 1))[1], span.get((r, c), (1, 1))[0]) for c in range(left, right + 1) if not covered(r, c)] for r in range(top, bottom + 1)]
            placed.append(((top, left, 0), {"type": "table", "html": table_html(rows, True)}))
        placed += [((*(at or (1 << 30, 1 << 30)), 1), {"type": "chart", "content": c}) for at, kind, c in drawn if kind == "chart"]
        loose = [{"type": "image", "image": c} for at, kind, c in drawn if kind == "image" and (at is None or at not in used)]
        return [b for _, b in sorted(placed, key=lambda x: x[0])] + loose

    @staticmethod
    def cell(at: tuple[int, int], s: dict) -> str:
        text = cell_html(s["marked"].get(at, ""))
        url = s["links"].get(at)
        return f'<a href="{html.escape(url)}">{text}</a>' if url and text and safe(url) else text


def serial_iso(x: float, date_1904: bool = False) -> str:
    """A serial as ISO text, with a T before the time; a time alone for a day before the first."""
    got = charts.serial_date(x, date_1904)
    return str(x) if got is None else got.replace(" ", "T")


def position(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref)
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def letters(col: int) -> str:
    out = ""
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out
