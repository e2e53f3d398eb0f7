"""The second set of office writers: flat Markdown without blocks, chosen by name (register_reader)."""

from __future__ import annotations

import itertools
import re
from collections import Counter

from sheafspark.functions import charts, latex
from sheafspark.functions.xml import attr, child, named, parse_xml, text_of
from sheafspark.sources import office

#: Fonts of code, and numbers that Chinese headings of the second and third level begin with.
CODE_FONTS = frozenset(["Courier New", "Courier", "Consolas", "Monaco", "Menlo", "Source Code Pro", "Fira Code", "DejaVu Sans Mono", "monospace"])
SECOND, THIRD = re.compile("[一二三四五六七八九十百千]+[、．.]"), re.compile("（[一二三四五六七八九十百千]+）")
#: Fixed value: the size of body text where a document says none.
BODY_SIZE = 16.0


def with_url(text: str, url: str | None) -> str:
    return f"[{text}]({url.replace('(', '%28').replace(')', '%29')})" if url else text


def wrapped(text: str, names: set[str]) -> str:
    """A run with its marks from the inside out: strike, bold and italic, underline, script; blanks at its ends stay outside, and underlined blanks keep their width."""
    core = text.strip()
    if not core:
        return f"<u>{chr(0xA0) * len(text)}</u>" if text and "underline" in names else text
    at, inner = text.index(core), core
    if "strikethrough" in names:
        inner = f"~~{inner}~~"
    mark = "**" * ("bold" in names) + "*" * ("italic" in names)
    inner = mark + inner + mark
    for name, tag in (("underline", "u"), ("superscript", "sup"), ("subscript", "sub")):
        if name in names and not (name == "subscript" and "superscript" in names):
            inner = f"<{tag}>{inner}</{tag}>"
    return text[:at] + inner + text[at + len(core) :]


def merged(items: list[tuple[str, str, str | None]]) -> list[tuple[str, set[str], str | None]]:
    """Neighbouring runs of one look and target as one."""
    return [("".join(t for t, _, _ in g), set(s.split(",")) - {""}, u) for (s, u), g in itertools.groupby([x for x in items if x[0]], key=lambda x: (x[1], x[2]))]


def runs_markdown(items: list[tuple[str, str, str | None]]) -> str:
    """Runs as Markdown; a zero-width space keeps marks that close apart from a letter or digit after them."""
    out = ""
    for text, names, url in merged(items):
        part = with_url(wrapped(text, names), url)
        out += ("​" if out.endswith(("*", "~~")) and part[:1].isalnum() else "") + part
    return out


def runs_html(items: list[tuple[str, str, str | None]]) -> str:
    out = ""
    for text, names, url in merged(items):
        for name, tag in (("bold", "b"), ("italic", "i"), ("underline", "u"), ("strikethrough", "del"), ("superscript", "sup"), ("subscript", "sub")):
            text = f"<{tag}>{text}</{tag}>" if name in names else text
        out += f'<a href="{url}">{text}</a>' if url else text
    return out


def maths(items: list[tuple[str, str, str | None]]) -> list[tuple[str, str, str | None]]:
    return [(f"${t[4:-5]}$", "", None) if t.startswith("<eq>") else (t, s, u) for t, s, u in items]


def toc_markdown(entries: list[tuple[str, str | None, int]]) -> str:
    """(text, anchor, level) entries as a list, two blanks a level below the first."""
    return "\n".join("  " * (level - 1) + (f"- [{text}](#{anchor})" if anchor else f"- {text}") for text, anchor, level in entries)


def chart_html(raw: bytes) -> str:
    """A chart's cached points: series go by the value axis' title before their own names, dates by the number format, categories as they come, values by their indexes; with a caption, and a head only where there is something to say."""
    chart = charts.parse(raw)
    if chart is None or not chart.series:
        return ""
    root = parse_xml(raw)
    code = next((text_of(e) for e in root.iter() if named(e) == "formatCode"), "")
    first = next((e for e in root.iter() if named(e) == "cat"), None)
    cats = [text_of(child(p, "v")) for p in (first.iter() if first is not None else []) if named(p) == "pt"]
    if first is not None and child(first, "numRef") is not None and re.search("[ymd]", code.lower()):
        cats = [(charts.serial_date(float(c)) or c)[:10] if re.fullmatch(r"[\d.]+", c) else c for c in cats]
    names = [chart.value_axis or s.literal or "" for s in chart.series]
    values = [s.y.cached for s in chart.series]
    n = max(len(cats), *map(len, values))
    head = f"<thead><tr><th>{chart.axis}</th>{''.join(f'<th>{x}</th>' for x in names)}</tr></thead>" if chart.axis or any(names) else ""
    get = lambda x, i: x[i] if i < len(x) else ""
    rows = "".join(f"<tr><td>{get(cats, i)}</td>{''.join(f'<td>{get(v, i)}</td>' for v in values)}</tr>" for i in range(n))
    return f"<table>{f'<caption>{chart.title}</caption>' if chart.title else ''}{head}<tbody>{rows}</tbody></table>"


class FlatDocx(office.Docx):
    def size(self, p) -> float | None:
        """Points of the first run that says a size."""
        return next((int(s) / 2 for r in p.iter() if named(r) == "r" and (s := attr(child(r, "rPr", "sz"), "val"))), None)

    def text(self, p) -> str:
        return runs_markdown(maths(self.segments(p))).strip()

    def body_size(self) -> float:
        sizes = Counter(s for p in self.body if named(p) == "p" and self.text(p) and (s := self.size(p)))
        return sizes.most_common(1)[0][0] if sizes else BODY_SIZE

    def heading(self, p, body: float) -> int:
        """A heading's level by style name, by a size of over one and a half times the body's (centred, or short), or by a Chinese number; 0 for others."""
        name, text = next(iter(self.style_names(p)), "").lower(), self.text(p)
        if m := re.match(r"heading\s*(\d*)", name):
            return int(m[1] or 1)
        if name in ("title", "subtitle"):
            return 1 if name == "title" else 2
        size = self.size(p)
        if text and size and size > body * 1.5:
            if attr(child(p, "pPr", "jc"), "val") == "center":
                return 1
            if len(text) <= 60:
                return 2
        return 2 if SECOND.match(text) else 3 if THIRD.match(text) else 0

    def is_code(self, p) -> bool:
        fonts = [attr(child(r, "rPr", "rFonts"), "ascii") for r in p.iter() if named(r) == "r" and any(t.text and t.text.strip() for t in r if named(t) == "t")]
        return any(fonts) and all(f in CODE_FONTS for f in fonts if f)

    def table(self, t) -> str:
        own = super().table(t)
        return re.sub(r"<eq>(.*?)</eq>", r"$\1$", own, flags=re.DOTALL)

    def markdown(self, headers: bool = False) -> str:
        body, out, code, toc, count = self.body_size(), [], [], [], {}

        def flush() -> None:
            if code:
                out.append("```\n" + "\n".join(code) + "\n```")
            if toc:
                out.append(toc_markdown(toc))
            code.clear()
            toc.clear()

        def flat(e):
            for c in e:
                yield from flat(child(c, "sdtContent")) if named(c) == "sdt" and child(c, "sdtContent") is not None else [c]

        for c in flat(self.body):
            if named(c) == "tbl":
                flush()
                out.append(self.table(c))
            if named(c) != "p":
                continue
            text, depth, num = self.text(c), self.toc_level(c), self.numbered(c)
            if depth is not None:
                if text:
                    target = next((a for e in c.iter() if named(e) == "hyperlink" and (a := attr(e, "anchor"))), None)
                    toc.append((re.sub(r"\[(.*)\]\(#.*\)", r"\1", text).rpartition("\t")[0] or text, target, depth + 1))
                continue
            if text and self.is_code(c):
                code.append("".join(t for t, _, _ in self.segments(c)))
                continue
            flush()
            for d in self.drawings(c):
                if d["type"] == "text":
                    out.append("".join(s["content"] for s in d["spans"]))
                elif d["type"] == "image":
                    out.append(f"![]({d['image']})")
            for e in c.iter():
                if named(e) == "chart" and attr(e, "id") and (raw := self.p.bytes(self.p.relations(self.part).get(attr(e, "id"), ("",))[0])):
                    out.append(chart_html(raw))
            level = self.heading(c, body)
            if level and text:
                anchors = [n for e in c.iter() if named(e) == "bookmarkStart" and (n := attr(e, "name", "")).startswith("_Toc")]
                out.append("".join(f'<a id="{a}"></a>' for a in anchors) + "#" * min(level, 6) + " " + text)
            elif num and text:
                key = num[:2]
                for k in [k for k in count if k[0] == num[0] and k[1] > num[1]]:
                    del count[k]
                count[key] = count.get(key, num[3] - 1) + 1
                line = "    " * num[1] + (f"{count[key]}. " if num[2] in office.ORDERED else "- ") + text
                if out and re.match(r"\s*(\d+\.|-) ", out[-1].rpartition("\n")[2]):
                    out[-1] += "\n" + line
                else:
                    out.append(line)
            elif text:
                out.append(text)
        flush()
        lead = ["".join(s["content"] for s in b["spans"]) for b in self.headers()] if headers else []
        return "\n\n".join(x for x in [*lead, *out] if x)


class FlatPptx(office.Pptx):
    def lines(self, sp) -> list[str]:
        title = attr(child(sp, "nvSpPr", "nvPr", "ph"), "type") in ("title", "ctrTitle")
        out = []
        for p in (x for x in (child(sp, "txBody") if child(sp, "txBody") is not None else []) if named(x) == "p"):
            text = runs_markdown(maths(self.segments(sp, p))).strip()
            level = int(attr(child(p, "pPr"), "lvl", "0"))
            found = next((b for x in [child(p, "pPr"), *self.inherited(sp, level)] if (b := self.bullet(x)) is not None), (level > 0, False, None))
            if text:
                out.append(f"## {text}" if title else "  " * level + f"- {text}" if found[0] else text)
        return out

    @staticmethod
    def kind(part: str) -> str:
        own = part.lstrip()
        return next((k for k, start in (("heading", "##"), ("html", "<"), ("list", "- "), ("quote", ">")) if own.startswith(start)), "other")

    def slide_parts(self, slide) -> list[str]:
        parts = []
        for e, _ in self.shapes(child(slide, "cSld", "spTree")):
            if named(e) == "sp":
                parts += self.lines(e)
                continue
            for b in self.shape_blocks(e):
                parts.append(b.get("html") or (f"![]({b['image']})" if "image" in b else b.get("content", "")))
        for e in slide.iter():
            if named(e) == "oMathPara":
                parts.append(f"$$\n{latex.omml_to_latex(next(x for x in e.iter() if named(x) == 'oMath'))}\n$$")
        notes = "\n".join("".join(s["content"] for s in b["spans"]) for b in self.notes())
        return [p for p in parts if p] + ([f"> **Notes**: {notes}"] if notes else [])

    def slides_markdown(self) -> list[str]:
        """Each slide: parts in the order of its shapes, those of a kind in a row together, an empty line between groups; notes as a quote."""
        out = []
        for self.part, slide in self.slides():
            out.append("\n\n".join("\n".join(g) for _, g in itertools.groupby(self.slide_parts(slide), key=self.kind)))
        return out


class FlatXlsx(office.Xlsx):
    def used(self, s: dict, anchors: list[tuple[int, int]], max_rows: int | None) -> tuple[int, int, int, int] | None:
        """The range that cells, merges and pictures use, rows up to max_rows."""
        most = max_rows or 1 << 30
        boxes = [(r, c, r, c) for r, c in [*s["cells"], *anchors] if r <= most] + [(a, b, min(x, most), y) for a, b, x, y in s["merges"] if a <= most]
        return (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else None

    def sheets_html(self, max_rows: int | None = None) -> list[tuple[str, str]]:
        """(name, table) of each visible sheet: its used range as one table; rows that only a merge reaches are not spelt out."""
        out = []
        for name, shown, part in self.listed:
            s = self.sheet(part, max_rows)
            drawn = [(at, c) for at, k, c in self.drawings(part) if k == "image" and at]
            box = self.used(s, [at for at, _ in drawn], max_rows)
            if not shown or box is None:
                continue
            low, high = box[0], max([r for r, _ in s["cells"]] + [at[0] for at, _ in drawn] + [a for a, *_ in s["merges"] if a <= (max_rows or 1 << 30)])
            merges = [(a, b, min(x, high), min(y, box[3])) for a, b, x, y in s["merges"]]
            span = {(a, b): (y - b + 1, x - a + 1) for a, b, x, y in merges}
            hidden = lambda r, c: any(a <= r <= x and b <= c <= y and (r, c) != (a, b) for a, b, x, y in merges)  # noqa: B023, E731
            media = {at: f'<img src="{c}">' for at, c in drawn}
            rows = [[(self.cell((r, c), s) + media.get((r, c), ""), *span.get((r, c), (1, 1))) for c in range(box[1], box[3] + 1) if not hidden(r, c)] for r in range(low, high + 1)]
            out.append((name, office.table_html(rows)))
        return out


def read_docx(raw: bytes, headers: bool = False) -> list[dict]:
    return [{"content": FlatDocx(raw).markdown(headers)}]


def read_pptx(raw: bytes) -> list[dict]:
    return [{"content": x, "slide_idx": str(i)} for i, x in enumerate(FlatPptx(raw).slides_markdown(), 1)]


def read_xlsx(raw: bytes, max_rows: int | None = None) -> list[dict]:
    return [{"content": x, "sheet_name": n} for n, x in FlatXlsx(raw).sheets_html(max_rows)]


READERS = {"docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx, "xlsm": read_xlsx}
