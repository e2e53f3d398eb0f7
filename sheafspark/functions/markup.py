"""HTML to Markdown by a small tree builder over the standard library's tokenizer.

Elements end with their end tag or with what encloses them; nothing is closed for
being out of place. Block elements stand apart by one empty line, headings are
written with #, lists with - or numbers, tables as pipe tables, code fenced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import quote, unquote, urlsplit, urlunsplit

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body div dl dd dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header html hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def tree(source: str) -> Node:
    builder = _Builder()
    builder.feed(source)
    builder.close()
    return builder.root


def find(node: Node, tag: str) -> Node | None:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag == tag:
            return n
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return None


def text_of(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag not in ("script", "style"):
            todo += reversed(n.children)
    return "".join(out)


@dataclass(frozen=True)
class Options:
    keep_data_uris: bool = True
    checkboxes: bool = False


def quote_url(url: str) -> str | None:
    """url with its path quoted anew; None where its scheme isn't http, https, file or none."""
    try:
        p = urlsplit(url)
    except ValueError:
        return None
    if p.scheme and p.scheme.lower() not in ("http", "https", "file"):
        return None
    return urlunsplit(p._replace(path=quote(unquote(p.path))))


class Writer:
    def __init__(self, options: Options = Options()):
        self.o = options

    def inline(self, node: Node, pre: bool = False) -> str:
        out = []
        for c in node.children:
            if isinstance(c, str):
                out.append(c if pre else re.sub(r"\s+", " ", c))
            else:
                out.append(self.element(c, True, pre))
        return "".join(out)

    def wrap(self, inner: str, mark: str) -> str:
        core = inner.strip()
        if not core:
            return inner
        a = len(inner) - len(inner.lstrip())
        return inner[:a] + mark + core + mark + inner[a + len(core) :]

    def anchor(self, node: Node, pre: bool) -> str:
        inner = self.inline(node, pre)
        if not inner.strip():
            return ""
        if pre:
            return inner
        href, title = node.attrs.get("href", ""), node.attrs.get("title")
        if href:
            href = quote_url(href)
            if href is None:
                return inner
        if not href:
            return inner
        core = inner.strip()
        if core.replace("\\_", "_") == href and not title:
            return f"<{href}>"
        return inner[: len(inner) - len(inner.lstrip())] + f"[{core}]({href}" + (f' "{title}"' if title else "") + ")" + inner[len(inner.rstrip()) :]

    def image(self, node: Node, inline: bool) -> str:
        alt = node.attrs.get("alt", "").replace("\n", " ")
        src = node.attrs.get("src") or node.attrs.get("data-src") or ""
        title = node.attrs.get("title")
        if src.startswith("data:") and not self.o.keep_data_uris:
            src = src.split(",")[0] + "..."
        return f"![{alt}]({src}" + (f' "{title}"' if title else "") + ")"

    def element(self, node: Node, inline: bool, pre: bool = False) -> str:
        tag = node.tag
        if tag in ("script", "style", "head", "template"):
            return ""
        if tag == "br":
            return "\n" if pre else "  \n"
        if tag == "img":
            return self.image(node, inline)
        if tag == "a":
            return self.anchor(node, pre)
        if tag in ("b", "strong"):
            return self.flow(node, pre, lambda s: self.wrap(s, "**"))
        if tag in ("i", "em"):
            return self.flow(node, pre, lambda s: self.wrap(s, "*"))
        if tag in ("s", "del", "strike"):
            return self.flow(node, pre, lambda s: self.wrap(s, "~~"))
        if tag in ("code", "kbd", "samp") and not pre:
            return self.wrap(self.inline(node, True), "`")
        if tag == "input":
            if self.o.checkboxes and node.attrs.get("type") == "checkbox":
                return "[x] " if "checked" in node.attrs else "[ ] "
            return ""
        if tag in BLOCK:
            return "\n\n" + self.block(node) + "\n\n"
        return self.flow(node, pre, lambda s: s)

    def flow(self, node: Node, pre: bool, mark) -> str:
        """An inline element; where one left open holds blocks, only its text before them is marked."""
        for i, c in enumerate(node.children):
            if isinstance(c, Node) and self.holds_block(c):
                before, after = Node("", {}, node.children[:i]), Node("", {}, node.children[i:])
                return mark(self.inline(before, pre)) + self.inline(after, pre)
        return mark(self.inline(node, pre))

    def holds_block(self, node: Node) -> bool:
        todo = [node]
        while todo:
            n = todo.pop()
            if n.tag in BLOCK:
                return True
            todo += [c for c in n.children if isinstance(c, Node)]
        return False

    def block(self, node: Node) -> str:
        tag = node.tag
        if re.fullmatch("h[1-6]", tag):
            body = re.sub(r"\s+", " ", self.inline(node)).strip()
            return f"{'#' * int(tag[1])} {body}" if body else ""
        if tag == "hr":
            return "---"
        if tag == "pre":
            return "```\n" + self.inline(node, True).strip("\n") + "\n```"
        if tag == "blockquote":
            return "\n".join("> " + x if x else ">" for x in self.tidy(self.inline(node)).split("\n"))
        if tag in ("ul", "ol"):
            return self.list(node)
        if tag == "table":
            return self.table(node)
        return self.tidy(self.inline(node))

    def tidy(self, text: str) -> str:
        text = re.sub(r"[ \t]*\n[ \t]*(?=\n)", "\n", text)
        return re.sub(r"\n{3,}", "\n\n", text).strip()

    def list(self, node: Node) -> str:
        try:
            number = int(node.attrs.get("start", "1"))
        except ValueError:
            number = 1
        out = []
        for c in node.children:
            if not isinstance(c, Node):
                continue
            body = self.tidy(self.inline(c) if c.tag == "li" else self.element(c, False))
            if not body:
                continue
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            out.append(mark + re.sub(r"\n+", "\n" + " " * len(mark), body))
        return "\n".join(out)

    def table(self, node: Node) -> str:
        rows, todo = [], [node]
        while todo:
            n = todo.pop(0)
            if n.tag == "tr":
                rows.append([re.sub(r"\s+", " ", self.inline(c)).strip().replace("|", "\\|") for c in n.children if isinstance(c, Node) and c.tag in ("td", "th")])
            else:
                todo = [c for c in n.children if isinstance(c, Node)] + todo
        rows = [r for r in rows if r]
        if not rows:
            return ""
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        line = lambda r: "| " + " | ".join(r) + " |"
        return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])

    def document(self, root: Node) -> str:
        return self.tidy(self.inline(root))


def to_markdown(source: str | None, options: Options = Options()) -> str:
    """The body (or all of it, without one) as Markdown, newline runs made one."""
    if not source:
        return ""
    root = tree(source)
    try:
        out = Writer(options).document(find(root, "body") or root)
    except RecursionError:  # nested beyond reason: its text alone
        out = text_of(root)
    return re.sub(r"\n{2,}", "\n", out).strip()


def title_of(source: str | None) -> str | None:
    node = find(tree(source), "title") if source else None
    return text_of(node).strip() if node else None
