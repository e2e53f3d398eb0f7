"""Block trees of a page as Markdown and content lists.

A block is a dict: type, spans (see functions.inline), level, anchor, is_numbered and section_number of titles; blocks,
ilevel, attribute (ordered or unordered) and start of lists and indexes; html, image or content and captions (text
blocks) of tables, images and charts.
"""

from __future__ import annotations

import re

from sheafspark.functions import inline
from sheafspark.functions.inline import paragraph

DISCARDED = {"header": "page_header", "footer": "page_footer", "page_footnote": "page_footnote"}
INDENT = "    "


def anchor_of(block: dict) -> str:
    return str(block.get("anchor") or "").strip()


def embedded(source: str, prefix: str = "") -> str:
    """HTML of a table or chart with the pictures' folder before their sources, and formulas between dollar signs."""
    if prefix:
        source = re.sub(r'src="(?!data:)([^"]+)"', lambda m: f'src="{prefix}/{m[1]}"', source or "")
    return re.sub(r"<eq>(.*?)</eq>", lambda m: f" {inline.INLINE[0]}{m[1]}{inline.INLINE[1]} ", source or "", flags=re.DOTALL)


def leaves(block: dict, root: int | None = None, number_leaves: bool = True):
    """(leaf, level under the root, its number or None) of a list's items, depth first."""
    own = int(block.get("ilevel") or 0)
    root = own if root is None else root
    n = int(block.get("start") or 1)
    for child in block.get("blocks", []):
        if child["type"] in ("list", "index"):
            yield from leaves(child, root)
        else:
            text = bool(paragraph(child, False).strip())
            ordered = block.get("attribute") == "ordered"
            yield child, max(own - root, 0), n if ordered else None
            n += text and ordered


def list_items(block: dict) -> list[str]:
    return [f"{INDENT * level}{'-' if n is None else f'{n}.'} {text}" for leaf, level, n in leaves(block) if (text := paragraph(leaf, False)).strip()]


def page_token(text: str) -> bool:
    """Whether a text is a page number: digits, roman numerals or a letter."""
    return len(text.strip()) <= 12 and re.fullmatch(r"\d+|[ivxlcdmIVXLCDM]+|[A-Za-z]", text.strip()) is not None


def without_page(spans: list[dict]) -> list[dict]:
    """An index entry's spans without the tab and page number at its end; other tabs are blanks."""
    tabbed = [i for i, s in enumerate(spans) if s.get("type") != "inline_equation" and "\t" in s.get("content", "")]
    out = []
    for i, s in enumerate(spans):
        text = s.get("content", "")
        if s.get("type") != "inline_equation":
            head, _, tail = text.rpartition("\t")
            text = (head if tabbed and i == tabbed[-1] and page_token(tail) else text).replace("\t", " ")
        out.append({**s, "content": text})
    return out


def uniform_style(spans: list[dict]) -> list[str] | None:
    """The style that all spans but formulas have; null for none or several."""
    seen = {tuple(s.get("style") or ()) for s in spans if s.get("content") and s.get("type") != "inline_equation"}
    return list(*seen) or None if len(seen) == 1 else None


def index_leaf(leaf: dict, indent: str) -> str | None:
    spans = without_page(leaf.get("spans", []))
    syntax, style = inline.syntax_of(leaf.get("spans", [])), uniform_style(spans)
    formula = lambda s: f"{inline.INLINE[0]}{s['content']}{inline.INLINE[1]}"
    own = [s for s in spans if s.get("content")]
    if style:
        text = inline.styled("".join(formula(s) if s["type"] == "inline_equation" else inline.escaped(s["content"], syntax) for s in own).strip(), style, syntax)
    else:
        parts = [p for s in own for p in ([inline.Part(s["type"], formula(s))] if s["type"] == "inline_equation" else inline.link_part(s, syntax, True) if s["type"] == "hyperlink" else inline.text_parts(s["content"], s.get("style"), syntax))]
        text = inline.joined(parts).strip()
    if not text:
        return None
    return f"{indent}- {inline.linked(text, '#' + anchor_of(leaf), syntax) if anchor_of(leaf) else text}"


def index_items(block: dict) -> list[str]:
    out = []
    for child in block.get("blocks", []):
        if child["type"] == "index":
            out += index_items(child)
        elif child["type"] == "text" and (line := index_leaf(child, INDENT * int(block.get("ilevel") or 0))):
            out.append(line)
    return out


def captions(block: dict) -> list[str]:
    return [paragraph(c) for c in block.get("captions", [])]


def body_data(block: dict) -> tuple[str, str]:
    """A block's picture and its content: a table's HTML, a chart's, a formula's or a text's."""
    kind = block["type"]
    if kind in ("image", "table", "chart"):
        return block.get("image") or "", {"table": block.get("html"), "chart": block.get("content")}.get(kind) or ""
    first = next(iter(block.get("spans", [])), {})
    return "", first.get("content", "") if first.get("type") in ("text", "interline_equation") else ""


def markdown(block: dict, mode: str = "mm_markdown", prefix: str = "") -> str:
    """One block as Markdown; nlp_markdown leaves pictures, tables and charts out (empty)."""
    kind, anchor = block["type"], anchor_of(block)
    if kind in ("text", "interline_equation"):
        mark = f'<a id="{anchor}"></a>\n' if kind == "text" and anchor.startswith("_Toc") else ""
        return (mark + paragraph(block)).strip() if not mark else mark + paragraph(block)
    if kind == "title":
        return (f'<a id="{anchor}"></a>\n' if anchor else "") + "#" * int(block.get("level") or 2) + " " + paragraph(block)
    if kind == "list":
        return "\n".join(list_items(block))
    if kind == "index":
        return "\n".join(index_items(block))
    if kind not in ("image", "table", "chart") or mode == "nlp_markdown":
        return ""
    picture, body = body_data(block)
    text = {"image": f"![]({picture})" if picture else "", "table": embedded(body, prefix), "chart": embedded(body, prefix) or (f"![]({picture})" if picture else "")}[kind]
    return (text + "".join("  \n" + c for c in captions(block))).strip()


def page_markdown(blocks: list[dict], mode: str = "mm_markdown", prefix: str = "") -> str:
    return "\n\n".join(x for b in blocks if (x := markdown(b, mode, prefix)).strip())


def content_item(block: dict, page: int | None, prefix: str = "") -> dict:
    """A block's entry of the flat content list."""
    kind = block["type"]
    picture, body = body_data(block)
    out = {
        "title": lambda: {"type": "text", "text": paragraph(block), **({"text_level": level} if (level := int(block.get("level", 2))) else {})},
        "list": lambda: {"type": kind, "list_items": list_items(block)}, "index": lambda: {"type": kind, "list_items": index_items(block)},
        "interline_equation": lambda: {"type": "equation", "text": paragraph(block), "text_format": "latex"},
        "image": lambda: {"type": kind, "img_path": picture, "image_caption": captions(block)},
        "table": lambda: {"type": kind, "table_caption": captions(block), **({"table_body": embedded(body, prefix)} if body else {})},
        "chart": lambda: {"type": kind, "img_path": picture, "content": embedded(body, prefix), "chart_caption": captions(block)},
    }.get(kind, lambda: {"type": kind, "text": paragraph(block)})()
    return out | {"page_idx": page} | ({"anchor": anchor_of(block)} if anchor_of(block) else {})


def spans_v2(block: dict) -> list[dict]:
    """A block's spans that show, formulas by their newer name, after a title's number."""
    shows = lambda s: bool(s.get("content", "").strip()) or bool(s.get("content")) and any(x in inline.VISIBLE for x in s.get("style") or ())
    own = [{**s, "type": "equation_inline" if s["type"] == "inline_equation" else s["type"]} for s in block.get("spans", []) if shows(s) or any(map(shows, inline.children_of(s)))]
    number = block.get("section_number") if block["type"] == "title" else None
    return [{"type": "text", "content": f"{number} "}, *own] if number else own


def list_items_v2(block: dict) -> list[dict]:
    return [
        {"item_type": "text", "ilevel": level, "prefix": INDENT * level + ("-" if n is None else f"{n}."), "item_content": spans, **({"anchor": anchor_of(leaf)} if anchor_of(leaf) else {})}
        for leaf, level, n in leaves(block) if (spans := spans_v2(leaf))
    ]


def content_item_v2(block: dict, prefix: str = "") -> dict:
    """A block's entry of the typed content list."""
    kind = block["type"]
    picture, body = body_data(block)
    caption = [s for c in block.get("captions", []) for s in spans_v2(c)]
    if kind in DISCARDED:
        name, content = DISCARDED[kind], {f"{DISCARDED[kind]}_content": spans_v2(block)}
    elif kind == "title" and int(block.get("level", 2)):
        name, content = kind, {"title_content": spans_v2(block), "level": int(block.get("level", 2))}
    elif kind in ("title", "text"):
        name, content = "paragraph", {"paragraph_content": spans_v2(block)}
    elif kind == "interline_equation":
        name, content = "equation_interline", {"math_content": body, "math_type": "latex"}
    elif kind == "image":
        name, content = kind, {"image_source": {"path": picture}, "image_caption": caption}
    elif kind == "table":
        nest = 2 if body.count("<table") > 1 else 1
        hard = nest > 1 or "colspan" in body or "rowspan" in body
        name, content = kind, {"table_caption": caption, "html": embedded(body, prefix), "table_type": "complex_table" if hard else "simple_table", "table_nest_level": nest}
    elif kind == "chart":
        name, content = kind, {"image_source": {"path": picture}, "content": embedded(body, prefix), "chart_caption": caption}
    elif kind in ("list", "index"):
        name, content = kind, {"list_type": "text_list", **({"attribute": block.get("attribute", "unordered")} if kind == "list" else {}), "list_items": list_items_v2(block)}
    else:
        name, content = kind, {}
    return {"type": name, "content": content, **({"anchor": anchor_of(block)} if anchor_of(block) else {})}


#: Blocks whose content makes no page text, and the kinds that a page's blocks are told apart by.
KINDS = ("image", "table", "chart", "interline_equation", "text", "title", "list", "index")


def page_info(blocks: list[dict], page: int) -> dict:
    """A page's blocks that are shown, by index, and those that aren't (headers, footers, notes); empty ones but charts are left out."""
    full = lambda b: b["type"] == "chart" or any(b.get(k) for k in ("spans", "blocks", "html", "image", "content"))
    order = lambda own: sorted(own, key=lambda b: b.get("index", 0))
    return {"para_blocks": order(b for b in blocks if b["type"] in KINDS and full(b)), "discarded_blocks": order(b for b in blocks if b["type"] in DISCARDED), "page_idx": page}


def linked_indexes(pages: list[dict]) -> list[dict]:
    """Pages whose index entries have only anchors that a block of the body has; where none has any, all stay."""
    known = {a for p in pages for b in p["para_blocks"] if (a := anchor_of(b))}

    def one(block: dict) -> dict:
        out = {**block, **({"blocks": [one(c) for c in block["blocks"]]} if "blocks" in block else {})}
        if block["type"] != "index" and anchor_of(block) not in known:
            out.pop("anchor", None)
        return out

    return [{**p, "para_blocks": [one(b) if b["type"] == "index" and known else b for b in p["para_blocks"]]} for p in pages]


def numbered(pages: list[dict]) -> list[dict]:
    """Pages whose numbered titles have section numbers: a title counts at its level and starts the deeper ones again; levels over it begin at 1; a number that an unnumbered title begins with is taken over."""
    at: dict[int, int] = {}
    out = []
    for p in pages:
        blocks = []
        for b in p["para_blocks"]:
            if b["type"] == "title":
                level = int(b.get("level", 1))
                if b.get("is_numbered"):
                    for k in range(1, level):
                        at[k] = at.get(k) or 1
                    at[level] = at.get(level, 0) + 1
                    b = {**b, "section_number": ".".join(str(at[k]) for k in range(1, level + 1))}
                    at = {k: n for k, n in at.items() if k <= level}
                else:
                    first = next(iter(b.get("spans", [])), {}).get("content", "").strip()
                    m = re.match(r"\d+(?:\.\d+)*", first)
                    parts = list(map(int, m[0].split("."))) if m else []
                    if len(parts) == level:
                        at = dict(enumerate(parts, 1))
            blocks.append(b)
        out.append({**p, "para_blocks": blocks})
    return out


def document(pages: list[list[dict]]) -> list[dict]:
    """Pages of blocks as a document: ordered, numbered, its indexes linked."""
    return linked_indexes(numbered([page_info(blocks, i) for i, blocks in enumerate(pages)]))


def make(pages: list[dict], mode: str = "mm_markdown", prefix: str = ""):
    """A document as Markdown (mm_markdown, nlp_markdown), as the flat list of all its blocks (content_list) or as a typed list a page (content_list_v2)."""
    if mode in ("mm_markdown", "nlp_markdown"):
        return "\n\n".join(x for p in pages if (x := page_markdown(p["para_blocks"], mode, prefix)))
    both = lambda p: p["para_blocks"] + p["discarded_blocks"]
    if mode == "content_list":
        return [content_item(b, p["page_idx"], prefix) for p in pages for b in both(p)]
    if mode == "content_list_v2":
        return [[content_item_v2(b, prefix) for b in both(p)] for p in pages]
    raise ValueError(f"unknown mode {mode!r}")
