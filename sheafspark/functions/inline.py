"""Spans of a paragraph as text: escaping, styles, links, formulas and what stands between them.

A span is a dict with type (text, hyperlink, inline_equation, interline_equation), content, style (a list) and, for
links, url and children (text spans). A block is written in Markdown where one simple style is enough for it; otherwise
in HTML, in which neighbouring spans share the tags that they have in common.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from typing import NamedTuple

from sheafspark.functions.repetition import escape_markdown

#: The Markdown marks of simple styles, and the HTML tags of all, outermost first.
MARKS = {frozenset(["bold"]): "**", frozenset(["italic"]): "*", frozenset(["strikethrough"]): "~~", frozenset(["bold", "italic"]): "***"}
TAGS = {
    "emphasis": ('<span style="text-emphasis: dot; text-emphasis-position: under;">', "</span>"), "strikethrough": ("<s>", "</s>"), "italic": ("<em>", "</em>"),
    "bold": ("<strong>", "</strong>"), "underline": ("<u>", "</u>"), "superscript": ("<sup>", "</sup>"), "subscript": ("<sub>", "</sub>"),
}
#: Styles that make blanks visible, with what a blank becomes.
VISIBLE = {"underline": "_", "strikethrough": "-"}
INLINE, DISPLAY = ("$", "$"), ("$$", "$$")
MARKDOWN, HTML = "markdown", "html"
EQUATIONS = ("inline_equation", "interline_equation")


class Part(NamedTuple):
    kind: str
    out: str
    raw: str = ""
    marked: bool = False  # has Markdown marks around it


def mark_of(style) -> str | None:
    """The Markdown marks of a style: empty for none at all, null where Markdown has none for it."""
    names = frozenset(x for x in style or () if x)
    return MARKS.get(names) if names else ""


def children_of(span: dict) -> list[dict]:
    return span.get("children") or []


def link_needs_html(span: dict) -> bool:
    """Whether a link has a style that Markdown lacks, a child that isn't text, or children of several styles."""
    if not children_of(span):
        return mark_of(span.get("style")) is None
    if any(c.get("type") != "text" for c in children_of(span)):
        return True
    seen = {mark_of(c.get("style")) for c in children_of(span) if str(c.get("content", "")).strip()}
    return None in seen or len(seen) > 1


def syntax_of(spans: list[dict]) -> str:
    """Markdown where the spans have at most one style, and a simple one; else HTML."""
    seen: set[str | None] = set()
    for s in spans:
        if s.get("type") == "hyperlink":
            if link_needs_html(s):
                return HTML
            pieces = [c for c in children_of(s) if c.get("type") == "text"] or [s]
        else:
            pieces = [s] if s.get("type") == "text" else []
        seen.update(mark_of(p.get("style")) for p in pieces if p.get("content"))
    return MARKDOWN if None not in seen and len(seen - {""}) <= 1 else HTML


def escaped(text: str, syntax: str) -> str:
    return escape_markdown(html.escape(text, quote=False) if syntax == HTML else text)


def styled(text: str, style, syntax: str) -> str:
    if not text:
        return text
    if syntax == MARKDOWN:
        mark = mark_of(style) or ""
        return mark + text + mark
    for name in reversed(stack_of(style)):
        text = TAGS[name][0] + text + TAGS[name][1]
    return text


def stack_of(style) -> list[str]:
    """A style's tags from the outside in; of superscript and subscript the first."""
    own = [name for name in TAGS if name in (style or ())]
    return own[:-1] if own[-2:] == ["superscript", "subscript"] else own


def linked(text: str, url: str, syntax: str) -> str:
    return f"[{text}]({url})" if syntax == MARKDOWN else f'<a href="{html.escape(url, quote=True)}">{text}</a>'


def blanks_shown(text: str, style, syntax: str) -> tuple[str, list[str]] | None:
    """text with its visible blanks as marks, and the style that is left to apply; null where the style shows no blanks.

    Text of blanks alone becomes marks without that style; of other text only the blanks at its ends do.
    """
    name = next((n for n in VISIBLE if n in (style or ())), None)
    if name is None:
        return None
    core = text.strip(" ")
    if not core:
        return VISIBLE[name] * len(text), [s for s in style if s != name]
    before, after = len(text) - len(text.lstrip(" ")), len(text) - len(text.rstrip(" "))
    return VISIBLE[name] * before + escaped(core, syntax) + VISIBLE[name] * after, list(style)


def text_parts(text: str, style, syntax: str) -> list[Part]:
    """A text with its style around all but the blanks at its ends."""
    if not text:
        return []
    marked = syntax == MARKDOWN and bool(mark_of(style))
    shown = blanks_shown(text, style, syntax)
    if shown:
        return [Part("text", styled(*shown, syntax), text, marked)]
    own = escaped(text, syntax)
    core = own.strip()
    if not core:
        return [Part("text", text, text, marked)]
    at = own.index(core)
    return [Part("text", own[:at] + styled(core, style, syntax) + own[at + len(core) :], text, marked)]


def html_runs(spans: list[dict]) -> str:
    """Texts in a row with tags that stay open from one to the next where both have them."""
    pieces: list[tuple[str, list[str]]] = []
    for s in spans:
        text, style = str(s.get("content", "")), s.get("style") or []
        shown = blanks_shown(text, style, HTML) if text else None
        if shown:
            pieces.append((shown[0], stack_of(shown[1])))
            continue
        own = escaped(text, HTML) if text.strip() else text
        core = own.strip()
        at = own.index(core) if core else len(own)
        pieces += [(own[:at], []), (core, stack_of(style)), (own[at + len(core) :], [])]
    out, open_ = "", []
    for text, stack in [(t, s) for t, s in pieces if t] + [("", [])]:
        same = next((i for i, (a, b) in enumerate(itertools.zip_longest(open_, stack)) if a != b), len(stack))
        out += "".join(TAGS[n][1] for n in reversed(open_[same:])) + "".join(TAGS[n][0] for n in stack[same:]) + text
        open_ = stack
    return out


def run_parts(spans: list[dict], syntax: str) -> list[Part]:
    """Neighbouring text spans: in Markdown those of one style as one, in HTML all but blank ends as one."""
    if syntax == MARKDOWN:
        return [p for _, same in itertools.groupby(spans, key=lambda s: mark_of(s.get("style"))) for own in [list(same)] for p in text_parts("".join(str(s.get("content", "")) for s in own), own[0].get("style"), syntax)]
    full = [i for i, s in enumerate(spans) if str(s.get("content", "")).strip()]
    a, b = (full[0], full[-1] + 1) if full else (len(spans), len(spans))
    single = lambda part: [p for s in part for p in text_parts(str(s.get("content", "")), s.get("style"), syntax)]
    core = html_runs(spans[a:b])
    return single(spans[:a]) + ([Part("text", core)] if core else []) + single(spans[b:])


def link_part(span: dict, syntax: str, plain: bool = False) -> list[Part]:
    """A link's text with its target, or (plain) alone."""
    text, url = str(span.get("content", "")), span.get("url", "")
    if children_of(span):
        own = [c for c in children_of(span) if c.get("type") == "text"]
        label = joined(run_parts(own, syntax)).strip()
        return [Part("hyperlink", label if plain else linked(label, url, syntax))] if label else []
    core = text.strip()
    if not core:
        return []
    shown = blanks_shown(core, span.get("style"), syntax)
    label = styled(*shown, syntax) if shown else styled(escaped(core, syntax), span.get("style"), syntax)
    at = text.index(core)
    return [Part("hyperlink", text[:at] + label + text[at + len(core) :] if plain else linked(label, url, syntax))]


def needs_space(before: Part, after: Part) -> bool:
    """Whether marks that close after punctuation need a blank before the letter that follows, to be read as marks."""
    if not before.marked or after.kind in ("hyperlink", *EQUATIONS) or not before.raw.strip() or not after.raw.strip():
        return False
    a, b = before.raw[-1], after.raw[0]
    sign = lambda c: unicodedata.category(c)[0] in "PS"
    return not a.isspace() and not b.isspace() and sign(a) and not sign(b)


def joined(parts: list[Part]) -> str:
    """Parts as one text: a blank around formulas within it, and where marks need one."""
    out: list[str] = []
    for i, p in enumerate(parts):
        if p.kind == "inline_equation":
            lead = " " if out and not out[-1].endswith(" ") else ""
            out += [lead, p.out, " " if i < len(parts) - 1 else ""]
            out = [x for x in out if x]
        else:
            out += [" " + p.out if i and needs_space(parts[i - 1], p) else p.out]
    return "".join(out)


def paragraph(block: dict, escape_start: bool = True) -> str:
    """A block's spans as text, a title's with its section number; what a text begins with doesn't become a heading, list or rule."""
    spans = block.get("spans", [])
    syntax, parts = syntax_of(spans), []
    if block.get("type") == "title" and block.get("is_numbered") and block.get("section_number"):
        parts.append(Part("text", f"{block['section_number']} "))
    for kind, own in itertools.groupby(spans, key=lambda s: s.get("type")):
        if kind == "text":
            parts += run_parts(list(own), syntax)
        elif kind == "hyperlink":
            parts += [p for s in own for p in link_part(s, syntax)]
        elif kind == "inline_equation":
            parts += [Part(kind, x) for s in own if (x := f"{INLINE[0]}{s['content']}{INLINE[1]}".strip())]
        elif kind == "interline_equation":
            parts += [Part(kind, f"{DISPLAY[0]}\n{s['content']}\n{DISPLAY[1]}") for s in own]
    text = joined(parts)
    if block.get("type") == "text":
        text = text.strip()
        if text and set(text) in ({"_"}, {"-"}):
            text = "\\" + text
        if escape_start:
            text = re.sub(r"\A( {0,3})(#{1,6}|[-+*])(?=[ \t]|\Z)", r"\1\\\2", text)
    return text


# The markup between readers and renderers ------------------------------------------

_MARKUP = re.compile(r"<eq>(?P<eq>.*?)</eq>|<text(?: style=\"(?P<style>[^\"]*)\")?>(?P<text>.*?)</text>|<hyperlink>(?P<link>.*?)</hyperlink>", re.DOTALL)
_OPEN = re.compile(r"<eq>|<text(?: style=\"[^\"]*\")?>|<hyperlink>")


def styles(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def _text_span(content: str, style: str | None) -> dict:
    return {"type": "text", "content": content, **({"style": styles(style)} if styles(style) else {})}


def parse_spans(content: str) -> list[dict]:
    """Spans of a text with <eq>, <text style="..."> and <hyperlink>...<url> marks; from a mark on that isn't closed all is plain."""
    out, at = [], 0
    while at < len(content):
        begin = _OPEN.search(content, at)
        if begin is None:
            break
        m = _MARKUP.match(content, begin.start())
        link = None if m is None or m["link"] is None else parse_link(m["link"])
        if m is None or m["link"] is not None and link is None:
            break
        if begin.start() > at:
            out.append({"type": "text", "content": content[at : begin.start()]})
        if m["eq"] is not None:
            out += [{"type": "inline_equation", "content": m["eq"]}] if m["eq"] else []
        elif m["text"] is not None:
            out += [_text_span(m["text"], m["style"])] if m["text"] else []
        else:
            out.append(link)
        at = m.end()
    return [*out, {"type": "text", "content": content[at:]}] if at < len(content) else out


def parse_link(inner: str) -> dict | None:
    """A link of its marks: its only text's content and style, or several as children; null without a target."""
    m = re.search(r"<url>(.*?)</url>", inner, re.DOTALL)
    if m is None:
        return None
    own = [_text_span(t[2], t[1]) for t in re.finditer(r"<text(?: style=\"([^\"]*)\")?>(.*?)</text>", inner[: m.start()], re.DOTALL)]
    if len(own) == 1:
        return {"type": "hyperlink", "content": own[0]["content"], "url": m[1], **({"style": own[0]["style"]} if "style" in own[0] else {})}
    text = "".join(c["content"] for c in own) if own else inner[: m.start()]
    return {"type": "hyperlink", "content": text, "url": m[1], **({"children": own} if own else {})}


class Look(NamedTuple):
    """How a run looks."""

    bold: bool = False
    italic: bool = False
    underline: bool = False
    emphasis: bool = False
    strikethrough: bool = False
    script: str = ""
    words_only: bool = False  # the underline leaves blanks out


def style_text(look: Look | None) -> str:
    """The names of a look's styles, comma-joined."""
    if look is None:
        return ""
    names = [n for n in ("bold", "italic", "underline", "emphasis", "strikethrough") if getattr(look, n)]
    return ",".join(names + ([look.script] if look.script else []))


def shows_blanks(look: Look | None) -> bool:
    return look is not None and (look.underline or look.emphasis or look.strikethrough)


def look_for(look: Look | None, text: str) -> Look | None:
    """A run's look for its text: blanks have no bold, italic or underline of words, and none at all unless it shows."""
    if look is None or text.strip():
        return look
    look = look._replace(bold=False, italic=False, underline=look.underline and not look.words_only, words_only=False)
    return look if shows_blanks(look) else None


def kept(text: str, look: Look | None, plain_blanks: bool = False) -> bool:
    """Whether a group of runs is worth keeping: it has text, or blanks that show."""
    return bool(text) and (bool(text.strip()) or shows_blanks(look) or plain_blanks)


def target_ok(url: str | None) -> bool:
    return bool(url and url.strip() and url != ".")


def tagged(text: str, style: str = "", force: bool = False) -> str:
    if not text or not (style or force):
        return text
    return f'<text style="{style}">{text}</text>' if style else f"<text>{text}</text>"


def rich_text(segments: list[tuple[str, str, str | None]], trim: bool = False) -> str:
    """Marks of (text, style, url) segments: blank ends trimmed unless they show, neighbours of one style joined, and those of one target one link; formulas, marked already, stay as they are."""
    own = [(t, ",".join(styles(s)), u) for t, s, u in segments if t]
    shows = lambda s: any(x in (*VISIBLE, "emphasis") for x in styles(s))
    if trim:
        while own and not own[0][0].strip() and not shows(own[0][1]):
            own.pop(0)
        while own and not own[-1][0].strip() and not shows(own[-1][1]):
            own.pop()
        if own and not shows(own[0][1]):
            own[0] = (own[0][0].lstrip(), *own[0][1:])
        if own and not shows(own[-1][1]):
            own[-1] = (own[-1][0].rstrip(), *own[-1][1:])
    math = lambda t: t.startswith("<eq>") and t.endswith("</eq>")
    out = ""
    for (formula, url), group in itertools.groupby(own, key=lambda x: (math(x[0]), x[2] if target_ok(x[2]) and not math(x[0]) else None)):
        if formula:
            out += "".join(t for t, _, _ in group)
            continue
        same = [(s, "".join(t for t, _, _ in g)) for s, g in itertools.groupby(group, key=lambda x: x[1])]
        if url is None:
            out += "".join(tagged(t, s) for s, t in same)
        else:
            out += "<hyperlink>" + "".join(tagged(t, s, True) for s, t in same) + f"<url>{url}</url></hyperlink>"
    return out
