"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: stretches of text between the edges of block
elements, each with the path of tags (and their class, id and role names) over
it. Scripts, styles, heads, templates, frames and comments are not text; what stands in
math, drawings, objects and noscript is, where the labeller takes it. For each block
the labeller reads the mean of the hashed path names' vectors, the mean of the
hashed words' vectors and a few measures; a bidirectional LSTM over the page's
whole sequence of blocks then says which belong to the article, so that what
stands before and after counts too. It is trained in numpy on pages that
``labelled_pages`` writes in many templates, broken markup among them.

Null and empty pages have an empty text. Elements left open end with what
encloses them. Nothing is dropped but what the labeller labels; blocks keep their
order, white space in one becomes one space, character references are decoded. A
block whose two labels are equally likely is left out. Repeated pages are pages, an
empty table gives an empty result, and columns beyond those named are not read,
whatever their names. Time and memory grow in proportion to a page's length and
tags, however deep they are nested and whatever is left unclosed: a block's path is
a node of the page's tree, whose vector is its parent's and its own.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sheafspark.llm.common import map_arrow, prefix_sums, slice_hash, spans_of, utf8
from sheafspark.llm.pii import _sig, lstm, lstm_back

#: Element names of HTML that end a line of text, that hold no text, that never have content.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN_TAGS = frozenset("script style head template iframe textarea title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title iframe".split())
#: Elements that a new one of the second set closes, as HTML lets their end tags be left out.
CLOSED_BY = {"p": BLOCK_TAGS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

_NAMED = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_EDGE = re.compile("[>\"']")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z]+")
PATH_BUCKETS, WORD_BUCKETS, PATH_WIDTH, WORD_WIDTH, MEASURES, HIDDEN = 2048, 2048, 16, 6, 6, 16
PAGES, EPOCHS = 700, 5
#: Blocks, padding included, that are labelled together; a longer page is labelled whole.
CELLS = 1 << 16
#: Levels of a page's tree from which on its nodes are summed up one by one.
DEEP = 64


def _crc(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % PATH_BUCKETS


class TagEnds:
    """Where tags end: at the first > outside quotes. Each quote is followed at most twice (as one that opens and as one that closes), so all tags of a page together take time in proportion to it."""

    def __init__(self, page: str):
        self.page, self.last = page, {q: page.rfind(q) for q in "\"'"}
        self.edge, self.known, self.lost = -1, -1, set()

    def after(self, at: int) -> int | None:
        """The end of a tag whose attributes begin at ``at``; the page's end where no > follows, None where a quote isn't closed."""
        page, way = self.page, []
        while True:
            if not self.known <= at <= self.edge:  # the last edge found serves all places since then
                m = _EDGE.search(page, at)
                self.known, self.edge = at, m.start() if m else len(page)
            e = self.edge
            if e == len(page):
                return e
            if page[e] == ">":
                return e + 1
            if e in self.lost or self.last[page[e]] <= e:
                self.lost.update(way)
                self.lost.add(e)
                return None
            way.append(e)
            at = page.index(page[e], e + 1) + 1


def tokens(page: str):
    """(text, slash, name, attributes) of each stretch of text (name None) and each tag (text None), in order, and where the token ends; what reads them may send a place to go on from."""
    ends, pos, n = TagEnds(page), 0, len(page)
    while pos < n:
        if page[pos] != "<":
            at = page.find("<", pos)
            at = n if at < 0 else at
            yield page[pos:at], "", None, "", at
            pos = at
            continue
        if page.startswith("<!--", pos):
            at = page.find("-->", pos + 4)
            pos = n if at < 0 else at + 3
            continue
        if page.startswith("<![CDATA[", pos):
            at = page.find("]]>", pos)
            pos = n if at < 0 else at + 3
            continue
        if page.startswith(("<!", "<?"), pos):
            at = page.find(">", pos)
            pos = n if at < 0 else at + 1
            continue
        m = _NAMED.match(page, pos + 1)
        end = ends.after(m.end()) if m else None
        if end is None:
            yield "<", "", None, "", pos + 1
            pos += 1
            continue
        inner = page[m.end() : end - 1] if page[end - 1] == ">" and end > m.end() else page[m.end() : end]
        go = yield None, m[1], m[2].lower(), inner, end
        pos = end if go is None else go
        if go is not None:
            yield None  # the answer to send


@dataclass
class Page:
    """Blocks (text, node of the path, share in links) in page order; for each node its parent's number (-1: none) and its own buckets."""

    blocks: list[tuple[str, int, float]]
    parents: list[int]
    own: list[tuple[int, ...]]

    def path(self, node: int) -> list[int]:
        """All buckets over a node."""
        out: list[int] = []
        while node >= 0:
            out += self.own[node]
            node = self.parents[node]
        return out


def blocks(page: str | None) -> Page:
    """The page's blocks that have text."""
    made = Page([], [], [])
    if not page:
        return made
    out, parents, owns = made.blocks, made.parents, made.own
    stack: list[tuple[str, int, bool]] = []  # name, its node, hidden
    open_: Counter[str] = Counter()  # open elements by name
    frames: list[tuple[int, Counter[str]]] = [(-1, Counter())]  # each open block element's place on the stack, and the inline ones in it
    text, linked, path, links, hidden, n = [], 0, -1, 0, 0, len(page)

    def close() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((joined, path, min(1.0, linked / max(1, len(joined)))))
        text, linked = [], 0

    def pop(down_to: int) -> None:
        nonlocal links, hidden
        while len(stack) > down_to:
            name, _, hid = stack.pop()
            open_[name] -= 1
            links -= name == "a"
            hidden -= hid
            if name in BLOCK_TAGS:
                frames.pop()
            else:
                frames[-1][1][name] -= 1

    read = tokens(page)
    for token in read:
        words, slash, tag, inner, pos = token
        if tag is None:
            if not hidden:
                if not text:
                    path = stack[-1][1] if stack else -1
                text.append(words)
                if links:
                    linked += len(words)
            continue
        block = tag in BLOCK_TAGS
        if slash:
            # an inline end tag doesn't close a block; one that closes nothing is nothing
            if not (open_[tag] if block else frames[-1][1][tag]):
                continue
            if block:
                close()
            at = len(stack) - 1
            while stack[at][0] != tag:
                at -= 1
            pop(at)
            continue
        if tag == "br":
            if text:
                text.append(" ")
            continue
        if block:
            close()
            at = frames[-1][0]
            if at >= 0 and tag in CLOSED_BY.get(stack[at][0], ()):
                pop(at)
        if tag in VOID_TAGS or inner.endswith("/") and not block and tag not in RAW_TAGS:
            continue
        own, hid = [_crc(tag)], tag in HIDDEN_TAGS
        if inner:
            for a in _ATTR.finditer(inner):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "hidden" or a[1].lower() == "aria-hidden" and value.lower() == "true":
                    hid = True
                elif a[1].lower() != "aria-hidden":
                    own += [_crc("." + x.lower()) for x in _NAME.findall(value)]
        if tag in RAW_TAGS:  # all of them hidden: what is in them isn't markup
            end = re.compile(f"</{tag}[\\s/>]", re.IGNORECASE).search(page, pos)
            read.send(page.find(">", end.start()) + 1 or n if end else n)
            continue
        parents.append(stack[-1][1] if stack else -1)
        owns.append(tuple(own))
        stack.append((tag, len(owns) - 1, hid))
        open_[tag] += 1
        if block:
            frames.append((len(stack) - 1, Counter()))
        else:
            frames[-1][1][tag] += 1
        links += tag == "a"
        hidden += hid
    close()
    return made


@dataclass
class Labeller:
    p: dict[str, np.ndarray]


def features(pages: list[Page], spread: bool = False) -> dict:
    """What the network reads of all blocks of all pages, one after another. ``spread`` lists each block's buckets (for training, on shallow pages) in place of the pages' trees."""
    flat = [b for p in pages for b in p.blocks]
    data, offsets = utf8(pa.array([b[0] for b in flat], pa.large_string()))
    start, end, row = spans_of(data > 47, offsets)
    words = (slice_hash(prefix_sums(data), start, end, 9) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    n = np.array([len(b[0]) for b in flat], np.float32)
    count = np.bincount(row, minlength=len(flat)).astype(np.float32)
    stops = np.bincount(np.searchsorted(offsets, np.flatnonzero((data == 46) | (data == 44)), "right") - 1, minlength=len(flat)) if len(data) else np.zeros(len(flat))
    link = np.array([b[2] for b in flat], np.float32)
    measures = np.stack([np.log1p(n) / 6, link, np.log1p(count) / 5, np.minimum(stops / np.maximum(count, 1), 1), n > 80, np.ones(len(flat))], 1).astype(np.float32) if flat else np.zeros((0, MEASURES), np.float32)
    out = {"word": words, "word_n": count.astype(np.int64), "measures": measures}
    if spread:
        paths = [p.path(b[1]) for p in pages for b in p.blocks]
        return out | {"path": np.array([b for p in paths for b in p], np.int64), "path_n": np.array([len(p) for p in paths], np.int64)}
    first = np.cumsum([0, *(len(p.own) for p in pages)])
    parents = np.array([q + a if q >= 0 else -1 for p, a in zip(pages, first.tolist(), strict=False) for q in p.parents], np.int64)
    node = np.array([b[1] + a if b[1] >= 0 else -1 for p, a in zip(pages, first.tolist(), strict=False) for b in p.blocks], np.int64)
    own = [x for p in pages for x in p.own]
    return out | {"tree": (parents, np.array([b for x in own for b in x], np.int64), np.array([len(x) for x in own], np.int64), node)}


def path_means(table: np.ndarray, tree: tuple) -> np.ndarray:
    """For each block the sum of its path's vectors over the root of their number: down the trees, a level at a time."""
    parents, ids, counts, node = tree
    if not len(parents):
        return np.zeros((len(node), table.shape[1]), np.float32)
    sums = np.add.reduceat(table[ids], np.cumsum(counts) - counts, axis=0)
    counts = counts.copy()
    depth, up = np.zeros(len(parents), np.int64), parents
    for _ in range(DEEP):
        live = up >= 0
        if not live.any():
            break
        depth += live
        up = np.where(live, parents[up], -1)
    if (up >= 0).any():  # very deep trees: one by one, parents come before their children
        for i, q in enumerate(parents.tolist()):
            if q >= 0:
                sums[i] += sums[q]
                counts[i] += counts[q]
    else:
        for d in range(1, int(depth.max()) + 1):
            rows = np.flatnonzero(depth == d)
            sums[rows] += sums[parents[rows]]
            counts[rows] += counts[parents[rows]]
    out = sums[node] / np.sqrt(np.maximum(counts[node], 1))[:, None]
    out[node < 0] = 0
    return out.astype(np.float32)


def _means(table: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(table[ids], (np.cumsum(counts) - counts)[full], axis=0)
    return out / np.maximum(counts, 1)[:, None]


def inputs(net: Labeller, f: dict) -> np.ndarray:
    paths = path_means(net.p["path"], f["tree"]) if "tree" in f else _means(net.p["path"], f["path"], f["path_n"]) * np.sqrt(np.maximum(f["path_n"], 1))[:, None]
    return np.concatenate([paths, _means(net.p["word"], f["word"], f["word_n"]), f["measures"]], 1).astype(np.float32)


def _grid(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a padded [T, B] batch over stretches that stand one after another, and which are real."""
    first, t = np.cumsum([0, *lengths[:-1]]), max(lengths)
    at = np.arange(t)[:, None] + first[None, :]
    real = np.arange(t)[:, None] < np.array(lengths)[None, :]
    return np.where(real, at, 0), real


def forward(net: Labeller, x: np.ndarray, real: np.ndarray, keep: bool = False):
    """Log-odds [T, B]. Backwards, each sequence is read from its own end."""
    p = net.p
    f, sf = lstm(x, p["wxf"], p["whf"], p["bf"], keep)
    turn = _turn(real)
    cols = np.arange(x.shape[1])[None, :]
    b, sb = lstm(x[turn, cols], p["wxb"], p["whb"], p["bb"], keep)
    hid = np.concatenate([f, b[turn, cols]], 2)
    return hid @ p["out"] + p["bias"], (hid, sf, sb, turn, cols)


def _turn(real: np.ndarray) -> np.ndarray:
    n, t = real.sum(0), len(real)
    at = np.arange(t)[:, None]
    return np.where(at < n[None, :], n[None, :] - 1 - at, at)


def train(seed: int = 23, pages: int = PAGES, epochs: int = EPOCHS) -> Labeller:
    rng = np.random.default_rng(seed)
    made = labelled_pages(rng, pages)
    data = []
    for source, wanted in made:
        own = blocks(source)
        if own.blocks:
            data.append((own, np.array([b[0] in wanted for b in own.blocks], np.float32)))
    width = PATH_WIDTH + WORD_WIDTH + MEASURES
    p = {"path": rng.normal(0, 0.2, (PATH_BUCKETS, PATH_WIDTH)), "word": rng.normal(0, 0.05, (WORD_BUCKETS, WORD_WIDTH)), "out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(())}
    for d in "fb":
        p["wx" + d], p["wh" + d], p["b" + d] = rng.normal(0, 0.2, (width, 4 * HIDDEN)), rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), np.zeros(4 * HIDDEN)
        p["b" + d][HIDDEN : 2 * HIDDEN] = 1
    net = Labeller({k: np.asarray(v, np.float32) for k, v in p.items()})
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    s, steps = 0, epochs * -(-len(data) // 16)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(data)), -(-len(data) // 16)):
            s += 1
            own = [data[i] for i in part]
            f, y = features([b for b, _ in own], spread=True), np.concatenate([y for _, y in own])
            for name, size in (("path", PATH_BUCKETS), ("word", WORD_BUCKETS)):  # names not seen before have vectors too
                odd = rng.random(len(f[name])) < (0.08 if name == "path" else 0.3)
                f[name] = np.where(odd, rng.integers(0, size, len(odd)), f[name])
            grads = gradient(net, f, y, [len(y) for _, y in own])
            rate = 0.015 * (1 - 0.9 * s / steps)
            for k, g in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - rate * (m1[k] / (1 - 0.9**s)) / (np.sqrt(m2[k] / (1 - 0.99**s)) + 1e-6)).astype(np.float32)
    return net


def gradient(net: Labeller, f: dict, y: np.ndarray, lengths: list[int]) -> dict[str, np.ndarray]:
    p = net.p
    flat = inputs(net, f)
    at, real = _grid(lengths)
    x = flat[at] * real[:, :, None]
    z, (hid, sf, sb, turn, cols) = forward(net, x, real, True)
    d = ((_sig(z) - y[at]) * real / len(y)).astype(np.float32)
    g = {"out": (hid * d[:, :, None]).sum((0, 1)), "bias": d.sum()}
    dh, h = d[:, :, None] * p["out"], HIDDEN
    dx, g["wxf"], g["whf"], g["bf"] = lstm_back(np.ascontiguousarray(dh[:, :, :h]), x, sf, p["wxf"], p["whf"])
    dxb, g["wxb"], g["whb"], g["bb"] = lstm_back(dh[:, :, h:][turn, cols], x[turn, cols], sb, p["wxb"], p["whb"])
    dx = dx + dxb[turn, cols]
    dflat = np.zeros_like(flat)
    dflat[at[real]] = dx[real]
    g["path"], g["word"] = np.zeros_like(p["path"]), np.zeros_like(p["word"])
    n = np.maximum(f["path_n"], 1)
    np.add.at(g["path"], f["path"], np.repeat(dflat[:, :PATH_WIDTH] / np.sqrt(n)[:, None], f["path_n"], axis=0))
    n = np.maximum(f["word_n"], 1)
    np.add.at(g["word"], f["word"], np.repeat(dflat[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] / n[:, None], f["word_n"], axis=0))
    return g


def label(net: Labeller, pages: list[Page]) -> list[np.ndarray]:
    """Whether each block of each page belongs to the article; each page is one sequence, whatever its length."""
    flat = inputs(net, features(pages))
    sizes = np.array([len(p.blocks) for p in pages], np.int64)
    first = np.cumsum(sizes) - sizes
    good = np.zeros(int(sizes.sum()), bool)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    while len(order):
        n = max(1, int(np.searchsorted(np.arange(1, len(order) + 1) * sizes[order], CELLS, "right")))
        own, order = order[:n], order[n:]
        at = np.arange(int(sizes[own].max()))[:, None]
        real = at < sizes[own][None, :]
        rows = np.where(real, at + first[own][None, :], 0)
        z, _ = forward(net, flat[rows] * real[:, :, None], real)
        good[rows[real]] = z[real] > 0
    return [good[a : a + n] for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]


def extract_all(net: Labeller, sources: list[str | None]) -> list[str]:
    pages = [blocks(s) for s in sources]
    if not any(p.blocks for p in pages):
        return [""] * len(sources)
    return ["\n".join(b[0] for b, ok in zip(p.blocks, good.tolist(), strict=True) if ok) for p, good in zip(pages, label(net, pages), strict=True)]


def extract(pages: DataFrame, net: Labeller, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """keep, text and n_chars of each page."""
    kinds, shared = dict(pages.dtypes), pages.sparkSession.sparkContext.broadcast(net)

    def make():
        n = shared.value

        def step(part):
            text = extract_all(n, part.column(column).to_pylist())
            return {c: part.column(c) for c in keep} | {"text": text, "n_chars": [len(t) for t in text]}

        return step

    names = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return map_arrow(pages.select(*keep, column), make, f"{names}, text string, n_chars long", text=column)


# Labelled pages -----------------------------------------------------------------


def labelled_pages(rng: np.random.Generator, n: int) -> list[tuple[str, set[str]]]:
    """Pages of invented words in many templates, and the blocks of each that are its article."""
    syllables = ["an", "er", "th", "in", "on", "re", "ti", "es", "or", "at", "ion", "le", "qu", "ch", "sch", "en", "ung", "ado", "ñ", "é", "st", "al", "ar", "it", "ou", "ve", "ma", "lo", "ke", "pra"]
    serial = [0]

    def word() -> str:
        return "".join(syllables[int(rng.integers(0, len(syllables)))] for _ in range(int(rng.integers(1, 5))))

    def words(a: int, b: int, end: str = "") -> str:
        k = int(rng.integers(a, b))
        out = [word() for _ in range(k)]
        if k > 6:
            for i in range(4, k, 7):
                out[i] += "," if rng.random() < 0.5 else "."
        serial[0] += 1
        return (" ".join(out).capitalize() + end).strip()

    pick = lambda x: x[int(rng.integers(0, len(x)))]
    chance = lambda p: rng.random() < p

    def tag(name: str, inner: str, cls: str = "") -> str:
        return f"<{name}{f' class={chr(34)}{cls}{chr(34)}' if cls else ''}>{inner}</{name}>"

    def menu() -> str:
        items = "".join(tag("li", f'<a href="/{word()}">{words(1, 3)}</a>') for _ in range(int(rng.integers(2, 12))))
        return pick([lambda: tag("nav", tag("ul", items)), lambda: tag("div", tag("ul", items), pick(["menu", "nav", "navbar", "breadcrumb", "top-links", "pagination"])), lambda: tag("ul", items, pick(["menu", "nav", "tabs"])), lambda: tag("nav", "".join(f'<a href="/{word()}">{words(1, 2)}</a> | ' for _ in range(4)))])()

    def header() -> str:
        return tag(pick(["header", "div"]), pick([tag("p", words(2, 6)), tag("div", words(1, 4), "logo"), tag("span", words(2, 5)), ""]) + (menu() if chance(0.5) else ""), pick(["header", "site-header", "masthead", "top", "banner"]))

    def advert() -> str:
        return tag(pick(["div", "aside", "section"]), pick([lambda: words(3, 20, "."), lambda: tag("p", words(4, 20, "."))])(), pick(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-box"]))

    def notice() -> str:
        return tag(pick(["div", "section", "p"]), words(5, 22, ".") + pick(["", "<button>" + words(1, 3) + "</button>"]), pick(["cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "newsletter", "subscribe", "modal", "popup", "disclaimer"]))

    def sidebar() -> str:
        inner = "".join(pick([lambda: tag("h3", words(1, 4)), lambda: tag("p", words(4, 22, ".")), lambda: tag("li", f'<a href="/{word()}">{words(3, 8)}</a>'), lambda: menu()])() for _ in range(int(rng.integers(1, 6))))
        return pick([lambda: tag("aside", inner), lambda: tag("div", inner, pick(["sidebar", "related", "widget", "side", "right-col", "recommended", "trending", "share", "social", "tags", "author-box"]))])()

    def footer() -> str:
        inner = pick([lambda: f"&copy; {word()}.example.com &middot; {words(3, 14, '.')}", lambda: tag("p", words(4, 18, ".")), lambda: tag("p", "&copy; " + words(2, 5)) + menu()])()
        return pick([lambda: tag("footer", inner), lambda: tag("div", inner, pick(["footer", "site-footer", "copyright", "bottom", "legal"]))])()

    def form() -> str:
        return tag("form", f"<label>{words(1, 4)}</label><input name=q>" + pick([f"<select><option>{words(1, 2)}<option>{words(1, 2)}</select>", "", f"<button>{words(1, 2)}</button>"]) + (tag("p", words(4, 10)) if chance(0.3) else ""), pick(["", "search", "login", "contact"]))

    def remarks() -> str:
        one = lambda: tag(pick(["div", "li", "article", "p"]), pick([lambda: tag("p", words(4, 40, ".")), lambda: words(4, 40, "."), lambda: tag("b", words(1, 3)) + " " + words(4, 30, ".")])(), pick(["comment", "reply", "comment-body", ""]))
        inner = (tag("h3", words(1, 3)) if chance(0.6) else "") + "".join(one() for _ in range(int(rng.integers(1, 6))))
        return tag(pick(["div", "section", "ol", "ul"]), inner, pick(["comments", "comment-list", "discussion", "responses", "replies", "user-comments"]))

    out, apart = [], np.random.default_rng(41)
    for _ in range(n):
        wanted: set[str] = set()

        def good(text: str) -> str:
            wanted.add(" ".join(html.unescape(text).split()))
            return text

        def para() -> str:
            mess = chance(0.15)
            text = words(1, 4, ".") if chance(0.15) else words(5, 90, ".")
            if mess:
                text = " ".join(w + pick(["***", "%%%", "&amp;&amp;", "$$$", "###", ""]) for w in text.split())
            good(text)
            if chance(0.15):
                a = text.split(" ")
                text = " ".join([*a[:1], f'<a href="/{word()}">{" ".join(a[1:3])}</a>', *a[3:]]) if len(a) > 3 else text
            if chance(0.15):
                return f"<p><b>{text}<br>"
            if chance(0.1):
                return f"<p>{text}"
            return f"<p>{text}</p>"

        def part() -> str:
            return pick([para, para, para, para, para, para, lambda: tag(pick(["h2", "h3"]), good(words(1, 8))), lambda: tag(pick(["ul", "ol"]), "".join(tag("li", good(words(3, 18))) for _ in range(int(rng.integers(2, 5))))), lambda: tag("blockquote", tag("p", good(words(5, 30, "."))) if chance(0.5) else good(words(5, 30, "."))), lambda: tag("pre", good(words(3, 12))), lambda: tag("table", "".join(tag("tr", tag("td", good(words(1, 4))) + tag("td", good(words(1, 4)))) for _ in range(2))), lambda: tag("figure", '<img src="x.png">' + tag("figcaption", good(words(3, 9))))])()

        title = words(2, 12)
        body = tag("h1", good(title)) if chance(0.85) else ""
        for _ in range(int(rng.integers(1, 14))):
            body += part()
            if chance(0.05):
                body += pick([advert, sidebar, notice, form])()
        box = pick([("article", ""), ("article", ""), ("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "article-body"), ("div", "entry-content"), ("section", "story"), ("div", "main"), ("article", "post")])
        body = tag(*(box[0], body), box[1])
        if chance(0.3):
            body = tag(pick(["main", "div"]), body, pick(["", "wrap", "container", "page"]))
        before = [header, menu, menu, advert, notice, form, sidebar]
        after = [footer, remarks, sidebar, advert, notice, form]
        top = "".join(f() for f in before if chance(0.35))
        end = "".join(f() for f in sorted(after, key=lambda _: rng.random()) if chance(0.35)) + (footer() if chance(0.6) else "")
        if chance(0.2):  # the plainest template
            top, end = tag("nav", tag("ul", "".join(tag("li", f'<a href="/x">{words(1, 2)}</a>') for _ in range(int(rng.integers(3, 8)))))) + f"<!-- ad -->{tag('div', words(3, 15, '.'), 'ad')}", tag("footer", f"&copy; {word()}.example.com &middot; {words(3, 12, '.')}")
        if apart.random() < 0.15:  # what is shown where there are no scripts, before or after the article
            said = "<noscript>" + tag(["p", "div"][int(apart.integers(0, 2))], " ".join(syllables[int(i)] + syllables[int(j)] for i, j in apart.integers(0, len(syllables), (int(apart.integers(3, 14)), 2))) + ".") + "</noscript>"
            top, end = (said + top, end) if apart.random() < 0.7 else (top, end + said)
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{top}{body}{end}" + pick(["</body></html>", ""])
        out.append((page, wanted))
    return out
