"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions.

Base spans are leftmost, non-overlapping matches of a pattern for each kind that
pass the kind's test (parts up to 255, Luhn, digit counts); a failing match is
dropped. The network labels characters (outside, or begin/inside of a kind) and
adds spans that the patterns miss, such as addresses written with "(at)" or
numbers without a plus sign. It is trained in numpy on labelled spans that
``labelled_lines`` writes. It reads windows of WINDOW characters, half
overlapping, around the characters that any span of its kinds must have (digits
or an at sign). Connected windows are one stretch, with the mean of the windows'
scores where they overlap, and it is decoded by Viterbi as one sequence; a
stretch with a span at its edge grows until the span ends inside it or the text
does, so no span depends on its place on the grid. Base spans stay always; a span
of the network that overlaps one goes, and so does what a kind's digits rule out.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Of
spans equally sure the first in the text stays. Texts of any length are read whole;
repeated rows are rows, an empty table gives an empty result, and columns beyond
those named in ``keep`` are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.common import CHUNK_BYTES, map_arrow

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, HIDDEN, LINES, STEPS, BATCH = 64, 32, 20, 4000, 420, 48
LEAST_SURE = 0.6

_DIGIT = re.compile("[0-9]")
_EMAIL = re.compile(r"([A-Za-z0-9._%+-]++)(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@(\[{]")
_AT = re.compile(r"(?<=[(\[{])at(?=[)\]}])", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def ip_matches(text: str):
    """Leftmost matches of four dotted numbers. Inside a run of digits a match can only begin at the run's start, unless the last match ended there; then the run is used up."""
    for m in re.finditer(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", text):
        yield m


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _EMAIL.finditer(text) if m[2]]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, m.start(), m.end()) for m in ip_matches(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# The network ------------------------------------------------------------------

#: Characters with a code of their own; letters, capitals, digits, white space and the rest share one each.
MARKS = "@.+-()[]{}:,;=_%/#\"'!|&*$"
LOWER, UPPER, DIGIT, WHITE, REST, PAD = range(len(MARKS) + 1, len(MARKS) + 7)
CODES = len(MARKS) + 7
_CODE = np.full(0x3001, REST, np.int64)
for _c in range(0x3000):
    _s = chr(_c)
    _CODE[_c] = MARKS.index(_s) + 1 if _s in MARKS else DIGIT if "0" <= _s <= "9" else WHITE if _s.isspace() else LOWER if _s.islower() else UPPER if _s.isupper() else REST
TAGS = 1 + 2 * len(KINDS)


def codes(text: str) -> np.ndarray:
    return _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x3000)]


@dataclass
class Network:
    """embed [CODES, e], for each direction wx [e, 4h], wh [h, 4h], b [4h], then out [2h, TAGS], bias, transitions [TAGS, TAGS] and first [TAGS]."""

    p: dict[str, np.ndarray]


def blank_network(rng: np.random.Generator, hidden: int = HIDDEN) -> Network:
    e = 16
    p = {"embed": rng.normal(0, 0.3, (CODES, e)), "out": rng.normal(0, 0.2, (2 * hidden, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
    p["bias"][0] = 1.0
    for d in "fb":
        p["wx" + d], p["wh" + d], p["b" + d] = rng.normal(0, 0.25, (e, 4 * hidden)), rng.normal(0, 0.2, (hidden, 4 * hidden)), np.zeros(4 * hidden)
        p["b" + d][hidden : 2 * hidden] = 1.0
    return Network({k: v.astype(np.float32) for k, v in p.items()})


def _sig(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(x: np.ndarray, wx, wh, b, keep: bool = False):
    """Outputs [T, B, h] of one direction over x [T, B, e]."""
    t, n, h = len(x), x.shape[1], len(wh)
    z = x.reshape(t * n, -1) @ wx
    z = z.reshape(t, n, 4 * h) + b
    hs, c, out, saved = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((t, n, h), np.float32), []
    for i in range(t):
        a = z[i] + hs @ wh
        g = _sig(a)
        g[:, 3 * h :] = np.tanh(a[:, 3 * h :])
        old, c = c, g[:, h : 2 * h] * c + g[:, :h] * g[:, 3 * h :]
        th = np.tanh(c)
        prev, hs = hs, g[:, 2 * h : 3 * h] * th
        out[i] = hs
        if keep:
            saved.append((g, old, th, prev))
    return out, saved


def lstm_back(dout, x, saved, wx, wh):
    t, n, h = dout.shape
    dz, dh, dc = np.empty((t, n, 4 * h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    dwh = np.zeros_like(wh)
    for i in range(t - 1, -1, -1):
        g, old, th, prev = saved[i]
        dh = dh + dout[i]
        dc = dc + dh * g[:, 2 * h : 3 * h] * (1 - th * th)
        d = np.concatenate([dc * g[:, 3 * h :], dc * old, dh * th, dc * g[:, :h]], 1)
        d[:, : 3 * h] *= g[:, : 3 * h] * (1 - g[:, : 3 * h])
        d[:, 3 * h :] *= 1 - g[:, 3 * h :] ** 2
        dz[i] = d
        dwh += prev.T @ d
        dc, dh = dc * g[:, h : 2 * h], d @ wh.T
    flat = dz.reshape(t * n, -1)
    return (flat @ wx.T).reshape(x.shape), x.reshape(t * n, -1).T @ flat, dwh, flat.sum(0)


def emissions(net: Network, ids: np.ndarray, keep: bool = False):
    """Scores [T, B, TAGS] of ids [B, T]."""
    p = net.p
    x = p["embed"][ids.T]
    f, sf = lstm(x, p["wxf"], p["whf"], p["bf"], keep)
    b, sb = lstm(x[::-1], p["wxb"], p["whb"], p["bb"], keep)
    hid = np.concatenate([f, b[::-1]], 2)
    return hid @ p["out"] + p["bias"], (x, hid, sf, sb)


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def crf_tables(em, trans, first):
    """Forward and backward log sums, and each row's log partition."""
    t = len(em)
    a, b = np.empty_like(em), np.zeros_like(em)
    a[0] = em[0] + first
    for i in range(1, t):
        a[i] = em[i] + _lse(a[i - 1][:, :, None] + trans[None], 1)
    for i in range(t - 2, -1, -1):
        b[i] = _lse(trans[None] + (em[i + 1] + b[i + 1])[:, None, :], 2)
    return a, b, _lse(a[-1], 1)


def train(seed: int = 17, lines: int = LINES, steps: int = STEPS) -> Network:
    """A network from labelled_lines, by Adam on the CRF's likelihood."""
    rng = np.random.default_rng(seed)
    net = blank_network(rng)
    data = labelled_lines(rng, lines)
    ids, tags = np.stack([d[0] for d in data]), np.stack([d[1] for d in data])
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for s in range(1, steps + 1):
        part = rng.integers(0, len(ids), BATCH)
        grads = gradient(net, ids[part], tags[part])
        rate = 0.012 * (1 - 0.9 * s / steps)
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            net.p[k] = (net.p[k] - rate * (m1[k] / (1 - 0.9**s)) / (np.sqrt(m2[k] / (1 - 0.99**s)) + 1e-7)).astype(np.float32)
    return net


def gradient(net: Network, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
    p, n, t = net.p, len(ids), ids.shape[1]
    em, (x, hid, sf, sb) = emissions(net, ids, True)
    a, b, z = crf_tables(em, p["trans"], p["first"])
    y = np.eye(TAGS, dtype=np.float32)[tags.T]
    marg = np.exp(a + b - z[None, :, None])
    dem = (marg - y) / n
    dtrans = np.zeros_like(p["trans"])
    for i in range(1, t):
        pair = np.exp(a[i - 1][:, :, None] + p["trans"][None] + (em[i] + b[i])[:, None, :] - z[:, None, None])
        dtrans += pair.sum(0)
    np.add.at(dtrans, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
    g = {"trans": dtrans / n, "first": dem[0].sum(0), "bias": dem.sum((0, 1))}
    h = hid.shape[2] // 2
    g["out"] = hid.reshape(t * n, -1).T @ dem.reshape(t * n, -1)
    dh = dem @ p["out"].T
    dx, g["wxf"], g["whf"], g["bf"] = lstm_back(np.ascontiguousarray(dh[:, :, :h]), x, sf, p["wxf"], p["whf"])
    dxb, g["wxb"], g["whb"], g["bb"] = lstm_back(np.ascontiguousarray(dh[::-1, :, h:]), x[::-1], sb, p["wxb"], p["whb"])
    dx = dx + dxb[::-1]
    g["embed"] = np.zeros_like(p["embed"])
    np.add.at(g["embed"], ids.T.ravel(), dx.reshape(t * n, -1))
    return g


def live_rows(sizes: np.ndarray, t: int) -> np.ndarray:
    """How many of the rows, longest first, have a character at each of t places."""
    return np.searchsorted(-sizes, -np.arange(t), "left")


def marginals(em, trans, first, sizes):
    """Each tag's probability [T, B, TAGS]. Sums are brought to a maximum of 0 at each step, so that a long row's stay exact."""
    t = len(em)
    live = live_rows(sizes, t)
    a, b = np.empty_like(em), np.zeros_like(em)
    a[0] = em[0] + first
    for i in range(1, t):
        k = live[i]
        x = em[i, :k] + _lse(a[i - 1, :k, :, None] + trans[None], 1)
        a[i, :k] = x - x.max(1, keepdims=True)
        a[i, k:] = 0
    for i in range(t - 2, -1, -1):
        k = live[i + 1]
        x = _lse(trans[None] + (em[i + 1, :k] + b[i + 1, :k])[:, None, :], 2)
        b[i, :k] = x - x.max(1, keepdims=True)
    a += b
    return np.exp(a - _lse(a, 2)[:, :, None])


def decode(net: Network, em: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags [B, T] for scores em [T, B, TAGS], and each tag's probability (1 in rows without a span). sizes: the rows' lengths, longest first; beyond them tags are 0."""
    trans, first = net.p["trans"], net.p["first"]
    t, n = em.shape[:2]
    live = live_rows(sizes, t)
    score, back = em[0] + first, np.zeros((t, n, TAGS), np.int8)
    for i in range(1, t):
        k = live[i]
        s = score[:k, :, None] + trans[None]
        back[i, :k] = s.argmax(1)
        s = em[i, :k] + s.max(1)
        score[:k] = s - s.max(1, keepdims=True)
    tags = np.zeros((n, t), np.int64)
    tags[np.arange(n), sizes - 1] = score.argmax(1)
    for i in range(t - 1, 0, -1):
        k = live[i]
        tags[:k, i - 1] = back[i, np.arange(k), tags[:k, i]]
    sure = np.ones((n, t), np.float32)
    some = np.flatnonzero((tags > 0).any(1))  # only these are asked for
    if len(some):
        prob = marginals(np.ascontiguousarray(em[:, some]), trans, first, sizes[some]).transpose(1, 0, 2)
        sure[some] = np.take_along_axis(prob, tags[some][:, :, None], 2)[:, :, 0]
    return tags, sure


# Labelled lines ---------------------------------------------------------------


def labelled_lines(rng: np.random.Generator, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of invented prose with personal data in many spellings and with look-alikes (dates, versions, sums, keys), and their tags."""
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    word = lambda a=2, b=9: "".join(letters[int(rng.integers(0, 26) * rng.random())] for _ in range(int(rng.integers(a, b))))
    digits = lambda k: "".join(str(int(rng.integers(0, 10))) for _ in range(k))
    pick = lambda x: x[int(rng.integers(0, len(x)))]

    def email() -> str:
        host = ".".join([word(2, 8) + (digits(1) if rng.random() < 0.4 else "") for _ in range(int(rng.integers(1, 3)))] + [pick(["com", "org", "net", "de"])])
        user = word() + pick(["", ".", "_", "-"]) + pick([word(), digits(2), ""])
        return user.strip("._-") + pick(["@", "@", "@", "(at)", "[at]", " (at) ", " [at] "]) + host

    def ip() -> str:
        parts = [str(int(rng.integers(0, 256))) for _ in range(4)]
        return pick([".", ".", ".", "[.]"]).join(parts)

    def card() -> str:
        body = digits(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        gap = pick(["", " ", "-", "."])
        return gap.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+{digits(1)} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)}-{a}-{b}{c}", f"{a}.{b}.{c}"])

    def other() -> str:
        return pick([
            lambda: digits(int(rng.integers(1, 9))), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(2)}:{digits(2)}",
            lambda: f"${digits(3)}.{digits(2)}", lambda: f"{digits(int(rng.integers(1, 5)))}.", lambda: word() + "=" + "".join(pick([word(2, 4), digits(2)]) for _ in range(6)), lambda: '"' + "".join(pick([word(1, 3), digits(1)]) for _ in range(9)) + '"',
            lambda: "".join(pick([word(1, 3).upper(), digits(2)]) for _ in range(5)), lambda: digits(int(rng.integers(20, 30))), lambda: "@" + word(), lambda: f"{digits(3)} {word()} {digits(2)}, {digits(1)}", lambda: f"({digits(4)})",
        ])()

    make = (email, ip, card, phone)
    out = []
    for _ in range(n):
        text, marks = "", []
        while len(text) < 2 * WINDOW:
            r = rng.random()
            if r < 0.16:
                k = int(rng.integers(0, 4))
                own = make[k]()
                marks.append((k, len(text), len(text) + len(own)))
                text += own
            elif r < 0.32:
                text += other()
            else:
                w = word()
                text += w.capitalize() if rng.random() < 0.2 else w.upper() if rng.random() < 0.05 else w
            text += pick([" ", " ", " ", " ", ", ", ". ", "\n", "!! "])
        at = int(rng.integers(0, WINDOW))
        tags = np.zeros(len(text), np.int64)
        for k, a, b in marks:
            tags[a:b] = 2 + 2 * k
            tags[a] = 1 + 2 * k
        out.append((codes(text)[at : at + WINDOW], tags[at : at + WINDOW]))
    return out


# Windows and reconciliation -----------------------------------------------------


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a trigger, on a grid of STRIDE from the text's start."""
    found: set[int] = set()
    for m in _TRIGGER.finditer(text):
        if m[0] in "([{" and text[m.end() : m.end() + 3].lower() not in ("at)", "at]", "at}"):
            continue
        g = m.start() // STRIDE
        found.update((g * STRIDE, max(0, g - 1) * STRIDE))
    return sorted(found)


def joined(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Starts and ends of the connected stretches of parts."""
    out: list[tuple[int, int]] = []
    for a, e in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def scores(net: Network, texts: list[str], jobs: list[tuple[int, int, int]], batch: int) -> list[np.ndarray]:
    """Scores [characters, TAGS] of each (text, start, end), whose windows' scores are averaged where they overlap."""
    out, total, coded = [], [], {}
    places = [(j, a) for j, (_, start, end) in enumerate(jobs) for a in range(start, max(start + 1, end - WINDOW + 1), STRIDE)]
    for i, start, end in jobs:
        size = min(end, len(texts[i])) - start
        out.append(np.zeros((size, TAGS), np.float32))
        total.append(np.zeros((size, 1), np.float32))
    for at in range(0, len(places), batch):
        own = places[at : at + batch]
        ids = np.full((len(own), WINDOW), PAD, np.int64)
        for r, (j, a) in enumerate(own):
            if j not in coded:
                coded = {j: codes(texts[jobs[j][0]][jobs[j][1] : jobs[j][2]])}
            c = coded[j][a - jobs[j][1] :][:WINDOW]
            ids[r, : len(c)] = c
        em, _ = emissions(net, ids)
        for r, (j, a) in enumerate(own):
            k = a - jobs[j][1]
            n = len(out[j][k : k + WINDOW])
            out[j][k : k + WINDOW] += em[:n, r]
            total[j][k : k + WINDOW] += 1
    return [x / n for x, n in zip(out, total, strict=True)]


def stretch_spans(net: Network, texts: list[str], jobs: list[tuple[int, int, int]], batch: int) -> list[tuple[list[tuple[float, int, int, int]], bool, bool]]:
    """Of each (text, start, end) the (sureness, kind, start, end) of all spans, and whether one stands at its start or at its end where the text goes on."""
    out: list = [None] * len(jobs)
    order = sorted(range(len(jobs)), key=lambda j: (jobs[j][1] - jobs[j][2], j))
    while order:
        part = order[: max(1, batch * WINDOW // (jobs[order[0]][2] - jobs[order[0]][1]))]
        order = order[len(part) :]
        got = scores(net, texts, [jobs[j] for j in part], batch)
        rank = sorted(range(len(part)), key=lambda r: (-len(got[r]), r))
        part, got = [part[r] for r in rank], [got[r] for r in rank]
        sizes = np.array([len(x) for x in got])
        em = np.zeros((sizes[0], len(part), TAGS), np.float32)
        for r, x in enumerate(got):
            em[: len(x), r] = x
        tags, prob = decode(net, em, sizes)
        some = (tags > 0).any(1)
        for r, j in enumerate(part):
            i, start, _ = jobs[j]
            n, row, spans, k = int(sizes[r]), tags[r].tolist() if some[r] else [], [], 0
            while k < len(row):
                if row[k] == 0:
                    k += 1
                    continue
                kind, e = (row[k] - 1) // 2, k + 1
                while e < n and row[e] == 2 + 2 * kind:
                    e += 1
                spans.append((float(prob[r, k:e].min()), kind, start + k, start + e))
                k = e
            out[j] = spans, bool(row) and row[0] > 0 and start > 0, bool(row) and row[n - 1] > 0 and start + n < len(texts[i])
    return out


#: What an address has, in this order: a letter or digit, a sign, a dot between names.
_NAME, _SIGN, _DOT = (re.compile(p, re.IGNORECASE) for p in (r"[A-Za-z0-9]", r"@|[(\[{]at[)\]}]", r"[A-Za-z0-9]\.[A-Za-z]"))


def plausible(kind: int, own: str) -> bool:
    """What a span of the kind must have, whatever the network says; one pass over it."""
    n = sum(c.isdigit() and c.isascii() for c in own)
    if kind == 0:
        at = 0
        for part in (_NAME, _SIGN, _DOT):  # the first of each leaves most room for the next
            m = part.search(own, at)
            if not m:
                return False
            at = m.end()
        return True
    if kind == 1:
        parts = re.findall("[0-9]+", own)
        return len(parts) == 4 and all(int(p) <= 255 for p in parts if len(p) < 9) and all(len(p) <= 3 for p in parts)
    if kind == 2:
        return 16 <= n <= 19 and luhn(re.sub("[^0-9]", "", own))
    return 9 <= n <= 15 and not re.search("[A-Za-z]", own)


def reconcile(base: list[tuple[int, int, int]], found: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """base, and those of the network's (sureness, kind, start, end) that overlap none of base; by kind, then start. The network's own don't overlap one another: they are runs of one decoding."""
    base_at = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in base_at], list(accumulate((b for _, b in base_at), max))
    out = list(base)
    for _, kind, a, b in found:
        i = bisect_left(starts, b)
        if not i or reach[i - 1] <= a:
            out.append((kind, a, b))
    return sorted(out)


def find_all(net: Network, texts: list[str | None], batch: int = 1024) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    done: list[dict] = [{} for _ in texts]
    read = [_AT.sub("at", t) for t in texts]  # in capitals too
    jobs = [(i, a, e) for i, t in enumerate(texts) for a, e in joined([(a, a + WINDOW) for a in windows(t)])]
    while jobs:
        wide: dict[int, list[tuple[int, int]]] = {}
        for (i, a, e), (spans, at_start, at_end) in zip(jobs, stretch_spans(net, read, jobs, batch), strict=True):
            done[i][a, e] = spans
            if at_start or at_end:  # twice as wide, so that a long span takes few rounds
                wide.setdefault(i, []).append((max(0, a - (e - a) * at_start), e + (e - a) * at_end))
        jobs = []
        for i, own in wide.items():
            now = joined([*done[i], *own])
            jobs += [(i, a, e) for a, e in now if (a, e) not in done[i]]
            done[i] = {x: done[i][x] for x in now if x in done[i]}
    found = [[s for spans in own.values() for s in spans if s[0] >= LEAST_SURE and plausible(s[1], t[s[2] : s[3]])] for t, own in zip(texts, done, strict=True)]
    return [(b, reconcile(b, f)) for b, f in zip(base, found, strict=True)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; spans that overlap become one, of the first's kind."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, n_<kind> (base spans), base and spans (as kind:start:end, comma-joined) and masked text of each row."""
    kinds, shared = dict(docs.dtypes), docs.sparkSession.sparkContext.broadcast(net)

    def make():
        n = shared.value

        def step(part):
            own = part.column("_text").to_pylist()
            got = find_all(n, own)
            return {c: part.column(c) for c in keep} | {f"n_{k}": [sum(s[0] == i for s in b) for b, _ in got] for i, k in enumerate(KINDS)} | {
                "base": [written(b) for b, _ in got],
                "base_sha256": [hashlib.sha256(written(b).encode()).hexdigest() for b, _ in got],
                "spans": [written(s) for _, s in got],
                "masked": [None if t is None else mask(t, s) for t, (_, s) in zip(own, got, strict=True)],
            }

        return step

    names = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return map_arrow(docs.select(*keep, F.col(text).alias("_text")), make, f"{names}, {', '.join(f'n_{k} long' for k in KINDS)}, base string, base_sha256 string, spans string, masked string", most_bytes=8 * CHUNK_BYTES)
