"""Byte-level BPE encoding and decoding without a regular expression.

A table gives each code point its class; the only thing that a neighbour does
not settle, whether an apostrophe opens a piece, is the state of a four-state
automaton. Each symbol is a transition function, four states of two bits in a
byte; composing two is a look-up, composing is associative, so a blocked scan
finds the state before every position. Slices between boundaries are merged by
rank and kept in a bounded cache; their places in the text are kept as well.

Null text counts as empty; an empty text has no ids. Any text is encoded whole: one
of more than PART_CHARS is cut where a blank stands between two Latin letters, which
is a boundary whatever surrounds it, so what it takes doesn't grow with a multiple of
its length. Of equal ranks the first pair is merged. Repeated rows are rows, an empty
table gives an empty result, and columns beyond those named are not read, whatever
their names. Letters and numbers are those of this Python's Unicode tables (version
15.1 in Python 3.13), which tests hold against the library's for every code point.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.common import map_arrow

#: Classes of code points.
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE = range(6)
#: States: plain, after a blank, inside a run of other characters, after an apostrophe that opens a piece.
PLAIN, AFTER_BLANK, INSIDE, OPEN = range(4)
#: The white space of the pattern's \s.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces that a worker keeps at most.
CACHE_PIECES = 400_000
#: Characters from which on a text is encoded in parts.
PART_CHARS = 1 << 19
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
BLOCK = 256


@lru_cache(1)
def class_table() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(sys.maxunicode + 1):
        out[c] = kinds.get(unicodedata.category(chr(c))[0], OTHER)
    out[WHITE] = SPACE
    out[0x20], out[0x27] = BLANK, QUOTE
    return out


def _function(to: list[int]) -> int:
    return sum(s << (2 * i) for i, s in enumerate(to))


@lru_cache(1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """The function code of each class, and the table that composes two codes (first, then)."""
    of = np.zeros(6, np.uint8)
    of[[LETTER, NUMBER, SPACE]] = _function([PLAIN] * 4)
    of[BLANK] = _function([AFTER_BLANK] * 4)
    of[OTHER] = _function([INSIDE] * 4)
    of[QUOTE] = _function([OPEN, INSIDE, INSIDE, INSIDE])
    code = np.arange(256)
    part = np.stack([(code >> (2 * s)) & 3 for s in range(4)])
    both = np.zeros((256, 256), np.int64)
    for s in range(4):
        both |= ((code[None, :] >> (2 * part[s][:, None])) & 3) << (2 * s)
    return of, both.astype(np.uint8)


def states_before(codes: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """The state before each position, from its function codes; reset marks texts' first positions (PLAIN before them)."""
    _, both = transitions()
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint8)
    blocks = -(-n // BLOCK)
    identity = np.uint8(_function([0, 1, 2, 3]))
    padded = np.full(blocks * BLOCK, identity, np.uint8)
    padded[:n] = codes
    # a text's first symbol starts from PLAIN whatever came before: its function is constant
    first = padded[reset] & 3
    padded[reset] = first * 0x55
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    run = np.empty_like(columns)
    run[0] = columns[0]
    for k in range(1, BLOCK):
        run[k] = both[run[k - 1], columns[k]]
    total, carry, step = run[-1].copy(), run[-1].copy(), 1
    while step < blocks:  # scan over the blocks' functions
        carry[step:] = both[total[:-step], total[step:]]
        total, step = carry.copy(), step * 2
    before = np.zeros(blocks, np.uint8)
    before[1:] = total[:-1] & 3
    after = (run >> (2 * before)[None, :]) & 3
    out = np.empty(blocks * BLOCK, np.uint8)
    out[1:] = after.T.reshape(-1)[:-1]
    out[0] = PLAIN
    out = out[:n]
    out[reset] = PLAIN
    return out


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pieces, over texts that stand one after another; first has the texts' first positions (of texts that aren't empty)."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[points]
    of, _ = transitions()
    state = states_before(of[kind], first)
    begin = np.zeros(n, bool)
    begin[first] = True
    white = (kind == SPACE) | (kind == BLANK)
    group = np.where(white, SPACE, np.where(kind == QUOTE, OTHER, kind))
    start = begin.copy()
    start[1:] |= group[1:] != group[:-1]
    ends = np.zeros(n, bool)  # the last of a text
    ends[first[1:] - 1] = True
    ends[-1] = True
    # a blank before another class goes with what follows: the start moves one place back
    glued = np.zeros(n, bool)
    glued[1:] = (kind[:-1] == BLANK) & ~white[1:] & ~begin[1:]
    piece = start & ~glued
    # the last of several white characters stands apart when something follows
    tail = np.zeros(n, bool)
    tail[:-1] = white[:-1] & ~white[1:] & ~ends[:-1]
    piece |= tail
    # 's 't 're 've 'm 'll 'd, where the apostrophe opens a piece
    quote = np.flatnonzero((kind == QUOTE) & (state == PLAIN))
    quote = quote[quote + 1 < n]
    quote = quote[~begin[quote + 1]]
    if len(quote):
        a = points[quote + 1]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two_ok = (quote + 2 < n) & ~begin[np.minimum(quote + 2, n - 1)]
        b = points[np.minimum(quote + 2, n - 1)]
        two = two_ok & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        piece[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two] + 3])
        piece[after[after < n]] = True
    return np.flatnonzero(piece)


class Codec:
    """Encodes pieces by rank and decodes ids; keeps up to CACHE_PIECES pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.bytes[v] = k
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        ranks = self.ranks
        if raw in ranks:
            return (ranks[raw],)
        if len(raw) > 400:
            return self._merge_long(raw)
        get, none = ranks.get, len(ranks) + 1
        at = list(range(len(raw) + 1))
        pair = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pair:
            best = min(pair)
            if best == none:
                break
            i = pair.index(best)
            del at[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(raw[at[i] : at[i + 2]], none)
            if i:
                pair[i - 1] = get(raw[at[i - 1] : at[i + 1]], none)
        return tuple(ranks[raw[i:j]] for i, j in zip(at, at[1:]))

    def _merge_long(self, raw: bytes) -> tuple[int, ...]:
        """The same by a heap and a linked list, for pieces of any length."""
        import heapq

        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))
        prev, alive = list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                r = ranks.get(raw[i : end[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                prev[stop] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return tuple(ranks[raw[i : end[i]]] for i in range(n) if alive[i])

    def encode_all(self, texts: list[str]) -> tuple[list[list[int]], list[np.ndarray]]:
        """Ids of each text, and where its pieces start (code points)."""
        if max(map(len, texts), default=0) <= PART_CHARS:
            return self._encode(texts)
        ids, places = [], []
        for t in texts:
            own, at, a = [], [], 0
            while a < len(t) or not t:
                m = _CUT.search(t, a + PART_CHARS) if len(t) - a > PART_CHARS else None
                end = m.start() if m else len(t)
                (x,), (p,) = self._encode([t[a:end]])
                own += x
                at.append(p + a)
                a = end
                if not t:
                    break
            ids.append(own)
            places.append(np.concatenate(at))
        return ids, places

    def _encode(self, texts: list[str]) -> tuple[list[list[int]], list[np.ndarray]]:
        whole = "".join(texts)
        size = np.array([len(t) for t in texts], np.int64)
        offset = np.concatenate([[0], np.cumsum(size)])
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        start = boundaries(points, offset[:-1][size > 0])
        stop = np.append(start[1:], len(points))
        at = np.searchsorted(start, offset).tolist()
        a, b = start.tolist(), stop.tolist()
        pieces = [whole[i:j] for i, j in zip(a, b)]
        found = list(map(self.cache.get, pieces))
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = self.lookup(pieces[i])
        ids = [list(chain.from_iterable(found[i:j])) for i, j in zip(at, at[1:])]
        return ids, [start[i:j] - o for i, j, o in zip(at, at[1:], offset)]

    def lookup(self, piece: str) -> tuple[int, ...]:
        """Of a piece that the younger cache lacks; when that is full it becomes the older one."""
        got = self.cache.get(piece) or self.older.get(piece) or self.merge(piece)
        if len(piece) <= 64:
            if len(self.cache) >= CACHE_PIECES // 2:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = got
        return got

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, ids array<int>, piece_starts array<int> (code points) of each row of docs."""
    kinds = dict(docs.dtypes)

    def make():
        codec = Codec(vocabulary)

        def step(part):
            texts = [t or "" for t in part.column("_text").to_pylist()]
            ids, places = codec.encode_all(texts)
            return {c: part.column(c) for c in keep} | {"ids": ids, "piece_starts": [p.tolist() for p in places]}

        return step

    return map_arrow(docs.select(*keep, F.col(text).alias("_text")), make, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ids array<int>, piece_starts array<int>")


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text and decodes its ids again."""

    def make():
        codec = Codec(vocabulary)
        word = codec.decimal

        def step(part):
            ids, _ = codec.encode_all([t or "" for t in part.column("_text").to_pylist()])
            return {
                "doc_id": part.column("doc_id"),
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(" ".join([word[i] for i in x]).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
            }

        return step

    return map_arrow(docs.select("doc_id", F.col("text").alias("_text")), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
