"""Fill-in-middle: each text is cut in three, and the middle is moved to its end.

A unit is a run of ASCII letters or any other code point. One scan over a batch's
bytes by a table does all there is to see: UTF-8 continuation bytes open nothing, a
letter after a letter opens nothing, and the three bytes of a sentinel end in a mark.
A byte is a function of the automaton's seven states; the functions that come up make
a small monoid, so a blocked scan composes them by look-up and finds the state before
every byte. The scan leaves a bit for each unit that opens and counts for each block;
the second pass finds a cut, the k-th unit of a text, by its block's count and then in
that block's bits alone.

Null text counts as empty; an empty text is plain. A null key is hashed as an empty
decimal. Equal rows are cut alike. A text of any length is scanned in segments, with
one bit and a part of a count a byte beside it. Bytes that aren't UTF-8 are units of
their own. Nothing is shuffled; repeated rows are rows, an empty table gives an empty
result, and columns beyond those named are not read, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.common import map_arrow, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of bytes.
LETTER, MARK, LEFT, RIGHT, OTHER, TAIL, LEAD2, LEAD3, LEAD4 = range(9)
#: States: between units, in a run of letters, after "<", after "<" and a sentinel's letter, and 1 to 3 continuation bytes to come.
PLAIN, RUN, OPENED, NAMED, NEED1, NEED2, NEED3 = range(7)
#: What a byte does: a unit opens, a sentinel ends.
UNIT, SENTINEL = 1, 2
BLOCK = 256
#: Bytes that are scanned at once.
SEGMENT = 1 << 20


@lru_cache(1)
def byte_classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    letters = np.r_[65:91, 97:123]
    out[letters] = LETTER
    out[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = MARK
    out[ord("<")], out[ord(">")] = LEFT, RIGHT
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:] = TAIL, LEAD2, LEAD3, LEAD4
    return out


@lru_cache(1)
def table() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission of each state (row) and class (column)."""
    to, out = np.full((7, 9), PLAIN, np.uint8), np.full((7, 9), UNIT, np.uint8)
    to[:, [LETTER, MARK]] = RUN
    to[:, LEFT] = OPENED
    to[OPENED, MARK] = NAMED
    to[:, [LEAD2, LEAD3, LEAD4]] = NEED1, NEED2, NEED3
    to[[NEED2, NEED3], TAIL] = NEED1, NEED2
    for state in (RUN, NAMED):
        out[state, [LETTER, MARK]] = 0
    out[NAMED, RIGHT] |= SENTINEL
    out[[NEED1, NEED2, NEED3], TAIL] = 0
    return to, out


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state functions that sequences of bytes can be: the number of each class's (and of each class's after a text's start), the state that a function gives, and the function of two in turn. The last one is the identity."""
    to, _ = table()
    single = [tuple(to[:, c]) for c in range(9)] + [(to[PLAIN, c],) * 7 for c in range(9)]
    found = {f: i for i, f in enumerate(dict.fromkeys(single))}
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in single:
            both = tuple(g[s] for s in f)
            if both not in found:
                found[both] = len(found)
                todo.append(both)
    found.setdefault(tuple(range(7)), len(found))
    gives = np.array(list(found), np.uint8)
    one = list(found)
    both = np.array([[found[tuple(g[s] for s in f)] for g in one] for f in one], np.uint8)
    return np.array([found[f] for f in single], np.uint8), gives, both


class Scan:
    """One pass over texts that stand one after another: bits of opening units, counts of units before each block and text, sentinels before each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.n, self.offsets = n, offsets
        size = np.diff(offsets)
        first = offsets[:-1][size > 0]
        self.bits = np.zeros(-(-n // 8), np.uint8)
        self.before_block = np.zeros(-(-n // BLOCK) + 1, np.int64)
        units, marks = np.zeros(len(first) + 1, np.int64), np.zeros(len(first) + 1, np.int64)
        state = total = seen = 0
        for a in range(0, n, SEGMENT):
            b = min(n, a + SEGMENT)
            lo, hi = np.searchsorted(first, [a, b])
            out, state = self._segment(data[a:b], first[lo:hi] - a, state)
            unit = (out & UNIT).astype(bool)
            self.bits[a // 8 : -(-b // 8)] = np.packbits(unit)
            blocks = np.add.reduceat(unit, np.arange(0, b - a, BLOCK), dtype=np.int64)
            self.before_block[a // BLOCK + 1 : a // BLOCK + 1 + len(blocks)] = total + np.cumsum(blocks)
            if hi > lo:
                units[lo:hi] = total + np.concatenate([[0], np.cumsum(unit, dtype=np.int64)])[first[lo:hi] - a]
                ends = np.flatnonzero(out & SENTINEL)
                marks[lo:hi] = seen + np.searchsorted(ends, first[lo:hi] - a)
            total += int(unit.sum())
            seen += int(np.count_nonzero(out & SENTINEL))
        units[-1], marks[-1] = total, seen
        filled = np.flatnonzero(size > 0)
        self.base, self.count, self.marked = np.zeros((3, len(size)), np.int64)
        self.base[filled], self.count[filled], self.marked[filled] = units[:-1], np.diff(units), np.diff(marks)

    @staticmethod
    def _segment(data: np.ndarray, first: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """What each byte emits, and the state after the last."""
        of, gives, both = monoid()
        _, out = table()
        n = len(data)
        kind = byte_classes()[data]
        blocks = -(-n // BLOCK)
        code = np.full(blocks * BLOCK, len(gives) - 1, np.uint8)
        code[:n] = of[kind]
        code[first] = of[kind[first] + 9]
        run = np.ascontiguousarray(code.reshape(blocks, BLOCK).T)
        for k in range(1, BLOCK):
            run[k] = both[run[k - 1], run[k]]
        whole, step = run[-1].copy(), 1
        while step < blocks:
            whole[step:] = both[whole[:-step], whole[step:]]
            step *= 2
        entry = np.empty(blocks, np.uint8)
        entry[0], entry[1:] = state, gives[whole[:-1], state]
        after = np.empty(blocks * BLOCK + 1, np.uint8)
        after[0] = state
        after[1:] = gives[run, entry[None, :]].T.reshape(-1)
        before = after[:n]
        before[first] = PLAIN
        return out[before, kind], int(after[n])

    def cuts(self, text: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The byte where the given unit (from 0) of each given text opens, or its end where there are so many."""
        at = self.offsets[text + 1].copy()
        inner = np.flatnonzero(unit < self.count[text])
        if len(inner):
            rank = self.base[text[inner]] + unit[inner]
            block = np.searchsorted(self.before_block, rank, "right") - 1
            place = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
            bits = np.where(place < len(self.bits), self.bits[np.minimum(place, len(self.bits) - 1)], np.uint8(0))
            nth = np.cumsum(np.unpackbits(bits, axis=1), axis=1, dtype=np.int64)
            at[inner] = block * BLOCK + np.argmax(nth > (rank - self.before_block[block])[:, None], axis=1)
        return at


def draws(key: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits from a hash of the seed and the row's key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, transformed: int = 90, suffix_first: int = 20) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output of each row of docs.

    n is the text's number of units. ``transformed`` of a hundred texts aren't left plain, of these ``suffix_first`` of a
    hundred are spm, the others psm; a text with a sentinel stays plain.
    """
    kinds = dict(docs.dtypes)
    marks = {c: s.encode() for c, s in zip("psm", (PREFIX, SUFFIX, MIDDLE), strict=True)}

    def make():
        def step(part):
            data, offsets = utf8(part.column("_text"))
            scan = Scan(data, offsets)
            h = [part.column(f"_h{i}").to_numpy() for i in range(4)]
            a, b = h[0] % (scan.count + 1), h[1] % (scan.count + 1)
            plain = (scan.count == 0) | (scan.marked > 0) | (h[2] % 100 >= transformed)
            spm = h[3] % 100 < suffix_first
            rows = np.flatnonzero(~plain)
            low = scan.cuts(rows, np.minimum(a, b)[rows])
            high = scan.cuts(rows, np.maximum(a, b)[rows])
            outputs, prefix, middle = [], [None] * part.num_rows, [None] * part.num_rows
            raw = memoryview(data)
            place = dict(zip(rows.tolist(), zip(low.tolist(), high.tolist(), strict=True), strict=True))
            for i, (at, end) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                if i not in place:
                    outputs.append(raw[at:end].tobytes())
                    continue
                x, y = place[i]
                cut = {"p": raw[at:x], "m": raw[x:y], "s": raw[y:end]}
                outputs.append(b"".join(s for c in ("spm" if spm[i] else "psm") for s in (marks[c], cut[c])))
                prefix[i], middle[i] = code_points(data[at:x]), code_points(data[x:y])
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            return {key: part.column(key), "n": scan.count, "form": form.tolist(), "prefix_chars": prefix, "middle_chars": middle, "output": pa.array(outputs, pa.binary()).view(pa.string())}

        return step

    rows = docs.select(key, F.col(text).alias("_text"), *[h.alias(f"_h{i}") for i, h in enumerate(draws(key, seed))])
    return map_arrow(rows, make, f"`{key}` {kinds[key]}, n long, form string, prefix_chars long, middle_chars long, output string")


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of: its parts lie between the sentinels, which a transformed text has once each."""
    second = F.when(form == "spm", F.locate(PREFIX, output)).otherwise(F.locate(SUFFIX, output))
    third = F.locate(MIDDLE, output)
    front = F.substring(output, F.lit(4), second - 4)
    back = F.substring(output, second + 3, third - second - 3)
    middle = F.substring(output, third + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "spm", F.concat(back, middle, front)).otherwise(F.concat(front, middle, back))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256, the text rebuilt from each output."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))
