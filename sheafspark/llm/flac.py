"""FLAC streams of one channel: encoded, decoded and verified many frames at a time.

Samples have eight bits and frames 192 samples. Bytes are companded: the n-th of
COMMON stands for amplitude 0, -1, 1, -2 and so on, the rest for the larger ones, so
that text has a small amplitude, which Rice codes are made for; a metadata block of
each stream says so. The encoder takes, frame by frame, the best of the fixed
predictors of order 0 to 2 and a quantised linear predictor of order 2, and writes
the residuals as Rice codes, or the samples as they are where codes would be longer,
so no frame is longer than its samples by more than a header. A stream's seek table
says where every SEEK_FRAMES-th frame begins. The decoder goes by the seek table in runs of frames: in a run it
finds frames by their sync code and header checksum, walks the Rice codes of all
frames together, one sample a step, undoes the predictors and verifies each
frame's CRC-16, and over the whole stream its MD5. Runs of many streams are decoded
together, and a long stream run after run, so memory doesn't grow with its length.

``store`` writes streams; ``pcm_blocks`` gives a stream's samples as blocks with the
offset of their first sample, all of them or only those that hold given samples;
``digest`` reads stored streams and takes checksums and features from the same
blocks. The decoder reads what ``encode`` writes and streams like it: one channel of
eight bits, frames of 192 samples, verbatim subframes, fixed and linear predictors, one Rice partition.

A damaged stream raises ValueError; nothing is returned in part. An empty or
null text is stored as one block of 192 blanks, equal texts as equal streams.
Repeated rows and rows without a key are rows; an empty table gives an empty result;
columns beyond key and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sheafspark.llm.common import map_arrow, slices

#: Bytes in the order of their amplitudes, about as often as text has them; those not named follow in ascending order.
COMMON = b" etaoinshrdlcumwfgypbvk.,xjqz\n" + bytes([0xC3]) + b"THISANDOERLCMBPWFGUYVKJQXZ0123456789-'\""
_RANKED = np.array([*COMMON, *(b for b in range(256) if b not in COMMON)], np.int16)
#: The sample of each byte, and the byte of each sample (by sample + 128).
SAMPLE, BYTE = np.zeros(256, np.int16), np.zeros(256, np.uint8)
SAMPLE[_RANKED] = [-(r + 1) // 2 if r % 2 else r // 2 for r in range(256)]
BYTE[SAMPLE + 128] = np.arange(256)

#: The metadata block (application data) that says that samples stand for bytes by COMMON.
COMPANDED = bytes([0x02, 0, 0, 5]) + b"SHFC" + bytes([1])

BLOCK, RATE_CODE, RATE = 192, 4, 8000
PAD, TAIL = 32, 16
LPC_BITS, LPC_SHIFT, MOST_RICE = 6, 4, 14
#: Frames between seek points, and frames that are encoded or decoded together (runs of several streams, or part of one).
SEEK_FRAMES, RUN_FRAMES = 256, 4096
HEAD = bytes([0xFF, 0xF8, (1 << 4) | RATE_CODE, (0 << 4) | (1 << 1)])


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (bits - 1) & 1 else c << 1) & ((1 << bits) - 1)
        out[i] = c
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The checksums of many slices of data, a byte a step."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    out = np.zeros(len(at), np.uint32)
    mask, shift = np.uint32((1 << bits) - 1), np.uint32(bits - 8)
    live = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), "right")
    for i, n in enumerate(live.tolist()):
        c = out[:n]
        out[:n] = ((c << np.uint32(8)) & mask) ^ table[(c >> shift) ^ data[at[:n] + i]]
    back = np.empty_like(out)
    back[order] = out
    return back


def signed(raw: np.ndarray) -> bytes:
    """The samples of bytes, as a stream's MD5 takes them."""
    return SAMPLE[raw].astype(np.int8).tobytes()


def _coded(n: int) -> bytes:
    return chr(n).encode("utf-8", "surrogatepass") if n < 0x10000 else bytes([0xF0 | n >> 18, *(0x80 | n >> s & 63 for s in (12, 6, 0))]) if n < 1 << 21 else bytes([0xF8 | n >> 24, *(0x80 | n >> s & 63 for s in (18, 12, 6, 0))])


def _lpc(x: np.ndarray) -> np.ndarray:
    """Order-2 coefficients of each frame, quantised."""
    a = x.astype(np.float64)
    r0, r1, r2 = (a * a).sum(1) + 1e-9, (a[:, 1:] * a[:, :-1]).sum(1), (a[:, 2:] * a[:, :-2]).sum(1)
    det = r0 * r0 - r1 * r1 + 1e-9
    c = np.stack([(r1 * r0 - r1 * r2) / det, (r0 * r2 - r1 * r1) / det], 1)
    top = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(c * (1 << LPC_SHIFT)), -top - 1, top).astype(np.int64)


def residuals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals of each frame (warm-up samples left as they are), the predictor taken (0 to 2 fixed, 3 linear) and its coefficients."""
    x = x.astype(np.int64)
    kinds = [x, np.diff(x, axis=1, prepend=0), None, None]
    kinds[2] = np.diff(kinds[1], axis=1, prepend=0)
    coef = _lpc(x)
    lin = x.copy()
    lin[:, 2:] -= (coef[:, :1] * x[:, 1:-1] + coef[:, 1:] * x[:, :-2]) >> LPC_SHIFT
    kinds[3] = lin
    warm = (0, 1, 2, 2)
    cost = np.stack([np.abs(k[:, w:]).sum(1) + 8 * w for k, w in zip(kinds, warm, strict=True)])
    cost[3] += 40
    best = cost.argmin(0)
    out = np.stack(kinds)[best, np.arange(len(x))]
    for b in (1, 2):
        rows = best == b
        out[rows, : warm[b]] = x[rows, : warm[b]]
    return out, best, coef


@lru_cache(1 << 16)
def frame_head(n: int) -> bytes:
    """The header of frame n, with its checksum."""
    h = HEAD + _coded(n)
    return h + bytes([int(crcs(np.frombuffer(h, np.uint8), np.array([0]), np.array([len(h)]), CRC8, 8)[0])])


def encode_frames(pcm: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The frames of pcm, whose numbers in their streams are given, one after another, and their sizes."""
    x = SAMPLE[pcm].reshape(-1, BLOCK)
    res, kind, coef = residuals(x)
    warm = np.array([0, 1, 2, 2])[kind]
    zig = np.where(res >= 0, 2 * res, -2 * res - 1)
    coded = np.arange(BLOCK)[None, :] >= warm[:, None]
    mean = np.where(coded, zig, 0).sum(1) / (BLOCK - warm)
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, MOST_RICE).astype(np.int64)
    q = zig >> k[:, None]
    bits = np.where(coded, q + 1 + k[:, None], 8)  # a warm-up sample is written as it is
    heads = [frame_head(n) for n in number.tolist()]
    size = np.array([len(h) for h in heads])
    linear = kind == 3
    extra = np.where(linear, 4 + 5 + 2 * LPC_BITS, 0)
    sub = 8 + extra + 10 + bits.sum(1)
    # a frame that codes would make longer is written sample by sample
    plain = sub > 8 + 8 * BLOCK
    warm, linear, coded = np.where(plain, BLOCK, warm), linear & ~plain, coded & ~plain[:, None]
    bits[plain], extra[plain], sub[plain] = 8, 0, 8 + 8 * BLOCK
    total = size + (sub + 7) // 8 + 2
    first = np.cumsum(total) - total
    out = np.zeros(int(total.sum()) * 8, np.uint8)
    # places of the samples: warm-up, then predictor and Rice parameters, then codes
    begin = (first + size) * 8
    add = np.where(coded, (extra + 10)[:, None], 0) + 8
    place = begin[:, None] + np.cumsum(bits, axis=1) - bits + add

    def write(at: np.ndarray, value: np.ndarray, n: int) -> None:
        for j in range(n):
            out[at + j] = (value >> (n - 1 - j)) & 1

    write(begin, np.where(plain, 1 << 1, np.where(linear, (32 | 1) << 1, (8 | kind) << 1)), 8)
    for i in range(2):
        rows = (warm > i) & ~plain
        write(place[rows, i], x[rows, i].astype(np.int64) & 255, 8)
    if plain.any():
        write(place[plain], x[plain].astype(np.int64) & 255, 8)
    after = begin + 8 + 8 * warm
    if linear.any():
        at = after[linear]
        write(at, np.full(len(at), LPC_BITS - 1), 4)
        write(at + 4, np.full(len(at), LPC_SHIFT), 5)
        write(at + 9, coef[linear, 0] & ((1 << LPC_BITS) - 1), LPC_BITS)
        write(at + 9 + LPC_BITS, coef[linear, 1] & ((1 << LPC_BITS) - 1), LPC_BITS)
    write((after + extra + 6)[~plain], k[~plain], 4)
    stop = place + q
    out[stop[coded]] = 1
    for j in range(int(k.max(initial=0))):
        rows = coded & (k > j)[:, None]
        out[(stop + k[:, None] - j)[rows]] = (zig[rows] >> j) & 1
    data = np.packbits(out)
    lead = np.frombuffer(b"".join(heads), np.uint8)
    data[np.arange(len(lead)) + np.repeat(first - (np.cumsum(size) - size), size)] = lead
    check = crcs(data, first, total - 2, CRC16, 16)
    data[first + total - 2], data[first + total - 1] = check >> 8, check & 255
    return data.tobytes(), total


def parts(sizes: list[int], most: int = RUN_FRAMES, step: int = SEEK_FRAMES) -> Iterator[list[tuple[int, int, int]]]:
    """(stream, first frame, end frame) in lists of at most about ``most`` frames; only multiples of step cut a stream."""
    own, n = [], 0
    for i, size in enumerate(sizes):
        at = 0
        while at < size:
            end = min(size, at + max(step, (most - n) // step * step))
            own.append((i, at, end))
            n, at = n + end - at, end
            if n >= most:
                yield own
                own, n = [], 0
    if own:
        yield own


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload; a payload's length is a multiple of BLOCK and not 0."""
    bodies, sizes = [[] for _ in payloads], [[] for _ in payloads]
    for run in parts([len(p) // BLOCK for p in payloads]):
        pcm = np.frombuffer(b"".join([payloads[i][a * BLOCK : e * BLOCK] for i, a, e in run]), np.uint8)
        body, size = encode_frames(pcm, np.concatenate([np.arange(a, e) for _, a, e in run]))
        at = f = 0
        for i, a, e in run:
            own = size[f : f + e - a]
            bodies[i].append(body[at : at + int(own.sum())])
            sizes[i].append(own)
            at, f = at + int(own.sum()), f + e - a
    out = []
    for p, body, size in zip(payloads, bodies, sizes, strict=True):
        own, md5 = np.concatenate(size), hashlib.md5()
        for a in range(0, len(p), 1 << 20):
            md5.update(signed(np.frombuffer(p, np.uint8, min(1 << 20, len(p) - a), a)))
        out.append(b"".join([stream_info(len(p), int(own.min()), int(own.max()), md5.digest()), COMPANDED, seek_table(own), *body]))
    return out


def seek_table(sizes: np.ndarray) -> bytes:
    """The metadata block that says where every SEEK_FRAMES-th frame begins."""
    first = (np.cumsum(sizes) - sizes)[::SEEK_FRAMES].tolist()
    return bytes([0x83]) + (18 * len(first)).to_bytes(3, "big") + b"".join((k * SEEK_FRAMES * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for k, at in enumerate(first))


def stream_info(samples: int, least: int, most: int, md5: bytes) -> bytes:
    packed = RATE << 44 | 0 << 41 | 7 << 36 | samples
    return b"fLaC" + bytes([0x00, 0, 0, 34]) + BLOCK.to_bytes(2, "big") * 2 + least.to_bytes(3, "big") + most.to_bytes(3, "big") + packed.to_bytes(8, "big") + md5


def _number(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded frame numbers at ``at``, and how many bytes they take (0: not a number)."""
    b0 = data[at].astype(np.int64)
    n = np.select([b0 < 0x80, b0 >> 5 == 6, b0 >> 4 == 14, b0 >> 3 == 30, b0 >> 2 == 62], [1, 2, 3, 4, 5], 0)
    value = np.where(n == 1, b0, b0 & ((1 << np.maximum(6 - n + 1, 0)) - 1))
    for i in range(1, 5):
        more = n > i
        nxt = data[np.minimum(at + i, len(data) - 1)].astype(np.int64)
        value = np.where(more, value << 6 | (nxt & 63), value)
        n = np.where(more & (nxt >> 6 != 2), 0, n)
    return value, n


def find_frames(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers and header sizes of the frames in data, by sync code and header checksum."""
    at = np.flatnonzero((data[:-6] == HEAD[0]) & (data[1:-5] == HEAD[1]) & (data[2:-4] == HEAD[2]) & (data[3:-3] == HEAD[3])) if len(data) > 6 else np.zeros(0, np.int64)
    number, n = _number(data, at + 4)
    good = (n > 0) & (at + 4 + n < len(data))
    at, number, n = at[good], number[good], n[good]
    good = crcs(data, at, n + 4, CRC8, 8) == data[at + 4 + n]
    return at[good], number[good], n[good] + 5


class Bits:
    """Reads fields of up to 16 bits at many places, and finds the next set bit of each."""

    def __init__(self, data: np.ndarray):
        b = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
        self.wide = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        ones = np.unpackbits(data)
        at = np.where(ones, np.arange(len(ones), dtype=np.int32), np.int32(len(ones)))
        self.next = np.minimum.accumulate(at[::-1])[::-1]
        self.n = len(ones)

    def take(self, at: np.ndarray, n) -> np.ndarray:
        n = np.asarray(n, np.uint32)
        got = (self.wide[at >> 3] << (at & 7).astype(np.uint32)) >> (np.uint32(31) - np.maximum(n, 1) + np.uint32(1))
        return np.where(n > 0, got, 0).astype(np.int64)


class Stream:
    """A stored stream: its length in samples, MD5, and where its frames and seek points are."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"fLaC" or raw[4] & 0x7F or len(raw) < 42:
            raise ValueError("not a stream that this decoder reads")
        self.raw, self.samples, self.md5 = raw, int.from_bytes(raw[18:26], "big") & ((1 << 36) - 1), raw[26:42]
        self.frames, at, last, points, said = self.samples // BLOCK, 42, raw[4] & 0x80, [], False
        while not last:
            if at + 4 > len(raw):
                raise ValueError("the metadata is cut off")
            last, kind, size = raw[at] & 0x80, raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
            said = said or kind == 2 and raw[at + 4 : at + 4 + size] == COMPANDED[4:]
            if kind == 3:
                points = [(int.from_bytes(raw[p : p + 8], "big") // BLOCK, int.from_bytes(raw[p + 8 : p + 16], "big")) for p in range(at + 4, at + 4 + size, 18)]
            at += 4 + size
        if not said:
            raise ValueError("the stream doesn't say which bytes its samples stand for")
        if points and [k for k, _ in points] != list(range(0, self.frames, SEEK_FRAMES)):
            raise ValueError("the seek table is damaged or another's")
        points = points or [(0, 0)]
        self.points = {k: at + p for k, p in points}

    def body(self, first: int, end: int) -> bytes:
        """The bytes of the frames from a seek point to the one at or after ``end``."""
        stop = -(-end // SEEK_FRAMES) * SEEK_FRAMES
        return self.raw[self.points[first] : self.points.get(stop, len(self.raw))]


def read_runs(streams: list[Stream], wanted: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(stream, first sample, PCM bytes) of runs of frames, in order; of the whole streams, or of the frames from wanted's first to its end, widened to seek points. Frame checksums are verified."""
    spans = wanted or [(0, s.frames) for s in streams]
    spans = [(a // SEEK_FRAMES * SEEK_FRAMES if len(s.points) > 1 else 0, min(s.frames, -(-e // SEEK_FRAMES) * SEEK_FRAMES) if len(s.points) > 1 else s.frames) for s, (a, e) in zip(streams, spans, strict=True)]
    for run in parts([e - a for a, e in spans], step=SEEK_FRAMES if all(len(s.points) > 1 or s.frames <= SEEK_FRAMES for s in streams) else 1 << 40):
        own = [(i, spans[i][0] + a, spans[i][0] + e) for i, a, e in run]
        pcm = decode_frames([streams[i].body(a, e) for i, a, e in own], [(a, e - a) for _, a, e in own])
        for (i, a, _), p in zip(own, pcm, strict=True):
            yield i, a * BLOCK, p


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams that ``encode`` wrote; raises where a checksum fails."""
    own = [Stream(s) for s in streams]
    out: list[list[bytes]] = [[] for _ in streams]
    for i, _, pcm in read_runs(own):
        out[i].append(pcm)
    whole = [b"".join(x) for x in out]
    for s, p in zip(own, whole, strict=True):
        if len(p) != s.samples or hashlib.md5(signed(np.frombuffer(p, np.uint8))).digest() != s.md5:
            raise ValueError("the stream's MD5 is wrong")
    return whole


def decode_frames(bodies: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    """The PCM bytes of stretches of frames, all decoded together; spans has each stretch's first number and how many frames it has."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    frames, begin = np.array([n for _, n in spans]), np.array([a for a, _ in spans])
    base = np.cumsum([0, *map(len, bodies)])
    start, number, lead = find_frames(data)
    owner = np.searchsorted(base, start, "right") - 1
    expect = np.arange(int(frames.sum())) - np.repeat(np.cumsum(frames) - frames - begin, frames)
    if len(start) != len(expect):  # a code that looks like a header: keep the ones that count up
        keep, want, who = [], int(begin[0]), 0
        for i, (o, n) in enumerate(zip(owner.tolist(), number.tolist(), strict=True)):
            if o != who:
                want, who = int(begin[o]), o
            if n == want:
                keep.append(i)
                want += 1
        start, number, lead, owner = start[keep], number[keep], lead[keep], owner[keep]
    if len(start) != len(expect) or (number != expect).any() or (owner != np.repeat(np.arange(len(frames)), frames)).any():
        raise ValueError("frames are missing or damaged")
    ends = np.append(start[1:], len(data))
    check = crcs(data, start, ends - start - 2, CRC16, 16)
    if (check != (data[ends - 2].astype(np.uint32) << 8 | data[ends - 1])).any():
        raise ValueError("a frame's checksum is wrong")
    bits = Bits(data)
    at = (start + lead) * 8
    kind = bits.take(at, 8) >> 1
    linear, fixed, plain = kind >= 32, (kind >= 8) & (kind <= 12), kind == 1
    if not (linear | fixed | plain).all():
        raise ValueError("a kind of subframe that this decoder doesn't read")
    order = np.where(plain, BLOCK, np.where(linear, (kind & 31) + 1, kind & 7))
    at = at + 8
    x = np.zeros((BLOCK, len(start)), np.int64)
    wide = lambda v, n: v - ((v >> (n - 1)) << n)
    for i in range(int(order.max(initial=0))):
        rows = np.flatnonzero(order > i)
        x[i, rows] = wide(bits.take(at[rows], 8), 8)
        at[rows] += 8
    coef, shift = np.zeros((32, len(start)), np.int64), np.zeros(len(start), np.int64)
    rows = np.flatnonzero(linear)
    if len(rows):
        n = bits.take(at[rows], 4) + 1
        shift[rows] = bits.take(at[rows] + 4, 5)
        at[rows] += 9
        for i in range(int(order[rows].max())):
            own = order[rows] > i
            coef[i, rows[own]] = wide(bits.take(at[rows[own]], n[own]), n[own])
            at[rows[own]] += n[own]
    if bits.take(at, 6)[~plain].any():
        raise ValueError("Rice partitions are not read")
    k = bits.take(at + 2 + 4, 4)
    at = np.where(plain, at, at + 10)
    for i in range(BLOCK):
        whole = i >= 2 or not (order > i).any()
        rows = slice(None) if whole and i >= int(order.max(initial=0)) else np.flatnonzero(order <= i)
        here = at[rows]
        stop = bits.next[np.minimum(here, bits.n - 1)].astype(np.int64)
        kk = k[rows]
        z = (stop - here) << kk | bits.take(stop + 1, kk)
        x[i, rows] = (z >> 1) ^ -(z & 1)
        at[rows] = stop + 1 + kk
    if ((at + 7) // 8 != ends - 2).any():
        raise ValueError("a frame's codes end in the wrong place")
    for o in range(1, 5):  # undo the fixed predictors
        rows = np.flatnonzero(fixed & (order == o))
        if len(rows):
            y = x[:, rows]
            for i in range(o, BLOCK):
                p = y[i - 1] if o == 1 else 2 * y[i - 1] - y[i - 2] if o == 2 else 3 * (y[i - 1] - y[i - 2]) + y[i - 3] if o == 3 else 4 * (y[i - 1] + y[i - 3]) - 6 * y[i - 2] - y[i - 4]
                y[i] += p
            x[:, rows] = y
    rows = np.flatnonzero(linear)
    for o in np.unique(order[rows]).tolist():
        own = rows[order[rows] == o]
        y, c, s = x[:, own], coef[:o, own], shift[own]
        for i in range(o, BLOCK):
            y[i] += sum(c[j] * y[i - 1 - j] for j in range(o)) >> s
        x[:, own] = y
    if x.min(initial=0) < -128 or x.max(initial=0) > 127:
        raise ValueError("a sample is out of range")
    pcm = BYTE[x.T + 128].tobytes()
    at = np.cumsum([0, *frames.tolist()]) * BLOCK
    return [pcm[a:e] for a, e in zip(at.tolist(), at[1:].tolist(), strict=False)]


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


class Summary:
    """Checksums and features of samples that come in order, block by block.

    The feature is the number of samples, their energy, their peak and their zero crossings: whole numbers, so that equal
    samples have equal features.
    """

    def __init__(self):
        self.sha, self.md5, self.n, self.energy, self.peak, self.crossings, self.tail, self.below = hashlib.sha256(), hashlib.md5(), 0, 0, 0, 0, b"", None

    def add(self, pcm: bytes) -> None:
        raw = np.frombuffer(pcm, np.uint8)
        self.sha.update(pcm)
        self.md5.update(signed(raw))
        s = SAMPLE[raw].astype(np.int32)
        below = s < 0
        self.n += len(s)
        self.energy += int((s * s).sum(dtype=np.int64))
        self.peak = max(self.peak, int(np.abs(s).max(initial=0)))
        self.crossings += int((below[1:] != below[:-1]).sum()) + (self.below is not None and len(s) > 0 and bool(below[0]) != self.below)
        self.below = bool(below[-1]) if len(s) else self.below
        self.tail = (self.tail + pcm)[-TAIL:]

    def feature(self) -> str:
        return f"{self.n}:{self.energy}:{self.peak}:{self.crossings}"


def feature(pcm: bytes) -> str:
    own = Summary()
    own.add(pcm)
    return own.feature()


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "media", frames_a_block: int = 16, samples: tuple[int, int] | None = None) -> DataFrame:
    """key, first_sample, n_samples, pcm: the decoded samples in blocks; the block of sample s has first_sample = s - s % (192 * frames_a_block).

    With ``samples`` (first, end) only the blocks that hold some of them, found by the seek table; the rest isn't decoded. Null media have no blocks.
    """
    kinds, size = dict(media.dtypes), BLOCK * frames_a_block
    schema = pa.schema([(key, to_arrow_type(media.schema[key].dataType)), ("first_sample", pa.int64()), ("n_samples", pa.int64()), ("pcm", pa.binary())])

    def run(batches):
        for b in batches:
            for part in slices(b, column):
                keys = [k for k, m in zip(part.column(0).to_pylist(), part.column(1), strict=True) if m.is_valid]
                streams = [Stream(m) for m in part.column(1).to_pylist() if m is not None]
                wanted, left = None, [(0, b"")] * len(streams)
                if samples:
                    cut = [(min(s.frames, samples[0] // size * frames_a_block), min(s.frames, -(-samples[1] // size) * frames_a_block)) for s in streams]
                    live = [i for i, (a, e) in enumerate(cut) if a < e]
                    keys, streams, wanted = [keys[i] for i in live], [streams[i] for i in live], [cut[i] for i in live]
                for i, first, pcm in read_runs(streams, wanted):
                    at, rest = left[i]
                    at, pcm = (at, rest + pcm) if rest else (first, pcm)
                    if wanted:
                        a, e = wanted[i][0] * BLOCK, min(wanted[i][1] * BLOCK, at + len(pcm))
                        at, pcm = max(at, a), pcm[max(at, a) - at : e - at]
                    ends = first + len(pcm) >= streams[i].samples or wanted and at + len(pcm) >= wanted[i][1] * BLOCK
                    full = len(pcm) if ends else len(pcm) // size * size
                    left[i] = (at + full, pcm[full:])
                    rows = [(keys[i], at + k, len(pcm[k : k + size]), pcm[k : k + size]) for k in range(0, full, size)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return media.select(key, column).mapInArrow(run, f"`{key}` {kinds[key]}, first_sample long, n_samples long, pcm binary")


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text) and the FLAC stream (media) of each row's text."""
    kinds = dict(docs.dtypes)

    def make():
        def step(part):
            made = [payload(t) for t in part.column("_text").to_pylist()]
            return {key: part.column(key), "n_bytes": [n for _, n in made], "media": encode([p for p, _ in made])}

        return step

    return map_arrow(docs.select(key, F.col(text).alias("_text")), make, f"`{key}` {kinds[key]}, n_bytes long, media binary")


def digest(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sizes, checksums and features of stored streams (as ``store`` gives them), read back block by block and verified."""
    kinds = dict(media.dtypes)

    def make():
        def step(part):
            raw = part.column("media").to_pylist()
            streams, own = [Stream(m) for m in raw], [Summary() for _ in raw]
            for i, _, pcm in read_runs(streams):
                own[i].add(pcm)
            if any(x.md5.digest() != s.md5 or x.n != s.samples for x, s in zip(own, streams, strict=True)):
                raise ValueError("a stream's MD5 is wrong")
            return {
                key: part.column(key),
                "n_bytes": part.column("n_bytes"),
                "payload_bytes": [x.n for x in own],
                "payload_sha256": [x.sha.hexdigest() for x in own],
                "tail_crc32": [zlib.crc32(x.tail) for x in own],
                "media_bytes": [len(m) for m in raw],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in raw],
                "feature": [x.feature() for x in own],
            }

        return step

    return map_arrow(media.select(key, "n_bytes", "media"), make, f"`{key}` {kinds[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", text="media")
