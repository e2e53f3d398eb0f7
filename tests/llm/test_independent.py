"""The networks and the audio streams against versions written out plainly: unit by unit, path by path, bit by bit."""

import hashlib
import itertools
import math
import random

import numpy as np

from sheafspark.llm import flac, main_text, pii, queries


def plain_lstm(x, wx, wh, b):
    """One sequence, one unit at a time."""
    h = len(wh)
    hidden, cell, out = [0.0] * h, [0.0] * h, []
    sig = lambda v: 1 / (1 + math.exp(-v))
    for row in x:
        a = [float(b[j]) + sum(float(row[k]) * float(wx[k, j]) for k in range(len(row))) + sum(hidden[k] * float(wh[k, j]) for k in range(h)) for j in range(4 * h)]
        cell = [sig(a[h + j]) * cell[j] + sig(a[j]) * math.tanh(a[3 * h + j]) for j in range(h)]
        hidden = [sig(a[2 * h + j]) * math.tanh(cell[j]) for j in range(h)]
        out.append(hidden)
    return np.array(out).reshape(len(x), h)


def both_ways(p, x):
    return np.concatenate([plain_lstm(x, p["wxf"], p["whf"], p["bf"]), plain_lstm(x[::-1], p["wxb"], p["whb"], p["bb"])[::-1]], 1)


def test_scores_of_characters():
    net = queries.network()
    for text in ("me(at)host.org", "a", "+49 30 1234567, né 😀"):
        ids = pii.codes(text)
        want = both_ways(net.p, net.p["embed"][ids]) @ net.p["out"] + net.p["bias"]
        assert np.abs(pii.emissions(net, ids[None])[0][:, 0] - want).max() < 1e-4


def test_labels_of_blocks():
    """Pages of different lengths side by side are as each alone, over all their blocks."""
    net = queries.labeller()
    pages = [main_text.blocks(s) for s, _ in main_text.labelled_pages(np.random.default_rng(3), 4)]
    f = main_text.features(pages)
    x = main_text.inputs(net, f)
    at = 0
    for page, got in zip(pages, main_text.label(net, pages), strict=True):
        n = len(got)
        odds = both_ways(net.p, x[at : at + n]) @ net.p["out"] + net.p["bias"]
        assert ((odds.reshape(-1) > 0) == np.asarray(got, bool).reshape(-1)).all()
        at += n


def test_best_path_of_all_paths():
    net, r = queries.network(), np.random.default_rng(4)
    for n in (1, 2, 4):
        em = r.normal(0, 3, (n, 1, pii.TAGS)).astype(np.float32)
        score = lambda path: net.p["first"][path[0]] + sum(em[i, 0, t] for i, t in enumerate(path)) + sum(net.p["trans"][a, b] for a, b in zip(path, path[1:]))  # noqa: E731, B023
        paths = list(itertools.product(range(pii.TAGS), repeat=n))
        scores = np.array([score(p) for p in paths], float)
        tags, sure = pii.decode(net, em.copy(), np.array([n]))
        assert tuple(tags[0].tolist()) == paths[int(scores.argmax())]
        if tags.any():
            share = np.exp(scores - scores.max())
            share /= share.sum()
            for i in range(n):
                assert abs(sure[0, i] - share[[p[i] == tags[0, i] for p in paths]].sum()) < 1e-3


def test_gradient_by_differences():
    r = np.random.default_rng(5)
    net = pii.blank_network(r, 5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, tags = r.integers(0, pii.CODES, (3, 6)), r.integers(0, pii.TAGS, (3, 6))

    def loss():
        em, _ = pii.emissions(net, ids)
        _, _, z = pii.crf_tables(em, net.p["trans"], net.p["first"])
        gold = [net.p["first"][t[0]] + sum(em[i, k, x] for i, x in enumerate(t)) + sum(net.p["trans"][a, b] for a, b in zip(t, t[1:])) for k, t in enumerate(tags)]
        return float(np.mean(z - np.array(gold)))

    grads = pii.gradient(net, ids, tags)
    for name in ("embed", "wxf", "whb", "bf", "out", "trans", "first", "bias"):
        own = net.p[name].reshape(-1)
        for k in r.choice(len(own), 4, replace=False).tolist():
            old, step = own[k], 1e-2
            own[k] = old + step
            up = loss()
            own[k] = old - step
            down = loss()
            own[k] = old
            assert abs((up - down) / (2 * step) - grads[name].reshape(-1)[k]) < 2e-3, (name, k)


class Bits:
    def __init__(self, data):
        self.n, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, k):
        self.left -= k
        return (self.n >> self.left) & ((1 << k) - 1)

    def signed(self, k):
        v = self.take(k)
        return v - (1 << k) if v >> (k - 1) else v

    def unary(self):
        k = 0
        while not self.take(1):
            k += 1
        return k


def crc(data, poly, bits):
    c = 0
    for byte in data:
        c ^= byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
    return c


def plain_decoder(stream):
    """PCM bytes of a mono stream of eight bits, by the format's public description: every kind of subframe, partitioned Rice codes, header and frame checksums."""
    assert stream[:4] == b"fLaC"
    at, info = 4, None
    while True:
        head, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if head & 127 == 0:
            info = body
        at += 4 + size
        if head >> 7:
            break
    samples = int.from_bytes(info[13:18], "big") & ((1 << 36) - 1)
    assert (info[12] >> 1 & 7) == 0 and ((info[12] & 1) << 4 | info[13] >> 4) == 7
    out = []
    while at < len(stream):
        b = Bits(stream[at:])
        whole = b.left
        assert b.take(14) == 0x3FFE and b.take(1) == 0
        b.take(1)
        size_code, rate_code = b.take(4), b.take(4)
        assert b.take(4) == 0 and b.take(3) in (0, 1) and b.take(1) == 0
        first = b.take(8)
        for _ in range(0 if first < 0x80 else 8 - (first ^ 0xFF).bit_length() - 1):
            assert b.take(2) == 2
            b.take(6)
        n = b.take(8) + 1 if size_code == 6 else b.take(16) + 1 if size_code == 7 else 192 if size_code == 1 else 576 << size_code - 2 if size_code < 6 else 256 << size_code - 8
        b.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        used = (whole - b.left) // 8
        assert b.take(8) == crc(stream[at : at + used], 0x07, 8)
        assert b.take(1) == 0
        kind, wasted = b.take(6), b.take(1)
        wide = 8 - (b.unary() + 1 if wasted else 0)
        if kind == 0:
            x = [b.signed(wide)] * n
        elif kind == 1:
            x = [b.signed(wide) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [b.signed(wide) for _ in range(order)]
            weights, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 32 else None, 0
            if kind >= 32:
                precision = b.take(4) + 1
                shift = b.signed(5)
                weights = [b.signed(precision) for _ in range(order)]
            long, parts = b.take(2), 1 << b.take(4)
            for k in range(parts):
                count = n // parts - (order if k == 0 else 0)
                rice = b.take(5 if long else 4)
                raw = b.take(5) if rice == (31 if long else 15) else None
                for _ in range(count):
                    if raw is None:
                        v = b.unary() << rice | b.take(rice)
                        e = v >> 1 ^ -(v & 1)
                    else:
                        e = b.signed(raw) if raw else 0
                    x.append(e + (sum(w * x[-1 - j] for j, w in enumerate(weights)) >> shift))
        out += [v << (8 - wide) for v in x]
        b.take(b.left % 8)
        used = (whole - b.left) // 8
        assert b.take(16) == crc(stream[at : at + used], 0x8005, 16)
        at += used + 2
    pcm = bytes(v & 255 for v in out)
    assert len(out) == samples and hashlib.md5(pcm).digest() == info[18:34]
    return pcm


def test_checksums_of_the_usual_text():
    assert crc(b"123456789", 0x07, 8) == 0xF4 and crc(b"123456789", 0x8005, 16) == 0xFEE8


def test_streams_by_another_decoder():
    """What the plain decoder makes of streams is what this module makes of them, sample by sample, and equal samples come from equal bytes alone."""
    r = random.Random(6)
    wild = ["".join(chr(r.randrange(low, high)) for _ in range(3000)) for low, high in ((0x4E00, 0x9FA5), (1, 0x2000), (0x410, 0x450))]
    texts = [*wild, "", "a", "The quick brown fox. " * 40, "Größe und Übermut " * 30, "天地玄黄" * 90, bytes(r.randrange(1, 128) for _ in range(900)).decode(), "e" * 500, "\x00\x7f" * 300]
    payloads = [flac.payload(t)[0] for t in texts]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    of = {}
    for own, stream in zip(payloads, streams, strict=True):
        pcm = plain_decoder(stream)
        assert len(pcm) == len(own)
        assert len(stream) <= 1.06 * len(own) + 42 + 9 + 22 * (1 + len(own) // (flac.BLOCK * flac.SEEK_FRAMES))
        for a, b in zip(own, pcm, strict=True):
            assert of.setdefault(a, b) == b
    assert len(set(of.values())) == len(of)
