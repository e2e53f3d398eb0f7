"""Which encoding bytes are in, by the statistics of pairs of neighbouring bytes.

Each encoding has a model: how likely each pair of bytes is in texts that are written in
it. Models come from lines made by a rule (words of letters of an alphabet, blanks,
marks, digits), or from texts that are given. Bytes are scored by every model, whole,
through the counts of their pairs; encodings in which they can't be read are out. Long
values are counted and read a piece at a time, so only the text found is held whole. How
common an encoding is counts too. The order is that of the scores, with their shares as
confidence. A word or two can be read in several: "да" comes out as Latin-1, "Èçê." as Cyrillic.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Byte order marks and what they say.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
#: Encodings that are told apart; of equal scores the first counts.
ENCODINGS = ("utf-8", "utf-16-le", "utf-16-be", "latin-1", "gb18030", "windows-1251", "koi8-r", "shift_jis")
#: Which alphabets an encoding is used for; the Unicode ones are for all.
USED_FOR = {"latin-1": ("latin",), "gb18030": ("han",), "windows-1251": ("cyrillic",), "koi8-r": ("cyrillic",), "shift_jis": ("kana", "japanese")}
#: How much of a model is evenly spread over all pairs, and what the score of a pair is made less by where bytes are read as text that no text has (control characters, code points without a character).
EVEN, ODD = 1e-3, 12.0
#: How much of a model goes by its bytes' own frequencies, beside that of the pairs seen: pairs of rare letters are too many to come up in made lines.
APART = 0.3
#: How common encodings are, as what is added to scores; it only decides texts of a few bytes, where pairs say little. Those that it hasn't count as the commonest.
COMMON = {"utf-16-le": -6.0, "utf-16-be": -6.0, "windows-1251": -11.0, "koi8-r": -11.0, "gb18030": -12.0, "shift_jis": -12.0}
#: Bytes of a value that are looked at at once, an even number.
PIECE = 1 << 18


#: Letters by how frequent they are in running text, and which of them are vowels.
LATIN, LATIN_VOWELS = "etaoinsrhldcumfpgwybvkxjqz", "aeiouy"
LATIN_RARE = "éèóñüäöçßêíáàúâîôûùëïåøæãõìòðýþÿ"
CYRILLIC, CYRILLIC_VOWELS = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэф", "оеаиуяыюэё"


def alphabets() -> dict[str, tuple[str, str]]:
    """Frequent and rarer letters of each alphabet; those of Latin and Cyrillic by their frequency."""
    span = lambda a, b: "".join(map(chr, range(a, b + 1)))
    common_han = "".join(bytes((hi, lo)).decode("gb2312") for hi in range(0xB0, 0xD7) for lo in range(0xA1, 0xFF))
    return {
        "latin": (LATIN, LATIN_RARE), "cyrillic": (CYRILLIC, "ъё"), "han": (common_han, ""),
        "kana": (span(0x3041, 0x3093), span(0x30A1, 0x30F3)), "japanese": (span(0x3041, 0x3093) * 8 + "".join(c for c in common_han if _fits(c, "shift_jis")), span(0x30A1, 0x30F3)),
    }


def _fits(text: str, encoding: str) -> bool:
    try:
        text.encode(encoding)
    except UnicodeEncodeError:
        return False
    return True


def made_lines(alphabet: str, n: int = 60_000, seed: int = 1) -> str:
    """About n characters of words of an alphabet."""
    rng = np.random.default_rng(seed)
    often, seldom = alphabets()[alphabet]
    wide = alphabet in ("han", "kana", "japanese")
    if wide:
        letters = rng.choice(list(often), n)
    else:  # vowels and consonants in turn, mostly, each by its frequency
        vowels = LATIN_VOWELS + CYRILLIC_VOWELS
        share = 1 / (np.arange(len(often)) + 4.0)
        is_vowel = np.array([c in vowels for c in often])
        turn = (np.arange(n) + (rng.random(n) < 0.15)) % 2 == 0
        letters = np.empty(n, "<U1")
        for kind, at in ((is_vowel, turn), (~is_vowel, ~turn)):
            letters[at] = rng.choice(np.array(list(often))[kind], int(at.sum()), p=share[kind] / share[kind].sum())
    if seldom:
        rare = rng.random(n) < 0.06
        share = 1 / (np.arange(len(seldom)) + 2.0)
        letters[rare] = rng.choice(list(seldom), int(rare.sum()), p=share / share.sum())
    out, at = [], 0
    ends = (", ", ". ", "\n", " (", ") ", " 12 ", "! ", ": ", " - ", '"')
    while at < n:
        size = int(rng.integers(1, 10))
        word = "".join(letters[at : at + size])
        draw = rng.random()
        out.append(word if draw < 0.86 else word.capitalize() if draw < 0.97 else word.upper())
        out.append(("" if wide else " ") if rng.random() < 0.85 else str(rng.choice(["，", "。", "\n", "12"])) if wide and rng.random() < 0.8 else str(rng.choice(ends)))
        at += size
    return "".join(out)


@dataclass
class Model:
    #: The encoding of each row; an encoding has one for each alphabet that it is used for.
    names: tuple[str, ...]
    #: Log-likelihood of each pair of bytes at even places (first * 256 + second), then of each at odd ones, a row for each name.
    pairs: np.ndarray


def pair_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring bytes' pairs that come up, at even and at odd places, and how often. Where a text is of units of two bytes, places tell which of them comes first."""
    whole = np.frombuffer(raw, np.uint8)
    if len(whole) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = None
    for start in range(0, len(whole) - 1, PIECE):  # a piece's last byte is the next one's first, so each pair is in one
        own = whole[start : start + PIECE + 1].astype(np.int64)
        pairs = own[:-1] * 256 + own[1:]
        pairs[1::2] += 1 << 16
        own = np.bincount(pairs, minlength=1 << 17)
        n = own if n is None else n + own
    at = np.flatnonzero(n)
    return at, n[at]


def fitted(texts: dict[str, Iterable[str]], names: tuple[str, ...] = ENCODINGS) -> Model:
    """A model from texts of alphabets (by name): a row for each encoding and alphabet that it is used for. What an encoding can't write is left out."""
    rows, of, by = [], [], []
    for name in names:
        for k in (k for k in texts if k in USED_FOR.get(name, texts)):
            own = np.full((2, 1 << 16), 1 / (1 << 16))
            at, n = pair_counts("".join(texts[k]).encode(name, "ignore"))
            seen = np.zeros(1 << 17)
            seen[at] = n
            seen = seen.reshape(2, -1)
            if not name.startswith("utf-16"):  # places say nothing here
                seen[:] = seen.sum(0)
            own += seen / np.maximum(seen.sum(1, keepdims=True), 1) / EVEN
            square = seen.reshape(2, 256, 256)
            apart = square.sum(2)[:, :, None] * square.sum(1)[:, None, :]
            own += (apart / np.maximum(apart.sum((1, 2), keepdims=True), 1)).reshape(2, -1) * APART / EVEN
            rows.append(np.log(own / own.sum(1, keepdims=True)).reshape(-1))
            of.append(name)
            by.append(k)
    pairs = np.array(rows, np.float32)
    # pairs of ASCII are as likely in all encodings that write an alphabet's texts with it: what tells them apart are the others
    at = np.arange(1 << 17)
    plain = (at & 0x8080) == 0
    for k in set(by):
        own = [i for i, (name, b) in enumerate(zip(of, by, strict=True)) if b == k and not name.startswith("utf-16")]
        if own:
            pairs[np.ix_(own, plain)] = pairs[np.ix_(own, plain)].max(0)
    return Model(tuple(of), pairs)


@lru_cache(1)
def made_model() -> Model:
    return fitted({k: [made_lines(k)] for k in alphabets()})


def _odd(text: str) -> int:
    """Characters that no text has."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    control = (points < 0x20) & ~np.isin(points, (9, 10, 12, 13))
    return int((control | ((points >= 0x7F) & (points < 0xA0)) | ((points >= 0xE000) & (points < 0xF900)) | ((points & 0xFFFE) == 0xFFFE)).sum())


def _reads(raw: bytes, name: str) -> bool:
    try:
        raw.decode(name)
    except UnicodeDecodeError:
        return False
    return True


def _odd_as(raw: bytes, name: str) -> int | None:
    """Characters that no text has, in bytes as an encoding reads them; None where it can't."""
    reader, n = codecs.getincrementaldecoder(name)(), 0
    try:
        for start in range(0, len(raw), PIECE):
            n += _odd(reader.decode(raw[start : start + PIECE], start + PIECE >= len(raw)))
    except UnicodeDecodeError:
        return None
    return n


def shares(raw: bytes, model: Model | None = None) -> list[tuple[str, float]]:
    """(encoding, confidence) of the encodings that read the bytes, surest first. A byte order mark settles it; bytes of ASCII alone, and empty ones, are UTF-8."""
    for mark, name in MARKS:
        if raw.startswith(mark) and _reads(raw, name):
            return [(name, 1.0)]
    if raw.isascii() and b"\0" not in raw:
        return [("utf-8", 1.0)]
    model = model or made_model()
    at, n = pair_counts(raw)
    scores: dict[str, float] = {}
    for name, score in zip(model.names, (model.pairs[:, at] @ n).tolist(), strict=True):
        scores[name] = max(score, scores.get(name, score))
    odd = {name: _odd_as(raw, name) for name in scores}
    read = [(score + COMMON.get(name, 0.0) - ODD * odd[name], name) for name, score in scores.items() if odd[name] is not None]
    if not read:
        return []
    # bytes over 127 that are whole UTF-8 sequences throughout hardly come up by chance, each byte after a sequence's first the less
    several = sum(0x80 <= b < 0xC0 for b in raw[: 1 << 16])
    read = [(s + (6.0 * several if name == "utf-8" else 0.0), name) for s, name in read]
    best = max(s for s, _ in read)
    share = [np.exp(min(0.0, s - best)) for s, _ in read]
    order = sorted(range(len(read)), key=lambda i: -read[i][0])
    return [(read[i][1], float(share[i] / sum(share))) for i in order]


def ranked(raw: bytes, model: Model | None = None) -> list[tuple[str, float, str]]:
    """(encoding, confidence, text) of the encodings that read the bytes, surest first."""
    return [(name, share, raw.decode(name)) for name, share in shares(raw, model)]


def decoded(raw: bytes, model: Model | None = None) -> tuple[str, str]:
    """Text and the encoding that it is most surely in; Latin-1, which reads anything, where no other does."""
    found = shares(raw, model)
    name = found[0][0] if found else "latin-1"
    return raw.decode(name), name
