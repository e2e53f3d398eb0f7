"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

Subwords are all runs of three and four bytes of the lower-cased text in which
every ASCII character that isn't a letter is a space. A text's vector is the mean of
its subwords' embeddings; a softmax over it names the language. Embeddings and
weights are trained together by stochastic gradient descent in numpy, on whole
texts and on short excerpts of them (so that short texts are known as well).
Then one temperature is fitted on texts held back from training. A text is
rejected whose score is under that of all but REJECT_SHARE of those held back, or
of whose subwords too large a share was in no training text. That share is set
between the held-back texts' and the one that they would have if their language
had been left out of training, for the language that then stands out least.

Null, empty and letterless texts are "und" with score 0 and are rejected, and so
are texts without subwords, for which nothing speaks. Of languages with equal
scores the first in alphabetical order is named. Without a labelled row there is
no language: every text is "und" with score 0, and only those that would be
rejected under any model are. An empty table gives an empty result, repeated rows
are rows, whole texts count at any length, and columns beyond those named in
``keep`` are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.common import ASCII_LOWER, CHUNK_BYTES, fitted, map_arrow, prefix_sums, runs, sampled, slice_hash, utf8

#: The bound of what training takes: labelled rows (about; never twice as many), rows of a rare language, and characters of a row.
TRAIN_ROWS, RARE_ROWS, TRAIN_CHARS = 2000, 100, 60_000
BUCKETS, WIDTH, SUBWORDS = 1 << 15, 16, (3, 4)
EPOCHS, RATE, REJECT_SHARE = 4, 4.0, 0.001
#: Subwords that each text has besides its own when the unseen ones' share is taken (so that one new word doesn't speak against a short text), subwords from which on a text tells what a left-out language looks like, and the share of such texts under what their language counts with.
EVEN, LONG, OUTSIDE_SHARE = 30, 60, 0.25
#: The share of unseen subwords up to which no text is rejected for them: names, numbers and keys have some in any language.
LEAST_UNSEEN = 0.1
UNKNOWN = "und"

_FOLD = ASCII_LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_ODD = np.array([b for b in range(0x80, 0x100)])


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # of each bucket for each language: embeddings times weights
    temperature: float = 1.0
    least: float = 0.0
    seen: np.ndarray | None = None  # of each bucket, whether a training text has it
    most_unseen: float = 1.0


def subwords(data: np.ndarray, offsets: np.ndarray, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords (that begin before ``stop``), and how many each row has; subwords don't cross rows, nor are they only spaces."""
    folded = _FOLD[data]
    sums = prefix_sums(folded)
    ids, rows = [], []
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    blank = np.concatenate([[0], np.cumsum(folded == 32)])
    for n in SUBWORDS:
        if len(folded) < n:
            continue
        at = np.arange(min(len(folded) - n + 1, len(folded) if stop is None else stop))
        ok = (row[: len(at)] == row[n - 1 : n - 1 + len(at)]) & (blank[n : n + len(at)] - blank[: len(at)] < n - 1)
        at = at[ok]
        ids.append((slice_hash(sums, at, at + n, n) % np.uint64(BUCKETS)).astype(np.int32))
        rows.append(row[at])
    if not ids:
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    ids, rows = np.concatenate(ids), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return ids[order], np.bincount(rows, minlength=len(offsets) - 1)


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``counts`` rows of values; an empty run's sum is 0."""
    out = np.zeros((len(counts), *values.shape[1:]), np.float64)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.float64)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    if not x.shape[1]:
        return x
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def logits(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each language before the temperature, and whether a text has a letter."""
    return evidence(model, texts)[:2]


def evidence(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of each language before the temperature, whether a text has a letter, how many subwords it has and the share of them that is in no training text."""
    data, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))  # as in training
    total, new, counts = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    whole = len(texts) > 1 or len(data) <= 2 * CHUNK_BYTES
    for a in range(0, 1 if whole else len(data), CHUNK_BYTES):  # a text that is very long is read in parts, a subword in that where it begins
        own = data if whole else data[a : a + CHUNK_BYTES + max(SUBWORDS) - 1]
        ids, n = subwords(own, offsets if whole else np.array([0, len(own)]), None if whole else CHUNK_BYTES)
        total += segment_sums(model.scores[ids], n)
        new += segment_sums(~model.seen[ids], n) if model.seen is not None else 0
        counts += n
    out = total / np.maximum(counts, 1)[:, None]
    low = np.concatenate([[0], np.cumsum((_FOLD[data] != 32) & (data < 128))])
    letter = (low[offsets[1:]] - low[offsets[:-1]]) > 0
    for i in np.flatnonzero(~letter):
        letter[i] = any(c.isalpha() for c in texts[i].as_py() or "")
    return out, letter, counts, new / (counts + EVEN)


def unknown(model: Model, score: np.ndarray, letter: np.ndarray, counts: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    """Whether a text is rejected."""
    return ~letter | (counts == 0) | ((score < model.least) | (unseen > model.most_unseen) if model.langs else False)


def train(texts: list[str], langs: list[str], seed: int = 5) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    rng = np.random.default_rng(seed)
    rows, y = [], []
    for t, lang in zip(texts, langs, strict=True):
        rows.append(t)
        y.append(names.index(lang))
        if len(t) > 40:  # an excerpt of one to a dozen words
            words = t.split(" ")
            n = int(rng.integers(1, 13))
            at = int(rng.integers(0, max(1, len(words) - n)))
            rows.append(" ".join(words[at : at + n]))
            y.append(names.index(lang))
    y = np.array(y)
    per_row = []
    for part in runs(rows):  # all subwords at once would take a hundred bytes for each byte of text
        ids, counts = subwords(*utf8(pc.utf8_lower(pa.array(part, pa.large_string()))))
        for own in np.split(ids, np.cumsum(counts)[:-1]):
            got, n = np.unique(own, return_counts=True)
            per_row.append((got.astype(np.uint16), n.astype(np.uint16 if n.max(initial=0) < 1 << 16 else np.uint32), len(own)))
    counts = np.array([len(got) for got, _, _ in per_row])
    held = (np.arange(len(rows)) // 2) % 6 == 0 if len(rows) > 60 else np.zeros(len(rows), bool)
    use = np.flatnonzero(~held & (counts > 0))
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weight = rng.normal(0, 0.3, (WIDTH, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    steps = EPOCHS * -(-len(use) // 32)
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(use), max(1, -(-len(use) // 32))):
            if not len(part):
                continue
            rate = RATE * (1 - step / steps)
            step += 1
            idx = np.concatenate([per_row[i][0] for i in part])
            w = np.concatenate([(per_row[i][1] / per_row[i][2]).astype(np.float32) for i in part])
            n = np.array([len(per_row[i][0]) for i in part])
            mean = segment_sums(embed[idx] * w[:, None], n).astype(np.float32)
            p = softmax(mean @ weight + bias)
            p[np.arange(len(part)), y[part]] -= 1
            p = (p / len(part)).astype(np.float32)
            back = p @ weight.T
            weight -= rate * mean.T @ p
            bias -= rate * p.sum(axis=0)
            np.add.at(embed, idx, -rate * 20 * np.repeat(back, n, axis=0) * w[:, None])
    by_lang = np.zeros((len(names), BUCKETS), bool)
    for i in use:
        by_lang[y[i], per_row[i][0]] = True
    model = Model(names, (embed @ weight + bias).astype(np.float32), seen=by_lang.any(axis=0))
    known = np.flatnonzero(held & (counts > 0))
    calibrate(model, [rows[i] for i in known], y[known], by_lang)
    return model


def calibrate(model: Model, texts: list[str], y: np.ndarray, by_lang: np.ndarray) -> None:
    """Fits the temperature by likelihood, the least score by REJECT_SHARE and the most unseen subwords by it and by what texts of a language that is left out have."""
    if not len(texts):
        return
    got = [evidence(model, pa.array(part)) for part in runs(texts)]
    x, counts, unseen = (np.concatenate([g[k] for g in got]) for k in (0, 2, 3))
    best = min(np.geomspace(0.02, 5, 60), key=lambda t: -np.log(np.maximum(softmax(x / t)[np.arange(len(y)), y], 1e-12)).sum())
    model.temperature = float(best)
    p = softmax(x / best).max(axis=1)
    model.least = float(np.quantile(p, REJECT_SHARE))
    inside, outside, long = float(np.quantile(unseen, 1 - REJECT_SHARE)), left_out(texts, y, by_lang), counts >= LONG
    least = min((float(np.quantile(outside[long & (y == k)], OUTSIDE_SHARE)) for k in np.unique(y[long])), default=0.0)
    model.most_unseen = max(LEAST_UNSEEN, inside, (3 * inside + least) / 4)  # nearer to what must stay


def left_out(texts: list[str], y: np.ndarray, by_lang: np.ndarray) -> np.ndarray:
    """The share of each text's subwords that only training texts of its own language have, or none."""
    out = np.zeros(len(texts))
    for k in np.unique(y):
        seen = np.delete(by_lang, k, axis=0).any(axis=0)
        own, at = np.flatnonzero(y == k), 0
        for part in runs([texts[i] for i in own]):
            ids, counts = subwords(*utf8(pc.utf8_lower(pa.array(part, pa.large_string()))))
            out[own[at : at + len(part)]] = segment_sums(~seen[ids], counts) / (counts + EVEN)
            at += len(part)
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Trains on a bounded sample (TRAIN_ROWS, RARE_ROWS, TRAIN_CHARS) of docs' rows that have a language and a text."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter(F.col("t").isNotNull() & F.col("l").isNotNull() & (F.length("t") <= TRAIN_CHARS))

    def learn(batches):
        got = pa.Table.from_batches(batches).sort_by([("k", "ascending"), ("t", "ascending"), ("l", "ascending")]) if batches else None
        return train(got["t"].to_pylist(), got["l"].to_pylist()) if got else train([], [])

    return fitted(sampled(rows, ["k", "t"], TRAIN_ROWS, "l", RARE_ROWS), 2 * TRAIN_ROWS, learn)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, lang_pred, score (0 to 1) and rejected of each row."""
    kinds, shared = dict(docs.dtypes), docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def step(part):
            x, letter, counts, unseen = evidence(m, part.column("_text"))
            p = softmax(x / m.temperature)
            named = letter & bool(m.langs)
            best, score = p.argmax(axis=1) if m.langs else np.zeros(len(p), int), np.where(named, p.max(axis=1, initial=0), 0.0)
            return {c: part.column(c) for c in keep} | {
                "lang_pred": [m.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), named.tolist(), strict=True)],
                "score": score,
                "rejected": unknown(m, score, letter, counts, unseen),
            }

        return step

    names = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return map_arrow(docs.select(*keep, F.col(text).alias("_text")), make, f"{names}, lang_pred string, score double, rejected boolean")
