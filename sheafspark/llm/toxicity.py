"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct words and the beginnings of four to six bytes of its
longer words, hashed into buckets; the score is the sigmoid of a bias, a weight for each
term and the product of two terms' factors for each pair, which sees that an
insult stands with the mention of a group where neither says enough alone.
Bias, weights and factors are trained in numpy by AdaGrad. Only terms take part
whose rows differ in toxicity from the rest by more than chance, or that stand in
a pair whose rows do, more than either term's alone (``pair_terms``). Weights with
hardly any say are dropped, and by their own length factors with hardly any, so
that a long text's many neutral terms don't add up. A slope and an offset are
fitted on rows held back from training, so that scores are probabilities.

Null and empty texts have no terms: their score is what the bias says, below the
threshold unless most of the labelled texts are toxic. Without a labelled row
every score is 0. An empty table gives an empty result, repeated rows are rows,
whole texts count at any length, equal texts have equal scores, and columns beyond
those named in ``keep`` are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.common import ASCII_LOWER, CHUNK_BYTES, fitted, map_arrow, prefix_sums, runs, sampled, slice_hash, spans_of, utf8
from sheafspark.llm.language_id import segment_sums

#: The bound of what training takes: labelled rows (about; never twice as many) and characters of a row.
TRAIN_ROWS, TRAIN_CHARS = 12_000, 60_000
BUCKETS, FACTORS, EPOCHS, RATE, DECAY = 1 << 18, 4, 6, 0.3, 0.02
#: Training rows a term needs, how far its share of toxic rows must lie from the others' (standard deviations), and the least weight and length of factors that stay.
LEAST_ROWS, LEAST_Z, LEAST_WEIGHT, LEAST_FACTOR = 4, 4.0, 0.1, 0.1
#: A term whose share of toxic rows is this at least, for all that chance (ALONE_Z standard deviations) may have added, weighs enough to say so alone.
ALONE_SHARE, ALONE_Z = 0.8, 2.0
#: Of pairs: the terms that are looked at (the most frequent that stand alone for nothing), the rows a pair needs, and how far its share of toxic rows must lie from the others' and from what the two terms' shares say.
PAIR_TERMS, PAIR_ROWS, PAIR_Z = 2048, 20, 8.0
BEGINNINGS, THRESHOLD = (4, 5, 6), 0.3

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    slope: float = 1.0
    offset: float = 0.0


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each row's distinct terms, row by row, and how many each row has."""
    data, offsets = utf8(texts)
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(rows, np.int64)
    data = ASCII_LOWER[data]
    member = _WORD[data]
    if rows == 1:  # a very long text is read in parts that end between words
        both = np.unique(np.concatenate([_codes(data[a:b], member[a:b], np.array([0, b - a])) for a, b in _parts(member)]))
    else:
        both = np.unique(_codes(data, member, offsets))
    return both % BUCKETS, np.bincount(both // BUCKETS, minlength=rows)


def _parts(member: np.ndarray, size: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """Stretches of about ``size`` bytes that don't end in a word."""
    cuts, at = [0], size
    while at < len(member):
        step = np.flatnonzero(~member[at : at + size])
        if len(step):
            cuts.append(at + int(step[0]))
            at = cuts[-1] + size
        else:
            at += size
    return list(zip(cuts, [*cuts[1:], len(member)], strict=True))


def _codes(data: np.ndarray, member: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """row * BUCKETS + bucket of each term."""
    sums = prefix_sums(data)
    start, end, row = spans_of(member, offsets)
    code, of = [slice_hash(sums, start, end, 1)], [row]
    for n in BEGINNINGS:
        long = end - start > n
        code.append(slice_hash(sums, start[long], start[long] + n, n))
        of.append(row[long])
    return np.concatenate(of) * BUCKETS + (np.concatenate(code) % np.uint64(BUCKETS)).astype(np.int64)


def raw_scores(bias, weight, factor, ids, counts) -> tuple[np.ndarray, np.ndarray]:
    """The machine's sums, and each row's sum of factors."""
    v = factor[ids]
    total = segment_sums(v, counts)
    pairs = 0.5 * ((total**2).sum(axis=1) - segment_sums((v * v).sum(axis=1), counts))
    return bias + segment_sums(weight[ids], counts) + pairs, total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def association(toxic: np.ndarray, seen: np.ndarray, n_toxic: float, n: float) -> np.ndarray:
    """How many standard deviations the share of toxic rows with a term lies above that of the others."""
    clean, n_clean = seen - toxic, n - n_toxic
    if not n_toxic or not n_clean:
        return np.zeros(len(seen))
    p = (seen + 0.5) / (n + 1)
    return (toxic / n_toxic - clean / n_clean) / np.sqrt(p * (1 - p) * (1 / n_toxic + 1 / n_clean))


def train(texts: list[str], labels: list[int], seed: int = 3) -> Model:
    own = []
    for part in runs([t or "" for t in texts]):
        ids, counts = terms(pa.array(part, pa.large_string()))
        own += [x.astype(np.int32) for x in np.split(ids, np.cumsum(counts)[:-1])]
    return train_terms(own, np.asarray(labels, np.float64), seed)


def tally(rows: list[np.ndarray]) -> np.ndarray:
    """How many rows have each bucket; a few hundred rows are counted together."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(rows), 256):
        out += np.bincount(np.concatenate(rows[at : at + 256]), minlength=BUCKETS)
    return out


def pair_terms(own: list[np.ndarray], y: np.ndarray, seen: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Buckets of terms that stand in a pair whose rows' share of toxic ones is not what the terms' own shares and chance explain.

    The PAIR_TERMS most frequent buckets of fewer than 19 in 20 rows are looked at; their pairs are counted by products of
    0/1 matrices, a thousand rows at a time. A pair is taken whose toxic rows differ by PAIR_Z standard deviations from the
    number that every row's expectation gives: the rest's share, moved by what each of the two terms moves it alone.
    """
    n, t = len(own), float(y.sum())
    found = np.zeros(BUCKETS, bool)
    if not t or t == n:
        return found
    able = (seen >= PAIR_ROWS) & (seen < 0.95 * n)
    top = np.argsort(np.where(able, -seen, 1), kind="stable")[:PAIR_TERMS]
    top = top[able[top]]
    if len(top) < 2:
        return found
    place = np.full(BUCKETS, -1, np.int32)
    place[top] = np.arange(len(top))
    both, bad = np.zeros((len(top), len(top)), np.float32), np.zeros((len(top), len(top)), np.float32)
    for at in range(0, n, 1000):
        x = np.zeros((min(1000, n - at), len(top)), np.float32)
        for r, ids in enumerate(own[at : at + 1000]):
            k = place[ids]
            x[r, k[k >= 0]] = 1
        both += x.T @ x
        marked = x[y[at : at + 1000] > 0]
        bad += marked.T @ marked
    base = t / n
    logit = lambda p: np.log(p / (1 - p))
    alone = logit((toxic[top] + base) / (seen[top] + 1)) - logit(base)
    expect = sigmoid(logit(base) + alone[:, None] + alone[None, :])
    z = (bad - both * expect) / np.sqrt(np.maximum(both * expect * (1 - expect), 0.5))
    plain = (bad - both * base) / np.sqrt(np.maximum(both * base * (1 - base), 0.5))
    odd = (np.abs(z) >= PAIR_Z) & (np.abs(plain) >= PAIR_Z) & (both >= PAIR_ROWS)
    # a term that always stands with another says nothing that the other doesn't
    odd &= both < 0.9 * np.minimum(seen[top][:, None], seen[top][None, :])
    np.fill_diagonal(odd, False)
    found[top[odd.any(1)]] = True
    return found


def train_terms(own: list[np.ndarray], y: np.ndarray, seed: int = 3) -> Model:
    """Trains on rows that are given by the buckets of their distinct terms. Empties ``own``: the terms that don't take part go early."""
    if not len(y):
        return Model(-np.inf, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 0 if len(y) >= 100 else np.zeros(len(y), bool)
    use = np.flatnonzero(~held)
    toxic, seen = tally([own[i] for i in use if y[i]]), tally([own[i] for i in use])
    trusted = (seen >= min(LEAST_ROWS, max(1, len(use) // 50))) & (np.abs(association(toxic, seen, y[use].sum(), len(use))) >= LEAST_Z)
    trusted |= pair_terms([own[i] for i in use], y[use], seen, toxic)
    kept = [x[trusted[x]] for x in own]
    own.clear()
    counts = np.array([len(x) for x in kept])
    share = float(np.clip(y[use].mean(), 1e-3, 1 - 1e-3))
    bias, weight = float(np.log(share / (1 - share))), np.zeros(BUCKETS)
    factor = rng.normal(0, 0.01, (BUCKETS, FACTORS))
    gw, gv, gb = np.ones(BUCKETS), np.ones((BUCKETS, FACTORS)), 1.0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(use), max(1, len(use) // 128)):
            n = counts[part]
            idx = np.concatenate([kept[i] for i in part])
            score, total = raw_scores(bias, weight, factor, idx, n)
            err = sigmoid(score) - y[part]
            gb += (g := err.mean()) ** 2
            bias -= RATE * g / np.sqrt(gb)
            if not len(idx):
                continue
            each = np.repeat(err, n)
            grad_v = each[:, None] * (np.repeat(total, n, axis=0) - factor[idx])
            order = np.argsort(idx, kind="stable")
            term, first = np.unique(idx[order], return_index=True)
            w = np.add.reduceat(each[order], first) + DECAY * weight[term]
            v = np.add.reduceat(grad_v[order], first, axis=0) + DECAY * factor[term]
            gw[term] += w * w
            gv[term] += v * v
            weight[term] -= RATE * w / np.sqrt(gw[term])
            factor[term] -= 0.3 * RATE * v / np.sqrt(gv[term])
    weight[(np.abs(weight) < LEAST_WEIGHT) | ~trusted] = 0
    factor[(np.sqrt((factor * factor).sum(1)) < LEAST_FACTOR) | ~trusted] = 0
    model = Model(bias, weight.astype(np.float32), factor.astype(np.float32))
    # the bias again, now that the small weights are gone, then slope and offset on the rows held back
    rest = np.flatnonzero(held) if held.any() else use
    x = raw_scores(bias, model.weight, model.factor, np.concatenate([kept[i] for i in rest]), counts[rest])[0]
    if 0 < y[rest].sum() < len(rest):
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps of a logistic regression on one input
            p = sigmoid(a * x + b)
            s = p * (1 - p) + 1e-6
            h = np.array([[(s * x * x).sum() + 1.0, (s * x).sum()], [(s * x).sum(), s.sum() + 1.0]])
            step = np.linalg.solve(h, [((p - y[rest]) * x).sum() + (a - 1), (p - y[rest]).sum() + b])
            a, b = a - step[0], b - step[1]
        if a > 0:
            model.slope, model.offset = float(a), float(b)
    # insults mostly stand several together, which leaves each too little weight to stand alone
    low = least_share(toxic, seen)
    alone = np.flatnonzero(trusted & (low >= ALONE_SHARE))
    need = (np.log(low[alone] / (1 - low[alone])) - model.offset) / model.slope - model.bias
    model.weight[alone] = np.maximum(model.weight[alone], need.astype(np.float32))
    return model


def least_share(toxic: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The least share of toxic rows that ALONE_Z standard deviations allow for (Wilson's bound)."""
    n, z = np.maximum(seen, 1), ALONE_Z
    p = toxic / n
    return np.clip((p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0, 1 - 1e-6)


def fit(rows: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Model:
    """Trains on a bounded sample (TRAIN_ROWS, TRAIN_CHARS) of rows' labelled texts."""
    rows = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("y")).filter(F.col("y").isNotNull() & (F.coalesce(F.length("t"), F.lit(0)) <= TRAIN_CHARS))
    sample = sampled(rows, ["k", "t"], TRAIN_ROWS)

    def make():
        def step(part):
            ids, counts = terms(part.column("_text"))
            return {"k": part.column("k"), "y": part.column("y"), "ids": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(ids.astype(np.int32)))}

        return step

    # terms are taken where the texts are; what one task gathers are their numbers
    kinds = dict(sample.dtypes)
    got = map_arrow(sample.withColumnRenamed("t", "_text"), make, f"k {kinds['k']}, y {kinds['y']}, ids array<int>")
    return fitted(got, 2 * TRAIN_ROWS, lambda batches: train_terms(*gathered(batches)))


def gathered(batches: list[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows' terms, as views of the batches, and their labels, by k, y and terms."""
    if not batches:
        return [], np.zeros(0)
    got = pa.Table.from_batches(batches)
    own = []
    for part in got.column("ids").chunks:
        at, ids = part.offsets.to_numpy().tolist(), part.values.to_numpy()
        own += [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
    k, y = got.column("k").to_pylist(), got.column("y").to_numpy().astype(np.float64)
    order = sorted(range(len(own)), key=lambda i: (k[i] is None, k[i], y[i], len(own[i])))
    return [own[i] for i in order], y[order]


def predict(model: Model, texts: pa.Array) -> np.ndarray:
    if model.bias == -np.inf:  # nothing was learnt
        return np.zeros(len(texts))
    x, _ = raw_scores(model.bias, model.weight, model.factor, *terms(texts))
    return sigmoid(model.slope * x + model.offset)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, score (0 to 1) and predicted (1 where the score is THRESHOLD or more)."""
    kinds, shared = dict(docs.dtypes), docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def step(part):
            s = predict(m, part.column("_text"))
            return {c: part.column(c) for c in keep} | {"score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

        return step

    names = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return map_arrow(docs.select(*keep, F.col(text).alias("_text")), make, f"{names}, score double, predicted int")
