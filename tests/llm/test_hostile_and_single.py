"""Texts that are hard on the personal-data search, and insults that stand alone."""

import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sheafspark.llm import pii, queries, toxicity

DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize("text", ["ann@bob" * 14_300, "(at)" * 25_000, "[{(" * 33_000, "0" * 100_000, "1 " * 50_000, "a@" + "b@" * 50_000 + "!", "a.b@" * 25_000, "+1(" * 33_000], ids=range(8))
def test_hostile_texts_take_seconds(text):
    net = queries.network()
    pii.find_all(net, ["warm up 1@b.c"])
    began = time.process_time()
    (base, spans), = pii.find_all(net, [text])
    assert time.process_time() - began < 20
    assert base == pii.base_spans(text) and set(base) <= set(spans)


def test_plausible_addresses():
    for own, want in (("a@b.c", True), ("A(AT)b1.c", True), ("@b.c", False), ("a@.c", False), ("a@b.1", False), ("a.b@c", False), ("a@b@c.de", True), ("a\n[at]\nb.c", True), ("", False)):
        assert pii.plausible(0, own) is want, own


def test_spans_beside_base_spans():
    base = [(0, 10, 20), (2, 0, 40), (3, 50, 60)]
    found = [(0.9, 1, 5, 8), (0.8, 1, 40, 45), (0.7, 0, 45, 51), (0.7, 0, 60, 70)]
    assert pii.reconcile(base, found) == [(0, 10, 20), (0, 60, 70), (1, 40, 45), (2, 0, 40), (3, 50, 60)]


@pytest.fixture(scope="module")
def rows():
    got = duckdb.sql(f"SELECT doc_id, text, toxic FROM '{DATA}/documents.parquet' JOIN '{DATA}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    held = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in got]
    return [r for r, h in zip(got, held, strict=True) if not h], [r for r, h in zip(got, held, strict=True) if h]


@pytest.fixture(scope="module")
def model(rows):
    return toxicity.train([t for _, t, _ in rows[0]], [y for *_, y in rows[0]])


def test_insults_alone_and_together(model):
    score = lambda t: float(toxicity.predict(model, pa.array([t]))[0])
    for word in ("idiot", "scum", "moron", "loser", "clown", "trash", "stupid"):
        assert score(word) >= 0.9 and score(f"The and {word.upper()} of") >= 0.9
    assert score("idiot scum") >= 0.9 and score("idiot " * 300) >= 0.9 and score(" ".join(["idiot", "scum", "moron", "loser"])) >= 0.9
    assert score("") < 0.3 and score("the and of ing") < 0.3


def test_held_out_rows(rows, model):
    s = toxicity.predict(model, pa.array([t for _, t, _ in rows[1]], pa.large_string())) >= toxicity.THRESHOLD
    y = np.array([y for *_, y in rows[1]]) == 1
    assert (s & y).sum() / y.sum() >= 0.9 and (s & ~y).sum() / (~y).sum() <= 0.01


def test_scores_by_loops(rows, model):
    """The machine's sum term by term and pair by pair."""
    for _, text, _ in rows[1][:60]:
        ids, _ = toxicity.terms(pa.array([text or ""]))
        x = model.bias + sum(float(model.weight[i]) for i in ids)
        live = [i for i in ids if model.factor[i].any()]
        x += sum(float(model.factor[i] @ model.factor[j]) for a, i in enumerate(live) for j in live[a + 1 :])
        assert abs(1 / (1 + np.exp(-(model.slope * x + model.offset))) - toxicity.predict(model, pa.array([text or ""]))[0]) < 1e-4
