"""Fill-in-middle, token counts and the prefix trie against plain versions, over awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sheafspark.llm import fill_middle, prefix_trie, token_counts

TEXTS = [
    None, "", "a", "<", "<P", "<P>", "<S>", "<M>", "x<M>y", "<<P>", "<PP>", "<p>", "<P >", "P>", "é<S>é", "日本<語>P", "😀<M", "ab<S", ">", "a<Pé>", "The quick  brown\n\nfox's 12 <jumps>",
    "<|endoftext|> a <|endoftext|>", "\x00a\x00", "word " * 400, "é" * 700, "日a" * 900, "x" * 5000, "<" * 600,
]


def plain_cut(key, text, seed=1):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    g = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(g[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no key here"), (None, "no key here"), (7, "again"), (7, "again"), (5000, "Some longer text, with words. " * 50_000)]
    return rows, spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, n int, form string, `_text` string")


def test_cuts_equal_a_plain_version(spark):
    rows, docs = documents(spark)
    got = fill_middle.transform(docs.repartition(3))
    back = got.select("*", fill_middle.restored(got.form, got.output).alias("back")).collect()
    want = sorted(((i, *plain_cut("" if i is None else i, t or "")) for i, t in rows), key=repr)
    assert sorted((tuple(r)[:6] for r in back), key=repr) == want
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert sorted((repr((r.doc_id, r.back)) for r in back)) == sorted(repr((i, t or "")) for i, t in rows)
    assert fill_middle.digest(docs.limit(0)).collect() == []


def test_scan_over_segments(monkeypatch):
    """Texts that lie across segments and blocks, every cut of each."""
    monkeypatch.setattr(fill_middle, "SEGMENT", 256)
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "B", "<P>", "<", ">", "é", "日", "😀", " ", "<S", "M>"]) for _ in range(r.randint(0, 300))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    scan = fill_middle.Scan(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, t in enumerate(texts):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        assert scan.count[i] == len(units)
        assert scan.marked[i] == len(re.findall("<[PSM]>", t))
        at = scan.cuts(np.full(len(units) + 1, i), np.arange(len(units) + 1)) - offsets[i]
        assert at.tolist() == [len("".join(units[:k]).encode()) for k in range(len(units) + 1)]


def test_bytes_that_are_not_utf8():
    data = np.frombuffer(b"a\x80b\xe2\x82\xc3", np.uint8)
    scan = fill_middle.Scan(data, np.array([0, len(data)]))
    assert scan.count[0] == 5


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_and_what_is_encoded(spark, tmp_path, library, monkeypatch):
    rows, docs = documents(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = token_counts.Cache(spark, str(tmp_path))
    got = token_counts.count_tokens(docs.repartition(5), path, cache).collect()
    want = [(i, len((t or "").encode()), n := library(t or ""), n > 512) for i, t in rows]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    name = token_counts.version(path)
    assert cache.counts(name).count() == len({t or "" for _, t in rows})
    stored = lambda: spark.read.parquet(f"{tmp_path}/{name}").count()
    first = stored()
    assert first == cache.counts(name).count()  # each digest was encoded once
    # a second run finds all, a run with one more text encodes that one
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(90_001, "a new one"), (90_002, "a new one")], "doc_id long, text string"))
    assert token_counts.count_tokens(docs, path, cache).count() == len(rows)
    assert stored() == first
    again = token_counts.count_tokens(more, path, cache)
    assert [r.n_tokens for r in again.filter("doc_id > 90000").collect()] == [library("a new one")] * 2
    assert stored() == first + 1
    assert token_counts.count_tokens(docs.limit(0), path, cache).collect() == []


def test_stored_counts_are_taken(spark, tmp_path):
    """A count that the cache has is not computed again, and one of another version is not taken."""
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), token_counts.Cache(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "abc"), (2, "other")], "doc_id long, text string")
    known = spark.createDataFrame([(bytearray(hashlib.sha256(b"abc").digest()), 77)], "digest binary, n_tokens long")
    cache.append(token_counts.version(path), known)
    cache.append("0" * 64, known.selectExpr("digest", "99L AS n_tokens"))
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path, cache).collect()} == {1: 77, 2: 1}


def test_other_vocabularies(spark, tmp_path):
    """White space is normalised where the vocabulary does so itself; counts are the libraries' own."""
    import sentencepiece

    texts = ["a  b", "a b", "a\n\tb ", " A B", "<|ENDOFTEXT|>  x", "<|endoftext|> x", "", None, "It's  12 °C\r\n", "  x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cache = token_counts.Cache(spark, str(tmp_path))
    word, piece = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    t = Tokenizer.from_file(word)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, word, cache).collect()} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert cache.counts(token_counts.version(word)).count() < len(texts) - 1  # "a  b" and "a b" are one
    p = sentencepiece.SentencePieceProcessor(model_file=piece)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, piece, cache).collect()} == {i: len(p.encode(x or "")) for i, x in enumerate(texts)}
    assert len({token_counts.version(v) for v in (word, piece)}) == 2
    with pytest.raises(ValueError):
        token_counts.version("x.txt")


def test_parts_are_encoded_as_in_the_whole(library):
    r = random.Random(1)
    text = " ".join(r.choice(["word", "It's", "12", "  ", "\n\n", "ünter", "a", "<|endoftext|>", "x!?"]) for _ in range(4000))
    parts = list(token_counts.pieces(text, 500))
    assert len(parts) > 10 and "".join(parts) == text
    assert sum(map(library, parts)) == library(text)


# The trie ---------------------------------------------------------------------


def plain_trie(rows):
    """Every node by enumeration."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0], x[1], hashlib.md5(x[2].encode()).hexdigest()))] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members, ends = {}, {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(tuple(built[c][:d]), []).append(c)
        ends.setdefault(tuple(built[c]), []).append(str(c))
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    return sorted(((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(",".join(ends.get(k, [])).encode()).hexdigest()) for k in members), key=repr)


def trie_of(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, block string")
    got = prefix_trie.nodes(df.repartition(parts))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_trie_of_awkward_conversations(spark):
    r = random.Random(9)
    turn = lambda: (r.choice(["user", "assistant", None]), r.choice(["a", "bb", "", None, "ccc é"]))
    rows = [(c, t, *turn()) for c in [*range(100, 130), *range(205, 215), *range(300, 306)] for t in range(r.randint(1, 7))]
    rows += [(c, t, *turn()) for c in (130, 131) for t in (None, 0, 0, 5, None, 5)]  # ties and no turn
    rows += [(132, 1, "user", "same")] * 4 + [(None, 0, "user", "lost")]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_long_conversations_and_towers(spark):
    """Chains over several blocks, a tower of conversations that go one turn further each, many equal ones."""
    line = [("user", f"turn {k % 17}") for k in range(2100)]
    rows = [(c, t, *x) for c, n in ((701, 2100), (702, 2100), (703, 130), (704, 64), (705, 63), (706, 1500)) for t, x in enumerate(line[:n])]
    rows += [(707, t, *x) for t, x in enumerate([*line[:1100], ("user", "apart"), *line[1101:1300]])]
    rows += [(800 + k, t, *x) for k in range(1, 40) for t, x in enumerate(line[: k + 6])]
    rows += [(c, t, "user", "equal") for c in range(1000, 1300) for t in range(3)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []
    assert trie_of(spark, [(1, None, None, None)], 1) == plain_trie([(1, None, None, None)])
