"""The registered queries over awkward tables, against plain versions: nulls in any column, no key, empty and long texts, repeated rows, ties, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from sheafspark.llm import flac, jaccard_join, language_id, main_text, packing, pii, queries, simhash, toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, node string, score int, copies string, media int, h double, piece string, `_t` string, `_text` int"
LABELS = "doc_id long, quality int, toxic int, text string, k int"
PAGES = "page_id long, url string, html string, n_chars string"
CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string"


def texts() -> list[tuple]:
    r = random.Random(2)
    parts = {"en": "the and ing wh ou st er ly tion are".split(), "de": "sch ung der ein ich ver keit lich au zu".split()}
    make = lambda lang, n: " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = []
    for i in range(240):
        lang = "de" if i % 3 == 0 else "en"
        text = make(lang, r.randint(12, 40))
        if i % 4 == 1:
            text += " you awful people"
        rows.append([i, text, lang, "web", len(text)])
    base = make("en", 60)
    rows += [[300, base, "en", None, 1], [301, base + " tail", "en", "x", None], [302, base, None, None, None], [302, base, None, None, None], [302, base, None, None, None]]
    rows += [[303, None, "en", "x", 0], [304, "", "en", "x", 0], [305, " \n\t ", "en", "x", 3], [306, "one", "en", "x", 3], [307, "One", "en", "x", 3], [308, "1 2 3", "en", "x", 3]]
    rows += [[None, base, "en", "x", 4], [None, "mail a.b@c.org or +49 30 1234567 or 10.0.0.1", "en", None, 4], [None, None, None, None, None], [400, make("de", 9000), "de", "x", 1], [500, "x" * 70_000, "en", "x", 1]]
    rows += [[600, "card 4111 1111 1111 1111, mail me(at)host.org é😀 10.0.0.300", "en", "x", 1]]
    return [(*row, "clash", 7, None, 1, 0.5, "p", "t", 9) for row in rows]


ROWS = texts()
SITE = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>", None), (3, "u", "plain &amp; text", "x"), (3, "u", "plain &amp; text", "x")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("awkward"))
    page = main_text.labelled_pages(np.random.default_rng(5), 6)
    spark.createDataFrame(ROWS, DOCUMENTS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, None, int(i % 4 == 1), "t", 1) for i in range(240)] + [(302, 1, None, None, None), (None, 1, 0, None, None)], LABELS).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(100, 0, "user", "a", "x"), (100, None, None, "b", "x"), (101, 0, "user", None, "x"), (None, 0, "user", "a", "x")], CONVERSATIONS).write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame(SITE + [(10 + i, "u", s, "x") for i, (s, _) in enumerate(page)], PAGES).write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("bare"))
    for name, schema in (("documents", DOCUMENTS), ("labels", LABELS), ("pages", PAGES), ("conversations", CONVERSATIONS)):
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(scope="module")
def answers(spark, folder):
    done = {}

    def get(name):
        if name not in done:
            done[name] = queries.QUERIES[name](spark, folder).collect()
        return done[name]

    return get


def pairs(rows):
    """doc_id and text of each row, in the order in which results are compared."""
    return sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))


def by_key(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def test_empty_tables(spark, bare):
    for name, query in queries.QUERIES.items():
        assert query(spark, bare).collect() == [], name
    assert corpus_pipeline.run(spark, bare).collect() == []


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op1_main_text", "op9_best_fit", "op13_prefix_trie")])
def test_a_row_for_each_row(answers, name):
    assert sorted(repr(r.doc_id) for r in answers(name)) == sorted(repr(r[0]) for r in ROWS)


def test_op1(answers):
    net = queries.labeller()
    want = SITE + [(10 + i, "u", s, "x") for i, (s, _) in enumerate(main_text.labelled_pages(np.random.default_rng(5), 6))]
    plain = [(i, u, t, len(t)) for (i, u, s, _) in want for t in main_text.extract_all(net, [s])]
    assert by_key(answers("op1_main_text"), "page_id", "url", "text", "n_chars") == sorted(plain, key=repr)
    assert {r.text for r in answers("op1_main_text") if r.page_id in (1, 2, None)} == {""}


def fingerprint(text):
    words = re.sub(r"[\x20\x09-\x0D]+", " ", text).split(" ")
    votes, total = [0] * 64, 0
    for a, b in zip(words, words[1:] + [""], strict=True):
        h, n = xxhash.xxh64(b.encode(), xxhash.xxh64(a.encode(), 42).intdigest()).intdigest(), min(len(a) + len(b), simhash.MOST_WEIGHT)
        total += n
        for k in range(64):
            votes[k] += n * (h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * votes[k] > total)


def test_op2(answers):
    """Every column against a plain version; the order of rows with the same key is the operator's."""
    h = lambda t: xxhash.xxh64(t.encode(), 42).intdigest()
    own = sorted(((i, t or "") for i, t, *_ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, h(x[1]) % simhash.PARTS, x[1]))
    prints = {t: fingerprint(t) for _, t in own}
    groups = {}
    for i, t in own:
        if i is not None and i % 100 == 0:
            groups[prints[t]] = min(i, groups.get(prints[t], i))
    want = []
    for (i, t), (_, after) in zip(own, own[1:] + own[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        f, e = prints[t], fingerprint(edited)
        like = lambda a, b: (64 - (a ^ b).bit_count()) / 64
        near = sorted((d, q) for p, q in groups.items() if (d := (p ^ f).bit_count()) <= simhash.NEAR_RADIUS and q != (-1 if i is None else i))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{f:016x}", f"{e:016x}", like(f, e), like(f, prints[after]), [(q, d) for d, q in near], groups[f] if i is not None and i % 100 == 0 else None))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, [tuple(x) for x in r.near_queries], r.query_group) for r in answers("op2_simhash")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_simhash_order_with_a_hot_key(spark):
    """One key holds most rows, one lies far off: the ring is whole, and no range holds everything."""
    rows = [(5, f"t{i}") for i in range(900)] + [(i, f"k{i}") for i in range(300)] + [(1 << 60, "far"), (-(1 << 60), "low"), (None, "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    h = lambda t: xxhash.xxh64(t.encode(), 42).intdigest() % simhash.PARTS
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, h(x[1]), x[1]))
    got = simhash.with_next(table, bucket_rows=20)
    assert sorted(((r.text, r.next_text) for r in got.collect())) == sorted((a[1], b[1]) for a, b in zip(want, want[1:] + want[:1], strict=True))
    starts = simhash.ranges(table.withColumnRenamed("doc_id", "_k"), len(rows), 20, 1000)
    assert (5, True) in starts and len(starts) > 10


def test_op3(answers):
    want = []
    for i, t, *_ in ROWS:
        raw = (t or "").encode()
        own = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want.append((i, len(raw), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:]), flac.feature(own)))
    assert by_key(answers("op3_flac"), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature") == sorted(want, key=repr)
    assert all(r.media_sha256 == hashlib.sha256(flac.encode([flac.payload(dict(pairs(ROWS))[r.doc_id])[0]])[0]).hexdigest() for r in answers("op3_flac") if r.doc_id in (300, 400, 500))


def test_flac_seeks(spark):
    """Blocks that hold given samples, of long and short streams, without reading the rest."""
    rows = [(1, "abc " * 200_000), (2, "short"), (3, None), (None, "é" * 5000)]
    media = flac.store(spark.createDataFrame(rows, "doc_id long, text string"))
    size = 192 * 16
    for wanted in (None, (0, 1), (500_000, 500_001), (9000, 60_000), (10**9, 10**9 + 5)):
        got = {(r.doc_id, r.first_sample): bytes(r.pcm) for r in flac.pcm_blocks(media, samples=wanted).collect()}
        plain = {}
        for i, t in rows:
            own = flac.payload(t)[0]
            plain |= {(i, a): own[a : a + size] for a in range(0, len(own), size) if not wanted or (a < wanted[1] and a + size > wanted[0])}
        assert got == plain, wanted
    raw = bytearray(flac.encode([flac.payload("abc " * 200_000)[0]])[0])
    raw[len(raw) // 2] ^= 1
    broken = spark.createDataFrame([(1, bytes(raw))], "doc_id long, media binary")
    assert flac.pcm_blocks(broken, samples=(0, 100)).count() == 1  # the damage lies elsewhere
    with pytest.raises(Exception, match="checksum|damaged|codes end"):
        flac.pcm_blocks(broken).collect()


def test_op4(answers):
    assert by_key(answers("op4_hash_tree"), "doc_id", "size", "text_crc32") == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS), key=repr)
    slots = {}
    for r in answers("op4_hash_tree"):
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op5(answers):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    from tiktoken.load import load_tiktoken_bpe

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, *_ in ROWS for ids in [own.encode_ordinary(t or "")]]
    assert by_key(answers("op5_byte_bpe"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_op6(spark, folder, answers):
    """The rows that may teach do, equal texts get equal answers, texts without letters are und; held-out rows are named rightly."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = answers("op6_language")
    assert all(r.held_out == (held(r.doc_id) if r.doc_id is not None else None) for r in rows)
    taught = sorted(((i, t, lang) for i, t, lang, *_ in ROWS if t is not None and lang is not None and i is not None and not held(i) and len(t) <= language_id.TRAIN_CHARS), key=lambda x: x)
    m = language_id.train([t for _, t, _ in taught], [lang for *_, lang in taught])
    x, letter, *_ = language_id.evidence(m, pa.array([t for _, t, *_ in ROWS]))
    p = language_id.softmax(x / m.temperature)
    want = [(i, m.langs[a] if ok else "und", round(float(s) if ok else 0.0, 9)) for (i, *_), a, s, ok in zip(ROWS, p.argmax(1), p.max(1), letter, strict=True)]
    assert sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in rows), key=repr) == sorted(want, key=repr)
    lang = {i: k for i, _, k, *_ in ROWS[:240]}
    known = [r for r in rows if r.doc_id in lang and r.held_out]
    assert known and all(r.lang_pred == lang[r.doc_id] for r in known)


def test_op6_rare_languages(spark):
    """A language of few rows among many is learnt all the same."""
    rows = [(i, "the thing and the other thing " * 3, "en") for i in range(9000)] + [(9000 + i, "zwölf schöne kühe grüßen müde bären " * 3, "de") for i in range(30)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]


def test_op7(answers):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = answers("op7_toxicity")
    assert all(r.held_out == (held(r.doc_id) if r.doc_id is not None else None) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    marked = [(i, t, int(i % 4 == 1)) for i, t, *_ in ROWS[:240] if not held(i)]
    m = toxicity.train([t for _, t, _ in marked], [y for *_, y in marked])
    want = [(i, round(float(s), 9)) for (i, *_), s in zip(ROWS, toxicity.predict(m, pa.array([r[1] for r in ROWS])), strict=True)]
    assert sorted(((r.doc_id, round(r.score, 9)) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(r.predicted == (r.doc_id % 4 == 1) for r in rows if r.doc_id is not None and r.doc_id < 240)


def test_toxicity_of_pairs_alone():
    """Two words, each of which says nothing: only that both or neither stand in a text does."""
    r = random.Random(3)

    def make(n):
        out, y = [], []
        for _ in range(n):
            a, b = r.random() < 0.5, r.random() < 0.5
            words = [f"word{r.randrange(300)}" for _ in range(20)] + ["alpha"] * a + ["beta"] * b
            r.shuffle(words)
            out.append(" ".join(words))
            y.append(int(a == b))
        return out, np.array(y)

    model, (own, y) = toxicity.train(*make(4000)), make(1000)
    assert ((toxicity.predict(model, pa.array(own)) >= 0.5) == y).mean() > 0.95
    # chance alone lets no pair in
    noise = [" ".join(f"word{r.randrange(300)}" for _ in range(20)) for _ in range(2000)]
    blank = toxicity.train(noise, [r.randrange(2) for _ in noise])
    assert (np.abs(blank.factor).sum(1) > 0).sum() <= 5


def test_terms_of_a_very_long_text(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    want = toxicity.terms(pa.array([text]))[0].tolist()
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 100)
    parts = toxicity._parts
    monkeypatch.setattr(toxicity, "_parts", lambda member: parts(member, 100))
    assert toxicity.terms(pa.array([text]))[0].tolist() == want
    # and of languages
    model = language_id.train(["the and thing " * 5, "der und ganz " * 5], ["en", "de"])
    one = language_id.evidence(model, pa.array([text]))
    monkeypatch.setattr(language_id, "CHUNK_BYTES", 64)
    assert all(np.allclose(a, b) for a, b in zip(one, language_id.evidence(model, pa.array([text])), strict=True))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_op8(answers):
    sets = [shingles(t) for _, t, *_ in ROWS]
    least = list(range(len(ROWS)))
    for _ in range(3):
        for a in range(len(ROWS)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    least[a] = least[b] = min(least[a], least[b])
    ids = {}
    for k, (i, *_) in zip(least, ROWS, strict=True):
        ids.setdefault(k, []).append(i)
    name = {k: min((i for i in own if i is not None), default=None) for k, own in ids.items()}
    want = [(i, len(s), name[k]) for (i, *_), s, k in zip(ROWS, sets, least, strict=True)]
    assert by_key(answers("op8_jaccard_join"), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_one_of_each_group_stays(spark):
    """Repeated rows, keys that are null or stand for several texts, rows without words."""
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, long), (5, long), (5, other), (3, long + " x"), (None, long), (None, "alone here"), (None, "alone here"), (7, ""), (7, ""), (8, None), (9, other)]
    table = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, _k string")
    got = [(r.doc_id, r.text) for r in jaccard_join.representatives(table).collect()]
    assert sorted(got, key=repr) == sorted([(3, long + " x"), (5, other), (None, "alone here"), (7, ""), (7, ""), (8, None)], key=repr)


def test_words_that_polynomials_confuse():
    """Words of a thousand letters in Thue-Morse order and their swap: polynomial hashes modulo powers of two are equal."""
    thue = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    swap = thue.translate({97: "b", 98: "a"})
    a, b = jaccard_join.shingle_sets(pa.array([f"{thue} one two", f"{swap} one two"]))
    assert a.tolist() != b.tolist()
    words = [thue[:k] for k in range(1, 600)] + [swap[:k] for k in range(1, 600)] + [f"{i}" for i in range(3000)] + ["a" * k for k in range(600, 900)]
    (whole,) = jaccard_join.shingle_sets(pa.array([" ".join(words)]), 1)
    assert len(whole) == len(set(words))
    apart = {int(s[0]) for s in jaccard_join.shingle_sets(pa.array(words), 1)}
    assert set(whole.tolist()) == apart  # wherever a word stands


def test_hot_keys_are_joined_apart(spark):
    from sheafspark.llm.common import join_counted

    big = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 50), (None, 51), (3, 52)], "k int, v int")
    small = spark.createDataFrame([(1, "a", 50), (2, "b", 1), (9, "c", 0)], "k int, s string, n long")
    for hot in (0, 10, 100):
        assert sorted((r.v, r.s) for r in join_counted(big, small, "k", "n", hot_rows=hot).collect()) == [(i, "a") for i in range(50)] + [(50, "b")]
        left = join_counted(big, small, "k", "n", "left", hot).collect()
        assert sorted((r.v, r.s or "") for r in left) == [(i, "a") for i in range(50)] + [(50, "b"), (51, ""), (52, "")]


def test_op9(answers):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t, *_ in ROWS:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    rows = answers("op9_best_fit")
    assert by_key(rows, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= 1 + -(-sum(w[3] for w in want) // 4096)


def test_op10(answers):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    want = []
    for i, t, *_ in ROWS:
        spans = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                if (True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(d) <= 19 and pii.luhn(d), 8 <= len(d) <= 15)[k]:
                    spans.append((k, m.start(), m.end()))
        want.append((i, *[sum(s[0] == k for s in spans) for k in range(4)], hashlib.sha256(pii.written(spans).encode()).hexdigest()))
    rows = answers("op10_pii")
    assert by_key(rows, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    spans = {r.doc_id: r.spans for r in rows}
    assert "email" in spans[600] and "card:5:24" in spans[600] and spans[303] == spans[304] == ""


def test_added_spans_are_right():
    """Obfuscated addresses, dotted numbers and phone numbers without a plus sign are added, look-alikes aren't; base spans all stay."""
    net, r = queries.network(), random.Random(4)
    lead = "the river and the old house by the sea "
    for own, kind in (("ann.lee(at)mail.org", 0), ("bob_2 [at] web.example.com", 0), ("(415) 555-0134", 3), ("415-555-0134", 3)):
        (_, spans), = pii.find_all(net, [lead + own + " was on the paper that morning"])
        assert (kind, len(lead), len(lead) + len(own)) in spans, own
    clean = [f"{lead} on {y}-{m:02d}-{d:02d} at {d}:{m:02d} there were {y * 7} of {m}.{d} " for y in (1999, 2024) for m in (3, 11) for d in (7, 28)]
    assert all(s == [] for _, s in pii.find_all(net, clean))
    text = " ".join(r.choice(["a.b@c.org", "10.1.2.3", "x", "2024-01-02", "+49 30 1234567"]) for _ in range(300))
    (base, spans), = pii.find_all(net, [text])
    assert set(base) <= set(spans) and len({(a, b) for _, a, b in spans}) == len(spans)


def test_pipeline(spark, folder):
    """run() against plain versions of its stages, one after another, and each stage's columns."""
    docs = [(i, t, lang, src, n) for i, t, lang, src, n, *_ in ROWS]
    kept = spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "personal_data", "packing"]
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(kept) == sorted(docs, key=repr)

    tox = queries.toxicity_model(spark, folder)
    docs = [d for d, s in zip(docs, toxicity.predict(tox, pa.array([d[1] for d in docs], pa.string())), strict=True) if s < toxicity.THRESHOLD]
    kept = stages["toxicity"](spark, kept, folder)
    assert rows(kept) == sorted(docs, key=repr) and not any("awful" in (d[1] or "") for d in docs)

    m = queries.language_model(spark.read.parquet(f"{folder}/documents.parquet"))
    x, letter, counts, unseen = language_id.evidence(m, pa.array([d[1] for d in docs], pa.string()))
    gone = language_id.unknown(m, np.where(letter, language_id.softmax(x / m.temperature).max(1), 0), letter, counts, unseen)
    docs = [d for d, g in zip(docs, gone, strict=True) if not g]
    kept = stages["language"](spark, kept, folder)
    assert rows(kept) == sorted(docs, key=repr) and sum(d[0] is not None and d[0] < 240 for d in docs) > 160

    sets, best = [shingles(d[1]) for d in docs], {}
    group = list(range(len(docs)))
    for _ in range(3):
        for a in range(len(docs)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    group[a] = group[b] = min(group[a], group[b])
    for k, d in zip(group, docs, strict=True):
        best[k] = min(best.get(k, d), d, key=lambda x: (x[0] is None, x[0] or 0))
    kept = stages["near_duplicates"](spark, kept, folder)
    # one document of each group, that with the smallest key; rows without words are groups of their own
    assert rows(kept) == sorted(best.values(), key=repr)
    docs = list(best.values())

    net = queries.network()
    docs = [(i, t if t is None else pii.mask(t, s), lang, src) for (i, t, lang, src, _), (_, s) in zip(docs, pii.find_all(net, [d[1] for d in docs]), strict=True)]
    kept = stages["personal_data"](spark, kept, folder)
    assert rows(kept) == sorted([(*d, None if d[1] is None else len(d[1])) for d in docs], key=repr)

    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    sizes = sorted((repr(d[0]), len(x) // 4 + 1) for d, x in zip(docs, encoder.encode_all([d[1] or "" for d in docs]), strict=True))
    out = corpus_pipeline.run(spark, folder).collect()
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert sorted((repr(k), n) for k, n in total.items()) == sizes
