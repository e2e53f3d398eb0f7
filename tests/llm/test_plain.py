"""The operators' own rules against plain versions, without Spark."""

import os
import random
import re
import time
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sheafspark.llm import byte_bpe, flac, jaccard_join, language_id, main_text, packing, pii, toxicity


def test_byte_bpe():
    import tiktoken

    codec = byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(1)
    texts = ["".join(r.choice("'''  \n\tstmdrelv aé1٣!. 　😀") for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", "a" * 3000, "it's we'll '''re"]
    ids, places = codec.encode_all(texts)
    for t, i, p in zip(texts, ids, places, strict=True):
        assert i == own.encode_ordinary(t)
        assert codec.decode(i) == t.encode()
        assert [m.start() for m in __import__("regex").finditer(public_tokenizers.PATTERN, t)] == p.tolist()


def test_byte_bpe_every_code_point():
    """The classes are the library's: each code point between letters, digits, blanks and apostrophes."""
    import regex

    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    codec = byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for at in range(0, len(points), 1 << 16):
        text = "".join(f"a{c}1 {c} 's{c}" for c in points[at : at + (1 << 16)] if unicodedata.category(c) != "Cn")
        (places,) = codec.encode_all([text])[1] if len(text) < 100 else [byte_bpe.boundaries(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0]))]
        assert [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)] == places.tolist()


def test_byte_bpe_long_text(monkeypatch):
    """A text that is cut has the ids and places of the whole."""
    codec = byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(11)
    texts = ["".join(r.choice("ab cd  's\n1.é ") for _ in range(3000)), "x" * 900, "", "a b"]
    want = codec.encode_all(texts)
    monkeypatch.setattr(byte_bpe, "PART_CHARS", 100)
    got = codec.encode_all(texts)
    assert got[0] == want[0] and all((a == b).all() for a, b in zip(got[1], want[1], strict=True))


def test_flac_round_trip_and_damage(monkeypatch):
    monkeypatch.setattr(flac, "RUN_FRAMES", 300)  # long streams are cut
    own = [os.urandom(192 * k) for k in (1, 3, 50, 1100)] + [b" " * 192 * 700] + [b" " * 192, bytes(range(192)), bytes([0, 255] * 96), flac.payload(None)[0], flac.payload("ü" * 300)[0]]
    made = flac.encode(own)
    assert flac.decode(made) == own
    for at in (30, 60, len(made[2]) - 1):
        bad = bytearray(made[2])
        bad[at] ^= 8
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_base_spans():
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def plain(t):
        out = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 16 <= len(d) <= 19 and pii.luhn(d), 8 <= len(d) <= 15)[k]
                if ok:
                    out.append((k, m.start(), m.end()))
        return out

    r = random.Random(3)
    for letters in ("a.@1-+% b", "1.2 3", "123 -", "+1( ).-2a"):
        for _ in range(3000):
            t = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
            assert sorted(pii.base_spans(t)) == plain(t)
    assert pii.mask("a 10.0.0.1 b", [(1, 2, 10)]) == "a <ip> b"


def test_obfuscated_addresses_anywhere():
    """Addresses of 20 to 120 characters are found at every place of the windows' grid, in one text or in many."""
    net = pii.train()
    texts, want = [], []
    for user, host in (("ann.lee", "mail.org"), ("firstname.lastname", "mail.company.com"), ("given.second-third.family", "post.department.company.com"), ("a.long-given.name.and.a.long.family-name.of.one", "the.mail.server.of.some.large.department.in.a.company.org")):
        for at in range(pii.STRIDE):
            lead = ("the river and the old house " * 5)[: 63 + at] + " "
            own = f"{user}(at){host}"
            texts.append(f"{lead}{own} said the letter, and the garden was quiet all the morning")
            want.append((0, len(lead), len(lead) + len(own)))
    found = pii.find_all(net, texts)
    assert [w for w, (_, spans) in zip(want, found, strict=True) if w not in spans] == []
    assert pii.find_all(net, texts, batch=3) == found
    assert pii.find_all(net, [t.replace("(at)", "(AT)") for t in texts]) == found
    whole = "\n".join(texts)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    assert set(pii.find_all(net, [whole])[0][1]) >= {(k, a + s, b + s) for (k, a, b), s in zip(want, starts.tolist(), strict=False)}


def test_packer_is_whole_and_tight():
    r = random.Random(5)
    sizes = [r.randint(1, 4096) for _ in range(4000)]
    packer = packing.Packer(most=256)
    bins: dict[int, int] = {}
    for n in sizes:
        at, offset = packer.put(n)
        assert bins.get(at, 0) == offset
        bins[at] = offset + n
    assert max(bins.values()) <= 4096 and len(bins) == packer.n_bins <= 1.08 * sum(sizes) / 4096 + 1


def test_packer_is_best_fit():
    """Against a plain list of open bins: least space left, of several the one put there last; the fullest closes when all are open."""
    r = random.Random(8)
    for length, most, largest in ((100, 5, 100), (64, 1, 64), (4096, 40, 900), (50, 1000, 30)):
        packer, bins, free = packing.Packer(length, most), 0, []
        for _ in range(1500):
            n = r.randint(1, largest)
            fit = min((f for f, _ in free if f >= n), default=None)
            if fit is None:
                at, left, bins = bins, length, bins + 1
                if n < length and len(free) >= most:
                    least = min(f for f, _ in free)
                    free.pop(max(i for i, (f, _) in enumerate(free) if f == least))
            else:
                at, left = free[i := max(i for i, (f, _) in enumerate(free) if f == fit)][1], fit
                free.pop(i)
            assert packer.put(n) == (at, length - left)
            if left > n:
                free.append((left - n, at))


def test_packing_without_word_ends(tmp_path):
    """A file whose tokenizer keeps white space is read by the library alone."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = {c: i for i, c in enumerate(pre_tokenizers.ByteLevel.alphabet())}
    own = Tokenizer(models.BPE(vocab, []))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    own.save(str(tmp_path / "t.json"))
    encoder, texts = packing.Encoder(str(tmp_path / "t.json")), ["a b", "", " x\n y"]
    assert encoder.plain
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_encoder():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), packing.Encoder(path)
    r = random.Random(2)
    texts = ["".join(r.choice("  \n\tABcΣς'sé1٣!. 　😀́İß.,") for _ in range(r.randint(0, 30))) for _ in range(1500)] + ["<|endoftext|> a", "a<|ENDOFTEXT|>b", "", "The the, THE."]
    for t, got in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_packing_encodes_a_word_once(monkeypatch):
    """A word with marks after it goes through the library once, whatever the marks; what is forgotten is encoded again."""
    path = public_tokenizers.path("word_bpe_49k.json")
    own, seen = packing.Encoder(path), []
    ids = own._ids
    own._ids = lambda text: seen.append(text) or ids(text)
    texts = ["house stone", "house, stone!! house. Stone?!", "", "... house... naïve! stone;", "stone's house:\n\nhouse,stone"]
    got = [own.encode_all([t])[0] for t in texts]
    assert not [s for s in seen[1:] if "house" in s.split() or "stone" in s.split()]
    monkeypatch.setattr(packing, "CACHE_BYTES", 60)
    small = packing.Encoder(path)
    for _ in range(2):
        assert [small.encode_all([t])[0] for t in texts] == got == small.encode_all(texts)
        assert len(small.parts) < 5


def test_shingles():
    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    texts = [None, "", " ", "a", "A b", "a b c d e", "a b c d e f a b c d e", "É é x y z w É é x y z w", "a\x0bb c"]
    sets = jaccard_join.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(plain(t)) for t in texts]
    for n in range(1, 400):  # partners of least size show enough shared ones
        assert jaccard_join.shared_needed(n) <= jaccard_join.lowest(n) <= n


def test_main_text():
    net = main_text.train(pages=250, epochs=4)
    made = main_text.labelled_pages(np.random.default_rng(77), 80)
    pages = [main_text.blocks(s) for s, _ in made]
    wanted = np.concatenate([[b[0] in w for b in p.blocks] for p, (_, w) in zip(pages, made, strict=True)])
    assert (np.concatenate(main_text.label(net, pages)) == wanted).mean() > 0.95
    assert main_text.extract_all(net, [None, "", "<p>"]) == ["", "", ""]
    assert [b[0] for b in main_text.blocks("<p>a &amp; b<p>c<br>d<script></p></script>").blocks] == ["a & b", "c d"]
    assert main_text.blocks("<p>Formula <math><mi>a</mi></math> here").blocks[0][0] == "Formula a here"
    # a page's tree and the list of each block's path say the same; pages of all depths and lengths
    deep = [main_text.blocks(s) for s in ("<div class='a b'>" * 90 + "x<p>y", "".join(f"<ul><li>{i}<b>z</b></ul>" for i in range(700)), "no tag")] + pages[:20]
    tree, spread = main_text.features(deep), main_text.features(deep, spread=True)
    assert np.allclose(main_text.inputs(net, tree), main_text.inputs(net, spread), atol=1e-4)
    # labels don't depend on what else is labelled, and a long page is one sequence
    long = main_text.blocks("<html><body>" + "".join(s for s, _ in made))
    assert len(long.blocks) > 1000
    x = main_text.inputs(net, main_text.features([long]))[:, None, :]
    z, _ = main_text.forward(net, x, np.ones(x.shape[:2], bool))
    assert (main_text.label(net, [*pages[:3], long])[3] == (z[:, 0] > 0)).all()


def test_main_text_in_linear_time():
    """Pages that nest, or leave open, a hundred thousand tags or quotes take seconds."""
    n = 100_000
    began = time.perf_counter()
    for page, first in (("<div>" * n + "x", "x"), ("<b>" * n + "</i>" * n + "x", "x"), ("<p " * n + '"', "<p <p"), ('<p "a" ' * n + "'", "<p"), ("<i><div>" + "<b>" * n + "</i>" * n + "y", "y"), ("<div>t " * (n // 4), "t"), ("</div>" * n + "z", "z"), ("<ul><li>" * (n // 2) + "q", "q"), ("<!-- <p" * n, None)):
        own = main_text.blocks(page).blocks
        assert own[0][0].startswith(first) if first else not own
    assert time.perf_counter() - began < 60


def test_language_and_toxicity():
    r = random.Random(4)
    make = lambda words: " ".join(r.choice(words) for _ in range(60))
    a, b = ["the", "and", "thing", "whole"], ["der", "und", "schön", "ganz"]
    texts = [make(a) for _ in range(60)] + [make(b) for _ in range(60)]
    m = language_id.train(texts, ["en"] * 60 + ["de"] * 60)
    x, letter = language_id.logits(m, pa.array(["the whole thing", "ganz schön", None, "123 !"]))
    assert [m.langs[i] for i in x[:2].argmax(1)] == ["en", "de"] and letter.tolist() == [True, True, False, False]
    y = [i % 4 == 0 for i in range(400)]
    tox = toxicity.train([make(a) + (" idiot scum" if t else "") for t in y], list(map(int, y)))
    s = toxicity.predict(tox, pa.array(["the idiot thing scum", "the whole", "", None]))
    assert s[0] >= 0.3 > s[1] and s[2] == s[3] < 0.3


def test_language_rejection():
    """Texts of no language of the training are rejected, those of its languages stay, and held-out rows without subwords don't lower the threshold."""
    r = random.Random(9)
    parts = {"en": "the and ing wh ou st er ly tion are".split(), "de": "sch ung der ein ich ver keit lich au zu".split(), "fr": "eau les tre ment oui que elle ais ou la".split(), "es": "cion los ado que ar mente la os ie al".split()}
    word = lambda lang: "".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3)))
    make = lambda lang, n: " ".join(word(lang) for _ in range(n))
    langs = [lang for lang in parts for _ in range(90 + 90 * (lang == "en"))]
    texts = [make(lang, 60) if r.random() < 0.9 else "1 2 3." for lang in langs]
    m = language_id.train(texts, langs)

    def rejected(own):
        x, letter, counts, unseen = language_id.evidence(m, pa.array(own))
        return language_id.unknown(m, language_id.softmax(x / m.temperature).max(axis=1), letter, counts, unseen)

    other = ["wszyscy ludzie rodzą się wolni i równi pod względem swej godności", "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan", "все люди рождаются свободными и равными в своем достоинстве", "人人生而自由在尊严和权利上一律平等", "xkq zvbt wrrgh plmk qqtz vbnm xcvz kjhg", "A.", "", "12"]
    assert rejected(other).all()
    assert rejected([make(lang, 60) for lang in parts for _ in range(100)]).mean() <= 0.01
