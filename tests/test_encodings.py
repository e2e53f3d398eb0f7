"""Encodings told apart by their bytes."""

import tracemalloc
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from sheafspark.functions import encodings
from sheafspark.plans import catalog
from sheafspark.sources import packages

TEXTS = {
    "latin": "Größe und Maß: für Äpfel, Öl und Übermut gibt es keine Wörterbücher. Élève, où êtes-vous? El niño comió piñas en Perú. ",
    "cyrillic": "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Всё смешалось в доме. ",
    "han": "天地玄黄，宇宙洪荒。日月盈昃，辰宿列张。寒来暑往，秋收冬藏。闰余成岁，律吕调阳。云腾致雨，露结为霜。",
    "japanese": "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた。",
}
USED = {"latin-1": "latin", "gb18030": "han", "windows-1251": "cyrillic", "koi8-r": "cyrillic", "shift_jis": "japanese"}


def test_confusion_of_encodings():
    """Real sentences, whole and in parts, in each encoding that can write them: nine in ten of short parts and all of longer ones come back."""
    for size, least in ((12, 0.9), (40, 1.0), (1000, 1.0)):
        table = Counter()
        for k, text in TEXTS.items():
            for name in encodings.ENCODINGS:
                if USED.get(name, k) != k:
                    continue
                for at in range(0, max(1, len(text) - size), max(1, size // 3)):
                    part = text[at : at + size]
                    got, found = encodings.decoded(part.encode(name))
                    table[name, "ok" if got == part else found] += 1
        for name in encodings.ENCODINGS:
            own = {k: n for k, n in table.items() if k[0] == name}
            assert own[name, "ok"] >= least * sum(own.values()), (size, own)


def test_order_and_confidence():
    found = encodings.ranked("Größe für Äpfel".encode("latin-1"))
    assert found[0][0] == "latin-1" and found[0][1] > 0.5 and abs(sum(c for _, c, _ in found) - 1) < 1e-6
    assert [c for _, c, _ in found] == sorted((c for _, c, _ in found), reverse=True)
    assert encodings.ranked(b"plain") == [("utf-8", 1.0, "plain")] and encodings.decoded(b"") == ("", "utf-8")
    assert encodings.decoded("é".encode("utf-8-sig")) == ("é", "utf-8-sig") and encodings.decoded("é".encode("utf-16")) == ("é", "utf-16") and encodings.decoded("é".encode("utf-32")) == ("é", "utf-32")
    assert packages.decode("naïve café".encode("latin-1")) == ("naïve café", "latin-1")
    assert encodings.decoded(b"\xff")[1] and encodings.decoded(bytes(range(256)))[0]


def test_a_model_of_given_texts():
    rows = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    model = encodings.fitted({"own": rows[::2]}, ("utf-8", "utf-16-le", "utf-16-be", "latin-1", "gb18030", "windows-1252"))
    for name in ("utf-8", "utf-16-le", "utf-16-be", "latin-1"):
        part = [t for t in rows[1::2] if encodings._fits(t, name)]
        assert sum(encodings.decoded(t.encode(name), model)[0] == t for t in part) >= 0.99 * len(part) > 50


def test_short_texts_with_accents():
    """One or two words of Latin-1, where few pairs speak for it; words of Cyrillic and Han still come back."""
    for text in ("Ré.", "Éch.", "Éé.", "Ñ.", "Ó.", "Éçé.", "chö.", "Óll.", "Ungß", "Öu.", "Äpf.", "Für é.", "Ñ é.", "Schö ç.", "É é."):
        for name in ("utf-8", "utf-16-le", "utf-16-be", "latin-1"):
            assert encodings.decoded(text.encode(name)) == (text, name), (text, name)
    for text, names in (("Привет", ("windows-1251", "koi8-r")), ("слово", ("windows-1251", "koi8-r")), ("中国", ("gb18030",)), ("日本語", ("shift_jis",))):
        for name in names:
            assert encodings.decoded(text.encode(name)) == (text, name), (text, name)


def test_long_values_are_looked_at_a_piece_at_a_time(monkeypatch):
    """What is held doesn't grow with the value, but for the text found: 16 to 20 times the bytes when all was counted and read at once."""
    encodings.made_model()
    for name in ("utf-8", "utf-16-le", "latin-1", "utf-16"):
        raw = (TEXTS["latin"] * 30_000).encode(name)
        tracemalloc.start()
        got = encodings.decoded(raw)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == (TEXTS["latin"] * 30_000, name) and most < 3 * len(raw) + (8 << 20), (name, most / len(raw))
    parts = [text.encode(name)[:n] for k, text in TEXTS.items() for name in (*encodings.ENCODINGS, "utf-16", "utf-8-sig") if USED.get(name, k) == k for n in (0, 1, 2, 3, 31, 62, 63, 200)]
    want = [encodings.ranked(raw) for raw in parts]
    for piece in (2, 4, 62):
        monkeypatch.setattr(encodings, "PIECE", piece)
        assert [encodings.ranked(raw) for raw in parts] == want


def test_a_sequence_of_three_bytes_beside_ascii():
    """A word or two in UTF-8 with one character of three or four bytes: read as Latin-1 before."""
    for text in ("a ஔ", "a ᚠ", "a ⓐ", "a ゟ", "a 🜁", "x ▲ y", "5 €", "a – b"):
        assert encodings.decoded(text.encode()) == (text, "utf-8"), text


def test_encoding_detect_of_odd_texts(spark, tmp_path):
    """Null and empty texts, and a text that begins with what would be a mark, under even and odd keys and none."""
    texts = [None, "", "\ufeffmarked", "\ufeff", "\0", "a ஔ", "é", "plain", "x" * 300_000 + "é"]
    rows = [(k, text) for i, text in enumerate(texts) for k in (2 * i, 2 * i + 1)] + [(None, "no key"), (None, None), (-3, "below"), (-4, "")]
    keys, values = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(keys, pa.int64()), "text": pa.array(values, pa.string())}), tmp_path / "documents.parquet")
    got = catalog.queries()["encoding_detect"](spark, str(tmp_path)).select("doc_id", "encoding", "n_chars").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, encoding, n_chars FROM ({catalog.oracle_sql()['encoding_detect']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
