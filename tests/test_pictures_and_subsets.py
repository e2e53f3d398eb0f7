"""Pictures as files, kinds whose encoding is asked for, and subsets against a plain version."""

import hashlib
import os
import random

from pyspark.sql import functions as F

from sheafspark.operators import cells
from sheafspark.sources import formats, pictures


def test_pictures_are_one_file_each(spark, tmp_path):
    png, jpg = b"\x89PNG\r\n" + bytes(50), b"\xff\xd8\xff\xe0" + bytes(9)
    rows = [(1, png), (2, jpg), (3, png), (4, None), (5, b""), (6, b"RIFF1234WEBP"), (7, png)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "i int, content binary").repartition(3)
    at = str(tmp_path / "pictures")
    name = lambda b, s: f"{hashlib.sha256(b).hexdigest()}.{s}"
    want = {1: name(png, "png"), 2: name(jpg, "jpg"), 3: name(png, "png"), 4: None, 5: name(b"", "bin"), 6: name(rows[5][1], "webp"), 7: name(png, "png")}
    for _ in range(2):  # a second run finds its files and changes none
        got = pictures.store(df, "content", at)
        assert got.columns == ["i", "file", "size_bytes"] and {r.i: r.file for r in got.collect()} == want
        assert sorted(os.listdir(at)) == sorted(set(filter(None, want.values())))
        stamps = {n: os.stat(f"{at}/{n}").st_mtime_ns for n in os.listdir(at)}
    assert stamps == {n: os.stat(f"{at}/{n}").st_mtime_ns for n in os.listdir(at)}
    assert open(f"{at}/{want[1]}", "rb").read() == png


def test_kinds_that_need_an_encoding(spark):
    df = spark.createDataFrame([("text",), ("docx",), ("csv",), (None,)], "c string")
    assert [r[0] for r in df.select(formats.needs_encoding(F.col("c"))).collect()] == [True, False, True, False]


def test_subsets_against_all_pairs(spark):
    r = random.Random(4)
    sets = [(g, i, sorted(r.sample(range(12), r.randint(0, 6)))) for g in ("a", "b") for i in range(60)]
    sets += [("c", 1, []), ("c", 2, []), ("d", 1, [3, 3]), ("d", 2, [3]), ("d", 3, [3, 3, 4]), ("a", 900, list(range(12)))]
    df = spark.createDataFrame(sets, "g string, k int, s array<int>")
    got = cells.without_subsets(df, "g", "k", "s")
    want = {(g, k) for g, k, s in sets if not any(h == g and set(s) < set(o) for h, _, o in sets)}
    assert got.columns == ["g", "k", "s"] and {(x.g, x.k) for x in got.collect()} == want


def test_subsets_of_groups_small_and_large(spark, monkeypatch):
    """Groups on both sides of the row limit, nulls as groups, sets and elements; the sets are worked out once."""
    r = random.Random(6)
    for few in (cells.FEW_ROWS, 5, 0):
        monkeypatch.setattr(cells, "FEW_ROWS", few)
        sets = [(g, i, [None if x == 9 else x for x in r.sample(range(10), r.randint(0, 5))]) for g, n in ((1, 5), (2, 6), (3, 90), (4, 64)) for i in range(n)]
        sets += [(5, 1, [None]), (5, 2, [None, 1]), (5, 3, None), (5, 4, []), (6, 1, None), (6, 2, []), (None, 1, [1]), (None, 2, [1, 2]), (7, 1, [])]
        made = spark.sparkContext.accumulator(0)

        def as_it_is(x, made=made):
            made.add(1)
            return x

        df = spark.createDataFrame(sets, "g int, k int, s array<int>").select("g", "k", F.udf(as_it_is, "array<int>")("s").alias("s"))
        got = cells.without_subsets(df, "g", "k", "s").collect()
        under = lambda s, o: s is not None and o is not None and set(s) < set(o)
        want = [(g, k, s) for g, k, s in sets if g is None or not any(h == g and under(s, o) for h, _, o in sets)]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
        assert made.value == len(sets)
