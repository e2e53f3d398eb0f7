"""Rules of Python over batches."""

import pandas as pd

from sheafspark.plans import catalog
from sheafspark.sources import packages

DATA = "/root/testdata/sf0.001"


def test_a_text_that_comes_up_again_is_worked_out_once(spark):
    from sheafspark.operators import texts

    asked = []
    rule = texts.mapped(lambda x: asked.append(x) or x.upper())
    assert rule.func(pd.Series(["b", "a", None, "b", "a", ""])).tolist() == ["B", "A", None, "B", "A", ""]
    assert asked == ["b", "a", ""]


def test_fragments_are_worked_out_once(spark, monkeypatch):
    from sheafspark.functions import markup
    from sheafspark.sources import html

    asked, own = [], markup.to_markdown
    monkeypatch.setattr(markup, "to_markdown", lambda x: asked.append(x) or own(x))
    assert html.markdown.func(pd.Series(["<b>x</b>", None, "<b>x</b>", ""])).tolist() == ["**x**", "", "**x**", ""]
    assert asked == ["<b>x</b>", ""]


def test_costly_rules_are_dealt_over_all_partitions(spark):
    for name in ("omml_formulas", "html_fragments"):
        assert catalog.queries()[name](spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_values_become_objects_a_slice_at_a_time(spark):
    from sheafspark.operators import batches, texts

    rows = [(i, None if i % 7 == 0 else b"" if i % 7 == 1 else (f"{i} é " * (i % 5 * 20000)).encode()) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, raw binary").coalesce(1)
    got = {r["k"]: (r["text"], r["encoding"]) for r in texts.decoded(df, ["k"], "raw").collect()}
    assert got == {k: (None, None) if raw is None else packages.decode(raw) for k, raw in rows}

    def held(_):  # the longest list of values or keys that this worker has
        import gc

        return (max(len(x) for x in gc.get_objects() if type(x) is list and x and all(v is None or type(v) is bytes for v in x)),)

    many = spark.range(4000).selectExpr("id AS k", "encode(repeat('x', 1000), 'UTF-8') AS raw").coalesce(1)
    most = batches.by_slices(many, ["k"], "raw", held, "most int").agg({"most": "max"}).first()[0]
    assert 0 < most <= batches.SLICE_BYTES // 1000 + 1


def test_tables_are_aligned_without_a_call_for_each_document(spark):
    from sheafspark.operators import alignment

    schema = "d long, o long, t string, r int, c int, m int"
    wanted = [(d, o, t, 1, 2, 0) for d in (1, 2, None) for o, t in ((3, "a b"), (1, ""), (2, "abc"))]
    there = [(d, o, t, r, 2, 0) for d in (1, None, 9) for o, t, r in ((1, "", 1), (2, "x", 1), (3, "ab", 1), (4, "a", 7))]
    df = alignment.aligned(spark.createDataFrame(wanted, schema), spark.createDataFrame(there, schema).selectExpr("*", "o * 10 AS k"), ["d"], "o", "t", "r", "c", "m", "k")
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted([(d, o, k) for d, ks in ((1, (10, 30, 40)), (2, (None,) * 3), (None, (10, 30, 40))) for o, k in zip((1, 2, 3), ks, strict=True)], key=repr)
    assert "CoGroup" not in df._jdf.queryExecution().toString()
