"""Closures, rectangles, connected cells, alignment and substitution against plain versions."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from sheafspark.operators import alignment, boxes, graph, regions, substitution
from sheafspark.operators.cells import table_bounds


# Closures -----------------------------------------------------------------------


def test_reachable_with_circles_and_dangling_edges(spark):
    edges = [("a", 1, 2), ("a", 2, 3), ("a", 3, 1), ("a", 3, 4), ("a", 5, 6), ("b", 1, 2), ("b", 2, 99), ("b", 2, None), ("b", None, 3), ("a", 1, 2)]
    df = spark.createDataFrame(edges, "doc string, s int, t int")
    members = spark.createDataFrame([("a", n) for n in range(1, 7)] + [("b", 1), ("b", 2), ("b", 3)], "doc string, m int")
    known = graph.known_edges(df, members, ["doc"], "t", "m")
    assert known.count() == 9 and known.filter("t = 99").count() == 0
    seeds = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), ("b", None)], "doc string, n int")
    got = {tuple(r) for r in graph.reachable(known, seeds, ["doc"], "s", "t", "n").collect()}
    assert got == {("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("b", 1, 0), ("b", 2, 1)}
    assert graph.reachable(known, seeds.limit(0), ["doc"], "s", "t", "n").collect() == []


def test_reachable_takes_more_rounds_than_a_union_keeps(spark):
    edges = spark.range(30).select(F.col("id").alias("s"), (F.col("id") + 1).alias("t"))
    got = graph.reachable(edges, spark.createDataFrame([(0,)], "n long"), [], "s", "t", "n").collect()
    assert sorted(tuple(r) for r in got) == [(i, i) for i in range(31)]


def test_inherit(spark):
    rows = [("d", 1, None, True), ("d", 2, 1, None), ("d", 3, 2, None), ("d", 4, 3, False), ("d", 5, 4, None), ("d", 6, 7, None), ("d", 7, 6, None), ("d", 8, 6, None), ("d", 9, 404, None), ("d", 10, 10, None), ("e", 2, 1, None), ("e", 1, None, None), (None, 1, None, True)]
    df = spark.createDataFrame(rows, "doc string, k int, p int, v boolean")
    got = {(r.doc, r.k): r.v for r in graph.inherit(df, "k", "p", "v", ["doc"]).collect()}
    assert got == {("d", 1): True, ("d", 2): True, ("d", 3): True, ("d", 4): False, ("d", 5): False, ("d", 6): None, ("d", 7): None, ("d", 8): None, ("d", 9): None, ("d", 10): None, ("e", 2): None, ("e", 1): None, (None, 1): True}


def test_inherit_over_a_chain_of_ten_thousand(spark):
    chain = spark.range(10_000).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"), F.when(F.col("id") % 7000 == 0, F.col("id")).alias("v"))
    got = graph.inherit(chain, "k", "p", "v")
    assert got.filter("v = case when k < 7000 then 0 else 7000 end").count() == 10_000


def test_inherit_over_two_million_rows(spark):
    """More rows than a recursive query may take: 500,000 documents of four styles."""
    n = F.col("id") % 4
    rows = spark.range(2_000_000).select(F.floor(F.col("id") / 4).alias("doc"), n.alias("k"), F.when(n > 0, n - 1).alias("p"), F.when(n == 0, True).alias("v"))
    assert graph.inherit(rows, "k", "p", "v", ["doc"]).filter("v").count() == 2_000_000


# Rectangles -----------------------------------------------------------------------


def random_boxes(r, n, most):
    out = []
    for i in range(n):
        top, left = r.randint(0, 60), r.randint(0, 60)
        high, wide = (r.choice([0, 0, 1, 3, most]) for _ in range(2))
        out.append((r.choice(["a", "b"]), top, left, top + high, left + wide, i))
    return out


def test_meeting_boxes(spark):
    r = random.Random(3)
    a, b = random_boxes(r, 120, 40), random_boxes(r, 120, 500)
    a += [("a", -5, -5, 3, 3, 900), ("a", 5, 5, 4, 9, 901), ("a", None, 1, 1, 1, 902), (None, 0, 0, 9, 9, 903), ("b", 0, 0, 1 << 20, 16_383, 904)]
    schema = "s string, top int, left int, bottom int, right int, i int"
    got = regions.meeting(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["s"])
    pairs = sorted((x.i, x.b_i) for x in got.collect())
    fits = lambda x, y: x[0] == y[0] and x[1] is not None and x[1] <= x[3] and max(x[1], y[1]) <= min(x[3], y[3]) and max(x[2], y[2]) <= min(x[4], y[4])
    assert pairs == sorted((x[5], y[5]) for x in a for y in b if fits(x, y)) and len(pairs) > 300


def test_covered_cells_and_vectors(spark):
    r = random.Random(5)
    cells = [("a", x, y, x * 100 + y) for x in range(40) for y in range(12)]
    ranges = [(k, t, x, min(b, t + 6), min(z, x + 4), i) for k, t, x, b, z, i in random_boxes(r, 25, 6)] + [("a", 30, 0, 1_000_000, 3, 99)]
    df, rg = spark.createDataFrame(cells, "s string, row int, col int, v int"), spark.createDataFrame(ranges, "s string, top int, left int, bottom int, right int, i int")
    got = {(c.row, c.col): (c.merged, c.hidden) for c in regions.covered_cells(df, rg, ["s"]).collect()}
    inside = lambda x, y: [g for g in ranges if g[0] == "a" and g[1] <= x <= g[3] and g[2] <= y <= g[4]]
    assert got == {(x, y): (bool(inside(x, y)), any((g[1], g[2]) != (x, y) for g in inside(x, y))) for _, x, y, _ in cells}
    vectors = sorted((c.i, c.place, c.v) for c in regions.vector_cells(df, rg, ["s"], "i").collect())
    want = sorted((g[5], x - g[1] + y - g[2] + 1, v) for g in ranges for _, x, y, v in cells if g[0] == "a" and (g[1] == g[3] or g[2] == g[4]) and g[1] <= x <= g[3] and g[2] <= y <= g[4])
    assert vectors == want and want


def painted(b):
    grid = np.zeros((120, 120), bool)
    for x1, y1, x2, y2 in b:
        grid[int(x1) : int(max(x1, x2)), int(y1) : int(max(y1, y2))] = True
    return float(grid.sum())


def test_area_by_slabs_and_by_sweep(monkeypatch):
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 40, 70, 300):
        at = r.integers(0, 90, (n, 2))
        b = np.concatenate([at, at + r.integers(0, 30, (n, 2))], axis=1).astype(float)
        b = np.concatenate([b, [[1, 1, 1, 5], [np.nan, 0, 1, 1]]])
        assert regions.area_of(b) == painted(b[:-1])
        monkeypatch.setattr(regions, "SWEEP_FROM", 1)
        assert regions.area_of(b) == painted(b[:-1])
        monkeypatch.undo()


def test_union_areas_of_large_pages_in_strips(spark, monkeypatch):
    monkeypatch.setattr(regions, "STRIP_BOXES", 50)
    r = np.random.default_rng(2)
    at = r.integers(0, 80, (900, 2)).astype(float)
    b = np.concatenate([at, at + r.integers(1, 6, (900, 2))], axis=1)
    b[::90, 2] = 110.0  # some across all strips
    rows = [(1, *map(float, x)) for x in b] + [(2, 0.0, 0.0, 10.0, 10.0), (2, 5.0, 5.0, 15.0, 15.0), (3, 1.0, 1.0, 1.0, 9.0), (4, None, 0.0, 1.0, 1.0), (None, 0.0, 0.0, 2.0, 2.0), (1, None, None, None, None)]
    df = spark.createDataFrame(rows, "page int, x1 double, y1 double, x2 double, y2 double")
    got = {x.page: x.area for x in regions.union_areas(df, ["page"]).collect()}
    assert got == {1: painted(b), 2: 175.0, 3: 0.0, 4: 0.0, None: 4.0}
    plan = regions.union_areas(df, ["page"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# Connected cells ------------------------------------------------------------------


def test_tables_of_sheets_in_strips(spark):
    r = random.Random(8)
    rows = [(s, x, y) for s in ("p", "q", "r") for x in range(60) for y in range(14) if r.random() < {"p": 0.45, "q": 0.2, "r": 0.7}[s]]
    rows += [("long", x, 0) for x in range(400)] + [("long", x, 5) for x in range(0, 400, 2)] + [("snake", x, y) for x in range(0, 40) for y in (range(9) if x % 2 == 0 else [0 if x % 4 == 1 else 8])]
    df = spark.createDataFrame(rows + rows[:20] + [(None, 1, 1), ("p", None, 1)], "sheet string, row int, col int")
    for gap in (0, 1, 2):
        for strip in (1, 30, 1 << 16):
            got = {}
            for x in regions.detect_tables(df, ["sheet"], gap, strip).collect():
                got.setdefault(x.sheet, {})[x.table_id] = (x.top, x.left, x.bottom, x.right)
            want = {s: dict(enumerate(table_bounds({(x, y) for k, x, y in rows if k == s}, gap), 1)) for s in {k for k, _, _ in rows}}
            assert got == want, (gap, strip)


def test_a_sheet_of_many_cells_is_several_tasks(spark):
    """A million cells: a block of 500 columns, cut by an empty row and an empty column."""
    at = spark.range(1_000_000).select(F.floor(F.col("id") / 500).cast("int").alias("row"), (F.col("id") % 500).cast("int").alias("col")).filter("row <> 777 and col <> 123").withColumn("sheet", F.lit(1))
    got = [tuple(r) for r in regions.detect_tables(at, ["sheet"]).orderBy("table_id").collect()]
    assert got == [(1, 1, 0, 0, 776, 122), (1, 2, 0, 124, 776, 499), (1, 3, 778, 0, 1999, 122), (1, 4, 778, 124, 1999, 499)]


# Alignment ------------------------------------------------------------------------


def fits(a, b):
    if a[0] or b[0]:
        return bool(a[0] and b[0] and (a[0].startswith(b[0]) or b[0].startswith(a[0])) and (a[1] == b[1] or a[2] == b[2]))
    return a[1:] == b[1:]


def test_alignment_of_tables(spark):
    r = random.Random(2)
    one = lambda: (r.choice(["", "", "a", "ab", "abc", "b", "ba", "x"]), r.randint(1, 2), r.randint(1, 3), r.randint(0, 1))
    left = {d: [one() for _ in range(n)] for d, n in (("p", 40), ("q", 15), ("none", 3))}
    right = {d: [one() for _ in range(n)] for d, n in (("p", 60), ("q", 4), ("other", 3))}
    schema = "doc string, o int, t string, r int, c int, m int"
    rows = lambda side: [(d, i, " ".join(t[0]) or None, *t[1:]) for d, own in side.items() for i, t in enumerate(own)]
    offered = spark.createDataFrame(rows(right), schema).withColumn("k", F.col("o"))
    got = alignment.aligned(spark.createDataFrame(rows(left), schema), offered, ["doc"], "o", "t", "r", "c", "m", "k")
    want = set()
    for d, own in left.items():
        at = 0
        for i, t in enumerate(own):
            k = next((k for k in range(at, len(right.get(d, []))) if fits(t, right[d][k])), None)
            at = at if k is None else k + 1
            want.add((d, i, k))
    assert {tuple(x) for x in got.collect()} == want


# Substitution ---------------------------------------------------------------------


def test_replacement_outside_formulas(spark):
    texts = ["", "a", "aa <eq>a</eq> aa", "<eq>a</eq>", "a<eq>a", "a<eq>b</eq><eq>a</eq>a a", "<eq>a\na</eq>", "a</eq>a<eq>", None, "$1 \\ a.b", "<eq></eq>a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for old, new in (("a", "<b>$1"), ("aa", ""), ("", "x"), (".", "\\")):
        got = {r.i: r.o for r in df.select("i", substitution.replace_outside(F.col("t"), F.lit(old), F.lit(new)).alias("o")).collect()}
        plain = lambda t: None if t is None else "".join(p if k % 2 or not old else p.replace(old, new, 1) for k, p in enumerate(re.split(r"(<eq>[^\n]*?</eq>)", t)))  # noqa: E731, B023
        assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_formulas_back_in_texts(spark):
    cases = [
        ("x  is y", [("x ", 0), ("<eq>1</eq>", 1), (" is y", 0)], "x <eq>1</eq> is y"), ("ab", [("<eq>1</eq>", 1), ("ab", 0)], "<eq>1</eq>ab"), ("ab", [("ab", 0), ("<eq>1</eq>", 1)], "ab<eq>1</eq>"),
        ("other", [("ab", 0), ("<eq>1</eq>", 1)], "other"), ("ab", [("ab", 0)], "ab"), ("a b", [("a", 0), ("", 0), ("<eq>q</eq>", 1), ("b", 0)], "a<eq>q</eq> b"), ("", [], ""),
    ]
    df = spark.createDataFrame([(i, t, [(c, bool(f)) for c, f in p]) for i, (t, p, _) in enumerate(cases)], "i int, t string, p array<struct<content:string,is_formula:boolean>>")
    got = {r.i: r.o for r in df.select("i", substitution.merge_formulas(F.col("t"), F.col("p")).alias("o")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}


def test_runs_cut_at_formulas(spark):
    texts = spark.createDataFrame([(1, "ab<eq>x</eq>cd<eq>y</eq>"), (2, "abc<eq>x</eq>d"), (3, "plain")], "k int, text string")
    runs = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, "bcd", "i"), (2, 0, "not the text", "b"), (3, 0, "pl", ""), (3, 1, "", ""), (3, 2, "ain", "")], "k int, o int, run string, style string")
    got = sorted(tuple(r) for r in substitution.split_runs(runs, texts, ["k"], "o", "run", "text").select("k", "o", "fragment", "run", "style").collect())
    assert got == [(1, 0, 0, "a", "b"), (1, 1, 0, "b", "i"), (1, 1, 1, "cd", "i"), (2, 0, 0, "not the text", "b"), (3, 0, 0, "pl", ""), (3, 1, 0, "", ""), (3, 2, 0, "ain", "")]


def test_pictures_replaced_by_their_texts(spark):
    contents = spark.createDataFrame([(1, "x ![](a) y ![](b) ![](a)"), (2, "![](a)"), (3, None), (4, ""), (5, "![](aa) ![x](a)")], "k int, c string")
    found = spark.createDataFrame([("a", "![](b)"), ("b", None), ("c", "never"), ("a", "A")], "u string, t string")
    got = {r.k: r.c for r in substitution.replace_pictures(contents, found, ["k"], "c", "u", "t").collect()}
    assert got == {1: "x A y  A", 2: "A", 3: None, 4: "", 5: "![](aa) ![x](a)"}


def test_pictures_of_many_contents(spark, monkeypatch):
    """Pieces without a picture meet nothing, a uri's references are dealt to several tasks, and rows without a key stay."""
    monkeypatch.setattr(substitution, "REFERENCES", 50)
    rows = [(k if k % 10 else None, f"{k} ![](hot) ![](n{k % 7}) ![](hot) w" if k % 3 else f"plain {k}") for k in range(400)]
    found = spark.createDataFrame([("hot", "H"), ("n1", "![](n2)"), ("n2", None)], "u string, t string")
    contents = spark.createDataFrame(rows, "k int, c string").repartition(4)
    got = substitution.replace_pictures(contents, found, ["k"], "c", "u", "t")
    want = [(k, c.replace("![](hot)", "H").replace("![](n2)", "").replace("![](n1)", "![](n2)")) for k, c in rows]
    assert sorted(((r.k, r.c) for r in got.filter("k is not null").collect())) == sorted(r for r in want if r[0] is not None)
    assert sorted(r.c for r in got.filter("k is null").collect()) == sorted(c for k, c in want if k is None)


def test_columns_order(spark):
    rows = [((0, 0, 40, 10), "a"), ((60, 0, 99, 10), "b"), ((0, 20, 40, 30), "c"), ((0, 50, 99, 60), "d"), ((0, 70, 40, 80), "e"), ((0, 90, 30, 99), "page 7")]
    df = spark.createDataFrame([(p, i, *map(float, b), t) for p in (1, 2) for i, (b, t) in enumerate(rows) if p == 1 or i == 4], "p int, k int, x1 double, y1 double, x2 double, y2 double, text string")
    got = sorted((r.p, r.position, r.k) for r in boxes.columns_order(df, ["p"], "k", F.lit(100.0)).collect())
    assert got == [(1, n, k) for n, k in enumerate([0, 2, 1, 3, 4, 5])] + [(2, 0, 4)]


# Counters over long documents ---------------------------------------------------------


def test_numbers_of_titles_over_ranges(spark):
    from sheafspark.functions import blocks
    from sheafspark.operators import sequences

    r = random.Random(6)
    rows = []
    for d, n in (("a", 400), ("b", 3), ("c", 90), (None, 20)):
        for i in range(n):
            level = r.choice([1, 1, 2, 2, 3, 4])
            lead = r.choice(["", "3", "2.0", "1.2.3", " 0.1 ", "5.1.1.9", "x"])
            rows.append((d, i, level, r.random() < 0.7, f"{lead} Title"))
    df = spark.createDataFrame(rows, "doc string, o int, level int, is_numbered boolean, text string")
    want = {}
    for d in {x[0] for x in rows}:
        titles = [{"type": "title", "level": n, "is_numbered": k, "spans": [{"type": "text", "content": t}], "o": o} for x, o, n, k, t in rows if x == d]
        want |= {(d, b["o"]): b.get("section_number") for b in blocks.numbered([{"para_blocks": titles}])[0]["para_blocks"]}
    for ranges in (1, 7, 60):
        got = {(x.doc, x.o): x.section_number for x in sequences.numbered_titles(df, ["doc"], "o", "level", "is_numbered", "text", ranges).collect()}
        assert got == want, ranges


def test_one_document_of_a_million_rows_in_eight_ranges(spark):
    from sheafspark.operators import sequences

    # a chapter every thousand rows, a section every ten (a chapter's first begins with its first paragraph), the rest paragraphs
    n = F.col("id")
    level = F.when(n % 1000 == 0, 1).when(n % 10 == 0, 2).otherwise(3)
    rows = spark.range(1_000_000).select(n, level.alias("level"))
    got = sequences.section_numbers(rows, [], ["id"], "level", ranges=8)
    want = F.concat_ws(".", F.floor(n / 1000) + 1, F.when(F.col("level") > 1, F.floor(n % 1000 / 10) + 1), F.when(F.col("level") > 2, n % 10))
    assert got.filter(F.col("number") == want).count() == 1_000_000


def test_dense_series_of_any_length(spark):
    from sheafspark.functions import tables

    df = spark.sql("SELECT map_from_arrays(sequence(0, 299999), transform(sequence(0, 299999), i -> cast(i AS string))) AS m UNION ALL SELECT map(3, 'd', 1, 'b', 4, null) UNION ALL SELECT map_from_arrays(cast(array() AS array<int>), cast(array() AS array<string>))")
    got = [r.d for r in df.select(tables.dense(F.col("m")).alias("d")).collect()]
    assert len(got[0]) == 300_000 and got[0][123_456] == "123456" and got[1:] == [["", "b", "", "d", ""], []]


def test_list_numbers_by_windows(spark):
    from sheafspark.operators import sequences

    r = random.Random(12)
    own = {d: [(r.choice([0, 0, 1, 1, 2, 3]), r.random() < 0.75, r.choice([None, None, None, 1, 2, 3, 7])) for _ in range(n)] for d, n in (("a", 400), ("b", 60), ("c", 1))}
    df = spark.createDataFrame([(d, i, *x) for d, items in own.items() for i, x in enumerate(items)], "d string, i int, level int, ordered boolean, start int")
    got = {(x.d, x.i): (x.list_no, x.number) for x in sequences.list_numbers(df, ["d"], "i", "level", "ordered", "start").collect()}
    assert got == {(d, i): x for d, items in own.items() for i, x in enumerate(sequences.numbers(items))}
    assert sequences.list_numbers(df.limit(0), ["d"], "i", "level", "ordered", "start").collect() == []
