"""Rectangles with rectangles and cells, areas that rectangles cover together, and connected cells, of sheets and pages of any size.

Rectangles are closed ranges of whole numbers (rows and columns of a sheet) for joins,
and half open for areas.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sheafspark.session import Stored

BOX = ["top", "left", "bottom", "right"]


# Rectangles that meet -------------------------------------------------------


def _level(box: list[str]) -> Column:
    """The least power of two (its exponent) that neither side of the box is longer than."""
    side = F.greatest(F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1])) + 1
    return F.ceil(F.log2(side.cast("double"))).cast("int")


def _tiles(df: DataFrame, box: list[str], levels: list[int], own_only: bool) -> DataFrame:
    """df with _level, _tr, _tc: the tiles that a row's box meets in the grid of its own level (at most four) and, unless own_only, in those of the coarser levels given."""
    rows = df.withColumn("_own", _level(box))
    at = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    chosen = F.array("_own") if own_only else F.filter(at, lambda x: x >= F.col("_own"))
    rows = rows.withColumn("_level", F.explode(chosen))
    tile = lambda x: F.floor(F.col(x) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    rows = rows.withColumn("_tr", F.explode(F.sequence(tile(box[0]), tile(box[2])))).withColumn("_tc", F.explode(F.sequence(tile(box[1]), tile(box[3]))))
    return rows


def meeting(a: DataFrame, b: DataFrame, keys: list[str], box: list[str] | None = None, prefix: str = "b_") -> DataFrame:
    """Pairs of a's and b's rows of equal keys whose boxes share a cell, once each: a's columns, and b's others with prefix.

    A box lies in at most four tiles of a grid whose tiles are as large as it. The larger of two boxes names the grid in
    which they meet: each box is dealt to its own level, and to the coarser levels that the other side's boxes have (there
    are as many levels as the logarithm of the largest box, and these numbers alone are collected). Of the tiles that both
    meet, the one with the top left corner of what they share counts, so nothing is reported twice and nothing is sorted
    out afterwards. No box is listed cell by cell, however large. Rows with a null in keys or edges meet nothing.
    """
    box = box or BOX
    other = b.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in b.columns if c not in keys])
    there = [f"{prefix}{c}" for c in box]
    full = lambda df, edges: df.dropna(subset=[*keys, *edges]).filter((F.col(edges[0]) <= F.col(edges[2])) & (F.col(edges[1]) <= F.col(edges[3])))
    a, other = full(a, box), full(other, there)
    levels = lambda df, edges: sorted(r[0] for r in df.select(_level(edges).alias("n")).distinct().collect())
    la, lb = levels(a, box), levels(other, there)
    grid = [*keys, "_level", "_tr", "_tc"]

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        met = x.join(y, grid)
        corner = [F.floor(F.greatest(F.col(box[i]), F.col(there[i])) / F.pow(F.lit(2.0), F.col("_level"))) for i in (0, 1)]
        hits = (F.greatest(F.col(box[0]), F.col(there[0])) <= F.least(F.col(box[2]), F.col(there[2]))) & (F.greatest(F.col(box[1]), F.col(there[1])) <= F.least(F.col(box[3]), F.col(there[3])))
        return met.filter(hits & (corner[0] == F.col("_tr")) & (corner[1] == F.col("_tc"))).select(*a.columns, *[c for c in other.columns if c not in keys])

    larger = pairs(_tiles(a, box, la, True).drop("_own"), _tiles(other, there, la, False).drop("_own"))  # a's box is the larger, or as large
    smaller = _tiles(a, box, lb, False).filter("_level > _own").drop("_own")
    return larger.unionByName(pairs(smaller, _tiles(other, there, lb, True).drop("_own")))


def covered_cells(cells: DataFrame, ranges: DataFrame, keys: list[str], row: str = "row", col: str = "col", box: list[str] | None = None) -> DataFrame:
    """cells with merged (whether a range of their group holds them) and hidden (whether they are in one of which they aren't the top left cell)."""
    box = box or BOX
    points = cells.select(*keys, row, col).distinct().select(*keys, F.col(row).alias(box[0]), F.col(col).alias(box[1]), F.col(row).alias(box[2]), F.col(col).alias(box[3]))
    met = meeting(points, ranges.select(*keys, *box), keys, box)
    away = (F.col(box[0]) != F.col(f"b_{box[0]}")) | (F.col(box[1]) != F.col(f"b_{box[1]}"))
    found = met.groupBy(*keys, F.col(box[0]).alias(row), F.col(box[1]).alias(col)).agg(F.max(away).alias("hidden")).withColumn("merged", F.lit(True))
    out = cells.join(found, [*keys, row, col], "left")
    return out.select(*cells.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("merged", "hidden")])


def vector_cells(cells: DataFrame, formulas: DataFrame, keys: list[str], name: str, row: str = "row", col: str = "col", box: list[str] | None = None) -> DataFrame:
    """keys, name, place (from 1) and a cell's columns of each formula's range, along it; a range of more than one row and column gives none: it is no vector."""
    box = box or BOX
    line = (F.col(box[0]) == F.col(box[2])) | (F.col(box[1]) == F.col(box[3]))
    at = cells.withColumns({box[0]: F.col(row), box[1]: F.col(col), box[2]: F.col(row), box[3]: F.col(col)})
    met = meeting(at, formulas.filter(line).select(*keys, *box, name), keys, box)
    place = F.col(box[0]) - F.col(f"b_{box[0]}") + F.col(box[1]) - F.col(f"b_{box[1]}") + 1
    return met.select(*keys, F.col(f"b_{name}").alias(name), place.alias("place"), *[c for c in cells.columns if c not in keys])


# Areas ------------------------------------------------------------------------


#: Boxes of a page's strip, about, and boxes from which on a strip is swept instead of compared with its slabs at once.
STRIP_BOXES, SWEEP_FROM = 4096, 64


def area_of(b: np.ndarray) -> float:
    """The area that boxes [n, 4] (x1, y1, x2, y2) cover together, by a sweep from left to right over a tree of the heights that are covered."""
    b = b[(b[:, 0] < b[:, 2]) & (b[:, 1] < b[:, 3]) & np.isfinite(b).all(1)]
    if len(b) == 0:
        return 0.0
    if len(b) < SWEEP_FROM:
        xs, ys = np.unique(b[:, [0, 2]]), np.unique(b[:, [1, 3]])
        inside = (b[:, None, 0] <= xs[None, :-1]) & (b[:, None, 2] > xs[None, :-1])
        tall = (b[:, None, 1] <= ys[None, :-1]) & (b[:, None, 3] > ys[None, :-1])
        return float(np.diff(xs) @ ((inside.T.astype(np.float32) @ tall.astype(np.float32)) > 0) @ np.diff(ys))
    ys = np.unique(b[:, [1, 3]])
    low, high = np.searchsorted(ys, b[:, 1]).tolist(), np.searchsorted(ys, b[:, 3]).tolist()
    size = 1 << (len(ys) - 2).bit_length() if len(ys) > 2 else 1
    count, length = [0] * (2 * size), [0.0] * (2 * size)
    width = [0.0] * (2 * size)
    width[size : size + len(ys) - 1] = np.diff(ys).tolist()
    for i in range(size - 1, 0, -1):
        width[i] = width[2 * i] + width[2 * i + 1]

    def settle(i: int) -> None:
        length[i] = width[i] if count[i] else length[2 * i] + length[2 * i + 1] if i < size else 0.0

    def cover(a: int, e: int, by: int) -> None:
        left, right = a + size, e + size
        a, e = left, right
        while a < e:
            if a & 1:
                count[a] += by
                settle(a)
                a += 1
            if e & 1:
                e -= 1
                count[e] += by
                settle(e)
            a, e = a >> 1, e >> 1
        for i in (left, right - 1):
            i >>= 1
            while i:
                settle(i)
                i >>= 1

    n = len(b)
    x = np.concatenate([b[:, 0], b[:, 2]])
    total, last = 0.0, 0.0
    for k in np.argsort(x, kind="stable").tolist():
        total += length[1] * (x[k] - last)
        last = x[k]
        cover(low[k % n], high[k % n], 1 if k < n else -1)
    return float(total)


def union_areas(df: DataFrame, page: list[str]) -> DataFrame:
    """page and area: what a page's boxes (x1, y1, x2, y2) cover together.

    A page of more than STRIP_BOXES boxes is cut at quantiles of their left edges into strips, 64 at most; a box goes to the
    strips that it meets, cut at their edges, and areas of strips add up. Other pages are one strip. Each strip is swept in
    the logarithm of its boxes' number for each of them. A page without a box of some extent has area 0; boxes with a null
    edge cover nothing.
    """
    edges = ["x1", "y1", "x2", "y2"]
    kinds = dict(df.dtypes)
    rows = df.select(*page, *[F.col(c).cast("double").alias(c) for c in edges])
    large = rows.groupBy(*page).agg(F.count("*").alias("_n")).filter(F.col("_n") > STRIP_BOXES)
    quantiles = F.percentile_approx("x1", [i / 64 for i in range(1, 64)], 4096)
    cuts = rows.join(large, page).groupBy(*page).agg(quantiles.alias("_q"), F.max("_n").alias("_n"))
    step = F.greatest(F.floor(F.lit(64) * STRIP_BOXES / F.col("_n")), F.lit(1)).cast("int")  # of the quantiles as many as the number of boxes asks for
    cuts = cuts.select(*page, F.array_distinct(F.filter("_q", lambda x, i: (i + 1) % step == 0)).alias("_q"))
    ends = F.concat(F.array(F.lit(float("-inf"))), F.coalesce("_q", F.array().cast("array<double>")), F.array(F.lit(float("inf"))))
    strips = F.transform(F.sequence(F.lit(1), F.size("_ends") - 1), lambda i: F.struct(i.alias("s"), F.get("_ends", i - 1).alias("a"), F.get("_ends", i).alias("e")))
    meets = F.filter(strips, lambda s: F.coalesce((s["a"] < F.col("x2")) & (s["e"] > F.col("x1")), s["s"] == 1))
    dealt = rows.join(cuts, page, "left").withColumn("_ends", ends).withColumn("_m", F.explode_outer(meets))
    cut = dealt.select(*page, F.coalesce("_m.s", F.lit(1)).alias("_s"), F.when(F.col("x1") > F.col("_m.a"), F.col("x1")).otherwise(F.col("_m.a")).alias("x1"), "y1", F.when(F.col("x2") < F.col("_m.e"), F.col("x2")).otherwise(F.col("_m.e")).alias("x2"), "y2")
    cut = cut.select(*page, "_s", *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in edges])
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in page) + ", area double"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in edges]
            at = lists[0].offsets.to_numpy()
            at = (at - at[0]).tolist() if len(at) else [0]
            values = np.stack([x.flatten().to_numpy(zero_copy_only=False) for x in lists], axis=1)
            areas = [area_of(values[a:e]) for a, e in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in page], pa.array(areas, pa.float64())], schema=out)

    groups = cut.groupBy(*page, "_s").agg(*[F.collect_list(c).alias(c) for c in edges]).drop("_s")
    return groups.mapInArrow(run, schema).groupBy(*page).agg(F.sum("area").alias("area"))


# Connected cells ----------------------------------------------------------------


#: Cells of a strip of rows, about.
STRIP_CELLS = 1 << 16


def joined_groups(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of each of n things' group, where a[i] and b[i] are in one group."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([root(i) for i in range(n)], np.int64)


def strip_groups(row: np.ndarray, col: np.ndarray, gap: int) -> np.ndarray:
    """Group numbers of cells that stand in ascending (row, col): those that steps of up to gap + 1 rows or columns connect. Cells in a row are grouped as runs first, so only runs go through the search."""
    n = len(row)
    new = np.ones(n, bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(col) > gap + 1)
    run = np.cumsum(new) - 1
    down = np.lexsort((row, col))
    r, c, k = row[down], col[down], run[down]
    near = (np.diff(c) == 0) & (np.diff(r) <= gap + 1)
    pairs = np.unique(np.stack([k[:-1][near], k[1:][near]], axis=1), axis=0)
    groups = joined_groups(pairs[:, 0], pairs[:, 1], int(run[-1]) + 1 if n else 0)
    return groups[run]


def connected(cells: DataFrame, sheet: list[str], gap: int = 0, row: str = "row", col: str = "col", strip_cells: int = STRIP_CELLS) -> DataFrame:
    """sheet, top, left, bottom, right, first_row and first_col of each group of cells that steps of up to gap + 1 rows or columns connect.

    Two levels: a sheet is cut into strips of rows with about ``strip_cells`` cells (a row is never cut). Groups inside
    strips are found strip by strip. The cells within gap + 1 rows of another strip then connect groups, a pair once; only
    groups at edges go through a second search, of which a sheet has as many as its columns times its strips at most. Boxes
    of groups are aggregates. Repeated cells are one; cells without a sheet or a place are left out.
    """
    tables = Stored(cells.sparkSession)
    own = cells.dropna(subset=[*sheet, row, col]).select(*sheet, F.col(row).cast("long").alias("_r"), F.col(col).cast("long").alias("_c"))
    by_row = own.groupBy(*sheet, "_r").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*sheet).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    strips = by_row.select(*sheet, "_r", F.floor(F.coalesce(upto, F.lit(0)) / strip_cells).alias("_s"))
    rows = own.join(strips, [*sheet, "_r"]).select(*sheet, "_s", "_r", "_c")
    kinds = dict(own.dtypes)
    names = [*sheet, "_s", "_r", "_c", "_g"]
    own_schema = "".join(f"`{k}` {kinds[k]}, " for k in sheet)

    def label(part):
        import pandas as pd

        part = part.drop_duplicates(["_r", "_c"]).sort_values(["_r", "_c"])
        g = strip_groups(part["_r"].to_numpy(np.int64), part["_c"].to_numpy(np.int64), gap)
        return pd.DataFrame({k: part[k].to_numpy() if k != "_g" else g for k in names})

    labelled = tables.cut(rows.groupBy(*sheet, "_s").applyInPandas(label, f"{own_schema}_s long, _r long, _c long, _g long"))
    group = [*sheet, "_s", "_g"]
    first = F.min(F.struct(F.col("_r").alias("r"), F.col("_c").alias("c"))).alias("_first")
    boxes = tables.cut(labelled.groupBy(*group).agg(F.min("_r").alias("top"), F.min("_c").alias("left"), F.max("_r").alias("bottom"), F.max("_c").alias("right"), first))
    # cells within reach of a neighbouring strip, each with the one above it in its column
    spans = boxes.groupBy(*sheet, "_s").agg(F.min("top").alias("_top"), F.max("bottom").alias("_bottom"))
    order = Window.partitionBy(*sheet).orderBy("_s")
    spans = spans.select(*sheet, "_s", F.lead("_top").over(order).alias("_below"), F.lag("_bottom").over(order).alias("_above"))
    edge = labelled.join(spans, [*sheet, "_s"]).filter((F.col("_below") - F.col("_r") <= gap + 1) | (F.col("_r") - F.col("_above") <= gap + 1))
    upper = F.lag(F.struct("_r", "_s", "_g")).over(Window.partitionBy(*sheet, "_c").orderBy("_r"))
    links = edge.withColumn("_u", upper).filter((F.col("_u._s") != F.col("_s")) & (F.col("_r") - F.col("_u._r") <= gap + 1))
    links = tables.cut(links.select(*sheet, F.col("_u._s").alias("_s1"), F.col("_u._g").alias("_g1"), F.col("_s").alias("_s2"), F.col("_g").alias("_g2")).distinct())

    def across(part):
        import pandas as pd

        ends = np.concatenate([part[["_s1", "_g1"]].to_numpy(np.int64), part[["_s2", "_g2"]].to_numpy(np.int64)])
        things, of = np.unique(ends, axis=0, return_inverse=True)
        of = of.reshape(-1)
        root = joined_groups(of[: len(part)], of[len(part) :], len(things))
        out = pd.DataFrame({k: part[k].iloc[0] for k in sheet}, index=range(len(things)))
        return out.assign(_s=things[:, 0], _g=things[:, 1], _rs=things[root, 0], _rg=things[root, 1])

    roots = links.groupBy(*sheet).applyInPandas(across, f"{own_schema}_s long, _g long, _rs long, _rg long")
    whole = boxes.join(roots, group, "left").withColumn("_rs", F.coalesce("_rs", "_s")).withColumn("_rg", F.coalesce("_rg", "_g"))
    out = whole.groupBy(*sheet, "_rs", "_rg").agg(F.min("top").alias("top"), F.min("left").alias("left"), F.max("bottom").alias("bottom"), F.max("right").alias("right"), F.min("_first").alias("_first"))
    return out.select(*sheet, *BOX, F.col("_first.r").alias("first_row"), F.col("_first.c").alias("first_col"))


def detect_tables(cells: DataFrame, sheet: list[str], gap: int = 0, strip_cells: int = STRIP_CELLS) -> DataFrame:
    """sheet, table_id (by each table's first cell in reading order, from 1), top, left, bottom, right of each sheet's tables."""
    found = connected(cells, sheet, gap, strip_cells=strip_cells)
    number = F.row_number().over(Window.partitionBy(*sheet).orderBy("first_row", "first_col"))
    return found.select(*sheet, number.alias("table_id"), *[F.col(c).cast("int").alias(c) for c in BOX])
