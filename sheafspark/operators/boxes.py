"""Operators over layout boxes of a page: overlap removal, containment, lines and reading order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafspark.functions import geometry as G
from sheafspark.operators import regions

EDGES = ["x1", "y1", "x2", "y2"]


def not_contained(df: DataFrame, page: list[str], key: str, least: float = 0.8) -> DataFrame:
    """Boxes that don't lie in another of their page; a page's boxes are few."""
    other = df.select(*page, F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in EDGES])
    inner = df.alias("a").join(other, page).filter((F.col(key) != F.col("_k")) & G.contained(G.box(), G.box("_"), least)).select(*page, key).distinct()
    return df.join(inner, [*page, key], "left_anti")


def kept_by_nms(b: np.ndarray, score: np.ndarray, cls: np.ndarray, same: float = 0.6, other: float = 0.98) -> list[int]:
    """Rows that stay, surest first: a later box goes where it covers a kept one too much (edges count as pixels)."""
    order, out = np.lexsort((np.arange(len(score)), -score)), []
    for i in order.tolist():
        for k in out:
            w = min(b[i, 2], b[k, 2]) - max(b[i, 0], b[k, 0]) + 1
            h = min(b[i, 3], b[k, 3]) - max(b[i, 1], b[k, 1]) + 1
            both = max(0, w) * max(0, h)
            area = sum((b[j, 2] - b[j, 0] + 1) * (b[j, 3] - b[j, 1] + 1) for j in (i, k)) - both
            if both / area >= (same if cls[i] == cls[k] else other):
                break
        else:
            out.append(i)
    return out


def _per_page(df: DataFrame, page: list[str], run, extra: str = "") -> DataFrame:
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + (f", {extra}" if extra else "")
    return df.groupBy(*page).applyInPandas(run, schema)


def nms(df: DataFrame, page: list[str], key: str, same: float = 0.6, other: float = 0.98) -> DataFrame:
    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(key).reset_index(drop=True)
        return own.iloc[kept_by_nms(own[EDGES].to_numpy(float), own["score"].to_numpy(float), own["cls"].to_numpy(), same, other)]

    return _per_page(df, page, run)


def layout(df: DataFrame, page: list[str], key: str, width: Column, height: Column) -> DataFrame:
    """Overlaps removed, boxes that fill the page dropped where others remain, contained ones dropped, the rest numbered from the top."""
    from pyspark.sql import Window

    left = nms(df, page, key)
    over = Window.partitionBy(*page)
    large = G.area(G.box()) > width * height * F.when(width > height, 0.82).otherwise(0.93)
    left = left.withColumn("_l", large).withColumn("_n", F.count("*").over(over)).withColumn("_s", F.sum(F.when(F.col("_l"), 0).otherwise(1)).over(over))
    left = left.filter(~F.col("_l") | (F.col("_n") == 1) | (F.col("_s") == 0)).drop("_l", "_n", "_s")
    left = not_contained(left, page, key)
    return left.withColumn("order_id", F.row_number().over(Window.partitionBy(*page).orderBy("y1", "x1", key)) - 1)


def lines_of(y: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Line numbers: by centre height, a new line where it lies ``most`` or more under its line's first."""
    order, out, line, first = np.lexsort((x, y)), np.zeros(len(y), int), -1, 0.0
    for i in order.tolist():
        if line < 0 or y[i] - first >= most:
            line, first = line + 1, y[i]
        out[i] = line
    return out


def lines(df: DataFrame, page: list[str], key: str, most: float) -> DataFrame:
    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(key)
        return own.assign(line_no=lines_of(((own["y1"] + own["y2"]) / 2).to_numpy(), own["x1"].to_numpy(), most))

    return _per_page(df, page, run, "line_no int")


def _gap(low: np.ndarray, high: np.ndarray) -> tuple[float, float]:
    """The widest empty stretch between intervals and its middle."""
    order = np.argsort(low, kind="stable")
    best, at, end = 0.0, 0.0, -np.inf
    for i in order.tolist():
        if end > -np.inf and low[i] - end > best:
            best, at = low[i] - end, (low[i] + end) / 2
        end = max(end, high[i])
    return best, at


def xy_cut(boxes: list[tuple[float, float, float, float]], least: float = 5.0) -> list[int]:
    """Reading order: cut at the widest gap (a tie goes to the vertical one), left or upper part first; where no gap is wide enough, by top and left."""
    b = np.asarray(boxes, float).reshape(-1, 4)
    out: list[int] = []
    todo = [np.arange(len(b))]
    while todo:
        own = todo.pop()
        if len(own) < 2:
            out += own.tolist()
            continue
        gx, x = _gap(b[own, 0], b[own, 2])
        if gx < least and len(own) > 2:  # again without narrow boxes, which may bridge two columns
            wide = own[(b[own, 2] - b[own, 0]) >= 0.1 * (b[own, 2].max() - b[own, 0].min())]
            if 1 < len(wide) < len(own):
                gx, x = _gap(b[wide, 0], b[wide, 2])
        gy, y = _gap(b[own, 1], b[own, 3])
        if max(gx, gy) < least:
            out += own[np.lexsort((b[own, 0], b[own, 1]))].tolist()
            continue
        first = (b[own, 0] + b[own, 2]) / 2 < x if gx >= gy else (b[own, 1] + b[own, 3]) / 2 < y
        if first.all() or not first.any():
            out += own[np.lexsort((b[own, 0], b[own, 1]))].tolist()
            continue
        todo += [own[~first], own[first]]
    return out


def crossing(boxes: list[tuple[float, float, float, float]], beta: float = 2.0, least: int = 2, share: float = 0.1) -> list[int]:
    """Boxes that lie across a layout: at least beta times as wide as the widest, with ``least`` others that share ``share`` of the narrower width. With a beta over 1 none is."""
    b = np.asarray(boxes, float).reshape(-1, 4)
    if len(b) < 3:
        return []
    width = b[:, 2] - b[:, 0]
    out = []
    for i in np.flatnonzero(width >= beta * width.max()).tolist():
        over = np.minimum(b[:, 2], b[i, 2]) - np.maximum(b[:, 0], b[i, 0])
        near = (over > 0) & (over >= share * np.minimum(width, width[i]))
        if near.sum() - 1 >= least:
            out.append(i)
    return out


def merged_order(boxes: list[tuple[float, float, float, float]], beta: float = 2.0) -> list[int]:
    """xy_cut of the boxes that don't lie across the layout, and those between them, each before the first that begins under it."""
    across = sorted(crossing(boxes, beta), key=lambda i: (boxes[i][1], boxes[i][0]))
    rest = [i for i in range(len(boxes)) if i not in set(across)]
    if not rest:
        return sorted(range(len(boxes)), key=lambda i: (boxes[i][1], boxes[i][0]))
    out = [rest[k] for k in xy_cut([boxes[i] for i in rest])]
    for i in across:
        at = next((n for n, k in enumerate(out) if boxes[k][1] > boxes[i][1]), len(out))
        out.insert(at, i)
    return out


def reading_order(df: DataFrame, page: list[str], key: str, beta: float = 2.0) -> DataFrame:
    """df with position, from 0; boxes without extent come last."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(key).reset_index(drop=True)
        good = ((own["x2"] > own["x1"]) & (own["y2"] > own["y1"])).to_numpy()
        placed = np.flatnonzero(good)
        order = [*placed[merged_order(own.loc[good, EDGES].to_numpy().tolist(), beta)].tolist(), *np.flatnonzero(~good).tolist()] if len(placed) else list(range(len(own)))
        own = own.iloc[order]
        return own.assign(position=range(len(own)))

    return _per_page(df, page, run, "position int")


def profile(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """keys, at and n: how many intervals [low, high) cover each whole place."""
    at = F.explode(F.when(F.col(high) > F.col(low), F.sequence(F.col(low), F.col(high) - 1)))
    return df.select(*keys, at.alias("at")).groupBy(*keys, "at").agg(F.count("*").alias("n"))


def without_large(df: DataFrame, sizes: DataFrame, page: list[str], wide: float = 0.82, tall: float = 0.93) -> DataFrame:
    """Boxes without the pictures that fill their page (width and height in ``sizes``), where the page has other boxes that stay."""
    from pyspark.sql import Window

    over = Window.partitionBy(*page)
    w, h = F.col("_w"), F.col("_h")
    inside = (F.least(F.col("x2"), w) - F.greatest(F.col("x1"), F.lit(0))) * (F.least(F.col("y2"), h) - F.greatest(F.col("y1"), F.lit(0)))
    large = (F.col("label") == "image") & (inside > w * h * F.when(w > h, wide).otherwise(tall))
    rows = df.join(sizes.select(*page, F.col("width").alias("_w"), F.col("height").alias("_h")), page).withColumn("_large", large)
    rows = rows.withColumn("_stay", F.sum(F.when(F.col("_large"), 0).otherwise(1)).over(over))
    return rows.filter("not _large or _stay = 0").drop("_w", "_h", "_large", "_stay")


def without_nested(df: DataFrame, page: list[str], key: str, merge: str, keep: tuple[str, ...] = (), least: float = 0.8) -> DataFrame:
    """Of boxes that lie in others of their page: with "large" they go, with "small" those go that hold others and lie in none. Labels in ``keep`` don't count as lying in another."""
    other = df.select(*page, F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in EDGES])
    pairs = df.filter(~F.col("label").isin(list(keep))).join(other, page).filter((F.col(key) != F.col("_k")) & G.contained(G.box(), G.box("_"), least))
    inner = pairs.select(*page, key).distinct()
    if merge == "large":
        return df.join(inner, [*page, key], "left_anti")
    outer = pairs.select(*page, F.col("_k").alias(key)).distinct().join(inner, [*page, key], "left_anti")
    return df.join(outer, [*page, key], "left_anti")


def without_inside(df: DataFrame, page: list[str], key: str) -> DataFrame:
    """Boxes that lie in no other of their page; two equal ones remove each other."""
    other = df.select(*page, F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in EDGES])
    inner = df.join(other, page).filter((F.col(key) != F.col("_k")) & F.expr("x1 >= _x1 and y1 >= _y1 and x2 <= _x2 and y2 <= _y2")).select(*page, key).distinct()
    return df.join(inner, [*page, key], "left_anti")


def matched(df: DataFrame, others: DataFrame, page: list[str], key: str, other: str, most: float = 1.0) -> DataFrame:
    """page, key and other of each box: the first (by other) of others' boxes of its page whose edges all lie within ``most``; null for none."""
    o = others.select(*page, F.col(other), *[F.col(c).alias(f"_{c}") for c in EDGES])
    near = F.lit(True)
    for c in EDGES:
        near = near & (F.abs(F.col(c) - F.col(f"_{c}")) <= most)
    # only boxes whose first edges share a cell of the grid, or stand in neighbouring ones, are compared
    cell = F.floor(F.col("x1") / (2 * most))
    a = df.withColumn("_g", F.explode(F.array(cell - 1, cell, cell + 1)))
    b = o.withColumn("_g", F.floor(F.col("_x1") / (2 * most)))
    hits = a.join(b, [*page, "_g"]).filter(near).groupBy(*page, key).agg(F.min(other).alias(other))
    return df.select(*page, key).join(hits, [*page, key], "left")


def profile_runs(df: DataFrame, keys: list[str], low: str, high: str, least: int = 0, gap: int = 1) -> DataFrame:
    """keys, run_start and run_end (excluded): stretches of the coverage profile over ``least``, cut where more than ``gap`` lies between covered places."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("at")
    rows = profile(df, keys, low, high).filter(F.col("n") > least)
    rows = rows.withColumn("_new", F.when(F.col("at") - F.lag("at").over(w) > gap, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(*keys, "_run").agg(F.min("at").alias("run_start"), (F.max("at") + 1).alias("run_end")).drop("_run")


def projected_order(boxes: list[tuple[float, float, float, float]]) -> list[int]:
    """Reading order by profiles of whole numbers: bands of rows from the top, in each the columns from the left, and again in each column while its bands come apart."""
    b = np.asarray(boxes, float).reshape(-1, 4).astype(int)

    def bands(own: np.ndarray, axis: int) -> list[np.ndarray]:
        order = own[np.argsort(b[own, axis], kind="stable")]
        reach = np.maximum.accumulate(b[order, axis + 2])
        return np.split(order, np.flatnonzero(b[order[1:], axis] > reach[:-1]) + 1)

    out, todo = [], [(np.arange(len(b)), 1, 0)] if len(b) else []
    while todo:
        own, axis, idle = todo.pop()
        parts = bands(own, axis)
        idle = 0 if len(parts) > 1 else idle + 1
        if idle > 1 or len(own) == 1:  # neither rows nor columns come apart any more
            out += own[np.lexsort((b[own, 0], b[own, 1]))].tolist()
            continue
        todo += [(p, 1 - axis, idle) for p in reversed(parts)]
    return out


#: What a text must be, whole and in any case, to count as a page number.
PAGE_NUMBER = "第\\s*[IVXLCDM]+\\s*页|第\\s*\\d+\\s*页|第\\s*[a-zA-Z]\\s*页|page[- ]*[IVXLCDM]+|page[- ]*\\d+|page[- ]*[a-zA-Z]|\\d+|[IVXLCDM]+"


def columns_order(df: DataFrame, page: list[str], key: str, width: Column) -> DataFrame:
    """df with position, from 0: the reading order of pages set in two columns (boxes with a column text).

    Three sort keys say it all. A box has a side: 0 left, 1 right, 2 across the middle. Boxes across cut a page into bands,
    numbered by a window that counts those above; within a band the left column comes first, then the right, then the box
    that ends it; within a column the upper box, then the left one, then the key.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*page).orderBy("y1", "x1", key)
    quarter, half = width / 4, width / 2
    # between the columns' edges: a box that starts in the first quarter stays left of the third, one that starts later ends right of the middle
    side = F.when((F.col("x1") < quarter) & (F.col("x2") < 3 * quarter), 0).when((F.col("x1") > quarter) & (F.col("x2") > half), F.when(F.col("x1") < 0.95 * half, 0).otherwise(1)).otherwise(2)
    # the lowest box has no column of its own to keep to: under all others it is across if it lies over the middle, else where it ends says it, and page numbers stand right
    number = F.coalesce(F.col("text").rlike(rf"(?iU)\A(?:{PAGE_NUMBER})\z"), F.lit(False))
    under = (F.col("y1") > F.lag("y2").over(w)) & (F.col("x1") < half) & (F.col("x2") > half)
    lowest = F.when(under, 2).when((F.col("x2") > half) | number, 1).otherwise(0)
    rows = df.withColumn("_side", F.when(F.lead("y1").over(w).isNull() & F.lag("y1").over(w).isNotNull(), lowest).otherwise(side))
    above = F.sum(F.when(F.col("_side") == 2, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_band", F.coalesce(above, F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*page).orderBy("_band", "_side", "y1", "x1", key)) - 1
    return rows.withColumn("position", place).drop("_side", "_band")


def quad_order(corners: list[tuple[float, float]], same: float = 10.0) -> list[int]:
    """Order of quadrangles by their first corner (x, y): by height and then left, a later one going before those of about its height that lie right of it."""
    out: list[int] = []
    for i in sorted(range(len(corners)), key=lambda i: (corners[i][1], corners[i][0])):
        at = len(out)
        while at and abs(corners[i][1] - corners[out[at - 1]][1]) < same and corners[i][0] < corners[out[at - 1]][0]:
            at -= 1
        out.insert(at, i)
    return out


def ordered(df: DataFrame, page: list[str], key: str, how: str, **options) -> DataFrame:
    """df with position, from 0 in a page; how: "profile" or "quad"."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(key).reset_index(drop=True)
        b = [tuple(r) for r in own[EDGES].to_numpy(float).tolist()]
        own = own.iloc[quad_order([(x, y) for x, y, _, _ in b], **options) if how == "quad" else projected_order(b)]
        return own.assign(position=range(len(own)))

    return _per_page(df, page, run, "position int")


def union_area(boxes: list[tuple[float, float, float, float]]) -> float:
    """The area that boxes cover together: slab by slab between their left and right edges."""
    edges, total = sorted({x for b in boxes for x in (b[0], b[2])}), 0.0
    for a, e in zip(edges, edges[1:], strict=False):
        end, high = -float("inf"), 0.0
        for y0, y1 in sorted((b[1], b[3]) for b in boxes if b[0] <= a and b[2] >= e):
            high += max(0.0, y1 - max(y0, end))
            end = max(end, y1)
        total += high * (e - a)
    return total


def background_pictures(shapes: DataFrame, page: list[str], order: str, least: float = 0.1) -> DataFrame:
    """page and order of pictures of which later text shapes cover ``least`` or more, together."""
    pics = shapes.filter("kind = 'picture'").select(*page, F.col(order), *[F.col(c).alias(f"p{c}") for c in EDGES])
    texts = shapes.filter("kind = 'text'").select(*page, F.col(order).alias("_o"), *EDGES)
    over = pics.join(texts, page).filter(F.col("_o") > F.col(order))
    cut = over.select(*page, order, F.greatest("x1", "px1").alias("x1"), F.greatest("y1", "py1").alias("y1"), F.least("x2", "px2").alias("x2"), F.least("y2", "py2").alias("y2")).filter("x1 < x2 and y1 < y2")
    areas = regions.union_areas(cut, [*page, order])
    whole = pics.select(*page, order, ((F.col("px2") - F.col("px1")) * (F.col("py2") - F.col("py1"))).alias("_all"))
    return areas.join(whole, [*page, order]).filter(F.col("area") >= F.col("_all") * least).select(*page, order)
