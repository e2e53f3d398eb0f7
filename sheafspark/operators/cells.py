"""Operators over spreadsheet cells: chunks, subsets, and the choice of tables. Tables are found in ``regions``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.session import Stored

#: Rows of a group up to which its sets are held against each other in one list.
FEW_ROWS = 64


def chunks(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """df with chunk_id: every ``size`` rows of a file, from 1."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("chunk_id", (F.floor((n - 1) / size) + 1).cast("int"))


def filled_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in one of columns at least, whose other nulls are empty."""
    return df.na.drop("all", subset=columns).na.fill("", columns)


def bounds(cells: DataFrame, keys: list[str], row: str, col: str) -> DataFrame:
    """keys, top, bottom, left_edge and right_edge of the cells that have a value."""
    return cells.groupBy(*keys).agg(F.min(row).alias("top"), F.max(row).alias("bottom"), F.min(col).alias("left_edge"), F.max(col).alias("right_edge"))


def modal_width(rows: DataFrame, keys: list[str], width: str, order: str) -> DataFrame:
    """keys and the width that most rows have; of several the one that comes first."""
    seen = rows.groupBy(*keys, width).agg(F.count("*").alias("_n"), F.min(order).alias("_f"))
    return seen.groupBy(*keys).agg(F.min_by(width, F.struct(-F.col("_n"), "_f")).alias("width"))


def in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str, name: str) -> DataFrame:
    """points with whether one of their group's intervals [low, high] holds them. Intervals are merged first and each point looks only at the last that begins before it, so that no interval is listed place by place."""
    same = Window.partitionBy(*keys).orderBy(low, high)
    reach = intervals.select(*keys, F.col(low).alias("_l"), F.col(high).alias("_h")).withColumnsRenamed({"_l": low, "_h": high})
    merged = reach.withColumn("_before", F.max(high).over(same.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_new", F.when(F.col("_before") >= F.col(low), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(same))
    merged = merged.groupBy(*keys, "_g").agg(F.min(low).alias("_at"), F.max(high).alias("_end")).drop("_g")
    both = points.withColumn("_at", F.col(at)).withColumn("_end", F.lit(None).cast(dict(merged.dtypes)["_end"])).withColumn("_point", F.lit(True)).unionByName(merged.withColumn("_point", F.lit(False)), allowMissingColumns=True)
    last = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn(name, F.coalesce(last >= F.col("_at"), F.lit(False))).filter("_point").drop("_at", "_end", "_point")


def blank_runs(rows: DataFrame, keys: list[str], at: str, blank: str) -> DataFrame:
    """keys, longest_blank (the most blank rows in a row) and blank_ratio."""
    isle = rows.withColumn("_i", F.col(at) - F.row_number().over(Window.partitionBy(*keys, blank).orderBy(at)))
    runs = isle.groupBy(*keys, "_i", blank).agg(F.count("*").alias("_n"))
    none = F.coalesce(F.sum(F.when(F.col(blank), F.col("_n"))), F.lit(0))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(blank), F.col("_n"))), F.lit(0)).alias("longest_blank"), (none / F.sum("_n")).alias("blank_ratio"))


def without_subsets(sets: DataFrame, group: str, key: str, column: str) -> DataFrame:
    """sets without those that are a strict subset of another of their group; equal sets stay together.

    Sets are stored, as they are read several times. A group of up to FEW_ROWS rows is one list, whose distinct sets are held
    against each other; those of larger groups meet by their rarest elements. The empty set is a subset wherever there is
    another; sets that are null, or of no group, stay.
    """
    tables = Stored(sets.sparkSession)
    own = tables.cut(sets.withColumn("_s", F.array_sort(F.array_distinct(column))))
    grouped = own.filter(F.col(group).isNotNull())
    many = tables.cut(grouped.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") > FEW_ROWS).select(group))
    rows = F.collect_list(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(sets.columns)], "_s"))
    few = grouped.join(many, group, "left_anti").groupBy(group).agg(rows.alias("_rows"))
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731 (x is worked out once, wherever f has it)
    under = lambda sets: F.filter(sets, lambda a: F.exists(sets, lambda b: (F.size(a) < F.size(b)) & (F.size(F.array_except(a, b)) == 0)))
    left = once(once(F.array_distinct(F.col("_rows")["_s"]), under), lambda over: F.filter("_rows", lambda r: ~F.coalesce(F.array_contains(over, r["_s"]), F.lit(False))))
    few = few.select(F.explode(left).alias("_r")).select(*[F.col("_r")[f"_{i}"].alias(c) for i, c in enumerate(sets.columns)])
    rest = _without_subsets(own.join(many, group, "left_semi"), group).select(*sets.columns)
    return few.union(rest).union(own.filter(F.col(group).isNull()).select(*sets.columns))


def _without_subsets(sets: DataFrame, group: str) -> DataFrame:
    """without_subsets for groups of any size; ``_s`` has the sets.

    Equal sets of a group meet as one, which goes by a number of 128 bits. A set meets only the larger ones that have its
    rarest element (of its group), by their numbers; the sets themselves come to such pairs alone.
    """
    size = F.size("_s")  # a null element is nothing to a hash
    rows = sets.withColumn("_id", F.struct(F.xxhash64("_s", size).alias("a"), F.xxhash64(F.lit(1), "_s", size).alias("b")))
    distinct = rows.groupBy(group, "_id").agg(F.first("_s").alias("_s"))
    each = distinct.select(group, "_id", F.size("_s").alias("_size"), F.explode("_s").alias("_e")).withColumn("_e", F.struct("_e"))
    rarity = each.groupBy(group, "_e").agg(F.count("*").alias("_n"))
    rarest = each.join(rarity, [group, "_e"]).groupBy(group, "_id", "_size").agg(F.min(F.struct("_n", "_e"))["_e"].alias("_e"))
    larger = each.select(group, F.col("_id").alias("_other"), F.col("_size").alias("_more"), "_e")
    pairs = rarest.join(larger, [group, "_e"]).filter("_size < _more").select(group, "_id", "_other")
    pairs = pairs.join(distinct, [group, "_id"]).join(distinct.select(group, F.col("_id").alias("_other"), F.col("_s").alias("_o")), [group, "_other"])
    over = pairs.filter(F.size(F.array_except("_s", "_o")) == 0).select(group, "_id")
    full = distinct.filter(F.size("_s") > 0).select(group).distinct()
    empty = distinct.filter(F.size("_s") == 0).join(full, group).select(group, "_id")
    return rows.join(over.union(empty).distinct(), [group, "_id"], "left_anti")


def table_bounds(cells: set[tuple[int, int]], gap: int = 0) -> list[tuple[int, int, int, int]]:
    """Boxes (top, left, bottom, right) of the parts that steps of up to gap + 1 rows or columns connect, in reading order."""
    left, out = set(cells), []
    for start in sorted(cells):
        if start not in left:
            continue
        left.discard(start)
        todo, box = [start], [*start, *start]
        while todo:
            r, c = todo.pop()
            box = [min(box[0], r), min(box[1], c), max(box[2], r), max(box[3], c)]
            for k in range(1, gap + 2):
                for at in ((r + k, c), (r - k, c), (r, c + k), (r, c - k)):
                    if at in left:
                        left.discard(at)
                        todo.append(at)
        out.append(tuple(box))
    return out


def content_mask(cells: DataFrame, table: list[str], rows: str, cols: str, semantic: str) -> DataFrame:
    """table, row and col of each place that a cell with content covers, its spans cut at the table's size."""
    own = cells.filter(F.col(semantic))
    down = F.sequence(F.col("row"), F.least(F.col("row") + F.col("row_span"), F.col(rows)) - 1)
    own = own.filter((F.col("row") < F.col(rows)) & (F.col("col") < F.col(cols))).select(*table, rows, cols, F.explode(down).alias("row"), "col", "col_span")
    across = F.sequence(F.col("col"), F.least(F.col("col") + F.col("col_span"), F.col(cols)) - 1)
    return own.select(*table, "row", F.explode(across).alias("col")).distinct()


def table_summaries(tables: DataFrame, mask: DataFrame, table: list[str], rows: str = "num_rows", cols: str = "num_cols") -> DataFrame:
    """tables with area, content_area, blank_ratio, blank_rows and blank_cols (inner ones without content) and longest_blank, the most of them in a row."""

    def blanks(size: str, axis: str) -> DataFrame:
        lines = tables.filter(F.col(size) > 2).select(*table, F.explode(F.sequence(F.lit(1), F.col(size) - 2)).alias(axis))
        empty = lines.join(mask.select(*table, axis).distinct(), [*table, axis], "left_anti")
        isle = empty.withColumn("_i", F.col(axis) - F.row_number().over(Window.partitionBy(*table).orderBy(axis)))
        return isle.groupBy(*table, "_i").agg(F.count("*").alias("_n")).groupBy(*table).agg(F.sum("_n").alias(f"blank_{axis}s"), F.max("_n").alias(f"_longest_{axis}"))

    out = tables.join(mask.groupBy(*table).agg(F.count("*").alias("content_area")), table, "left").join(blanks(rows, "row"), table, "left").join(blanks(cols, "col"), table, "left")
    out = out.na.fill(0, ["content_area", "blank_rows", "blank_cols", "_longest_row", "_longest_col"]).withColumn("area", F.col(rows) * F.col(cols))
    out = out.withColumn("blank_ratio", 1 - F.col("content_area") / F.greatest(F.col("area"), F.lit(1)))
    return out.withColumn("longest_blank", F.greatest("_longest_row", "_longest_col")).drop("_longest_row", "_longest_col")


def candidate_summaries(tables: DataFrame, keys: list[str], rows: str = "num_rows", cols: str = "num_cols") -> DataFrame:
    """keys, severe and penalty of each candidate, a way to cut a sheet into tables (table_summaries' rows with top and is_single)."""
    inner = F.greatest(F.col(rows) - 2, F.lit(0)) + F.greatest(F.col(cols) - 2, F.lit(0))
    total = tables.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("is_single").cast("int")).alias("single"), F.sum((F.col("longest_blank") >= 2).cast("int")).alias("severe"),
        F.sum(((F.col("area") >= 6) & (F.col("blank_ratio") > 0.35)).cast("int")).alias("sparse"), F.sum("area").alias("area"), F.sum(F.col("area") - F.col("content_area")).alias("blank"),
        F.sum(F.col("blank_rows") + F.col("blank_cols")).alias("lines"), F.sum(inner).alias("inner"),
    )
    covered = tables.select(*keys, F.explode(F.sequence(F.col("top"), F.col("top") + F.col(rows) - 1)).alias("_r")).groupBy(*keys, "_r").agg(F.count("*").alias("_n"))
    over = covered.groupBy(*keys).agg((F.sum(F.col("_n") - 1) / F.count("*")).alias("overlap"))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    penalty = 6.0 * F.col("severe") + 2.5 * share("lines", "inner") + 1.5 * share("sparse", "n") + share("single", "n") + 0.5 * share("blank", "area") + F.col("overlap")
    return total.join(over, keys).select(*keys, "severe", share("lines", "inner").alias("line_ratio"), penalty.alias("penalty"))


def best_gaps(candidates: DataFrame, sheet: list[str], gap: str = "gap", margin: float = 0.15) -> DataFrame:
    """sheet and the tolerance of its best candidate: of those within ``margin`` of the least penalty the one with the fewest severe gaps, then 1 before 0 before 2, then the fewest blank lines."""
    near = candidates.withColumn("_least", F.min("penalty").over(Window.partitionBy(*sheet))).filter(F.col("penalty") <= F.col("_least") + margin)
    prefer = F.when(F.col(gap) == 1, 0).when(F.col(gap) == 0, 1).otherwise(2)
    return near.groupBy(*sheet).agg(F.min_by(gap, F.struct("severe", prefer.alias("_p"), "line_ratio", "penalty")).alias(gap))


def best_gap(cells: set[tuple[int, int]], single_ok: bool = True) -> tuple[int, list[tuple[int, int, int, int]]]:
    """The best tolerance (0, 1 or 2) for a sheet's cells and its tables' boxes, as the DataFrame form chooses, without tables whose cells another has."""
    made = []
    for gap in (0, 1, 2):
        boxes = table_bounds(cells, gap)
        severe = lines = inner = sparse = single = area = blank = 0
        rows: dict[int, int] = {}
        for top, left, bottom, right in boxes:
            own = {(r, c) for r, c in cells if top <= r <= bottom and left <= c <= right}
            high, wide = bottom - top + 1, right - left + 1
            empty = [[r not in {x for x, _ in own} for r in range(top + 1, bottom)], [c not in {x for _, x in own} for c in range(left + 1, right)]]
            run = max((len(x) for e in empty for x in "".join("x" if b else " " for b in e).split()), default=0)
            severe, lines, inner = severe + (run >= 2), lines + sum(map(sum, empty)), inner + max(high - 2, 0) + max(wide - 2, 0)
            area, blank, single = area + high * wide, blank + high * wide - len(own), single + (high == wide == 1)
            sparse += high * wide >= 6 and 1 - len(own) / (high * wide) > 0.35
            for r in range(top, bottom + 1):
                rows[r] = rows.get(r, 0) + 1
        n = max(len(boxes), 1)
        ratio = lines / max(inner, 1)
        penalty = 6 * severe + 2.5 * ratio + 1.5 * sparse / n + single / n + 0.5 * blank / max(area, 1) + sum(k - 1 for k in rows.values()) / max(len(rows), 1)
        sets = [{(r, c) for r, c in cells if b[0] <= r <= b[2] and b[1] <= c <= b[3]} for b in boxes]
        made.append((penalty, severe, (1, 0, 2)[gap], ratio, gap, [b for b, x in zip(boxes, sets, strict=True) if not any(x < y for y in sets)]))
    least = min(m[0] for m in made)
    best = min((m for m in made if m[0] <= least + 0.15), key=lambda m: (m[1], m[2], m[3], m[0]))
    return best[4], best[5]
