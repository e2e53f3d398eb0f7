"""Order-sensitive operators as windows: numbering, lists, runs, captions, promotion, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.operators import scans


def section_numbers(df: DataFrame, doc: list[str], order: list[str], level: str, ranges: int | None = None) -> DataFrame:
    """df with number, dotted: a heading counts at its level and starts the deeper ones again; levels without a heading yet count as 1. A document may be dealt to many tasks (``scans``)."""
    return scans.numbered(df, doc, order, level, ranges=ranges)


def list_counters(df: DataFrame, keys: list[str], order: str, level: str, depth: int, start: int = 1) -> DataFrame:
    """df with number: an item's place at its level since the last item of a lesser level."""
    rows = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = F.lit(0)
    for k in range(1, depth):
        group = F.when(F.col(level) == k, F.sum(F.when(F.col(level) < k, 1).otherwise(0)).over(rows)).otherwise(group)
    df = df.withColumn("_g", group)
    return df.withColumn("number", F.row_number().over(Window.partitionBy(*keys, level, "_g").orderBy(order)) + F.lit(start - 1)).drop("_g")


def list_parents(df: DataFrame, keys: list[str], order: str, level: str, depth: int) -> DataFrame:
    """df with parent: the last item before it of a lesser level."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast(dict(df.dtypes)[order])
    for k in range(1, depth):
        parent = F.when(F.col(level) == k, F.max(F.when(F.col(level) < k, F.col(order))).over(before)).otherwise(parent)
    return df.withColumn("parent", parent)


def split_pages(df: DataFrame, keys: list[str], order: str, ends: str) -> DataFrame:
    """df with page, from 1: a row that ends a page is its last."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("page", F.lit(1) + F.coalesce(F.sum(F.when(F.col(ends), 1).otherwise(0)).over(before), F.lit(0)))


def mode_small(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and mode: the most frequent value, of several the smallest."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("_n"), column)).alias("mode"))


def promote(df: DataFrame, slide: list[str], size: str, bold: str, body: str) -> DataFrame:
    """df with title_level: 2 for a single largest bold block, 4 points over the body and 2 over the next bold size; 3 for the next such size under it."""
    ranked = df.filter(F.col(bold)).groupBy(*slide, size).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*slide).orderBy(F.col(size).desc())
    ranked = ranked.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead(size).over(w)).withColumn("_top", F.max(size).over(Window.partitionBy(*slide)))
    out = df.join(ranked, [*slide, size], "left")
    clear = F.col("_next").isNull() | (F.col(size) - F.col("_next") >= 2)
    two = F.col(bold) & (F.col("_k") == 1) & (F.col("_n") == 1) & (F.col(size) >= F.col(body) + 4) & clear
    three = F.col(bold) & (F.col("_k") == 2) & (F.col(size) >= F.col(body) + 2) & clear & (F.col("_top") - F.col(size) >= 2)
    return out.withColumn("title_level", F.when(two, 2).when(three, 3)).drop("_k", "_next", "_top", "_n")


def runs(df: DataFrame, keys: list[str], order: str, same: list[str]) -> DataFrame:
    """df with run: the number of the stretch of equal values that a row stands in."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    new = F.when(F.row_number().over(w) == 1, 1).when(new, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def merge_runs(df: DataFrame, keys: list[str], order: str, same: list[str], text: str) -> DataFrame:
    """A row for each run: keys, same, the first row's place and the texts joined."""
    own = F.array_sort(F.collect_list(F.struct(order, text)))
    return runs(df, keys, order, same).groupBy(*keys, "run", *same).agg(F.min(order).alias("first"), F.array_join(F.transform(own, lambda x: x[text]), "").alias("text"))


def nearest_body(df: DataFrame, page: list[str], idx: str, key: str, is_caption: Column, is_body: Column) -> DataFrame:
    """caption and body keys: of a page's bodies the one with the least gap, captions between not counted; of several the first.

    A gap can only grow past the nearest body on either side, as each step away adds at least as much as the captions
    it passes take off; so the last body before and the first after are all that need comparing, by two windows.
    """
    w = Window.partitionBy(*page).orderBy(idx)
    rows = df.withColumn("_c", is_caption).withColumn("_b", is_body)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_n", F.sum(F.when(F.col("_c"), 1).otherwise(0)).over(so_far)).withColumn("_m", F.col(idx) - F.col("_n"))
    mark = F.when(F.col("_b"), F.struct(F.col("_m").alias("m"), F.col("_n").alias("n"), F.col(idx).alias("i"), F.col(key).alias("k")))
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # among earlier bodies with the same gap the first counts: they have the same idx less captions
    after = F.first(mark, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = rows.withColumn("_p", before).withColumn("_f", after).filter("_c")
    gap_p = F.col("_m") + 1 - F.col("_p.m")
    gap_f = F.col("_f.m") - F.col("_m")
    first = rows.filter("_b").groupBy(*page, F.col("_m").alias("_pm")).agg(F.min(F.struct(F.col(idx).alias("i"), F.col(key).alias("k"))).alias("_first"))
    both = near.withColumn("_gp", gap_p).withColumn("_gf", gap_f).withColumn("_pm", F.col("_p.m")).join(first, [*page, "_pm"], "left")
    take_f = F.col("_gp").isNull() | (F.col("_gf") < F.col("_gp"))
    return both.select(F.col(key).alias("caption"), F.when(take_f, F.col("_f.k")).otherwise(F.col("_first.k")).alias("body")).filter("body is not null")


#: What a text that follows a table, image or chart begins with if it is its caption (in lower case).
CAPTION_STARTS = {"table": ("表", "table"), "image": ("图", "fig"), "chart": ("图", "fig", "chart")}


def captions(df: DataFrame, page: list[str], order: str, kind: str = "type", content: str = "content") -> DataFrame:
    """df whose captions have their type: a text right after a table, image or chart that begins like its caption is one; a caption goes with the nearest of these before it, captions between not counted, else with the one after; without either it is text."""
    w = Window.partitionBy(*page).orderBy(order)
    start, before = F.lower(F.trim(content)), F.lag(kind).over(w)
    begins = F.lit(False)
    for name, starts in CAPTION_STARTS.items():
        for x in starts:
            begins = begins | ((F.col("_before") == name) & F.col("_start").startswith(x))
    rows = df.withColumn("_before", before).withColumn("_start", start)
    rows = rows.withColumn("_kind", F.when((F.col(kind) == "text") & F.coalesce(begins, F.lit(False)), "caption").otherwise(F.col(kind)))
    other = F.when(F.col("_kind") != "caption", F.col("_kind"))
    last = F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first(other, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("_last", last).withColumn("_next", following)
    bodies = list(CAPTION_STARTS)
    own = F.when(F.col("_last").isin(bodies), F.concat("_last", F.lit("_caption"))).when(F.col("_next").isin(bodies), F.concat("_next", F.lit("_caption"))).otherwise("text")
    return rows.withColumn(kind, F.when(F.col("_kind") == "caption", own).otherwise(F.col("_kind"))).drop("_before", "_start", "_kind", "_last", "_next")


def contiguous_captions(df: DataFrame, keys: list[str], body: str, caption: str) -> DataFrame:
    """df (a row for each body and caption, with their places) with stays: counted back from a body's last caption, captions stay while each stands right before the next one kept, or only the body stands between."""
    w = Window.partitionBy(*keys, body).orderBy(F.desc(caption))
    step = F.lag(caption).over(w) - F.col(caption)
    broken = ~((step == 1) | ((step == 2) & (F.col(body) == F.col(caption) + 1)))
    return df.withColumn("_gap", F.when(broken, 1).otherwise(0)).withColumn("stays", F.sum("_gap").over(w) == 0).drop("_gap")


def with_captions(bodies: DataFrame, ties: DataFrame, keys: list[str], body: str, caption: str, text: str) -> DataFrame:
    """bodies with captions: the texts of those tied to each, in order; none is an empty list."""
    own = ties.groupBy(*keys, body).agg(F.transform(F.array_sort(F.collect_list(F.struct(caption, text))), lambda x: x[text]).alias("captions"))
    return bodies.join(own, [*keys, body], "left").withColumn("captions", F.coalesce("captions", F.array().cast("array<string>")))


def numbered_titles(df: DataFrame, doc: list[str], order: str, level: str, is_numbered: str, text: str, ranges: int | None = None) -> DataFrame:
    """df with section_number, as section_numbers counts, but a dotted number that a title without one begins with, of as many parts as its level, is taken over. A document may be dealt to many tasks (``scans``)."""
    parts = F.split(F.regexp_extract(text, r"(?U)\A\s*(\d+(?:\.\d+)*)", 1), r"\.")
    taken = F.when((F.size(parts) == F.col(level)) & (parts[0] != ""), parts.cast("array<bigint>"))
    return scans.numbered(df, doc, [order], level, F.col(is_numbered), taken, ranges).withColumnRenamed("number", "section_number")


def list_levels(df: DataFrame, keys: list[str], order: str, is_item: str, level: str) -> DataFrame:
    """df with depth: an item's level over the first one's of its run of items, 0 at least; null for others."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = F.sum(F.when(F.col(is_item), 0).otherwise(1)).over(w)
    first = F.first(F.when(F.col(is_item), F.col(level)), ignorenulls=True).over(Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_run", run).withColumn("depth", F.when(F.col(is_item), F.greatest(F.col(level) - first, F.lit(0)))).drop("_run")


def numbers(items: list[tuple[int, bool, int | None]]) -> list[tuple[int, int | None]]:
    """(list, number) of (level, ordered, explicit start) items in a row: a deeper item opens a list in its parent's, a shallower one closes the deeper ones, and another kind or a start that isn't the next number opens a new list; numbers are null where unordered."""
    out, stack, n = [], [], 0  # stack: [level, ordered, next, list]
    for level, ordered, start in items:
        while stack and stack[-1][0] > level:
            stack.pop()
        top = stack[-1] if stack and stack[-1][0] == level else None
        if top and (top[1] != ordered or ordered and start is not None and start != top[2]):
            stack.pop()
            top = None
        if top is None:
            n += 1
            top = [level, ordered, start if start is not None else 1, n]
            stack.append(top)
        out.append((top[3], top[2] if ordered else None))
        top[2] += 1
    return out


def list_numbers(df: DataFrame, keys: list[str], order: str, level: str, ordered: str, start: str, deepest: int | None = None) -> DataFrame:
    """df with list_no and number of each item, as ``numbers`` says, by windows.

    An item goes on with the list of the item before it of its level, unless a shallower one came between, or one of the two
    is ordered and the other isn't. In such a run an explicit start is the item's number whether or not it was expected, so
    numbers count from the last start, or from 1; a start that isn't the number before plus one opens a new list. Levels
    count from 0 to ``deepest`` (asked of df where it isn't given).
    """
    deepest = deepest if deepest is not None else df.agg(F.max(level)).first()[0] or 0
    rows = Window.partitionBy(*keys).orderBy(order)
    before, same = rows.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys, level).orderBy(order)
    out = df.withColumn("_at", F.row_number().over(rows))
    shallower = F.lit(None).cast("int")
    for k in range(1, deepest + 1):  # one window for all levels
        shallower = F.when(F.col(level) == k, F.max(F.when(F.col(level) < k, F.col("_at"))).over(before)).otherwise(shallower)
    out = out.withColumn("_over", shallower).withColumn("_last", F.lag("_at").over(same)).withColumn("_kind", F.lag(ordered).over(same))
    goes_on = F.col("_last").isNotNull() & (F.coalesce("_over", F.lit(0)) < F.col("_last")) & (F.col("_kind") == F.col(ordered))
    out = out.withColumn("_run", F.sum(F.when(goes_on, 0).otherwise(1)).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy(*keys, level, "_run").orderBy(order)
    out = out.withColumn("_n", F.row_number().over(run))
    # an explicit start, or the run's first item, is where counting begins
    begins = F.when(F.col(start).isNotNull() & F.col(ordered) | (F.col("_n") == 1), F.coalesce(start, F.lit(1)) - F.col("_n"))
    out = out.withColumn("_number", F.col("_n") + F.last(begins, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    jumps = F.col(ordered) & F.col(start).isNotNull() & (F.col(start) != F.lag("_number").over(run) + 1)
    out = out.withColumn("_new", F.when((F.col("_n") == 1) | jumps, 1).otherwise(0))
    number = F.when(F.col(ordered), F.col("_number")).cast("int").alias("number")
    opened = F.when(F.col("_new") == 1, F.sum("_new").over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.withColumn("_opened", opened)
    return out.select(*df.columns, F.last("_opened", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int").alias("list_no"), number)


def heading_lists(df: DataFrame, doc: list[str], order: str, num: str, level: str, is_text: str) -> DataFrame:
    """doc and num of lists that are headings: items of several levels, with body text between some of them."""
    w = Window.partitionBy(*doc).orderBy(order)
    texts = F.sum(F.when(F.col(is_text), 1).otherwise(0)).over(w)
    items = df.withColumn("_t", texts).filter(F.col(num).isNotNull())
    return items.groupBy(*doc, num).agg(F.countDistinct(level).alias("_levels"), F.min("_t").alias("_a"), F.max("_t").alias("_b")).filter("_levels > 1 and _b > _a").select(*doc, num)


def grouped_parts(df: DataFrame, keys: list[str], order: str, kind: str, text: str) -> DataFrame:
    """keys and content: parts of a kind in a row a line each, an empty line between groups."""
    own = F.array_sort(F.collect_list(F.struct(order, text)))
    groups = runs(df, keys, order, [kind]).groupBy(*keys, "run").agg(F.array_join(F.transform(own, lambda x: x[text]), "\n").alias("_g"))
    return groups.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "_g"))), lambda x: x["_g"]), "\n\n").alias("content"))


def following_captions(df: DataFrame, page: list[str], order: str) -> DataFrame:
    """df whose texts with a caption's beginning (column cap) right after a table, image or chart have its caption type."""
    before = F.lag("type").over(Window.partitionBy(*page).orderBy(order))
    return df.withColumn("type", F.when((F.col("type") == "text") & F.col("cap") & before.isin("table", "image", "chart"), F.concat(before, F.lit("_caption"))).otherwise(F.col("type")))


def keep_known_anchors(toc: DataFrame, body: DataFrame, anchor: str) -> DataFrame:
    """toc with anchors that no body block carries set to null; where no body block carries any, all stay."""
    known = body.filter(F.col(anchor).isNotNull()).select(anchor, F.lit(True).alias("_known")).distinct()
    any_ = known.agg((F.count("*") > 0).alias("_any"))  # a single row
    out = toc.join(known, anchor, "left").crossJoin(F.broadcast(any_))
    return out.withColumn(anchor, F.when(~F.col("_any") | F.coalesce("_known", F.lit(False)), F.col(anchor))).drop("_known", "_any")


def toggles(runs_: DataFrame, char_styles: DataFrame, para_styles: DataFrame, doc: list[str], direct: str, char: str, para: str, value: str, links: tuple[str, ...] = ("Hyperlink",)) -> DataFrame:
    """runs_ with value: the run's own, else its character style's (links' aside), else its paragraph style's, else false. The styles' values are those that ``graph.inherit`` gives."""
    c = char_styles.select(*doc, F.col("style").alias(char), F.col(value).alias("_c"))
    p = para_styles.select(*doc, F.col("style").alias(para), F.col(value).alias("_p"))
    rows = runs_.join(c, [*doc, char], "left").join(p, [*doc, para], "left")
    return rows.withColumn(value, F.coalesce(direct, F.when(~F.col(char).isin(list(links)), F.col("_c")), "_p", F.lit(False))).drop("_c", "_p")


def ctc(symbols: Column, blank: int = 0) -> Column:
    """Repeats dropped, then blanks."""
    return F.filter(symbols, lambda x, i: (x != blank) & ((i == 0) | (x != F.get(symbols, i - 1))))
