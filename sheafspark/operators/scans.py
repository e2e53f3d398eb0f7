"""Counters over long documents: what rows do to a counter is put together in pieces, so no document is one group.

Rows are dealt to ranges of (document, order), so a long document is cut where a range
ends. A stretch of rows is a function of the counters it starts from, and functions of
stretches compose: a first pass gives each row its counters in terms of the unknown
start of its stretch, a second puts the stretches of the documents that lie across
ranges one after another (there are as many as ranges), and the third sets the starts
in. All but the first are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sheafspark.session import Stored

#: What became of a counter since its stretch began: it is a number, or its start and a number, or that with a start of 0 counting as 1.
IS, ADDS, SEEDS = range(3)
_TERMS = "array<struct<k:int,n:bigint>>"


def seeded(term: tuple[int, int]) -> tuple[int, int]:
    """A counter that begins with 1 if it hasn't begun."""
    k, n = term
    return (IS, n or 1) if k == IS else (SEEDS, 0) if term == (ADDS, 0) else term


def counted(terms: list[tuple[int, int]], fresh: tuple[int, int], level: int) -> list[tuple[int, int]]:
    """Counters after a heading of a level: it counts, those over it have begun, those under it are gone."""
    own = [*terms[:level], *[fresh] * (level - len(terms))]
    k, n = own[-1]
    return [*map(seeded, own[:-1]), (k, n + 1)]


def _set(start: Column, terms: Column) -> Column:
    """The numbers that terms are with counters that start as given; those beyond start are 0."""
    at = lambda i: F.coalesce(F.get(start, i), F.lit(0).cast("long"))
    return F.transform(terms, lambda t, i: F.when(t["k"] == IS, t["n"]).when((t["k"] == SEEDS) & (at(i) == 0), t["n"] + 1).otherwise(at(i) + t["n"]))


def numbered(df: DataFrame, doc: list[str], order: list[str], level: str, counts: Column | None = None, taken: Column | None = None, ranges: int | None = None) -> DataFrame:
    """df with number, dotted: a row of a level counts at it and starts the deeper ones again; levels over it that haven't begun count as 1.

    ``counts``: which rows do (all); others have no number. ``taken``: an array of as many numbers as the row's level that
    such another row sets the counters to (null: it changes nothing). Rows with a level under 1 or none change nothing.
    Rows that ``doc`` and ``order`` don't tell apart are in no defined order. ``ranges``: those that rows are dealt to (the
    session's shuffle partitions).
    """
    spark = df.sparkSession
    tables = Stored(spark)
    ok = F.coalesce(F.col(level) >= 1, F.lit(False))
    counts = F.lit(True) if counts is None else F.coalesce(counts, F.lit(False))
    step = F.when(ok & counts, F.array(F.col(level).cast("long"))).when(ok & (taken is not None), F.concat(F.array(F.lit(0).cast("long")), taken.cast("array<bigint>")) if taken is not None else F.lit(None))
    rows = df.withColumn("_do", step)
    by = [*doc, *order]
    dealt = rows.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    columns, schema = df.columns, StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", _counts boolean, _part int, _i bigint, _terms {_TERMS}")
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, terms, fresh, i = TaskContext.get().partitionId(), object(), [], (ADDS, 0), 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in doc), strict=True)) if doc else [()] * batch.num_rows
            out = []
            for key, do in zip(keys, batch.column("_do").to_pylist(), strict=True):
                if key != last:
                    last, terms, fresh = key, [], (ADDS, 0)
                if do:
                    terms = counted(terms, fresh, do[0]) if do[0] else [(IS, n) for n in do[1:]]
                    fresh = (IS, 0)
                out.append([{"k": k, "n": n} for k, n in terms] if do else None)
            n = batch.num_rows
            own = [batch.column(c) for c in columns]
            made = [pa.array([bool(d and d[0]) for d in batch.column("_do").to_pylist()]), pa.array([part] * n, pa.int32()), pa.array(range(i, i + n), pa.int64()), pa.array(out, kind.field("_terms").type)]
            i += n
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([*own, *made], kind, strict=True)], schema=kind)

    done = tables.cut(dealt.mapInArrow(run, schema))
    ends = done.groupBy(*doc, "_part").agg(F.max_by("_terms", F.when(F.col("_terms").isNotNull(), F.col("_i"))).alias("_end"))
    w = Window.partitionBy(*doc).orderBy("_part")
    earlier = F.collect_list("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))  # at most as many as ranges; a stretch that changes nothing isn't among them
    starts = ends.withColumn("_before", earlier).filter(F.size("_before") > 0)
    starts = starts.select(*[F.col(c).alias(f"_d{i}") for i, c in enumerate(doc)], F.col("_part").alias("_p"), F.aggregate("_before", F.array().cast("array<bigint>"), _set).alias("_start"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(doc):
        same = same & F.col(c).eqNullSafe(F.col(f"_d{i}"))
    whole = done.join(starts, same, "left")
    number = F.array_join(_set(F.coalesce("_start", F.array().cast("array<bigint>")), F.col("_terms")), ".")
    return whole.select(*columns, F.when(F.col("_counts"), number).alias("number"))
