"""Two ordered lists of a document's tables put side by side by their signatures."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Tables that are Python objects at a time, about; a document with more is looked at by itself.
TABLES = 50_000


def tight(text: Column) -> Column:
    """A table's text without white space, by which tables are compared."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


class Candidates:
    """Where tables with a signature stand: a table with a text is found by any text that begins with it or that it begins with, if rows or cells are as many; one without by rows, cells and pictures."""

    def __init__(self, tables: list[tuple[str, int, int, int]]):
        self.places: dict[tuple, list[int]] = {}
        for i, (text, rows, cells, images) in enumerate(tables):
            for key in self._keys(text, rows, cells, images):
                self.places.setdefault(key, []).append(i)
        self.texts = sorted({t for t, *_ in tables if t})
        self.sizes = sorted({len(t) for t in self.texts})

    @staticmethod
    def _keys(text: str, rows: int, cells: int, images: int) -> list[tuple]:
        return [(text, "rows", rows), (text, "cells", cells)] if text else [("", rows, cells, images)]

    def _alike(self, text: str) -> list[str]:
        """The texts here that begin the given one, and those that begin with it."""
        own = [text[:n] for n in self.sizes if n < len(text)]
        at = bisect_right(self.texts, text)
        at -= at > 0 and self.texts[at - 1] == text
        while at < len(self.texts) and self.texts[at].startswith(text):
            own.append(self.texts[at])
            at += 1
        return own

    def first(self, table: tuple[str, int, int, int], after: int) -> int | None:
        """The first place after ``after`` of a table that matches."""
        text, rows, cells, images = table
        best = None
        for t in self._alike(text) if text else [""]:
            for key in self._keys(t, rows, cells, images):
                own = self.places.get(key, [])
                k = bisect_right(own, after)
                if k < len(own) and (best is None or own[k] < best):
                    best = own[k]
        return best


def aligned(wanted: DataFrame, offered: DataFrame, doc: list[str], order: str, text: str, rows: str, cells: str, images: str, key: str) -> DataFrame:
    """doc, order and key of each wanted table: the key of the next offered table of its document that matches, null where none after the last match does; what lies between is passed over, and a miss passes nothing over.

    Each match depends on the one before, so a document's tables are one list; a match is found by its signature in the
    logarithm of their number, not by going through them. Many documents are looked at in a batch, TABLES at a time, as a
    call for each would cost more than its work. Texts are compared without white space. Null numbers are 0.
    """
    kinds = dict(wanted.dtypes)
    side = lambda df, at, k: df.select(*doc, F.struct(F.lit(at).alias("_s"), F.col(order).isNull().alias("_n"), F.col(order).alias("_o"), tight(F.col(text)).alias("_t"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n) for c, n in ((rows, "_r"), (cells, "_c"), (images, "_m"))], k.alias("_k")).alias("_x"))
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in doc], f"`{order}` {kinds[order]}", f"`{key}` {dict(offered.dtypes)[key]}"])
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(doc))
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(ends // TABLES)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = lists.slice(a, b - a)
                items, sizes = own.flatten(), pc.list_value_length(own).to_pylist()
                offers = items.field("_s").to_pylist()
                tables = list(zip(*(items.field(c).to_pylist() for c in ("_t", "_r", "_c", "_m")), strict=True))
                row, left, right, start = [], [], [], 0
                for i, n in enumerate(sizes, a):
                    end = start + n
                    first = start + bisect_right(offers[start:end], 0)
                    there, at = Candidates(tables[first:end]), -1
                    for j in range(start, first):
                        found = there.first(tables[j], at)
                        at = at if found is None else found
                        row.append(i)
                        left.append(j)
                        right.append(None if found is None else first + found)
                    start = end
                made = [*[batch.column(c).take(pa.array(row, pa.int64())) for c in range(len(doc))], items.field("_o").take(pa.array(left, pa.int64())), items.field("_k").take(pa.array(right, pa.int64()))]
                yield pa.RecordBatch.from_arrays([m.cast(f.type) for m, f in zip(made, kind, strict=True)], schema=kind)

    both = side(wanted, 0, F.lit(None).cast(dict(offered.dtypes)[key])).unionByName(side(offered, 1, F.col(key)))
    return both.groupBy(*doc).agg(F.array_sort(F.collect_list("_x")).alias("_x")).mapInArrow(run, schema)
