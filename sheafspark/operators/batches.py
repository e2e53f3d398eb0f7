"""Rules of Python over columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of values that are Python objects at a time.
SLICE_BYTES = 1 << 18


def each_once(x: pd.Series, rule: Callable[[str], str]) -> pd.Series:
    """What a rule makes of a batch's texts, worked out once for texts that are the same; null stays null."""
    code, texts = pd.factorize(x)
    made = np.array([*map(rule, texts), None], dtype=object)
    return pd.Series(made[code], index=x.index)


def by_slices(df: DataFrame, keys: list[str], column: str, rule: Callable[[object], tuple], schema: str) -> DataFrame:
    """keys and the columns (``schema``) that a rule makes of each value. Values become Python objects in runs of about SLICE_BYTES, a longer one by itself, so what a worker holds doesn't grow with batches."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], schema])
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(keys))
            size = np.asarray(pc.fill_null(pc.binary_length(values), 0)).astype(np.int64)
            cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // SLICE_BYTES)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                made = zip(*map(rule, values.slice(a, b - a).to_pylist()), strict=True) if b > a else [()] * (len(kind) - len(keys))
                own = [batch.column(i).slice(a, b - a).cast(kind[i].type) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(m, f.type) for m, f in zip(made, list(kind)[len(keys) :], strict=True)]], schema=kind)
        pa.default_memory_pool().release_unused()

    return df.select(*keys, column).mapInArrow(run, schema)
