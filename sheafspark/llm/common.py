"""What the operators share: shared-folder tables, bounded samples, batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import os
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes from which on word_hash leaves a slice to a C function.
LONG_SLICE = 256
#: Bytes of text that one step of a vectorised operator looks at together.
CHUNK_BYTES = 1 << 18


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(1)
def _local_folder() -> str:
    """A folder of this process's own, for sessions whose driver and executors are one process; it goes with it."""
    folder = tempfile.mkdtemp(prefix="sheafspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; where that is unset, a folder in the warehouse, which is shared as well.

    Only a session in a single process (master local) has a folder of the machine's own, made when it is first asked for.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] == "local":
        found = _local_folder()
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_sheafspark").rstrip("/")


class Tables:
    """Named tables in the shared folder; they cut lineage and outlive an executor.

    A result may be read long after its operator returned, so what it reads stays; ``drop`` deletes what nothing reads
    any more, ``close`` everything of this object.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/sheafspark-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """df written and read back, with the schema it has (so that an empty table keeps its columns)."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sheaf_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            self._delete(t._sheaf_path)

    def close(self) -> None:
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of one key from which on join_counted treats it apart.
HOT_ROWS = 1 << 20


def join_counted(big: DataFrame, small: DataFrame, key: str, count: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """big joined to small, which has one row a key and in ``count`` how many rows of big have it.

    A key with more than hot_rows rows isn't dealt to a single task: the rows of such keys meet theirs by broadcast. There
    are at most (rows of big) / hot_rows such keys, which is the size bound of what is broadcast. ``count`` is dropped.
    """
    hot = F.broadcast(small.filter(F.col(count) > hot_rows).drop(count))
    rest = big.join(hot.select(key), key, "left_anti").join(small.filter(F.coalesce(F.col(count), F.lit(0)) <= hot_rows).drop(count), key, how)
    return big.join(hot, key).unionByName(rest)


def give_back() -> None:
    """Returns freed memory to the system. Workers are kept from task to task, and what each of them holds back adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Values of a sample's strata that get a share of their own at most.
STRATA = 1000


def sampled(df: DataFrame, key: list[str], rows: int, by: str | None = None, least: int = 0, seed: int = 11) -> DataFrame:
    """About ``rows`` rows of df, drawn by a hash of ``key``: the same rows each time, however df is partitioned.

    With ``by`` a value too rare to have about ``least`` rows in the sample is drawn with a greater share (the STRATA most
    frequent of such values). Who collects the sample puts a limit after the step that makes rows small.
    """
    if by is None:
        rare, n = [], df.count()
        base = min(1.0, rows / max(1, n))
    else:
        counts = df.groupBy(by).agg(F.count("*").alias("_n"))
        n = counts.agg(F.sum("_n")).first()[0] or 0
        base = min(1.0, rows / max(1, n))
        rare = counts.filter(F.col("_n") * base < least).orderBy(F.desc("_n"), by).limit(STRATA).collect() if base < 1 else []
    if base >= 1:
        return df
    share = F  # one CASE of all of them: one inside another would be as deep as they are many
    for r in rare:
        share = share.when(F.col(by).eqNullSafe(F.lit(r[0])), F.lit(min(1.0, least / r[1])))
    share = share.otherwise(base) if rare else F.lit(base)
    draw = F.pmod(F.xxhash64(*[F.col(k) for k in key], F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.filter(draw < share)


def fitted(rows: DataFrame, most: int, train: Callable[[list[pa.RecordBatch]], object]) -> object:
    """What ``train`` makes of rows, a bounded sample of which at most ``most`` are taken: it runs in one task of an
    executor, so the driver has the model alone and a lost executor's work is done again elsewhere."""

    def run(batches):
        made = pickle.dumps(train(list(batches)))
        give_back()
        yield pa.RecordBatch.from_pydict({"model": [made]}, schema=pa.schema([("model", pa.binary())]))

    got = rows.limit(most).mapInArrow(run, "model binary").first()
    return pickle.loads(got[0]) if got else train([])


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts have about ``most_bytes`` bytes; a longer text is a run of its own."""
    n = batch.num_rows
    if not n:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    run = (np.cumsum(size) - size) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def runs(texts: list[str], most_chars: int = CHUNK_BYTES >> 2) -> Iterator[list[str]]:
    """texts in lists of about ``most_chars`` characters, in order; a longer text is a list of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most_chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes as one array, and the offsets of its rows in it (one more than rows). Null is empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, text: str = "_text", most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Runs ``make()`` once in each task and its result on each slice of df's batches; that returns columns by name."""

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        step = make()
        for batch in batches:
            for part in slices(batch, text, most_bytes):
                out = step(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in kind], schema=kind)
        step = out = part = batch = None
        give_back()

    return df.mapInArrow(run, schema)


# Hashes of byte slices -------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of h."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over data's bytes, from which slice_hash takes any slice's hash."""
    power, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=out[1:])
    return out


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the slices start:end; equal bytes have equal hashes wherever they stand."""
    _, inverse = _powers(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + np.uint64(salt * 2 + 1) * (end - start).astype(np.uint64))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """64-bit hashes of the slices start:end, eight bytes a step, each mixed with what came before under a key, so that no
    arithmetic relation between two slices makes their hashes meet. Long slices are hashed in C, one by one."""
    out = np.full(len(start), key, np.uint64) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    long = size > LONG_SLICE
    for i in np.flatnonzero(long).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(padded[start[i] : end[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest(), "<u8")[0]
    live = np.flatnonzero(~long)
    at = 0
    while len(live):
        left = size[live] - at
        chunk = wide[start[live] + at]
        cut = left < 8
        chunk[cut] &= (np.uint64(1) << (left[cut] * 8).astype(np.uint64)) - np.uint64(1)
        out[live] = mix(out[live] ^ chunk) + np.uint64(at + 1)
        live, at = live[left > 8], at + 8
    return mix(out)


def spans_of(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of True that don't cross a row's end."""
    n = len(member)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = member[inner]
    last[inner - 1] = member[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
