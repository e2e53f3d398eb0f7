"""A data source for the members of zip packages: ``spark.read.format("members")``, its stream, and a writer of packages.

The driver lists files and deals them to splits by size alone: small packages share a
split, a large one is dealt to several, each of which takes the members that begin in
its stretch of bytes. Tasks read central directories, so a stretch is as long as its
package's directory at least, whose size the driver asks of a large package; a member's bytes are read where
the schema asks for ``content`` and the filters let the member through, so give a
schema of the columns you need. Filters on path, name, suffix and size are taken by the
reader. Paths are those that ``pyarrow.fs`` opens (file, S3, GCS, HDFS).

A package that can't be read is one row with its error; a member that can't is a row
with its name and error.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = "path string, name string, suffix string, size_bytes long, packed_bytes long, crc32 long, content binary, error string"
#: Bytes of a split, what a file counts at least, and bytes of a batch.
SPLIT_BYTES, FILE_BYTES, BATCH_BYTES = 64 << 20, 1 << 20, 8 << 20
#: Bytes at a package's end in which the records about its directory are, a longest comment included.
END_BYTES = (1 << 16) + 256
#: Columns that are known before a member is opened.
LISTED = ("path", "name", "suffix", "size_bytes", "packed_bytes", "crc32")


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def listed(path: str, ends: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """(path, size, time of change in ns) of a file, or of a folder's files with one of the ends, by path; hidden ones are left out."""
    store, at = open_store(path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(at, recursive=True))
    shown = lambda p: not any(part.startswith((".", "_")) for part in p[len(at) :].split("/"))
    return sorted((f.path, f.size, f.mtime_ns) for f in found if f.type == pafs.FileType.File and shown(f.path) and (info is f or f.path.lower().endswith(ends)))


@dataclass
class Split(InputPartition):
    """(path, first byte, byte after the last) of the stretches that a task reads."""

    stretches: list[tuple[str, int, int]]


def directory_bytes(path: str, size: int) -> int:
    """Size of a package's central directory, by the record at its end; 0 where there is none."""
    try:
        store, at = open_store(path)
        with store.open_input_file(at) as raw:
            raw.seek(max(0, size - END_BYTES))
            tail = raw.read()
        end = tail.rfind(b"PK\5\6")
        n = struct.unpack_from("<I", tail, end + 12)[0] if end >= 0 else 0
        # a large directory's size is in a record before that
        return n if n < 0xFFFFFFFF else struct.unpack_from("<Q", tail, tail.rindex(b"PK\6\6", 0, end) + 40)[0]
    except (OSError, ValueError, struct.error):
        return 0


def splits(files: Iterable[tuple[str, int]], most: int = SPLIT_BYTES, directory: Callable[[str, int], int] = lambda path, size: 0) -> list[Split]:
    """A file over ``most`` bytes in as many stretches as it takes, none shorter than its directory, which every stretch's task reads: what is read of directories then grows with the file, not with its square. Smaller ones together, each counting FILE_BYTES at least."""
    out, part, size = [], [], 0
    for path, n in files:
        if n > most:
            parts = -(-n // max(most, directory(path, n)))
            out += [Split([(path, n * k // parts, n * (k + 1) // parts)]) for k in range(parts)]
            continue
        if part and size + max(n, FILE_BYTES) > most:
            out.append(Split(part))
            part, size = [], 0
        part.append((path, 0, n))
        size += max(n, FILE_BYTES)
    return [*out, Split(part)] if part else out


def suffix_of(name: str) -> str:
    last = name.rsplit("/", 1)[-1]
    return last.rsplit(".", 1)[-1].lower() if "." in last else ""


_TESTS: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    IsNotNull: lambda v, x: True, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x),
}


def takes(f: Filter) -> bool:
    """Whether the reader answers a filter itself."""
    return type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in LISTED


def passes(row: dict, filters: list[tuple[type, str, object]]) -> bool:
    """A filter holds for no null."""
    return all(row[c] is not None and _TESTS[kind](row[c], value) for kind, c, value in filters)


def rows_of(split: Split, columns: list[str], filters: list[tuple[type, str, object]]) -> Iterator[dict]:
    blank = dict.fromkeys(("path", "name", "suffix", "size_bytes", "packed_bytes", "crc32", "content", "error"))
    for path, first, after in split.stretches:
        on_path = [f for f in filters if f[1] == "path"]
        if not passes({"path": path}, on_path):
            continue
        try:
            store, at = open_store(path)
            with store.open_input_file(at) as raw, zipfile.ZipFile(raw) as package:
                for m in package.infolist():
                    if m.is_dir() or not first <= m.header_offset < after:
                        continue
                    row = blank | {"path": path, "name": m.filename, "suffix": suffix_of(m.filename), "size_bytes": m.file_size, "packed_bytes": m.compress_size, "crc32": m.CRC}
                    if not passes(row, filters):
                        continue
                    if "content" in columns:
                        try:
                            row["content"] = package.read(m)
                        except Exception as e:  # a damaged, encrypted or oddly packed member
                            row["error"] = f"{type(e).__name__}: {e}"
                    yield row
        except Exception as e:
            if first == 0 and len(on_path) == len(filters):
                yield blank | {"path": path, "error": f"{type(e).__name__}: {e}"}


def batches(rows: Iterable[dict], schema: StructType) -> Iterator[pa.RecordBatch]:
    """rows in batches of about BATCH_BYTES of content."""
    kind, part, size = to_arrow_schema(schema), [], 0
    for row in rows:
        part.append({c: row[c] for c in kind.names})
        size += 200 + len(row["content"] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(part, schema=kind)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, schema=kind)


class _Reading:
    """What batch and stream readers share: options, columns, filters."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options.get("path")
        if not self.path:
            raise ValueError("members: give a path")
        self.ends = tuple(e.strip().lower() for e in options.get("ends", ".zip,.docx,.pptx,.xlsx,.xlsm,.epub").split(","))
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.filters: list[tuple[type, str, object]] = []

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from batches(rows_of(partition, self.schema.names, self.filters), self.schema)


class Reader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if takes(f):
                self.filters.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Split]:
        return splits(((p, n) for p, n, _ in listed(self.path, self.ends)), self.split_bytes, directory_bytes)


class StreamReader(_Reading, DataSourceStreamReader):
    """Offsets are the latest time of change and the files that have it, so one that comes within the same instant isn't lost. A file that is put in place with an earlier time than one taken before is not seen."""

    def initialOffset(self) -> dict:
        return {"time": -1, "paths": []}

    def latestOffset(self) -> dict:
        files = listed(self.path, self.ends)
        last = max((t for _, _, t in files), default=-1)
        return {"time": last, "paths": [p for p, _, t in files if t == last]}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        def between(path: str, time: int) -> bool:
            begun = time > start["time"] or (time == start["time"] and path not in start["paths"])
            return begun and (time < end["time"] or (time == end["time"] and path in end["paths"]))

        return splits(((p, n) for p, n, t in listed(self.path, self.ends) if between(p, t)), self.split_bytes, directory_bytes)


@dataclass
class Written(WriterCommitMessage):
    made: str | None


class Writer(DataSourceWriter):
    """One package a task from rows of name and content: written under a hidden name, shown when the whole job is done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.job = options["path"], uuid.uuid4().hex
        store, at = open_store(self.path)
        if overwrite and store.get_file_info(at).type == pafs.FileType.Directory:
            store.delete_dir_contents(at)
        store.create_dir(at, recursive=True)

    def write(self, rows: Iterator) -> Written:
        store, at = open_store(self.path)
        hidden, package, seen = f"{at}/.{self.job}-{uuid.uuid4().hex}", None, set()
        for row in rows:
            if package is None:
                out = store.open_output_stream(hidden)
                package = zipfile.ZipFile(_Positioned(out), "w", zipfile.ZIP_DEFLATED)
            if row["name"] in seen:
                raise ValueError(f"two members of a package are named {row['name']}")
            seen.add(row["name"])
            package.writestr(zipfile.ZipInfo(row["name"]), bytes(row["content"] or b""), zipfile.ZIP_DEFLATED)
        if package is None:
            return Written(None)
        package.close()
        out.close()
        return Written(hidden)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = open_store(self.path)
        for k, made in enumerate(m.made for m in messages if m and m.made):
            store.move(made, f"{at}/part-{k:05d}-{self.job}.zip")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = open_store(self.path)
        for m in messages:
            if m and m.made:
                store.delete_file(m.made)


class _Positioned(io.RawIOBase):
    """A stream that can only be written to, with the place where it is."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def tell(self) -> int:
        return self.at

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)


class Members(DataSource):
    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


#: Sources by the name that ``format`` takes; further ones are added with ``add``.
SOURCES: dict[str, type[DataSource]] = {"members": Members}


def add(source: type[DataSource]) -> None:
    """Adds a source to those that ``register`` makes known; of two with a name the later counts."""
    SOURCES[source.name()] = source


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES.values():
        spark.dataSource.register(source)
