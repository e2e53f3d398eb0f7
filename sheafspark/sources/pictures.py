"""Bytes of pictures as files that go by their content: the same picture is one file, however often it comes up."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafspark.sources.members import open_store

#: What pictures of a kind begin with (in hexadecimal), and their suffix.
KINDS = (("89504e47", "png"), ("ffd8ff", "jpg"), ("47494638", "gif"), ("424d", "bmp"), ("52494646", "webp"))


def suffix(content: Column) -> Column:
    """By how the bytes begin; "bin" for others."""
    start, out = F.lower(F.hex(F.substring(content, 1, 4))), F.lit("bin")
    for begins, name in reversed(KINDS):
        out = F.when(start.startswith(begins), name).otherwise(out)
    return out


def store(df: DataFrame, content: str, folder: str) -> DataFrame:
    """df without its column of bytes, with file (the SHA-256 of the bytes and a suffix; null for null) and size_bytes; the files are in ``folder`` when this returns.

    Of equal bytes one row is written: rows meet by digest before bytes are. A file is put in place whole under a name that
    only its content says, so a task that runs again writes the same, and files of earlier runs are left as they are.
    """
    rows = df.withColumn("file", F.concat(F.sha2(content, 256), F.lit("."), suffix(F.col(content)))).withColumn("size_bytes", F.octet_length(content).cast("long"))
    own = rows.filter(F.col("file").isNotNull()).select("file", F.col(content).alias("content")).dropDuplicates(["file"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = open_store(folder)
        where.create_dir(at, recursive=True)
        for batch in batches:
            names = batch.column("file").to_pylist()
            there = {f.path.rsplit("/", 1)[-1] for f in where.get_file_info([f"{at}/{n}" for n in names]) if f.is_file}
            for name, content in zip(names, batch.column("content"), strict=True):
                if name not in there:
                    hidden = f"{at}/.{uuid.uuid4().hex}"
                    with where.open_output_stream(hidden) as out:
                        out.write(content.as_buffer())
                    where.move(hidden, f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"n": [len(names)]}, schema=pa.schema([("n", pa.int64())]))

    own.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    return rows.drop(content)
