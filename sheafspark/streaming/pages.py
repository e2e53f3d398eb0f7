"""Structured Streaming over texts and files: the batch rules, a micro-batch at a time."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.functions import text as T
from sheafspark.session import shared_dir


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and content of a growing folder of document files (or of one file)."""
    kind = spark.read.parquet(path).schema
    folder, name = (path, None) if not path.endswith(".parquet") or _is_folder(spark, path) else os.path.split(path)
    reader = spark.readStream.schema(kind)
    stream = (reader.option("pathGlobFilter", name) if name else reader).parquet(folder)
    return stream.select("doc_id", T.collapse_newlines(F.col("text")).alias("content"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def file_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """Pages of files as they arrive in a folder; a file that can't be read is a row with its error, and the stream goes on."""
    from sheafspark.sources import formats, packages

    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(path)
    return packages.read(formats.dispatch(rows, "path").filter("error is null"))


def write_json(stream: DataFrame, target: str, checkpoint: str):
    """Appends a stream's rows as JSON lines, once each."""
    return stream.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def drained(spark: SparkSession, stream: DataFrame, schema: str) -> DataFrame:
    """What a stream has now, run to its end into the shared folder and read from there."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/rows")
