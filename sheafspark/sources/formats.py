"""File kinds: suffixes to categories, data-URI prefixes to suffixes, and dispatch by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of each category.
CATEGORIES = {
    "text": ["txt"], "markdown": ["md", "rst"], "html": ["html", "htm"], "csv": ["csv", "tsv"], "ipynb": ["ipynb"], "email": ["eml"], "epub": ["epub"],
    "pdf": ["pdf"], "docx": ["docx"], "pptx": ["pptx"], "xlsx": ["xlsx", "xlsm"], "image": ["jpg", "jpeg", "png", "bmp", "webp"],
}
#: Media types in order; of several with the same the first counts.
MIMES = [("text/csv", "tsv"), ("text/csv", "csv"), ("text/html", "htm"), ("text/html", "html"), ("text/plain", "txt"), ("application/pdf", "pdf"), ("application/json", "ipynb")]
#: Categories whose files are texts in an encoding that has to be found.
TEXTUAL = ("text", "markdown", "html", "csv")


def kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, c) for c, own in CATEGORIES.items() for s in own], "suffix string, category string")


def needs_encoding(category: Column) -> Column:
    """Whether files of a category are texts in an encoding that has to be found."""
    return F.coalesce(category.isin(*TEXTUAL), F.lit(False))


def dispatch(files: DataFrame, path: str) -> DataFrame:
    """files with suffix, category and, for a suffix that isn't known, error 415."""
    named = files.withColumn("suffix", F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))
    known = named.join(F.broadcast(kinds(files.sparkSession)), "suffix", "left")
    return known.withColumn("error", F.when(F.col("category").isNull(), 415))


def resolve_mime(rows: DataFrame, uri: str, keys: list[str]) -> DataFrame:
    """keys and the suffix of the first media type that a data URI begins with; null where none does."""
    spark = rows.sparkSession
    types = spark.createDataFrame([(m, s, i) for i, (m, s) in enumerate(MIMES)], "mime string, suffix string, o int")
    hits = rows.join(F.broadcast(types), F.col(uri).startswith(F.concat(F.lit("data:"), F.col("mime"))), "left")
    return hits.groupBy(*keys).agg(F.min_by("suffix", "o").alias("suffix"))


def scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, name, suffix, category, size_bytes, content of files; unknown kinds are dropped before bytes are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    named = rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), "content")
    return dispatch(named, "path").filter("error is null").drop("error")
