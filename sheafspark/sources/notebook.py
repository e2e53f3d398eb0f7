"""Notebooks: one page for each cell that isn't empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_content(kind: Column, source: Column) -> Column:
    """Code fenced as python, raw fenced, Markdown as it is, other kinds empty."""
    return F.when(kind == "markdown", source).when(kind == "code", F.concat(F.lit("```python\n"), source, F.lit("\n```"))).when(kind == "raw", F.concat(F.lit("```\n"), source, F.lit("\n```"))).otherwise("")


def read(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, page_id (dense), cell_idx (the cell's place) and content. A source may be a string or a list of strings."""
    cells = F.from_json(F.get_json_object(text, "$.cells"), "array<string>")
    rows = files.select(key, F.posexplode(cells).alias("cell_idx", "cell"))
    listed = F.array_join(F.from_json(F.get_json_object("cell", "$.source"), "array<string>"), "")
    plain = F.get_json_object("cell", "$.source")
    source = F.when(F.substring(F.ltrim(plain), 1, 1) == "[", F.coalesce(listed, plain)).otherwise(plain)
    own = rows.select(key, "cell_idx", F.get_json_object("cell", "$.cell_type").alias("kind"), source.alias("source")).filter(F.length("source") > 0)
    from pyspark.sql import Window

    return own.select(key, F.row_number().over(Window.partitionBy(key).orderBy("cell_idx")).alias("page_id"), "cell_idx", cell_content(F.col("kind"), F.col("source")).alias("content"))
