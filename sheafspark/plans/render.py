"""Blocks to Markdown and to content lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (type, level, content, anchor) with markdown: headings (level 2 without one), items, formulas, captions, HTML as it is."""
    c, kind, level = F.col("content"), F.col("type"), F.col("level")
    anchor = F.when(F.col("anchor").isNotNull(), F.concat(F.lit('<a id="'), F.col("anchor"), F.lit('"></a>\n'))).otherwise("")
    body = (
        F.when(kind == "title", F.concat(F.repeat(F.lit("#"), F.least(F.coalesce(level, F.lit(2)), F.lit(6)).cast("int")), F.lit(" "), c))
        .when(kind == "list_item", F.concat(F.repeat(F.lit("    "), F.coalesce(level, F.lit(0)).cast("int")), F.lit("- "), c))
        .when(kind == "equation", F.concat(F.lit("$$\n"), c, F.lit("\n$$")))
        .when(kind == "image", F.concat(F.lit("![]("), c, F.lit(")")))
        .otherwise(c)
    )
    return blocks.withColumn("markdown", F.concat(anchor, body))


def documents(blocks: DataFrame, doc: list[str], order: str, mode: str = "mm_markdown") -> DataFrame:
    """doc and content: paragraphs with an empty line between. nlp_markdown leaves pictures, tables and charts out."""
    own = blocks if mode == "mm_markdown" else blocks.filter(~F.col("type").isin("image", "table", "chart"))
    rows = F.array_sort(F.collect_list(F.struct(order, "markdown")))
    return markdown_blocks(own).filter(F.length("content") > 0).groupBy(*doc).agg(F.array_join(F.transform(rows, lambda r: r["markdown"]), "\n\n").alias("content"))


def content_list(blocks: DataFrame, doc: list[str], order: str, page: str) -> DataFrame:
    """doc and content_list: a JSON array of each block's type, text, level and page index, in order."""
    item = F.struct("type", F.col("content").alias("text"), F.col("level").alias("text_level"), F.col(page).alias("page_idx"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i"))))
    return blocks.groupBy(*doc).agg(F.to_json(F.transform(rows, lambda r: r["i"])).alias("content_list"))
