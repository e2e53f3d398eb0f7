"""Row operators over text that the built-ins can't say, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.functions import inline as inline_rules
from sheafspark.functions import repetition, tables
from sheafspark.functions import latex as latex_rules
from sheafspark.operators.batches import by_slices, each_once


def mapped(rule):
    """A rule on text as a function of columns, a batch at a time; null stays null."""
    return F.pandas_udf(lambda x: each_once(x, rule), "string")


latex = mapped(latex_rules.omml_to_latex)
clean_table = mapped(tables.clean_table)
even_spans = mapped(tables.modal_colspans)


@F.pandas_udf("struct<markdown string, n_spans int, syntax string>")
def inline(x: pd.Series) -> pd.DataFrame:
    spans = x.fillna("").map(inline_rules.parse_spans)
    return pd.DataFrame({"markdown": spans.map(lambda s: inline_rules.paragraph({"type": "text", "spans": s})), "n_spans": spans.map(len), "syntax": spans.map(inline_rules.syntax_of)})


@F.pandas_udf("string")
def rich(x: pd.Series) -> pd.Series:
    """Marked text of arrays of (text, style, url), blank ends trimmed."""
    return x.map(lambda own: inline_rules.rich_text([(s["text"], s["style"], s["url"]) for s in own], True))


def recognised(style: str):
    from sheafspark.operators.ocr import formatted

    return F.pandas_udf(lambda t, label: pd.Series([formatted(a, b, style) for a, b in zip(t, label, strict=True)]), "string")


@F.pandas_udf("string")
def prompts(x: pd.Series) -> pd.Series:
    from sheafspark.operators.ocr import prompt

    return x.map(prompt)


@F.pandas_udf("string")
def otsl(x: pd.Series) -> pd.Series:
    return x.map(tables.otsl_html)


def truncated(df: DataFrame, keys: list[str], column: str, least: int = 50) -> DataFrame:
    """keys and content: texts of ``least`` characters or more without runaway repetition."""
    truncate = F.pandas_udf(lambda x: x.map(lambda t: repetition.truncate(t, least)), "string")
    return df.select(*keys, truncate(F.col(column)).alias("content"))


def otsl_tables(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.select(*keys, otsl(F.col(column)).alias("html"))


def decoded(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, text and encoding of bytes; null has neither."""
    from sheafspark.sources.packages import decode as one

    return by_slices(df, keys, column, lambda raw: (None, None) if raw is None else one(raw), "text string, encoding string")
