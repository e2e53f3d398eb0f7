"""Pages of HTML as Markdown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.functions import markup
from sheafspark.operators import batches


@F.pandas_udf("string")
def markdown(source: pd.Series) -> pd.Series:
    return batches.each_once(source, markup.to_markdown).fillna("")


@F.pandas_udf("string")
def title(source: pd.Series) -> pd.Series:
    return source.map(markup.title_of)


def read(pages: DataFrame, key: str, column: str) -> DataFrame:
    """key, page_id (1) and content of each page. Null and empty pages are empty."""
    return batches.by_slices(pages.withColumn("page_no", F.lit(1)), [key, "page_no"], column, lambda x: (markup.to_markdown(x),), "content string")
