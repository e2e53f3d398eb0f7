"""Operators over documents and their pages: lines, digests, numbering, links, joins of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line_no (from 1) and line of each line; a text without line ends is one line, null has none."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("_p", "line")).select(*keys, (F.col("_p") + 1).alias("line_no"), "line")


def line_repetition(df: DataFrame, keys: list[str], text: str, times: int = 10, share: float = 0.8) -> DataFrame:
    """keys, n_lines, top_count (how often the commonest line stands) and whether the text collapses to that line."""
    counts = lines(df, keys, text).groupBy(*keys, "line").agg(F.count("*").alias("_n"))
    own = counts.groupBy(*keys).agg(F.sum("_n").alias("n_lines"), F.max("_n").alias("top_count"))
    return own.withColumn("collapses", (F.col("top_count") >= times) & (F.col("top_count") * 10 >= F.col("n_lines") * int(share * 10)))


def digests(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """keys, md5, sha1 and sha256 of bytes, or of a text's UTF-8."""
    raw = F.col(content) if dict(df.dtypes)[content] == "binary" else F.encode(content, "UTF-8")
    return df.select(*keys, F.md5(raw).alias("md5"), F.sha1(raw).alias("sha1"), F.sha2(raw, 256).alias("sha256"))


def page_ids(df: DataFrame, doc: list[str], order: str, name: str = "page_id") -> DataFrame:
    """df with the place of each page in its document, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*doc).orderBy(order)))


def concatenated(pages: DataFrame, doc: list[str], order: str, content: str) -> DataFrame:
    """doc, content (pages in order, a newline between) and n_pages. A document's pages meet in its one string."""
    own = F.array_sort(F.collect_list(F.struct(order, content)))
    return pages.groupBy(*doc).agg(F.array_join(F.transform(own, lambda p: p[content]), "\n").alias("content"), F.count("*").alias("n_pages"))


def title(html: Column) -> Column:
    """The text of a page's title element."""
    return F.regexp_extract(html, r"(?is)<title\b[^>]*>([^<]*)</title>", 1)


def links(df: DataFrame, keys: list[str], html: str) -> DataFrame:
    """keys, pos (from 0) and href of each link."""
    return df.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


def json_fields(df: DataFrame, keys: list[str], column: str, schema: str) -> DataFrame:
    """keys and the fields of a JSON text; what isn't JSON has nulls."""
    return df.select(*keys, F.from_json(column, schema).alias("_j")).select(*keys, "_j.*")


def listed(spine: DataFrame, manifest: DataFrame, doc: list[str], key: str, order: str) -> DataFrame:
    """Spine items that the manifest has, with page_no: their places without gaps."""
    kept = spine.join(manifest.select(key).distinct(), key, "left_semi")
    return page_ids(kept, doc, order, "page_no")


def unused(parts: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """parts that nothing uses."""
    return parts.join(used.select(key).distinct(), key, "left_anti")


def distinct_texts(df: DataFrame, keys: list[str], text: str, name: str = "texts") -> DataFrame:
    """keys and the distinct texts of each group, sorted."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(text)).alias(name))


def one_kind_after_another(parts: dict[str, DataFrame], columns: dict[str, str]) -> DataFrame:
    """Rows of all kinds with the kind's name; columns: each one's name and type, which every part has by name."""
    own = [p.select(F.lit(kind).alias("kind"), *[F.col(c).cast(t).alias(c) for c, t in columns.items()]) for kind, p in parts.items()]
    out = own[0]
    for p in own[1:]:
        out = out.unionByName(p)
    return out
