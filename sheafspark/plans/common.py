"""A register of queries: each is a function and, where SQL says the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Register:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Small rows dealt evenly over the session's shuffle partitions, where what is made of them costs more than reading: a small file of many rows is a few tasks otherwise."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: The strip's white space as DuckDB writes it.
SQL_WHITE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_collapse(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '\n{{2,}}', chr(10), 'g'), '^[{SQL_WHITE}]+', ''), '[{SQL_WHITE}]+$', '')"
