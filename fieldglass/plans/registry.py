"""Registration of queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(x: Column) -> Column:
    """Six decimals, halves upwards, as the SQL says it."""
    return F.floor(x * 1e6 + 0.5) / 1e6


#: All columns of a line in an order that settles ties.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ORD_SQL = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)})"


def six_sql(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"
