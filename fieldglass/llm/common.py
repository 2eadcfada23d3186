"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.work import by_rows, dropped, shared_dir, written  # noqa: F401  (operators take them from here)

#: ASCII white space, as the duplicate operators use it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def held_out(id_col: str) -> Column:
    """True for the quarter of ids that no model learns from (null: learnt from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def columns_only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of any name can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def whole_rows(df: DataFrame) -> DataFrame:
    """Each row as one struct ``doc``, beside which helper columns of any name can't clash; ``doc.*`` undoes it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))


def one_of_each(rows: DataFrame, keep: DataFrame, on: Column, *keys: str) -> DataFrame:
    """Rows (doc, keys) that ``keep`` (with ``copies``, a written table) names, as documents; one of those that repeat.

    Only rows that repeat are shuffled by their keys, with one row a key and
    task, and only if there are any.
    """
    found = rows.join(by_rows(keep), on)
    if keep.where("copies > 1").limit(1).count() == 0:
        return found.select("doc.*")
    again = found.where("copies > 1").groupBy(*keys).agg(F.first("doc").alias("doc")).select("doc")
    return found.where("copies = 1").select("doc").unionByName(again).select("doc.*")
