"""Exact duplicates by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import SPACE, by_rows, columns_only, one_of_each, whole, whole_rows, written


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 64,
    hot_groups: int = 5000,
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after each run of ASCII white space has
    become one space. Stages, each of which groups by the full text beside its
    digest, so equal digests of different texts never merge:

    1. within each task, rows with the same digest and text combine (the
       map-side half of the first grouping);
    2. rows of one digest and salt combine. Only digests of more than
       rows / ``hot_groups`` rows have more than one salt, so at most
       ``hot_groups`` digests are broadcast whatever the size of the input;
    3. the salts' winners combine into one winner for a text.

    Then every row learns its winner by digest. Texts travel here only where
    one digest stands for several texts.

    Null text is the empty text. A null id sorts after all others and is kept
    only where its whole group has null ids. Rows repeated with the same id
    and text are counted each, and all carry the same decision. An empty table
    gives an empty result. Other columns are ignored.
    """
    base = columns_only(docs, id_col, text_col).select(
        F.col(f"`{id_col}`").alias("id"), F.regexp_replace(whole(text_col), SPACE, " ").alias("norm")
    )
    full = base.select("id", "norm", digest(F.col("norm")).alias("digest"))
    marks = written(full.select("id", F.col("digest")))
    total = marks.count()
    hot = (
        marks.groupBy("digest").count()
        .where(F.col("count") > max(1000, total // hot_groups))
        .select("digest", F.lit(True).alias("hot"))
    )
    hot = written(hot)  # at most hot_groups rows
    few_hot = F.broadcast(hot)

    salted = full.join(few_hot, "digest", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(0))
    )
    by_salt = salted.groupBy("digest", "salt", "norm").agg(
        F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"), F.max("hot").alias("hot")
    )
    # the text goes on only where salts' winners have yet to be compared
    by_salt = written(by_salt.select("digest", "keep", "n", "hot", F.when(F.col("hot"), F.col("norm")).alias("norm")))
    merged = (
        by_salt.where("hot").groupBy("digest", "norm").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    )
    winners = by_salt.where("hot IS NULL").select("digest", "keep", "n").unionByName(merged.select("digest", "keep", "n"))
    return _told(marks, winners, by_salt.count(), hot, full, id_col)


def _told(marks: DataFrame, winners: DataFrame, most: int, hot: DataFrame, full: DataFrame, id_col: str) -> DataFrame:
    """Each row's winner, of ``most`` at most; digests of several texts are told apart by the text."""
    several = written(winners.groupBy("digest").count().where("count > 1").select("digest"))
    clash = several.limit(1).count() > 0
    lone = winners.select("digest", "keep", "n")
    if clash:
        several = by_rows(several)
        lone = lone.join(several, "digest", "left_anti")
    hot_lone = F.broadcast(lone.join(hot.select("digest"), "digest", "left_semi"))
    cold_lone = lone.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    is_hot = marks.join(F.broadcast(hot), "digest", "left")
    told = (
        is_hot.where("hot").join(hot_lone, "digest")
        .unionByName(is_hot.where("hot IS NULL").join(by_rows(cold_lone, most), "digest"))
        .select("id", "digest", "keep", "n")
    )
    if clash:
        texts = full.join(several, "digest", "left_semi")
        among = texts.groupBy("digest", "norm").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        told = told.unionByName(texts.join(by_rows(among, most), ["digest", "norm"]).select("id", "digest", "keep", "n"))
    return told.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of equal texts, with all its columns.

    That is the one with the smallest id; of rows that repeat the same id and
    text one stays. Null text is the empty text, and a group without any id
    keeps one row. Rows are found again by id and digest, so that other texts
    under the same id keep their own decision. An empty table gives an empty
    one. Columns may have any names.
    """
    keep = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(f"`{id_col}`").alias("keep"), F.col("text_sha256").alias("of"))
    keep = written(keep.groupBy("keep", "of").agg(F.count(F.lit(1)).alias("copies")))
    text = F.regexp_replace(whole(F.col("doc").getField(text_col)), SPACE, " ")
    rows = whole_rows(docs).withColumns({"id": F.col("doc").getField(id_col), "digest": sha256_hex(text)})
    return one_of_each(rows, keep, F.col("id").eqNullSafe(F.col("keep")) & (F.col("digest") == F.col("of")), "id", "digest")
