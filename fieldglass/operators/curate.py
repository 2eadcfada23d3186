"""Keeping the catalog and the labelled set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.geometry import keystone
from fieldglass.functions.text import clean_name, normalize_key
from fieldglass.work import written


#: Width and height of a synthetic photo, and of the flat screen that it shows.
PHOTO, SCREEN = (1600.0, 1000.0), (1280.0, 720.0)


def catalog_upsert(catalog: DataFrame, batch: DataFrame) -> DataFrame:
    """New catalog rows of a batch (ord, name, charts): those whose key the catalog lacks.

    The first row of a key with charts counts; rows without charts are passed
    over and don't block a later one. Existing rows (key) are never touched.
    """
    named = batch.withColumn("name", clean_name(F.col("name"))).withColumn("key", normalize_key(F.col("name")))
    named = named.where((F.col("key") != "") & (F.size(F.coalesce("charts", F.array())) > 0))
    first = named.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("ord"))).where("_r = 1").drop("_r")
    return first.join(catalog.select("key"), "key", "left_anti")


def match_status(same: Column, score: Column) -> Column:
    """exact where the normal forms are equal, fuzzy from 0.55, else none."""
    return F.when(F.coalesce(same, F.lit(False)), "exact").when(F.coalesce(score, F.lit(0.0)) >= 0.55, "fuzzy").otherwise("none")


def mismatch(match_name: Column, song: Column) -> Column:
    """Whether a catalog match is there and reads otherwise than the song."""
    return match_name.isNotNull() & (F.lower(F.trim(match_name)) != F.lower(F.trim(F.coalesce(song, F.lit("")))))


def chart_validity(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items (key, names in order of trust, type, level) as ok, bad or unknown against the catalog (name, charts)."""
    tried = items.select("key", "type", "level", F.posexplode("names").alias("place", "name"))
    found = tried.join(catalog.select("name", "charts"), "name", "left")
    first = found.where("charts IS NOT NULL").groupBy("key").agg(F.min(F.struct("place", "charts")).alias("at"))
    out = items.join(first, "key", "left")
    fits = F.exists("at.charts", lambda c: (c["type"] == F.col("type")) & (c["level"] == F.col("level")))
    return out.select("key", F.when(F.col("at").isNull(), "unknown").when(fits, "ok").otherwise("bad").alias("validity"))


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their place ``_i`` in an order, from 0; sorted by ranges, so that no task holds the whole list.

    A row knows its place in its range when the sorted rows are written; with
    one count a range, that gives its place among all.
    """
    at = F.monotonically_increasing_id()
    sorted_ = written(df.orderBy(*order).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.shiftright(at, 33).alias("_range"), at.bitwiseAND((1 << 33) - 1).alias("_at")))
    counts = sorted_.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    return sorted_.join(F.broadcast(before), "_range").select("_row.*", (F.col("_before") + F.col("_at")).alias("_i"))


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two lists of the same length side by side, by position."""
    if left.count() != right.count():
        raise ValueError("the lists differ in length")
    return _numbered(left, left_order).join(_numbered(right, right_order), "_i").drop("_i")


#: The validator's views of the labelled set.
VIEWS = {
    "all": "true", "pending": "NOT coalesce(validated, false)", "done": "coalesce(validated, false)",
    "suspect": "match_status = 'none' OR mismatch",
}


def view(items: DataFrame, name: str) -> DataFrame:
    return items.where(VIEWS[name])


def final_rows(items: DataFrame) -> DataFrame:
    """The exported row of each item: corrected values before read ones, validated as 1 or 0."""
    return items.select(
        "file", F.coalesce("song_final", "song_ocr", F.lit("")).alias("song"), F.coalesce("score_final", "score_ocr").alias("score"),
        F.coalesce("chart_final", F.lit("")).alias("chart"), F.col("level_final").alias("level"),
        F.when(F.coalesce("validated", F.lit(False)), 1).otherwise(0).alias("validated"),
    )


def progress(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if("validated").alias("done"), F.count(F.lit(1)).alias("total"))


def synthetic_cases(songs: DataFrame, seed: int = 7) -> DataFrame:
    """Every song under each of 4 angles, 3 brightnesses, and with and without glare, shifted by hashes.

    Adds ``jitter`` and ``jitter_y``, at most 2 % of a photo's sides, ``inset``,
    the share of its width by which the upper side is shorter at either end,
    and ``quad``, the screen's corners in a photo of 1600 by 1000.
    """
    spark = songs.sparkSession
    angles = spark.createDataFrame([(a,) for a in (0, 10, 20, 30)], "angle int")
    lights = spark.createDataFrame([(b,) for b in (0.4, 0.7, 1.0)], "brightness double")
    glares = spark.createDataFrame([(False,), (True,)], "glare boolean")
    grid = F.broadcast(angles.join(lights).join(glares))  # 24 rows
    shift = lambda n: F.pmod(F.xxhash64(F.col("song"), F.col("angle"), F.col("brightness"), F.col("glare"), F.lit(n)), F.lit(4001)) / 100000 - 0.02
    cases = songs.join(grid).withColumns({"jitter": shift(seed), "jitter_y": shift(seed + 1), "inset": F.sin(F.radians(F.col("angle").cast("double"))) * 0.5})
    return cases.withColumn("quad", keystone(F.col("angle"), F.col("jitter"), F.col("jitter_y"), *PHOTO))


def status_counts(items: DataFrame) -> DataFrame:
    """How many items have each match status: match_status, n."""
    return items.groupBy("match_status").agg(F.count(F.lit(1)).alias("n"))
