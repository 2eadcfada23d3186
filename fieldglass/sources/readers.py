"""Readers of the formats that recordings, catalogs and ground truth come in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "array<int>"
#: The reading record that recognition writes, one JSON object a photo.
READING = f"""titles array<struct<raw:string, raw2:string, conf:double, box:{BOX}>>, w int, h int, turned_by int,
screen_box {BOX}, score_box {BOX}, badge_box {BOX}, rank_box {BOX}, score int, score_margin double, score2 int,
score2_margin double, score_digits string, chart_type string, chart_conf double, level_digits array<int>,
level_scores array<array<double>>"""
#: What a missing key means.
DEFAULTS = {"chart_type": "", "chart_conf": 0.0, "score": -1, "score_margin": 0.0, "score2": -2, "w": 0, "h": 0, "turned_by": 0}
EMPTY = '{"titles":[],"score":-1,"score_margin":0,"score_digits":"","chart_type":"","chart_conf":0,"level_digits":[],"level_scores":[]}'


def reading_of(json: Column) -> Column:
    """A reading struct from its JSON, missing keys filled; unreadable JSON is the empty reading."""
    return F.from_json(F.coalesce(json, F.lit(EMPTY)), READING)


def read_native(rows: DataFrame, key: str = "key", json: str = "native") -> DataFrame:
    """Rows (key, JSON) as columns of the reading record with defaults."""
    flat = rows.select(F.col(key).alias("key"), reading_of(F.col(json)).alias("r")).select("key", "r.*")
    return flat.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})


def box_of(corners: Column) -> Column:
    """A box struct from an array of exactly four numbers, else null."""
    return F.when(F.size(corners) == 4, F.struct(*[corners[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]))


def parse_catalog(texts: DataFrame, text: str = "value") -> DataFrame:
    """Catalog rows (ord, key, name, charts) of JSON objects in their key order.

    Keys with a leading underscore are notes; charts without a level go.
    """
    entry = F.from_json(F.col(text), "map<string,struct<n:string,c:array<array<string>>>>")
    rows = texts.select(entry.alias("m"), F.posexplode(F.json_object_keys(F.col(text))).alias("ord", "key")).where(~F.col("key").startswith("_"))
    chart = lambda c: F.struct(c[0].alias("type"), c[1].cast("int").alias("level"))
    charts = F.transform(F.filter(F.try_element_at("m", F.col("key"))["c"], lambda c: c[1].isNotNull()), chart)
    return rows.select("ord", "key", F.try_element_at("m", F.col("key"))["n"].alias("name"), charts.alias("charts"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return parse_catalog(spark.read.text(path, wholetext=True))


def read_truth_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth lines of five tab-separated columns and more: image, song, score, type, level.

    Blank and ``#`` lines are passed over; numbers count only if all digits;
    the key is the file name without its ending.
    """
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    cells = lines.select(F.split("value", "\t").alias("c")).where(F.size("c") >= 5)
    number = lambda c: F.when(F.trim(c).rlike("^[0-9]{1,9}$"), F.trim(c).cast("int"))
    kind = F.trim(F.col("c")[3])
    chart = F.when(kind == "s", "single").when(kind == "d", "double").when(kind == "h", "halfdouble").when(kind == "c", "coop")
    return cells.select(
        F.regexp_replace(F.regexp_extract(F.trim(F.col("c")[0]), r"([^/]*)$", 1), r"\.[^.]*$", "").alias("key"), F.trim(F.col("c")[1]).alias("song"),
        number(F.col("c")[2]).alias("score"), chart.alias("chart_type"), number(F.col("c")[4]).alias("level"),
    )


def read_truth_json(spark: SparkSession, songs: str, levels: str, scores: str) -> DataFrame:
    """Ground truth of three JSON objects by key: key, song, chart_type, level, scores (array).

    Keys with a leading underscore are notes, and keys without a song go; a
    score is a number or a list of them.
    """
    def entries(path: str, kind: str) -> DataFrame:
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("key", "v"))
        return rows.where(~F.col("key").startswith("_"))

    song = entries(songs, "string").where("v != ''").select("key", F.col("v").alias("song"))
    level = entries(levels, "array<string>").select("key", F.col("v")[0].alias("chart_type"), F.col("v")[1].cast("int").alias("level"))
    score = entries(scores, "string").select("key", F.from_json(F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.concat(F.lit("["), "v", F.lit("]"))), "array<int>").alias("scores"))
    return song.join(level, "key", "left").join(score, "key", "left").select("key", "song", "chart_type", "level", F.coalesce("scores", F.array().cast("array<int>")).alias("scores"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Reference boxes of a JSON list of photos: key, file, cls (name), ord, box, conf."""
    schema = f"array<struct<key:string,file:string,boxes:map<string,array<struct<box:{BOX},conf:double>>>>>"
    photo = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("p")).select("p.*")
    of_class = photo.select("key", "file", F.explode("boxes").alias("cls", "all"))
    return of_class.select("key", "file", "cls", F.posexplode("all").alias("ord", "b")).select("key", "file", "cls", "ord", box_of(F.col("b.box")).alias("box"), "b.conf")


def read_renames(spark: SparkSession, path: str) -> DataFrame:
    """Renamed images: old name to the new name's stem."""
    rows = spark.read.csv(path, header=True)
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return rows.select(stem(F.col("old_image")).alias("old"), stem(F.col("new_image")).alias("key"))


def read_device_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of a device run, a row a photo: key (stem before ``_``), native JSON, ms and fields."""
    schema = "load_ms double, device string, abi string, rows map<string,struct<native:string,ms:double,song:string,level:int,chart_type:string,score:int,raw:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    return rows.select("d.device", "d.load_ms", F.explode("d.rows").alias("stem", "r")).select(F.split("stem", "_")[0].alias("key"), "device", "load_ms", "r.*")


def read_song_dump(spark: SparkSession, path: str) -> DataFrame:
    """A dumped song list: ord, name, charts."""
    schema = "array<struct<song_name:string,charts:array<struct<step_type:string,level:int>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)).alias("ord", "s"))
    return rows.select("ord", F.col("s.song_name").alias("name"), F.transform("s.charts", lambda c: F.struct(c["step_type"].alias("type"), c["level"].alias("level"))).alias("charts"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (blue, green, red bytes), in order of their paths; unreadable ones go."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").orderBy("origin")


def shrink_power(width: Column, height: Column, most: int = 4096) -> Column:
    """The smallest power of two that brings the longer side to at most ``most`` by whole division."""
    side = F.greatest(width, height)
    powers = F.array(*[F.lit(1 << k) for k in range(16)])
    return F.try_element_at(F.filter(powers, lambda p: F.floor(side / p) <= most), F.lit(1))


def detector_size(spark: SparkSession, path: str, fallback: int = 640) -> int:
    """Canvas size that a detector's text graph was made for, from its reshape layers."""
    rows = spark.read.text(path).where(F.col("value").startswith("Reshape"))
    k = rows.select(F.explode(F.regexp_extract_all("value", F.lit(r"\b0=(\d+)"), F.lit(1))).alias("k")).select(F.col("k").cast("long").alias("k"))
    s = k.withColumn("s", F.round(F.sqrt(F.col("k") * 1024 / 21)).cast("long"))
    cells = lambda d: F.pow(F.floor(F.col("s") / d), F.lit(2.0))
    ok = s.where((F.col("s") % 32 == 0) & (cells(8) + cells(16) + cells(32) == F.col("k")))
    return ok.agg(F.max("s").alias("s")).first()["s"] or fallback


def _bank(raw: bytes, magic: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and rows of a bank file; nothing if it is cut short or of another kind."""
    none = np.zeros(0, np.int32), np.zeros((0, dim), np.float32)
    if raw[:4] != magic:
        return none
    head = np.frombuffer(raw[4:12], "<i4")
    if len(head) < 2 or head[1] != dim:
        return none
    k, at, scale, kind = int(head[0]), 12, 1.0, "<f4"
    if magic == b"PIUT":
        if len(raw) < 20:
            return none
        if int(np.frombuffer(raw[12:16], "<i4")[0]):
            kind, scale = "i1", float(np.frombuffer(raw[16:20], "<f4")[0]) / 127
        at = 20
    size = np.dtype(kind).itemsize
    if len(raw) < at + 4 * k + size * k * dim:
        return none
    x = np.frombuffer(raw, kind, k * dim, at + 4 * k).reshape(k, dim).astype(np.float32) * scale
    if kind == "i1":  # rounding moved the rows off length 1
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return np.frombuffer(raw, "<i4", k, at), x


def read_bank(spark: SparkSession, path: str, neighbours: bool = False) -> DataFrame:
    """Template bank (768 values a row, length 1) or neighbour bank (20 values): idx, label, vec."""
    magic, dim = (b"PIUK", 20) if neighbours else (b"PIUT", 768)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                y, x = _bank(raw.as_py(), magic, dim)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(y), dtype=np.int32)), pa.array(y.astype(np.int32)), pa.array(list(x), pa.list_(pa.float32()))],
                    names=["idx", "label", "vec"],
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "idx int, label int, vec array<float>")
