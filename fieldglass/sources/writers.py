"""Writers of readings, metrics, sweeps and labelled sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.text import significant
from fieldglass.sources.readers import EMPTY


def reading_json(reading: Column) -> Column:
    """A reading struct as JSON; null is the empty reading."""
    return F.coalesce(F.to_json(reading), F.lit(EMPTY))


def six_digits(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers as a text with six significant digits would give them back."""
    return df.withColumns({c: significant(F.col(c)) for c in columns})


def box_array(b: Column) -> Column:
    return F.array(b["x1"], b["y1"], b["x2"], b["y2"])


def envelope(result: Column, boxes: Column, load_ms: Column, read_ms: Column, detected: Column) -> Column:
    """The command-line result: reading, boxes, times and whether a detector ran."""
    return F.to_json(F.struct(result.alias("result"), boxes.alias("boxes"), F.struct(load_ms.alias("load"), read_ms.alias("read")).alias("ms"), detected.alias("detected")))


def write_fixture(rows: DataFrame, path: str) -> None:
    """Replay rows (key, native, gt, expected) as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Long metrics (metric, value) as the baseline of later runs."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_sweep(rows: DataFrame, path: str) -> None:
    """A gate sweep as TSV, numbers with four decimals."""
    shown = [F.format_string("%.4f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    rows.select(*shown).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_dataset_tsv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_glyph_sweep(rows: DataFrame, path: str) -> None:
    """Gate candidates of each photo as TSV: readings' fields and margins with four decimals, and the number of glyphs read."""
    glyphs = F.length(F.replace(F.col("raw"), F.lit(" | "), F.lit("")))
    write_sweep(rows.withColumn("glyphs", glyphs), path)


def catalog_json(catalog: DataFrame) -> DataFrame:
    """Catalog rows (ord, key, name, charts) as one JSON object in their order, which the reader takes back.

    A catalog is a closed list of some hundred names; it is one file by its format.
    """
    charts = F.transform("charts", lambda c: F.concat(F.lit('["'), c["type"], F.lit('",'), c["level"].cast("string"), F.lit("]")))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    entry = F.concat(quoted(F.col("key")), F.lit(':{"n":'), quoted(F.col("name")), F.lit(',"c":['), F.array_join(charts, ","), F.lit("]}"))
    rows = catalog.select("ord", entry.alias("e")).agg(F.array_sort(F.collect_list(F.struct("ord", "e"))).alias("all"))
    return rows.select(F.concat(F.lit("{"), F.array_join(F.transform("all", lambda r: r["e"]), ","), F.lit("}")).alias("value"))


def write_catalog(catalog: DataFrame, added: DataFrame, path: str, dry: bool = False) -> int:
    """Writes old rows and, behind them, new ones (ord, key, name, charts) if any were added; returns how many.

    The new catalog is written beside the old one, which then steps aside for
    it and is deleted last, so ``catalog`` may be read from ``path`` and one of
    the two is whole at any time: where ``path`` is missing after a crash, the
    old catalog is at ``path.old`` and the new one at ``path.new``.
    """
    n = added.count()
    if n and not dry:
        last = catalog.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("last"))
        moved = added.join(F.broadcast(last)).select((F.col("ord") + F.col("last")).alias("ord"), "key", "name", "charts")
        catalog_json(catalog.select("ord", "key", "name", "charts").unionByName(moved)).coalesce(1).write.mode("overwrite").text(f"{path}.new")
        hadoop = catalog.sparkSession._jvm.org.apache.hadoop.fs
        old, new, aside = hadoop.Path(path), hadoop.Path(f"{path}.new"), hadoop.Path(f"{path}.old")
        files = old.getFileSystem(catalog.sparkSession._jsc.hadoopConfiguration())
        if files.exists(old):
            files.delete(aside, True)  # left by a run that ended before its last step
            if not files.rename(old, aside):
                raise OSError(f"{path} can't be moved aside")
        if not files.rename(new, old):
            raise OSError(f"{path}.new can't take its place; the old catalog is at {path}.old")
        files.delete(aside, True)
    return n


def details_json(readings: DataFrame, native: DataFrame) -> DataFrame:
    """One JSON row a photo: native reading, its time, the gated values and the raw titles (native: key, native, ms)."""
    values = [F.col(f"{f}.value").alias(f) for f in ("song", "level", "chart_type", "score")]
    rows = native.join(readings, "key", "left")
    return rows.select("key", F.to_json(F.struct(F.parse_json("native").alias("native"), "ms", *values, "raw"), {"ignoreNullFields": "false"}).alias("json"))


def write_details(readings: DataFrame, native: DataFrame, path: str) -> None:
    """Per-photo details as text lines of JSON."""
    details_json(readings, native).select("json").write.mode("overwrite").text(path)


def write_device_results(readings: DataFrame, native: DataFrame, path: str, load_ms: float, device: str, abi: str) -> None:
    """A device run: rows of details with the run's own figures beside each."""
    rows = details_json(readings, native).withColumns({"load_ms": F.lit(load_ms), "device": F.lit(device), "abi": F.lit(abi)})
    rows.write.mode("overwrite").json(path)


def write_dataset(items: DataFrame, path: str, snapshot: str | None = None) -> None:
    """The labelled set as JSON lines; what was there before goes to ``snapshot`` first."""
    spark = items.sparkSession
    if snapshot:
        spark.read.json(path).write.mode("overwrite").json(snapshot)
    items.write.mode("overwrite").json(path)
