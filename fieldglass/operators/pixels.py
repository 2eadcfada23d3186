"""Pictures as rows of pixels: colours, masks, profiles, bands and connected components.

A pixel is a row (key, x, y, b, g, r); a key is one crop, whose size the
reader bounds. Colours, masks and profiles are SQL expressions and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.geometry import in_disc
from fieldglass.operators.lines import longest_run, lower_rank, middle_rank, ranks_of_counts, same_line, score_components


def pixel_rows(images: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of pixels of decoded images (origin, height, width, nChannels, data): key, x, y, b, g, r.

    With ``most``, an image whose longer side is above it is read with a
    stride, the smallest power of two that brings it there by whole division:
    the pixels between never become rows. A last row or column that the stride
    doesn't fill is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for origin, h, w, c, data in zip(*(col.to_pylist() for col in b.columns)):
                step = 1
                while most is not None and max(h, w) // step > most:
                    step *= 2
                a = np.frombuffer(data, np.uint8).reshape(h, w, c)[::step, ::step][: max(1, h // step), : max(1, w // step)]
                a = np.repeat(a, 3, axis=2) if c == 1 else a
                y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
                cols = [pa.array([origin] * x.size), pa.array(x.ravel().astype(np.int32)), pa.array(y.ravel().astype(np.int32))]
                cols += [pa.array(a[:, :, k].ravel().astype(np.int32)) for k in range(3)]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "x", "y", "b", "g", "r"])

    return images.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "key string, x int, y int, b int, g int, r int")


def gray(b: Column, g: Column, r: Column) -> Column:
    return F.round(0.114 * b + 0.587 * g + 0.299 * r).cast("int")


def hsv(b: Column, g: Column, r: Column) -> Column:
    """Struct (hue 0-179, sat 0-255, val 0-255)."""
    high, low = F.greatest(b, g, r), F.least(b, g, r)
    span = (high - low).cast("double")
    sector = F.when(high == r, 60 * (g - b) / span).when(high == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    hue = F.when(span == 0, 0.0).otherwise(F.pmod(sector, F.lit(360.0)))
    return F.struct(
        (F.round(hue / 2) % 180).cast("int").alias("hue"), F.when(high == 0, 0).otherwise(F.round(255 * span / high)).cast("int").alias("sat"), high.alias("val")
    )


def coloured(pixels: DataFrame, sat: int = 80, val: int = 60, radius: float = 0.80, least: int = 20) -> DataFrame:
    """Coloured pixels (key, x, y, hue, sat, val, width, height) of a badge's disc; crops with too few give none."""
    inside = pixels.where(in_disc(F.col("x"), F.col("y"), F.col("width"), F.col("height"), radius) & (F.col("sat") > sat) & (F.col("val") > val))
    return inside.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where(F.col("_n") >= least).drop("_n")


def adaptive_cuts(pixels: DataFrame) -> DataFrame:
    """Saturation and value above which a crop's pixels count, from its own colours: key, sat_cut, val_cut.

    Both have 256 values, so a crop is two histograms of at most so many rows.
    """
    levels = pixels.select("key", F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("v")) for c in ("sat", "val")])).alias("x")).select("key", "x.*")
    counts = levels.groupBy("key", "of", "v").agg(F.count(F.lit(1)).alias("n"))
    sat = ranks_of_counts(counts.where("of = 'sat'"), "key", "v", "n", {"s": middle_rank})
    val = ranks_of_counts(counts.where("of = 'val'"), "key", "v", "n", {"v20": lower_rank(0.20)})
    return sat.join(val, "key").select(
        "key", F.greatest(F.lit(20.0), 0.5 * F.col("s")).alias("sat_cut"), F.greatest(F.lit(40.0), 0.5 * F.col("v20")).alias("val_cut"))


def column_profile(mask: DataFrame) -> DataFrame:
    """Foreground pixels of each column (rows key, x): key, x, n."""
    return mask.groupBy("key", "x").agg(F.count(F.lit(1)).alias("n"))


def component_brightness(labelled: DataFrame) -> DataFrame:
    """Mean gray of each component's pixels (rows key, ord, gray): key, ord, bright."""
    return labelled.groupBy("key", "ord").agg(F.avg("gray").alias("bright"))


def row_profile(pixels: DataFrame) -> DataFrame:
    """Mean of each pixel row, smoothed by 1 4 6 4 1 with mirrored ends: key, y, level."""
    rows = pixels.groupBy("key", "y").agg(F.avg("gray").alias("m"))
    w = Window.partitionBy("key").orderBy("y")
    back = lambda k: F.lag("m", k).over(w)
    ahead = lambda k: F.lead("m", k).over(w)
    one = F.coalesce(back(1), ahead(1), F.col("m")), F.coalesce(ahead(1), back(1), F.col("m"))
    # a mirrored end: the row beyond the first is the second, beyond the last the last but one
    two = F.coalesce(back(2), F.when(back(1).isNotNull(), F.col("m")), ahead(2), F.col("m")), F.coalesce(ahead(2), F.when(ahead(1).isNotNull(), F.col("m")), back(2), F.col("m"))
    return rows.select("key", "y", ((two[0] + 4 * one[0] + 6 * F.col("m") + 4 * one[1] + two[1]) / 16).alias("level"))


def focus_band(pixels: DataFrame) -> DataFrame:
    """The brightest stretch of rows of each crop: key, y0, y1 (exclusive), padded; the whole crop if none stands out."""
    profile = row_profile(pixels)
    stats = profile.groupBy("key").agg(F.min("level").alias("lo"), F.max("level").alias("hi"), F.count(F.lit(1)).alias("rows"))
    marked = profile.join(stats, "key")
    runs = longest_run(marked, F.col("level") >= F.col("lo") + 0.55 * (F.col("hi") - F.col("lo")))
    pad = F.greatest(F.lit(2), (0.18 * F.col("length")).cast("int"))
    out = stats.join(runs, "key", "left")
    keep = (F.col("rows") >= 12) & (F.col("hi") - F.col("lo") >= 12) & (F.col("length") >= 0.25 * F.col("rows"))
    return out.select(
        "key", F.when(keep, F.greatest(F.lit(0), F.col("start") - pad)).otherwise(0).cast("int").alias("y0"),
        F.when(keep, F.least(F.col("rows"), F.col("start") + F.col("length") + pad)).otherwise(F.col("rows")).cast("int").alias("y1"),
    )


def components(mask: DataFrame) -> DataFrame:
    """Connected components (8 neighbours) of mask pixels (key, x, y): key, ord, x, y, w, h, area; with ``gray``, also their mean ``bright``.

    One crop is one group of bounded size. Runs of a row join the runs that
    they touch in the row above.
    """

    def label(t: pa.Table) -> pa.Table:
        x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
        by = np.lexsort((x, y))
        x, y, level = x[by], y[by], t.column("gray").to_numpy()[by].astype(float)
        first = np.flatnonzero(np.r_[True, (np.diff(y) != 0) | (np.diff(x) != 1)])
        runs = [(int(y[a]), int(x[a]), int(x[b - 1])) for a, b in zip(first, np.r_[first[1:], len(x)])]
        sums = np.add.reduceat(level, first).tolist()
        up = list(range(len(runs)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        rows: dict[int, list[int]] = {}
        for i, (row, x0, x1) in enumerate(runs):
            for j in rows.get(row - 1, ()):
                if runs[j][1] <= x1 + 1 and runs[j][2] >= x0 - 1:
                    a, b = top(i), top(j)
                    up[max(a, b)] = min(a, b)
            rows.setdefault(row, []).append(i)
        found: dict[int, list[int]] = {}
        for i, (row, x0, x1) in enumerate(runs):
            c = found.setdefault(top(i), [x0, row, x1, row, 0, 0.0])
            c[:] = [min(c[0], x0), min(c[1], row), max(c[2], x1), max(c[3], row), c[4] + x1 - x0 + 1, c[5] + sums[i]]
        boxes = list(found.values())
        key = t.column("key")[0].as_py()
        ints = lambda v: pa.array(v, pa.int32())
        return pa.table({"key": pa.array([str(key)] * len(boxes)), "ord": ints(list(range(len(boxes)))), "x": ints([c[0] for c in boxes]), "y": ints([c[1] for c in boxes]),
                         "w": ints([c[2] - c[0] + 1 for c in boxes]), "h": ints([c[3] - c[1] + 1 for c in boxes]), "area": ints([c[4] for c in boxes]),
                         "bright": pa.array([c[5] / c[4] for c in boxes], pa.float64())})

    shaded = "gray" in mask.columns
    rows = mask.groupBy(F.col("key").cast("string").alias("key"), "x", "y").agg((F.max("gray") if shaded else F.lit(0)).cast("int").alias("gray"))
    out = rows.groupBy("key").applyInArrow(label, "key string, ord int, x int, y int, w int, h int, area int, bright double")
    return out if shaded else out.drop("bright")


def score_glyphs(mask: DataFrame) -> DataFrame:
    """The digits of a score among mask pixels (key, x, y, gray), from left to right: key, place, x, y, w, h.

    Components that are high, filled, narrow and bright enough, on one line.
    """
    kept = same_line(score_components(components(mask)))
    return kept.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("x", "ord")) - 1).alias("place"), "x", "y", "w", "h")


def photo_measures(pixels: DataFrame) -> DataFrame:
    """Mean gray and share of glaring pixels of each photo (rows with gray and val)."""
    return pixels.groupBy("key").agg(F.avg("gray").alias("mean_gray"), F.avg((F.col("val") > 250).cast("int")).alias("glare_share"))
