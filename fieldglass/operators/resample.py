"""Rows of pixels resampled by taps, and glyphs as vectors of a fixed size.

A tap says how much of a source column (or row) goes to a target column (or
row). Both axes are independent, so a target pixel is the sum over the taps of
its column and its row: two joins and a grouping, whatever the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed size of a glyph's vector.
GLYPH_W, GLYPH_H = 24, 32
#: Fixed value: the slope of the cubic kernel.
CUBIC = -0.75


def _area(n: Column, m: Column, at: Column, both: Column) -> Column:
    """Taps (src, weight) of a target cell ``at`` of ``m``, over ``n`` source cells; weights in units of 1 / n.

    The share of the target cell that each source cell covers. Where an image
    shrinks in one direction only (``both`` is false), that direction takes
    two cells: the one in which the target cell begins, and for what reaches
    beyond it the next.
    """
    first = F.floor(at * n / m).cast("int")
    last = (F.ceil((at + 1) * n / m) - 1).cast("int")
    share = lambda s: F.least((at + 1) * n, (s + 1) * m) - F.greatest(at * n, s * m)
    covered = F.transform(F.sequence(first, F.least(last, n - 1)), lambda s: F.struct(s.alias("src"), share(s).cast("double").alias("weight")))
    beyond = (at + 1) * n - (first + 1) * m
    part = F.when(beyond <= 0, F.lit(0)).otherwise(beyond % n)
    two = F.array(F.struct(first.alias("src"), (n - part).cast("double").alias("weight")), F.struct(F.least(first + 1, n - 1).alias("src"), part.cast("double").alias("weight")))
    return F.when(both | (m >= n), covered).otherwise(two)


def _cubic(n: Column, m: Column, at: Column) -> Column:
    """Four taps (src, weight) around the target cell's middle; weights in units of 1 / n, and the border goes on."""
    middle = (at + 0.5) * n / m - 0.5
    base = F.floor(middle)
    t = middle - base
    a = F.lit(CUBIC)
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    weights = (far(t + 1), near(t), near(1 - t))
    weights = (*weights, 1 - weights[0] - weights[1] - weights[2])
    src = lambda k: F.greatest(F.lit(0), F.least(n - 1, (base + k).cast("int")))
    return F.array(*[F.struct(src(k - 1).alias("src"), (w * n).alias("weight")) for k, w in enumerate(weights)])


def _summed(kind: str, n: Column, m: Column, at: Column, both: Column) -> Column:
    return _cubic(n, m, at) if kind == "cubic" else _area(n, m, at, both)


def _taps(sizes: DataFrame, keys: list[str], kind: str, n: str, m: str, names: tuple[str, str, str]) -> DataFrame:
    """Rows (keys, dst, src, weight) of one axis; taps of one source cell become one."""
    both = (F.col("width") >= F.col("to_width")) & (F.col("height") >= F.col("to_height"))
    dst, src, weight = names
    cells = sizes.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
    cells = cells.select(*keys, F.col("_at").alias(dst), F.explode(_summed(kind, F.col(n), F.col(m), F.col("_at"), both)).alias("t"))
    return cells.select(*keys, dst, F.col("t.src").alias(src), F.col("t.weight").alias(weight)).where(F.col(weight) != 0)


def resampled(pixels: DataFrame, sizes: DataFrame, kind: str = "area") -> DataFrame:
    """Crops of another size: key, x, y, gray.

    ``pixels`` are (key, x, y, gray) from 0 on, every one given; ``sizes`` are
    (key, width, height, to_width, to_height), a row a crop. ``kind`` is
    ``area`` (the mean of what a target pixel covers, halves to even) or
    ``cubic`` (four by four pixels around it, halves upwards, 0 to 255).
    """
    xs = _taps(sizes, ["key"], kind, "width", "to_width", ("tx", "x", "wx"))
    ys = _taps(sizes, ["key"], kind, "height", "to_height", ("ty", "y", "wy"))
    parts = pixels.select("key", "x", "y", "gray").join(xs, ["key", "x"])
    # columns first: a target column has one sum for each source row, so the rows' taps meet fewer pixels
    rows = parts.groupBy("key", "tx", "y").agg(F.sum(F.col("gray") * F.col("wx")).alias("v"))
    done = rows.join(ys, ["key", "y"]).groupBy("key", "tx", "ty").agg(F.sum(F.col("v") * F.col("wy")).alias("v"))
    done = done.join(sizes.select("key", (F.col("width") * F.col("height")).alias("_of")), "key")
    value = F.col("v") / F.col("_of")
    value = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(value + 0.5))) if kind == "cubic" else F.rint(value)
    return done.select("key", F.col("tx").alias("x"), F.col("ty").alias("y"), value.cast("int").alias("gray"))


def working_scale(height: Column, target: int = 160, least: float = 0.15, most: float = 3.0) -> Column:
    """The factor that brings a title to its working height, in single precision; 1 where it hardly differs."""
    f = (F.lit(float(target)).cast("float") / F.greatest(height, F.lit(1)).cast("float")).cast("float")
    f = F.least(F.greatest(f, F.lit(least).cast("float")), F.lit(most).cast("float"))
    return F.when(F.abs(f - F.lit(1.0).cast("float")) > F.lit(0.02).cast("float"), f).otherwise(F.lit(1.0).cast("float"))


def _half_even(x: Column) -> Column:
    return F.rint(x).cast("int")


def glyph_vectors(boxes: DataFrame, mask: DataFrame, keys: list[str], in_line: bool = False) -> DataFrame:
    """Glyphs (keys, x, y, w, h, any further columns) cut out of mask pixels (keys but the last, x, y) as vectors: ``vec``, 768 numbers.

    A glyph keeps its aspect, is 32 high (at most 24 wide) and stands in the
    middle; a target pixel is 255 times the share of it that the mask covers,
    halves to even. With ``in_line`` glyphs keep their height and their place
    in the line, the rectangle around all glyphs that share all keys but the last.
    The last of ``keys`` tells the glyphs of a mask apart; all foreground
    pixels in a glyph's rectangle count, whatever component they belong to. A
    glyph without any is a vector of zeros. All joins are by shuffle: taps are
    exploded and glyphs compress well, so that Spark takes both to be small.
    """
    shared = keys[:-1]
    lone = boxes.withColumns({"width": F.col("w").cast("int"), "height": F.col("h").cast("int")})
    if in_line:
        top, low = F.min("y").over(_by(shared)), F.max(F.col("y") + F.col("h")).over(_by(shared))
        lone = lone.withColumn("_top", top).withColumn("_line", F.greatest(F.lit(1), low - top))
        lone = lone.withColumn("to_height", F.greatest(F.lit(1), _half_even(F.lit(float(GLYPH_H)) * F.col("h") / F.col("_line"))))
        lone = lone.withColumn("to_width", F.greatest(F.lit(1), F.least(F.lit(GLYPH_W), _half_even(F.col("to_height").cast("double") * F.col("w") / F.greatest(F.col("h"), F.lit(1))))))
        down = F.greatest(F.lit(0), F.least(F.lit(GLYPH_H) - F.col("to_height"), _half_even(F.lit(float(GLYPH_H)) * (F.col("y") - F.col("_top")) / F.col("_line"))))
        lone = lone.withColumn("_down", down).drop("_top", "_line")
    else:
        aspect = (F.col("w").cast("float") / F.greatest(F.col("h"), F.lit(1)).cast("float")).cast("float")
        lone = lone.withColumn("to_height", F.lit(GLYPH_H)).withColumn("_down", F.lit(0))
        lone = lone.withColumn("to_width", F.greatest(F.lit(1), F.least(F.lit(GLYPH_W), _half_even(F.lit(float(GLYPH_H)) * aspect.cast("double")))))
    lone = lone.withColumn("_right", F.floor((F.lit(GLYPH_W) - F.col("to_width")) / 2).cast("int"))

    inside = mask.select(*shared, F.col("x").alias("px"), F.col("y").alias("py")).join(lone.select(*keys, "x", "y", "w", "h").hint("merge"), shared)
    inside = inside.where((F.col("px") >= F.col("x")) & (F.col("px") < F.col("x") + F.col("w")) & (F.col("py") >= F.col("y")) & (F.col("py") < F.col("y") + F.col("h")))
    inside = inside.select(*keys, (F.col("px") - F.col("x")).cast("int").alias("sx"), (F.col("py") - F.col("y")).cast("int").alias("sy"))
    xs = _taps(lone, [*keys, "_right"], "area", "width", "to_width", ("tx", "sx", "wx"))
    ys = _taps(lone, [*keys, "_down"], "area", "height", "to_height", ("ty", "sy", "wy"))
    # one row of 24 sums for each source row of a glyph, then one for each target row
    cells = [F.sum(F.when(F.col("tx") + F.col("_right") == i, F.col("wx")).otherwise(0.0)) for i in range(GLYPH_W)]
    rows = inside.join(xs.hint("merge"), [*keys, "sx"]).groupBy(*keys, "sy").agg(F.array(*cells).alias("cells"))
    spread = [F.sum(F.col("cells")[i] * F.col("wy")) for i in range(GLYPH_W)]
    rows = rows.join(ys.hint("merge"), [*keys, "sy"]).groupBy(*keys, (F.col("ty") + F.col("_down")).alias("row")).agg(F.array(*spread).alias("cells"))
    drawn = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("row", "cells"))).alias("_rows"))
    none = F.array_repeat(F.lit(0.0), GLYPH_W)
    area = (F.col("w") * F.col("h")).cast("double")
    vec = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(GLYPH_H - 1)), lambda r: F.coalesce(F.try_element_at("_rows", r), none)))
    out = lone.drop("width", "height", "to_width", "to_height", "_right", "_down").join(drawn.hint("merge"), keys, "left")
    return out.withColumn("vec", F.transform(vec, lambda v: F.rint(v * 255 / area))).drop("_rows")


def _by(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)
