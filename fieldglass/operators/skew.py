"""The slope of a line of text: edges, their votes for lines, and the angle that weighs most."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.operators.lines import weighted_median
from fieldglass.operators.sweep import join_pairs

#: Gradients of weak and strong edges, the steepest angle, the least that is turned.
WEAK, STRONG, STEEPEST, LEAST_TURN = 50, 150, 5.0, 0.3
#: Share of a line's places that hold points.
SOLID = 0.6


def _neighbours(df: DataFrame, of: str, by: str, at: str) -> tuple[Column, Column]:
    """The values before and behind along one axis; the border goes on."""
    w = Window.partitionBy("key", by).orderBy(at)
    return F.coalesce(F.lag(of).over(w), F.col(of)), F.coalesce(F.lead(of).over(w), F.col(of))


def gradients(pixels: DataFrame) -> DataFrame:
    """Slopes of the gray values (key, x, y, gray; every pixel given) over three by three pixels: key, x, y, gx, gy, size."""
    before, behind = _neighbours(pixels, "gray", "y", "x")
    rows = pixels.select("key", "x", "y", (behind - before).alias("dx"), (before + 2 * F.col("gray") + behind).alias("sx"))
    (dx0, dx1), (sx0, sx1) = (_neighbours(rows, c, "x", "y") for c in ("dx", "sx"))
    found = rows.select("key", "x", "y", (dx0 + 2 * F.col("dx") + dx1).alias("gx"), (sx1 - sx0).alias("gy"))
    return found.withColumn("size", F.abs("gx") + F.abs("gy"))


def edges(pixels: DataFrame, weak: int = WEAK, strong: int = STRONG) -> DataFrame:
    """Edge pixels (key, x, y): crests of the gradient that are strong, or weak and connected with strong ones.

    A crest is steeper than its neighbour on the one side of the slope's
    direction (of four) and no less steep than that on the other.
    """
    g = gradients(pixels)
    ax, ay = F.abs("gx"), F.abs("gy")
    flat, steep = ay < ax * math.tan(math.pi / 8), ay > ax * math.tan(3 * math.pi / 8)
    same = F.signum(F.col("gx").cast("double")) == F.signum(F.col("gy").cast("double"))
    g = g.withColumn("ox", F.when(steep, 0).otherwise(1)).withColumn("oy", F.when(flat, 0).when(steep | same, 1).otherwise(-1)).where(F.col("size") > weak)
    there = gradients(pixels).select("key", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("size").alias("other"))
    sides = g.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    met = sides.withColumns({"nx": F.col("x") + F.col("side") * F.col("ox"), "ny": F.col("y") + F.col("side") * F.col("oy")}).join(there, ["key", "nx", "ny"], "left")
    other = F.coalesce("other", F.lit(0))
    holds = F.when(F.col("side") < 0, F.col("size") > other).otherwise(F.col("size") >= other)
    crests = met.groupBy("key", "x", "y", "size").agg(F.bool_and(holds).alias("crest")).where("crest")
    kind = crests.schema["key"].dataType.simpleString()

    def kept(t: pa.Table) -> pa.Table:
        """Crests of components that hold a strong one; a crop, whose size the reader bounds, is one group."""
        x, y, size = (t.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "size"))
        place = {p: i for i, p in enumerate(zip(x.tolist(), y.tolist()))}
        pairs = [(i, j) for (px, py), i in place.items() for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1)) if (j := place.get((px + dx, py + dy))) is not None]
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        root = join_pairs(np.arange(len(x)), a, b)
        good = np.isin(root, root[size > strong])
        return t.select(["key", "x", "y"]).filter(pa.array(good))

    out = crests.select("key", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("size").cast("int").alias("size"))
    return out.groupBy("key").applyInArrow(kept, f"key {kind}, x int, y int")


def line_votes(points: DataFrame, steepest: float = STEEPEST, step: float = 1.0) -> DataFrame:
    """Votes of points (key, x, y) for lines: key, angle (degrees, rising to the lower right), offset, votes, length.

    Each point votes for one line at each angle; votes are added up where they
    are cast first. A line is as long as its points reach along it.
    """
    n = int(steepest / step)
    grid = [(i * step, math.cos(math.radians(i * step)), math.sin(math.radians(i * step))) for i in range(-n, n + 1)]
    angles = F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(c).alias("c"), F.lit(s).alias("s")) for a, c, s in grid])
    cast = points.select("key", "x", "y", F.explode(angles).alias("a")).select("key", "x", "y", "a.*")
    offset = F.floor(F.round(F.col("y") * F.col("c") - F.col("x") * F.col("s"), 9) + 0.5).cast("int")
    along = F.col("x") * F.col("c") + F.col("y") * F.col("s")
    return cast.groupBy("key", "angle", offset.alias("offset")).agg(F.count(F.lit(1)).alias("votes"), (F.max(along) - F.min(along)).alias("length"))


def text_angle(points: DataFrame, widths: DataFrame, steepest: float = STEEPEST, votes: int = 10) -> DataFrame:
    """The angle by which the text of each crop (edge points key, x, y) slopes: key, angle.

    Lines have ``votes`` or an eighth of the crop's width in points (``widths``:
    key, cols), whichever is more, a quarter of it in length, and points at
    0.6 of the places along them; of lines that lie beside each other, in angle or offset, the one with most votes counts
    (the first of equals). The angle at which half of all length is reached
    wins; below 0.3 degrees, and without lines, it is 0.
    """
    lines = line_votes(points, steepest).join(widths, "key")
    lines = lines.where((F.col("votes") >= F.greatest(F.lit(votes), F.floor(F.col("cols") / 8))) & (F.col("length") >= F.col("cols") / 4) & (F.col("votes") >= SOLID * F.col("length")))
    lines = lines.withColumn("turn", F.rint("angle").cast("int")).withColumn("rank", F.struct("votes", (-F.col("angle")).alias("a"), (-F.col("offset")).alias("o")))
    near = lambda c: F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])).alias(c)
    heard = lines.select("key", "rank", near("turn"), "offset").select("key", "rank", "turn", near("offset"))
    most = heard.groupBy("key", "turn", "offset").agg(F.max("rank").alias("most"))
    crests = lines.join(most, ["key", "turn", "offset"]).where("rank = most")
    found = weighted_median(crests, "key", "angle", "length")
    turn = F.when(F.abs("median") >= LEAST_TURN, F.col("median")).otherwise(0.0)
    return widths.select("key").join(found, "key", "left").select("key", F.coalesce(turn, F.lit(0.0)).alias("angle"))


def turned(pixels: DataFrame, angles: DataFrame) -> DataFrame:
    """Crops turned about their middle so that text of that angle (key, angle, cols, rows) lies level: key, x, y, gray.

    A pixel is weighted from the four around its place; beyond the border that goes on.
    """
    a = F.radians(-F.col("angle"))
    cx, cy = F.col("cols") / 2, F.col("rows") / 2
    cells = angles.withColumn("ty", F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.col("cols").cast("int") - 1)))
    dx, dy = F.col("tx") - cx, F.col("ty") - cy
    u, v = F.cos(a) * dx + F.sin(a) * dy + cx, -F.sin(a) * dx + F.cos(a) * dy + cy
    within = lambda c, n: F.least(F.greatest(c, F.lit(0.0)), F.col(n) - 1.0)
    at = cells.select("key", "tx", "ty", "cols", "rows", within(u, "cols").alias("u"), within(v, "rows").alias("v"))
    at = at.withColumns({"ix": F.floor("u").cast("int"), "iy": F.floor("v").cast("int")}).withColumns({"fu": F.col("u") - F.col("ix"), "fv": F.col("v") - F.col("iy")})
    corner = lambda i, j: F.struct(
        F.least(F.col("ix") + i, F.col("cols") - 1).cast("int").alias("x"), F.least(F.col("iy") + j, F.col("rows") - 1).cast("int").alias("y"),
        ((F.col("fu") if i else 1 - F.col("fu")) * (F.col("fv") if j else 1 - F.col("fv"))).alias("weight"))
    asked = at.select("key", "tx", "ty", F.explode(F.array(*[corner(i, j) for j in (0, 1) for i in (0, 1)])).alias("c")).select("key", "tx", "ty", "c.*")
    told = asked.join(pixels.select("key", "x", "y", "gray"), ["key", "x", "y"])
    return told.groupBy("key", F.col("tx").alias("x"), F.col("ty").alias("y")).agg(F.rint(F.round(F.sum(F.col("weight") * F.col("gray")), 6)).cast("int").alias("gray"))
