"""Screens in photos: outlines, hulls, smallest rectangles, quadrilaterals, and pictures gathered under a homography.

Outlines and shapes are a few hundred points a crop; each is worked out from
its own rows. Everything over pixels is joins, windows and groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.geometry import order_quad, plausible_quad
from fieldglass.operators.light import blurred, closed
from fieldglass.operators.lines import histogram, otsu
from fieldglass.operators.segments import homographies

#: Padding of a screen's box, tolerance of a simplified hull (of its length), greatest side of an upright picture.
PAD, TOLERANCE, LONGEST = 0.06, 0.02, 1600

Point = tuple[float, float]
#: Eight neighbours in turn, clockwise on a screen from the right.
_TURN = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def outline(inside: set[tuple[int, int]], start: tuple[int, int]) -> list[tuple[int, int]]:
    """The outer border of the component of ``start``, its first pixel by row and column, followed once round."""
    border, here, back = [start], start, 4  # what lies left of the first pixel is outside
    first = None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            there = (here[0] + _TURN[d][0], here[1] + _TURN[d][1])
            if there in inside:
                break
        else:
            return border  # a lone pixel
        if first is None:
            first = (here, d)
        elif (here, d) == first:
            return border[:-1]
        border.append(there)
        here, back = there, (d + 4) % 8


def enclosed(points: list[Point]) -> float:
    """The area that a closed line of points encloses."""
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def hull(points: list[Point]) -> list[Point]:
    """Corners of the convex hull in turn, from the leftmost (uppermost of those); points between two corners are none."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def chain(run: list[Point]) -> list[Point]:
        kept: list[Point] = []
        for p in run:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) - (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]) <= 0:
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return chain(ordered) + chain(ordered[::-1])


def smallest_rectangle(corners: list[Point]) -> tuple[float, float, float, float, float, list[Point]]:
    """Middle, sides, angle in degrees (of the first side, from 0 below 90) and corners of the smallest rectangle around a hull.

    One of its sides lies on an edge of the hull; the first of equals is taken.
    """
    c = np.array(corners, float)
    best: tuple | None = None
    edges = np.diff(np.concatenate([c, c[:1]]), axis=0) if len(c) > 1 else np.array([[1.0, 0.0]])
    for dx, dy in edges[np.hypot(edges[:, 0], edges[:, 1]) > 0]:
        u = np.array([dx, dy]) / math.hypot(dx, dy)
        v = np.array([-u[1], u[0]])
        a, b = c @ u, c @ v
        size = (a.max() - a.min(), b.max() - b.min())
        if best is None or size[0] * size[1] < best[0] - 1e-9:
            best = (size[0] * size[1], u, v, a.min(), a.max(), b.min(), b.max())
    if best is None:
        best = (0.0, np.array([1.0, 0.0]), np.array([0.0, 1.0]), c[0, 0], c[0, 0], c[0, 1], c[0, 1])
    _, u, v, a0, a1, b0, b1 = best
    middle = u * (a0 + a1) / 2 + v * (b0 + b1) / 2
    four = [tuple((u * a + v * b).tolist()) for a, b in ((a0, b0), (a1, b0), (a1, b1), (a0, b1))]
    return float(middle[0]), float(middle[1]), float(a1 - a0), float(b1 - b0), math.degrees(math.atan2(u[1], u[0])) % 90, four


def simplified(corners: list[Point], tolerance: float) -> list[Point]:
    """A closed line with fewer corners, none of which lies further than ``tolerance`` from it: halves between its farthest corners, cut on."""
    if len(corners) < 3:
        return corners
    away = lambda p, a, b: math.dist(p, a) if a == b else abs((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / math.dist(a, b)
    farthest = lambda i: max(range(len(corners)), key=lambda j: math.dist(corners[i], corners[j]))
    first = farthest(farthest(0))
    ring = corners[first:] + corners[:first] + [corners[first]]
    middle = max(range(len(ring)), key=lambda j: math.dist(ring[0], ring[j]))
    keep, spans = {0, middle}, [(0, middle), (middle, len(ring) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        far = max(range(a + 1, b), key=lambda j: away(ring[j], ring[a], ring[b]))
        if away(ring[far], ring[a], ring[b]) > tolerance:
            keep.add(far)
            spans += [(a, far), (far, b)]
    return [ring[i] for i in sorted(keep)]


_POINTS = "array<struct<x:double,y:double>>"
_POINT = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def _points(p: list[Point]) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in p]


def outlines(mask: DataFrame) -> DataFrame:
    """The outer border (of 8 neighbours) of each crop's mask pixels (key, x, y) that encloses most: key, area, outline.

    The first of equals. A crop, whose size the reader bounds, is one group; a
    component whose rectangle is no larger than the best border isn't followed.
    """
    kind = mask.schema["key"].dataType.simpleString()

    def largest(t: pa.Table) -> pa.Table:
        x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
        left = set(zip(x.tolist(), y.tolist()))
        inside = frozenset(left)
        found: list[tuple[int, tuple[int, int]]] = []
        for start in sorted(inside, key=lambda p: (p[1], p[0])):
            if start not in left:
                continue
            left.discard(start)
            heap, x0, x1, y0, y1 = [start], start[0], start[0], start[1], start[1]
            while heap:
                px, py = heap.pop()
                x0, x1, y0, y1 = min(x0, px), max(x1, px), min(y0, py), max(y1, py)
                for dx, dy in _TURN:
                    if (near := (px + dx, py + dy)) in left:
                        left.discard(near)
                        heap.append(near)
            found.append(((x1 - x0) * (y1 - y0), start))
        best: tuple[float, list] = (-1.0, [])
        for most, start in sorted(found, key=lambda f: -f[0]):
            if most <= best[0]:
                break
            line = outline(inside, start)
            if (area := enclosed(line)) > best[0]:
                best = (area, line)
        return pa.table({"key": t.column("key").slice(0, 1), "area": [best[0]], "outline": pa.array([_points(best[1])], _POINT)})

    return mask.select("key", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).groupBy("key").applyInArrow(largest, f"key {kind}, area double, outline {_POINTS}")


def _each(rows: DataFrame, of: str, schema: str, names: list[str], work: Callable[[list[Point]], dict]) -> DataFrame:
    """``work`` on the points of every row; its columns are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"hull": _POINT, "corners": _POINT}
        for b in batches:
            made = [work([(p["x"], p["y"]) for p in points]) for points in b.column(of).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([m[n] for m in made], kinds.get(n, pa.float64())) for n in names)], names=[*b.schema.names, *names])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), schema]))


def hulls(rows: DataFrame, points: str = "outline") -> DataFrame:
    """Adds ``hull``, the corners of the convex hull of each row's points."""
    return _each(rows, points, f"hull {_POINTS}", ["hull"], lambda p: {"hull": _points(hull(p))})


def rectangles(rows: DataFrame, points: str = "hull") -> DataFrame:
    """Adds the smallest rectangle around each row's hull: cx, cy, side_a, side_b, angle, corners."""
    names = ["cx", "cy", "side_a", "side_b", "angle", "corners"]

    def work(p: list[Point]) -> dict:
        *numbers, four = smallest_rectangle(p) if p else (None, None, None, None, None, [])
        return dict(zip(names, [*numbers, _points(four)]))

    return _each(rows, points, ", ".join(f"{n} {_POINTS if n == 'corners' else 'double'}" for n in names), names, work)


def quads(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``corners``, the four of the hull if it is simple, else those of the smallest rectangle, in order from the top left."""

    def work(p: list[Point]) -> dict:
        length = sum(math.dist(a, b) for a, b in zip(p, p[1:] + p[:1]))
        four = simplified(p, tolerance * length)
        return {"corners": _points(four if len(four) == 4 else smallest_rectangle(p)[-1])}

    return _each(rows, "hull", f"corners {_POINTS}", ["corners"], work).withColumn("corners", order_quad(F.col("corners")))


def tilt(angle: Column) -> Column:
    """Degrees to the nearest axis."""
    return F.least(angle % 90, 90 - angle % 90)


def screen_crop(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels (key, x, y, gray) in the padded boxes (key, x1, y1, x2, y2, width, height of the photo), with the crop's corner and size.

    Boxes or crops below 40 in either direction give none.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    pad = (F.lit(PAD).cast("float") * F.greatest(w, h)).cast("float").cast("int")
    grown = boxes.where((w >= 40) & (h >= 40)).select(
        "key", F.greatest(F.lit(0), F.col("x1") - pad).alias("cx1"), F.greatest(F.lit(0), F.col("y1") - pad).alias("cy1"),
        F.least("width", F.col("x2") + pad).alias("cx2"), F.least("height", F.col("y2") + pad).alias("cy2"), w.alias("box_w"), h.alias("box_h"))
    grown = grown.where("cx2 - cx1 >= 40 AND cy2 - cy1 >= 40")
    inside = pixels.join(grown, "key").where("x >= cx1 AND x < cx2 AND y >= cy1 AND y < cy2")
    return inside.withColumns({"x": F.col("x") - F.col("cx1"), "y": F.col("y") - F.col("cy1")})


def screen_quads(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """The quadrilateral of each photo's screen and the map onto it: key, quad (8 numbers), width, height, h.

    The bright part of the padded box (smoothed, split by variance, closed over
    7 by 7) has an outline, that a hull, and that four corners. Screens that
    aren't plausible, by share, sides or aspect, or whose map can't be inverted,
    give none. ``h`` leads from the upright picture, of at most 1600 a side, to
    the photo.
    """
    crop = screen_crop(pixels, boxes)
    corner = crop.select("key", "cx1", "cy1", "cx2", "cy2", "box_w", "box_h").distinct()
    smooth = blurred(crop.select("key", "x", "y", "gray"))
    split = otsu(histogram(smooth, F.col("gray")))
    cut = smooth.join(split, "key").select("key", "x", "y", F.when(F.col("gray") > F.col("threshold"), 255).otherwise(0).alias("gray"))
    found = quads(hulls(outlines(closed(cut, 7).where("gray > 0").select("key", "x", "y")))).join(corner, "key")
    side = lambda i, j: F.hypot(F.col("corners")[i]["x"] - F.col("corners")[j]["x"], F.col("corners")[i]["y"] - F.col("corners")[j]["y"])
    w, h = F.greatest(side(0, 1), side(3, 2)), F.greatest(side(0, 3), side(1, 2))
    fill = F.col("area") / ((F.col("cx2") - F.col("cx1")) * (F.col("cy2") - F.col("cy1")))
    found = found.withColumns({"w": w, "h": h, "fill": fill}).where(plausible_quad(F.col("w"), F.col("h"), F.col("fill"), F.col("box_w"), F.col("box_h")))
    upright = lambda n: F.floor(F.least(F.col(n), F.lit(float(LONGEST)))).cast("double")
    moved = F.flatten(F.transform("corners", lambda p: F.array(p["x"] + F.col("cx1"), p["y"] + F.col("cy1"))))
    flat = found.select("key", moved.alias("quad"), upright("w").alias("width"), upright("h").alias("height"))
    return homographies(flat).where("h IS NOT NULL")


def warped(pixels: DataFrame, maps: DataFrame) -> DataFrame:
    """Pictures gathered under a map: key, x, y, gray, for each pixel of (key, width, height, h).

    ``h`` (9 numbers, by row) leads from a target pixel to a place in the
    picture, whose four pixels around are weighted; what lies outside is 0.
    """
    cells = maps.select("key", "h", F.col("width").cast("int").alias("width"), F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1)).alias("ty"))
    cells = cells.select("key", "h", "ty", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("tx"))
    row = lambda i: F.col("h")[3 * i] * F.col("tx") + F.col("h")[3 * i + 1] * F.col("ty") + F.col("h")[3 * i + 2]
    cells = cells.select("key", "tx", "ty", F.try_divide(row(0), row(2)).alias("u"), F.try_divide(row(1), row(2)).alias("v"))
    at = cells.select("key", "tx", "ty", F.floor("u").cast("int").alias("ix"), F.floor("v").cast("int").alias("iy"), (F.col("u") - F.floor("u")).alias("fu"), (F.col("v") - F.floor("v")).alias("fv"))
    corner = lambda dx, dy: F.struct(
        (F.col("ix") + dx).alias("x"), (F.col("iy") + dy).alias("y"), ((F.col("fu") if dx else 1 - F.col("fu")) * (F.col("fv") if dy else 1 - F.col("fv"))).alias("weight"))
    asked = at.select("key", "tx", "ty", F.explode(F.array(*[corner(dx, dy) for dy in (0, 1) for dx in (0, 1)])).alias("c")).select("key", "tx", "ty", "c.*")
    told = asked.join(pixels.select("key", "x", "y", "gray"), ["key", "x", "y"], "left")
    value = F.rint(F.round(F.sum(F.col("weight") * F.coalesce("gray", F.lit(0))), 6))
    return told.groupBy("key", F.col("tx").alias("x"), F.col("ty").alias("y")).agg(F.coalesce(value, F.lit(0.0)).cast("int").alias("gray"))


def screen_tilts(pixels: DataFrame, least: float = 0.2) -> DataFrame:
    """Degrees by which each screen's crop (key, x, y, gray) is turned: key, tilt; 0 where its bright part encloses no more than ``least`` of it."""
    split = otsu(histogram(pixels, F.col("gray")))
    size = pixels.groupBy("key").agg(((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("all"))
    bright = pixels.join(split, "key").where("gray > threshold").select("key", "x", "y")
    found = rectangles(hulls(outlines(bright))).join(size, "key")
    measured = found.select("key", F.when(F.col("area") > least * F.col("all"), tilt(F.col("angle"))).otherwise(0.0).alias("tilt"))
    return size.select("key").join(measured, "key", "left").select("key", F.coalesce("tilt", F.lit(0.0)).alias("tilt"))
