"""Box expressions. A box is a struct with x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), x2.cast("int").alias("x2"), y2.cast("int").alias("y2"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if the union is empty."""
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda q: (q["x2"] - q["x1"]) * (q["y2"] - q["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def turn_back(b: Column, turn: Column, width: Column, height: Column) -> Column:
    """A box of a turned image in the image as it was (1: turned by 90, 2: by 270)."""
    return (
        F.when(turn == 1, box(b["y1"], height - b["x2"], b["y2"], height - b["x1"]))
        .when(turn == 2, box(width - b["y2"], b["x1"], width - b["y1"], b["x2"]))
        .otherwise(box(b["x1"], b["y1"], b["x2"], b["y2"]))
    )


def clamp(b: Column, width: Column, height: Column) -> Column:
    """A box cut to the image."""
    keep = lambda v, hi: F.greatest(F.lit(0), F.least(v, hi))
    return box(keep(b["x1"], width), keep(b["y1"], height), keep(b["x2"], width), keep(b["y2"], height))


def crop(b: Column, width: Column, height: Column, pad: float, pad_x: float | None = None) -> Column:
    """The padded crop of a box within the image; null if nothing is left. Padding truncates."""
    px = ((b["x2"] - b["x1"]) * F.lit(pad if pad_x is None else pad_x).cast("float")).cast("float").cast("int")
    py = ((b["y2"] - b["y1"]) * F.lit(pad).cast("float")).cast("float").cast("int")
    out = clamp(F.struct((b["x1"] - px).alias("x1"), (b["y1"] - py).alias("y1"), (b["x2"] + px).alias("x2"), (b["y2"] + py).alias("y2")), width, height)
    return F.when((out["x2"] > out["x1"]) & (out["y2"] > out["y1"]), out)


def map_back(b: Column, h: Column, half_even: bool = False) -> Column:
    """A box through a 3 x 3 homography (array of 9, row by row): bounds of its corners.

    Halves go away from zero, or to even where asked.
    """
    corner = lambda x, y: F.struct(
        ((h[0] * x + h[1] * y + h[2]) / (h[6] * x + h[7] * y + h[8])).alias("x"),
        ((h[3] * x + h[4] * y + h[5]) / (h[6] * x + h[7] * y + h[8])).alias("y"),
    )
    corners = [corner(b[x], b[y]) for x in ("x1", "x2") for y in ("y1", "y2")]
    nearest = F.rint if half_even else F.round
    return box(*[nearest(f(*[c[a] for c in corners])) for f, a in ((F.least, "x"), (F.least, "y"), (F.greatest, "x"), (F.greatest, "y"))])


def letterbox_decode(cx: Column, cy: Column, w: Column, h: Column, scale: Column, pad_x: Column, pad_y: Column, flip: Column, width: Column, height: Column) -> Column:
    """A detector's centre box on its canvas as an image box: padding, flip and scale undone, truncated, cut."""
    left = (cx - w / 2 - pad_x) / scale
    right = (cx + w / 2 - pad_x) / scale
    x1 = F.when(flip, width - right).otherwise(left)
    x2 = F.when(flip, width - left).otherwise(right)
    raw = box(x1, (cy - h / 2 - pad_y) / scale, x2, (cy + h / 2 - pad_y) / scale)
    return clamp(raw, width, height)


#: Class confidence below which a detection counts as none.
LEAST_CONF = 0.005


def detected(b: Column, conf: Column, least: float = LEAST_CONF) -> Column:
    """Whether a decoded box stays: confident, and two pixels long on both sides."""
    return (conf >= least) & sides_at_least(b)


def sides_at_least(b: Column, least: int = 2) -> Column:
    return (b["x2"] - b["x1"] >= least) & (b["y2"] - b["y1"] >= least)


def class_argmax(scores: Column) -> Column:
    """Struct (cls, conf) of the first highest class score; class 0 with 0 if none is above 0."""
    top = F.array_max(scores)
    return F.when(top > 0, F.struct((F.array_position(scores, top) - 1).cast("int").alias("cls"), top.alias("conf"))).otherwise(
        F.struct(F.lit(0).alias("cls"), F.lit(0.0).alias("conf"))
    )


def zoom_eligible(screen: Column, width: Column, height: Column, share: float = 0.40, least: int = 64) -> Column:
    """Whether a detected screen is so small that a second look pays."""
    w, h = screen["x2"] - screen["x1"], screen["y2"] - screen["y1"]
    return (w * h < share * width * height) & (w >= least) & (h >= least)


def tiny_title(b: Column) -> Column:
    """Whether a title is so low that it is looked at again."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return (h < 24) & (w >= 8) & (h >= 4)


def translate(b: Column, dx: Column, dy: Column) -> Column:
    """A box found in a crop, in the image that the crop was cut from at (dx, dy)."""
    return box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy)


def second_score_box(b: Column) -> Column:
    """A score's box without its upper 15 %, where a caption stands."""
    cut = (F.lit(0.15).cast("float") * (b["y2"] - b["y1"])).cast("float").cast("int")
    return box(b["x1"], b["y1"] + cut, b["x2"], b["y2"])


def title_crop(b: Column, width: Column, height: Column) -> Column:
    """What is looked at again around a tiny title: 0.6 widths and 1 height more on each side; null below 20 x 12."""
    grown = crop(b, width, height, 1.0, 0.6)
    return F.when(tiny_title(b) & (grown["x2"] - grown["x1"] >= 20) & (grown["y2"] - grown["y1"] >= 12), grown)


def taller(found: Column, b: Column, at: Column) -> Column:
    """The title found in a crop, in the image's frame, if it is taller than the first one; else that."""
    moved = translate(found, at["x1"], at["y1"])
    return F.when(found.isNotNull() & (found["y2"] - found["y1"] > b["y2"] - b["y1"]), moved).otherwise(box(b["x1"], b["y1"], b["x2"], b["y2"]))


def in_disc(x: Column, y: Column, width: Column, height: Column, radius: float) -> Column:
    """Whether a pixel lies in the ellipse of this radius within the crop."""
    dx, dy = ((at - (n - 1) / 2) / F.greatest(n / 2, F.lit(1.0)) for at, n in ((x, width), (y, height)))
    return dx * dx + dy * dy <= radius * radius


def order_quad(corners: Column) -> Column:
    """Four corners (array of struct x, y) as top left, top right, bottom right, bottom left."""
    by_y = F.array_sort(corners, lambda a, b: F.when(a["y"] < b["y"], -1).when(a["y"] > b["y"], 1).otherwise(F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0)))
    by_x = lambda part: F.array_sort(part, lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0))
    top, low = by_x(F.slice(by_y, 1, 2)), by_x(F.slice(by_y, 3, 2))
    return F.array(top[0], top[1], low[1], low[0])


def keystone(angle: Column, shift_x: Column, shift_y: Column, width: float, height: float, margin: float = 60.0) -> Column:
    """Corners (8 numbers, from the top left) of a screen that is seen from an angle in degrees: the steeper, the shorter its upper side.

    The screen leaves a margin in its photo and is shifted by shares of the photo's sides.
    """
    inset = F.sin(F.radians(angle.cast("double"))) * 0.5 * width
    dx, dy = shift_x * width, shift_y * height
    left, right, top, low = margin + dx, width - margin + dx, margin + dy, height - margin + dy
    return F.array(left + inset, top, right - inset, top, right, low, left, low)


def plausible_quad(w: Column, h: Column, fill: Column, box_w: Column, box_h: Column) -> Column:
    """Whether a quadrilateral found in a detected box can be a screen: both sizes, filled share and aspect."""
    aspect = w / F.greatest(h, F.lit(1))
    return (box_w >= 40) & (box_h >= 40) & (w >= 60) & (h >= 60) & fill.between(0.30, 1.02) & aspect.between(0.6, 5.0)
