"""Pictures made even: opening, closing, top-hat, local equalisation and local thresholds.

Pixels are rows (key, x, y, gray), of which every one of a crop is given.
Neighbourhoods are frames over one axis, then over the other; what lies beyond
the border doesn't count for minima and maxima, and repeats the border for
weighted sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of local equalisation: tiles each way, and how far a bin may rise above an even histogram.
TILES, CLIP = 8, 2.0


def _over(df: DataFrame, of: str, by: str, at: str, reach: int, least: bool) -> Column:
    frame = Window.partitionBy("key", by).orderBy(at).rangeBetween(-reach, reach)
    return (F.min if least else F.max)(of).over(frame)


def _boxed(pixels: DataFrame, size: int, least: bool) -> DataFrame:
    """Least or greatest gray value in a square around each pixel: a frame over x, then one over y."""
    reach = size // 2
    rows = pixels.withColumn("gray", _over(pixels, "gray", "y", "x", reach, least))
    return rows.withColumn("gray", _over(rows, "gray", "x", "y", reach, least))


def opened(pixels: DataFrame, size: int = 3) -> DataFrame:
    """Pixels without bright spots narrower than a square of ``size`` (odd): the greatest of the least values around."""
    return _boxed(_boxed(pixels, size, True), size, False)


def closed(pixels: DataFrame, size: int = 7) -> DataFrame:
    """Pixels without dark spots narrower than a square of ``size`` (odd): the least of the greatest values around."""
    return _boxed(_boxed(pixels, size, False), size, True)


def ellipse_spans(size: int) -> list[int]:
    """How far an ellipse of ``size`` (odd) reaches to either side in each of its rows, from the top."""
    r = size // 2
    return [round(r * math.sqrt((r * r - d * d) / (r * r))) if r else 0 for d in range(-r, r + 1)]


def _elliptic(pixels: DataFrame, size: int, least: bool) -> DataFrame:
    """Least or greatest gray value in an ellipse: one frame over x for each width, then the rows of the ellipse over y."""
    spans = ellipse_spans(size)
    reach = size // 2
    widths = sorted(set(spans))
    rows = pixels.select("key", "x", "y", "gray", *[_over(pixels, "gray", "y", "x", s, least).alias(f"_s{s}") for s in widths])
    down = Window.partitionBy("key", "x").orderBy("y")
    # rows of equal width lie in one stretch for each half; what the wider rows cover is asked of them alone
    stretches = {s: [d - reach for d, w in enumerate(spans) if w == s] for s in widths}
    asked = []
    for s, places in stretches.items():
        groups: list[list[int]] = []
        for d in places:
            if groups and d == groups[-1][1] + 1:
                groups[-1][1] = d
            else:
                groups.append([d, d])
        asked += [(F.min if least else F.max)(f"_s{s}").over(down.rangeBetween(a, b)) for a, b in groups]
    best = (F.least if least else F.greatest)(*asked) if len(asked) > 1 else asked[0]
    return rows.select("key", "x", "y", best.alias("gray"))


def top_hat(pixels: DataFrame, size: int) -> DataFrame:
    """What an opening by an ellipse of ``size`` (odd) takes away: letters on a band that shades off."""
    low = _elliptic(_elliptic(pixels, size, True), size, False).select("key", "x", "y", F.col("gray").alias("_low"))
    return pixels.join(low, ["key", "x", "y"]).select("key", "x", "y", (F.col("gray") - F.col("_low")).alias("gray"))


def title_hat_size(rows: int) -> int:
    """The top-hat's size for a title of so many rows: 0.55 of them (halves to even), odd, 3 at least."""
    return max(3, round(0.55 * rows) | 1)


def _tile_tables(pixels: DataFrame, sizes: DataFrame, tiles: int, clip: float) -> DataFrame:
    """Lookup tables of each tile: key, ty, tx, table (256 gray values).

    A tile's histogram is cut at a limit; what lies above is handed round, an
    equal part to every bin and the rest to bins at even steps from 0 on. Its
    running sums are the table. A crop that the tiles don't divide is mirrored beyond its right and
    lower border.
    """
    even = (F.col("width") % tiles == 0) & (F.col("height") % tiles == 0)
    grown = lambda n: F.when(even, F.col(n)).otherwise(F.col(n) + tiles - F.col(n) % tiles).cast("int")
    sized = sizes.select("key", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")).withColumns({"_w": grown("width"), "_h": grown("height")})
    here = pixels.select("key", "x", "y", "gray").join(sized, "key")

    def images(at: str, n: str, full: str) -> Column:
        """Places of a pixel in the grown crop: its own, and its mirror images beyond the border."""
        period = F.greatest(2 * (F.col(n) - 1), F.lit(1))
        source = lambda g: F.when(g % period < F.col(n), g % period).otherwise(period - g % period)
        beyond = F.filter(F.sequence(F.col(n), F.col(full) - 1), lambda g: source(g) == F.col(at))
        return F.when(F.col(full) > F.col(n), F.concat(F.array(F.col(at)), beyond)).otherwise(F.array(F.col(at)))

    spread = here.withColumn("gx", F.explode(images("x", "width", "_w"))).withColumn("gy", F.explode(images("y", "height", "_h")))
    tile = lambda at, full: F.floor(F.col(at) * tiles / F.col(full)).cast("int")
    area = (F.col("_w") / tiles) * (F.col("_h") / tiles)
    counts = spread.groupBy("key", tile("gy", "_h").alias("ty"), tile("gx", "_w").alias("tx"), "gray").agg(F.count(F.lit(1)).alias("n"), F.first(area).alias("area"))
    by_tile = counts.groupBy("key", "ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("gray", "n"))).alias("h"), F.first("area").alias("area"))
    limit = F.greatest(F.lit(1), F.floor(F.lit(clip) * F.col("area") / 256)).cast("long")
    full = by_tile.withColumn("limit", limit).withColumn("h", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.coalesce(F.try_element_at("h", v), F.lit(0)).cast("long")))
    over = F.aggregate("h", F.lit(0).cast("long"), lambda a, n: a + F.greatest(n - F.col("limit"), F.lit(0)))
    full = full.withColumn("over", over).withColumn("each", F.floor(F.col("over") / 256)).withColumn("rest", F.col("over") % 256)
    step = F.greatest(F.floor(F.lit(256) / F.greatest(F.col("rest"), F.lit(1))), F.lit(1))
    full = full.withColumn("step", step)
    given = lambda i: F.when((i % F.col("step") == 0) & (F.floor(i / F.col("step")) < F.col("rest")), 1).otherwise(0)
    full = full.withColumn("h", F.transform("h", lambda n, i: F.least(n, F.col("limit")) + F.col("each") + given(i)))
    scale = (F.lit(255.0).cast("float") / F.col("area").cast("float")).cast("float")
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("table"))
    value = lambda s: F.least(F.lit(255), F.rint((s.cast("float") * scale).cast("float")).cast("int"))
    run = F.aggregate("h", start, lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.concat(a["table"], F.array(value(a["sum"] + n))).alias("table")), lambda a: a["table"])
    return full.select("key", "ty", "tx", run.alias("table")).join(sized.select("key", "_w", "_h"), "key")


def equalised(pixels: DataFrame, sizes: DataFrame, tiles: int = TILES, clip: float = CLIP) -> DataFrame:
    """Crops with their contrast made even, tile by tile: key, x, y, gray.

    ``sizes`` are (key, width, height). Every pixel is looked up in the tables
    of the four tiles whose middles surround it, and weighted by its distance.
    """
    tables = _tile_tables(pixels, sizes, tiles, clip)
    frames = tables.groupBy("key").agg(F.first("_w").alias("_w"), F.first("_h").alias("_h"))
    here = pixels.join(frames, "key")

    def around(at: str, full: str) -> tuple[Column, Column, Column]:
        place = ((F.col(at).cast("float") * (F.lit(float(tiles)).cast("float") / F.col(full).cast("float")).cast("float")).cast("float") - F.lit(0.5).cast("float")).cast("float")
        low = F.floor(place).cast("int")
        return F.greatest(low, F.lit(0)), F.least(low + 1, F.lit(tiles - 1)), (place - low.cast("float")).cast("float")

    (x0, x1, fx), (y0, y1, fy) = around("x", "_w"), around("y", "_h")
    one = F.lit(1.0).cast("float")
    corner = lambda ty, wy, tx, wx: F.struct(ty.alias("ty"), tx.alias("tx"), (wy.cast("double") * wx.cast("double")).alias("weight"))
    four = F.array(corner(y0, one - fy, x0, one - fx), corner(y0, one - fy, x1, fx), corner(y1, fy, x0, one - fx), corner(y1, fy, x1, fx))
    asked = here.select("key", "x", "y", "gray", F.explode(four).alias("c")).select("key", "x", "y", "gray", "c.*")
    told = asked.join(tables.select("key", "ty", "tx", "table"), ["key", "ty", "tx"])
    return told.groupBy("key", "x", "y").agg(F.rint(F.round(F.sum(F.col("weight") * F.element_at("table", F.col("gray") + 1)), 6)).cast("int").alias("gray"))


def gaussian(size: int) -> list[float]:
    """Weights of a Gaussian window of ``size`` (odd), whose width follows from its size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / math.fsum(w) for x in w]


def _weighted(pixels: DataFrame, of: str, by: str, at: str, n: str, weights: list[float], mirrored: bool = False) -> DataFrame:
    """Weighted sums along one axis; beyond the border its pixel goes on, or the row runs back.

    Each row of pixels is one array, and each place takes its window of it.
    """
    reach = len(weights) // 2
    lines = pixels.groupBy("key", by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(of).cast("double").alias("v")))), lambda p: p["v"]).alias("line"), F.count(F.lit(1)).cast("int").alias(n))
    if mirrored:  # a row of one pixel goes on with it
        last = F.size("line") - 1
        source = lambda g: F.when(last == 0, F.lit(0)).otherwise(F.least(F.abs(g) % (2 * last), 2 * last - F.abs(g) % (2 * last)))
        lines = lines.withColumn("line", F.transform(F.sequence(F.lit(-reach), last + reach), lambda g: F.get("line", source(g))))
    padded = F.col("line") if mirrored else F.concat(F.array_repeat(F.col("line")[0], reach), F.col("line"), F.array_repeat(F.element_at("line", -1), reach))
    lines = lines.withColumn("line", padded).withColumn("w", F.lit(weights))
    sums = F.transform(F.sequence(F.lit(1), F.col(n)), lambda i: F.aggregate(F.zip_with(F.slice("line", i, F.lit(len(weights))), F.col("w"), lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v))
    return lines.select("key", by, F.posexplode(sums).alias(at, of))


def blurred(pixels: DataFrame) -> DataFrame:
    """Pixels smoothed by 1 4 6 4 1 over both axes, to whole numbers; rows run back at the border. Places count from 0."""
    weights = [w / 16 for w in (1.0, 4.0, 6.0, 4.0, 1.0)]
    both = _weighted(_weighted(pixels, "gray", "y", "x", "_n", weights, True), "gray", "x", "y", "_n", weights, True)
    return both.select("key", "x", "y", F.floor(F.col("gray") + 0.5).cast("int").alias("gray"))


def adaptive_mask(pixels: DataFrame, size: int, offset: int) -> DataFrame:
    """Pixels brighter than their surroundings: key, x, y, gray (255 or 0).

    A pixel stays if it is above the Gaussian mean (to whole numbers, halves
    to even) of the ``size`` by ``size`` pixels around it, less ``offset``.
    Places count from 0.
    """
    weights = gaussian(size)
    means = _weighted(_weighted(pixels, "gray", "y", "x", "_n", weights), "gray", "x", "y", "_n", weights)
    means = means.select("key", "x", "y", F.rint(F.round(F.col("gray"), 6)).alias("_mean"))
    on = F.col("gray") > F.col("_mean") - offset
    return pixels.join(means, ["key", "x", "y"]).select("key", "x", "y", F.when(on, 255).otherwise(0).alias("gray"))


def score_window(rows: int) -> int:
    """Window of the local threshold of a score: half its rows, odd, 11 at least."""
    return max(11, (rows // 2) | 1)


def title_window(rows: int) -> int:
    """Window of the local threshold of a title: an eighth of its rows, odd, 11 at least."""
    return max(11, (rows // 8) | 1)


def title_sources(pixels: DataFrame, sizes: DataFrame, rows: int, even: bool = False, local: bool = False) -> list[DataFrame]:
    """The pictures of titles of ``rows`` rows that are cut: as they are, their top-hat and, where asked for, made even and cut locally."""
    out = [pixels.select("key", "x", "y", "gray"), top_hat(pixels, title_hat_size(rows))]
    out += [equalised(pixels, sizes)] if even else []
    return out + ([adaptive_mask(pixels, title_window(rows), 8)] if local else [])


def score_sources(pixels: DataFrame, sizes: DataFrame, rows: int, even: bool = False, local: bool = False) -> list[DataFrame]:
    """The same for scores of ``rows`` rows, with the ``light`` of the picture itself: made even, and cut locally."""
    light = pixels.select("key", "x", "y", F.col("gray").alias("light"))
    with_light = lambda df: df.join(light, ["key", "x", "y"])
    out = [with_light(equalised(pixels, sizes))] if even else []
    return out + ([with_light(adaptive_mask(pixels, score_window(rows), 5))] if local else [])
