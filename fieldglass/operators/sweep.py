"""Pictures read at several thresholds: nested components, and the best of the readings.

A crop's thresholds share their components: going from the highest to the
lowest, pixels are added and components only grow together, so one pass over a
crop gives the components of all its cuts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.text import digit_of
from fieldglass.operators import resample, vectors
from fieldglass.operators.lines import (
    coherence, dominant_line, histogram, merge_by_x, otsu, plausibility, ranks_of_counts, same_line, score_components, title_components,
)
from fieldglass.operators.resolve import score_reading
from fieldglass.operators.segments import best_readings, best_threshold
from fieldglass.work import written

#: Percentiles at which scores and titles are cut.
SCORE_CUTS = (60, 70, 78, 85, 90, 94)
TITLE_CUTS = (55, 65, 75, 82, 88, 93)


def join_pairs(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the pairs a, b are joined; every entry of ``parent`` is a root, the first of its component."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _grown(x: np.ndarray, y: np.ndarray, level: np.ndarray, gray: np.ndarray, thresholds: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each threshold (falling) the components of pixels above it, in the order of their first pixel: x, y, w, h, area, bright.

    Pixels are given once each, by row and column. Each joins at the first
    threshold below its level, each pair of neighbours at the later of the
    two; what a component has gathered goes to the one that it becomes part of.
    """
    n = len(x)
    first = np.searchsorted(-thresholds, -level, "right")  # the first threshold below the level
    left, top = int(x.min()), int(y.min())
    wide = int(x.max()) - left + 3
    place = np.full((int(y.max()) - top + 3) * wide, -1, np.int64)
    at = (y - top + 1) * wide + x - left + 1
    place[at] = np.arange(n)
    pairs = [(np.arange(n), place[at + step]) for step in (1, wide - 1, wide, wide + 1)]
    a = np.concatenate([p[q >= 0] for p, q in pairs])
    b = np.concatenate([q[q >= 0] for _, q in pairs])
    when = np.maximum(first[a], first[b])
    by = np.argsort(when, kind="stable")
    a, b, when = a[by], b[by], when[by]
    x0, y0, x1, y1 = x.copy(), y.copy(), x.copy(), y.copy()
    area, light = np.ones(n, np.int64), gray.astype(np.int64).copy()
    parent, self_ = np.arange(n), np.arange(n)
    out = []
    for k in range(len(thresholds)):
        lo, hi = np.searchsorted(when, [k, k + 1])
        was = parent == self_
        parent = join_pairs(parent, a[lo:hi], b[lo:hi])
        gone = np.flatnonzero(was & (parent != self_))
        to = parent[gone]
        for of, low in ((x0, True), (y0, True), (x1, False), (y1, False)):
            (np.minimum if low else np.maximum).at(of, to, of[gone])
        np.add.at(area, to, area[gone])
        np.add.at(light, to, light[gone])
        r = np.flatnonzero((parent == self_) & (first <= k))
        out.append((x0[r], y0[r], x1[r] - x0[r] + 1, y1[r] - y0[r] + 1, area[r], light[r] / np.maximum(area[r], 1)))
    return out


def threshold_components(pixels: DataFrame, cuts: DataFrame) -> DataFrame:
    """Connected components (8 neighbours) of every cut of every crop: key, cut, ord, x, y, w, h, area, bright.

    ``pixels`` are (key, x, y, gray), of any range; of a pixel that is given
    twice the brightest counts. ``cuts`` are (key, cut, threshold, dark): a cut
    has the pixels above its threshold or, where ``dark``, the others.
    ``bright`` is the mean of a component's pixels, of their ``light`` if there is such a column, else of their gray. A crop, whose size the
    reader bounds, is one group; cuts without pixels have no component.
    """
    kind = pixels.schema["key"].dataType.simpleString()
    schema = f"key {kind}, cut int, ord int, x int, y int, w int, h int, area int, bright double"
    names = ["cut", "ord", "x", "y", "w", "h", "area", "bright"]

    def label(t: pa.Table, c: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[] for _ in names]
        if t.num_rows and c.num_rows:
            x, y, gray = (t.column(n).to_numpy().astype(np.int64) for n in ("x", "y", "gray"))
            light = t.column("light").to_numpy().astype(np.int64)
            by = np.lexsort((-gray, x, y))
            by = by[np.concatenate([[True], (np.diff(x[by]) != 0) | (np.diff(y[by]) != 0)])]
            x, y, gray, light = x[by], y[by], gray[by], light[by]
            cut, threshold, dark = (np.asarray(c.column(n).to_pylist()) for n in ("cut", "threshold", "dark"))
            for side in (False, True):
                mine = np.flatnonzero(dark == side)
                if not len(mine):
                    continue
                bound = -threshold[mine] - 1 if side else threshold[mine]
                order = np.argsort(-bound, kind="stable")
                for k, parts in zip(mine[order], _grown(x, y, -gray if side else gray, light, bound[order].astype(np.int64))):
                    for into, values in zip(found, (np.full(len(parts[0]), cut[k]), np.arange(len(parts[0])), *parts)):
                        into.append(values)
        columns = [np.concatenate(f) if f else np.zeros(0) for f in found]
        total = len(columns[0])
        key = t.column("key") if t.num_rows else c.column("key")
        keys = pa.array([key[0].as_py()] * total, key.type) if total else pa.array([], key.type)
        kinds = [pa.int32()] * 7 + [pa.float64()]
        return pa.table({"key": keys, **{n: pa.array(v.astype(np.float64 if k == pa.float64() else np.int32), k) for n, v, k in zip(names, columns, kinds)}})

    light = F.col("light" if "light" in pixels.columns else "gray").cast("int").alias("light")
    left = pixels.select(F.col("key").alias("key"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("gray").cast("int").alias("gray"), light)
    right = cuts.select(F.col("key").alias("key"), F.col("cut").cast("int").alias("cut"), F.col("threshold").cast("int").alias("threshold"), "dark")
    return left.groupBy("key").cogroup(right.groupBy("key")).applyInArrow(label, schema)


def cut_mask(pixels: DataFrame, cuts: DataFrame) -> DataFrame:
    """The pixels of each cut: key, cut, x, y."""
    above = F.col("gray") > F.col("threshold")
    return pixels.join(cuts.hint("merge"), "key").where(above != F.col("dark")).select("key", "cut", "x", "y")


def score_cuts(pixels: DataFrame, first: int = 0) -> DataFrame:
    """The cuts of a score's crop: key, cut (from ``first`` on), threshold, dark.

    The split by variance, its inverse, and six linear percentiles of the
    gray values. A flat crop is split at 0.
    """
    counts = histogram(pixels, F.col("gray"))
    split = counts.select("key").distinct().join(otsu(counts), "key", "left").select("key", F.coalesce("threshold", F.lit(0)).alias("t"))
    place = lambda p: (lambda n: F.floor(F.lit(p / 100.0) * (n - 1)))
    wanted = {f"a{p}": place(p) for p in SCORE_CUTS} | {f"b{p}": (lambda n, at=place(p): at(n) + 1) for p in SCORE_CUTS}
    found = ranks_of_counts(counts, "key", "v", "n", wanted)
    size = counts.groupBy("key").agg(F.sum("n").alias("size"))

    def threshold(p: int):
        at = F.lit(p / 100.0) * (F.col("size") - 1)
        exact = F.col(f"a{p}") + (at - F.floor(at)) * (F.coalesce(F.col(f"b{p}"), F.lit(255)) - F.col(f"a{p}"))
        return F.floor(exact.cast("float")).cast("int")  # gray is whole: above the percentile is above its floor

    rows = [(F.col("t"), False), (F.col("t"), True), *((threshold(p), False) for p in SCORE_CUTS)]
    tries = F.array(*[F.struct(F.lit(first + i).alias("cut"), t.cast("int").alias("threshold"), F.lit(dark).alias("dark")) for i, (t, dark) in enumerate(rows)])
    return split.join(found, "key").join(size, "key").select("key", F.explode(tries).alias("c")).select("key", "c.*")


def title_cuts(pixels: DataFrame, first: int = 0) -> DataFrame:
    """The cuts of a title's crop, the percentiles of its gray values by rank: key, cut (from ``first`` on), threshold, dark."""
    counts = histogram(pixels, F.col("gray"))
    single = lambda p: (lambda n: F.least(n - 1, F.floor((F.lit(p / 100.0).cast("float") * (n - 1).cast("float")).cast("float"))))
    found = ranks_of_counts(counts, "key", "v", "n", {f"p{p}": single(p) for p in TITLE_CUTS})
    tries = F.array(*[F.struct(F.lit(first + i).alias("cut"), F.col(f"p{p}").cast("int").alias("threshold"), F.lit(False).alias("dark")) for i, p in enumerate(TITLE_CUTS)])
    return found.select("key", F.explode(tries).alias("c")).select("key", "c.*")


def local_cuts(pixels: DataFrame, first: int = 0) -> DataFrame:
    """The cuts of pictures that were cut already (gray 0 or 255): what stays, and its inverse."""
    tries = F.array(*[F.struct(F.lit(first + i).alias("cut"), F.lit(127).alias("threshold"), F.lit(bool(i)).alias("dark")) for i in (0, 1)])
    return pixels.select("key").distinct().select("key", F.explode(tries).alias("c")).select("key", "c.*")


Sources = list[tuple[DataFrame, DataFrame]]


def _all(sources: Sources, of: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What ``of`` gives for the pixels and the cuts of each source, together."""
    return reduce(DataFrame.unionByName, (of(pixels, cuts) for pixels, cuts in sources))


def _tries(df: DataFrame) -> DataFrame:
    return df.withColumn("try", F.struct("key", "cut"))


def digit_sweep(pixels: DataFrame, cuts: DataFrame, more: Sequence[tuple[DataFrame, DataFrame]] = ()) -> DataFrame:
    """The digits of each cut, from left to right: key, cut, place, x, y, w, h.

    Components that are high, filled, narrow and bright enough, on one line.
    ``more`` are further pictures of the same crops with their cuts.
    """
    kept = same_line(score_components(_tries(_all([(pixels, cuts), *more], threshold_components)), "try"), "try")
    place = F.row_number().over(Window.partitionBy("try").orderBy("x", "ord")) - 1
    return kept.select("key", "cut", place.alias("place"), "x", "y", "w", "h")


def _read(glyphs: DataFrame, mask: DataFrame, bank: DataFrame, in_line: bool) -> DataFrame:
    """Glyphs (key, cut, place, x, y, w, h) with their ``label`` and ``margin``."""
    cut_out = resample.glyph_vectors(glyphs, mask, ["key", "cut", "place"], in_line)
    rows = cut_out.select(F.struct("key", "cut", "place").alias("id"), vectors.normalised(F.col("vec")).alias("vec"))
    return vectors.classify(rows, bank).select("id.*", "label", F.col("margin").cast("float").alias("margin"))


def _compared(x):
    """Scores are compared at six decimals, so that the order of a sum doesn't decide."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def score_from_pixels(pixels: DataFrame, bank: DataFrame, cuts: DataFrame | None = None, more: Sequence[tuple[DataFrame, DataFrame]] = ()) -> DataFrame:
    """The score that each crop shows: key, cut, digits, margins, score, margin.

    Every cut is read; of those with 4 to 8 digits the mean margin against the
    ``bank`` (label 0 to 9, vec) counts three times beside the regularity of
    heights and gaps. Without such a cut the most regular one is read. The best one wins, the first of equals; a sweep ends with
    the first cut that is good enough. Crops without digits have score -1, like
    those whose digits are no score. ``cuts`` are those of ``score_cuts`` if
    none are given.
    """
    sources = [(p, written(c)) for p, c in [(pixels, score_cuts(pixels) if cuts is None else cuts), *more]]
    cuts = reduce(DataFrame.unionByName, (c for _, c in sources))
    glyphs = written(digit_sweep(*sources[0], sources[1:]))
    shape = plausibility(_tries(glyphs), "try").select("try.*", "tier", _compared(F.col("regularity")).alias("regularity"))
    by_key = Window.partitionBy("key")
    first = F.row_number().over(by_key.orderBy(F.desc("tier"), F.desc("regularity"), "cut"))
    asked = shape.withColumn("_r", first).withColumn("_most", F.max("tier").over(by_key)).where("tier > 0 OR _most = 0 AND _r = 1").select("key", "cut")
    read = glyphs.join(asked, ["key", "cut"], "left_semi")
    told = _read(read, _all(sources, lambda p, c: cut_mask(p, c.join(asked, ["key", "cut"], "left_semi"))), bank, False)
    words = told.groupBy("key", "cut").agg(F.array_sort(F.collect_list(F.struct("place", "label", "margin"))).alias("g"), F.avg("margin").alias("sure"))
    tries = cuts.select("key", "cut").join(shape, ["key", "cut"], "left").join(words, ["key", "cut"], "left").select(
        "key", F.col("cut").alias("ord"), F.coalesce("tier", F.lit(-1)).alias("tier"),
        _compared(F.coalesce("regularity", F.lit(0.0)) + F.when(F.col("tier") > 0, 3.0 * F.coalesce("sure", F.lit(-1.0))).otherwise(0.0)).alias("regularity"), "g")
    best = best_threshold(tries)
    digits = F.transform(F.col("g"), lambda g: digit_of(g["label"]))
    margins = F.transform(F.col("g"), lambda g: g["margin"].cast("double"))
    whole = F.when(F.array_min(digits) >= 0, F.array_join(F.transform(digits, lambda d: d.cast("string")), ""))
    found = best.select("key", F.col("ord").alias("cut"), F.coalesce(whole, F.lit("")).alias("digits"), F.coalesce(margins, F.array().cast("array<double>")).alias("margins"))
    reading = score_reading(F.when(F.col("digits") != "", F.col("digits")), F.col("margins"))
    return found.withColumn("r", reading).select("key", "cut", "digits", "margins", "r.score", "r.margin")


def title_sweep(pixels: DataFrame | list[DataFrame], sizes: DataFrame, wanted: int | None = None) -> DataFrame:
    """The glyphs of the two best readings of each title: key, rank, cut, place, x, y, w, h, vec.

    At each cut, components that look like letters are joined where one stands
    above the other, and the line that dominates stays. Readings with more
    glyphs (or with a number nearer to ``wanted``) win, then those of even
    height; the first of equals. Readings whose glyphs are all the same are
    one. ``sizes`` are the crops' (key, rows, cols); of several pictures of the
    same crops (``light.title_sources``) the first ones win ties.
    """
    pictures = [pixels] if isinstance(pixels, DataFrame) else pixels
    sources = [(p, written(title_cuts(p, i * len(TITLE_CUTS)))) for i, p in enumerate(pictures)]
    letters = title_components(_tries(_all(sources, threshold_components).join(sizes.hint("merge"), "key")), "try")
    line = dominant_line(merge_by_x(letters, "try").withColumnRenamed("part", "ord"), "try")
    place = F.row_number().over(Window.partitionBy("try").orderBy("x", "ord")) - 1
    glyphs = written(line.select("try.*", place.alias("place"), "x", "y", "w", "h"))
    shape = coherence(_tries(glyphs), "try").join(_tries(glyphs).groupBy("try").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "try").select("try.*", "coherence", "n")
    cut_out = written(resample.glyph_vectors(glyphs, _all(sources, cut_mask), ["key", "cut", "place"], True))
    drawn = cut_out.groupBy("key", "cut").agg(F.sha2(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "vec"))), lambda g: g["vec"])), ","), 256).alias("reading"))
    first = F.col("n") if wanted is None else -F.abs(F.col("n") - wanted)
    tries = shape.join(drawn.hint("merge"), ["key", "cut"]).select("key", F.col("cut").alias("ord"), "reading", first.alias("score_a"), _compared(F.col("coherence")).alias("score_b"))
    best = best_readings(tries).select("key", F.col("ord").alias("cut"), "rank")
    return cut_out.join(best.hint("merge"), ["key", "cut"]).select("key", "rank", "cut", "place", "x", "y", "w", "h", "vec")
