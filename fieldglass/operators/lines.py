"""Ordered sequences of components: lines, runs, merging, robust statistics.

Components are rows (key, ord, x, y, w, h); a key is one crop, whose
components a detector bounds, so windows partition by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.work import written

#: Steps of the sketch that says where a rank lies, and values of a stretch that is ordered.
STEPS = 128
STRETCH = 100_000

Ranks = dict[str, Callable[[Column], Column]]


def ranks_of_counts(counts: DataFrame, key: str, value: str, n: str, ranks: Ranks) -> DataFrame:
    """Elements of samples at the wanted places: key and a column for each of ``ranks``.

    ``counts`` are distinct (key, value) with their number ``n``; each rank is
    a function of the sample's size that gives a place from 0.
    """
    run = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_size", F.sum(n).over(Window.partitionBy(key))).withColumn("_upto", F.sum(n).over(run))
    at = [F.min(F.when(F.col("_upto") > rank(F.col("_size")), F.col(value))).alias(name) for name, rank in ranks.items()]
    return placed.groupBy(key).agg(*at)


def ranks(rows: DataFrame, key: str, value: str, wanted: Ranks) -> DataFrame:
    """Elements of unbounded samples at the wanted places (see ``ranks_of_counts``); nulls don't count.

    A bounded sketch cuts each key's values into some ``STEPS`` stretches;
    stretches are counted exactly, and only those that hold a wanted place go
    on. They are cut again until none has more than ``STRETCH`` values, and
    ordered then, all ranks in one pass. No task sees a whole key.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy(key).agg(F.sum("_n").alias("_all"))
    asked = F.array(*[F.struct(F.lit(name).alias("_name"), rank(F.col("_all")).cast("long").alias("_place")) for name, rank in wanted.items()])
    asked = sizes.select(key, F.explode(asked).alias("_a")).select(key, "_a.*", F.lit(0).cast("long").alias("_below"))
    live = written(_held(counts, asked, [key], key, value))
    while (live.groupBy(key, "_name").count().agg(F.max("count")).first()[0] or 0) > STRETCH:  # one number comes back
        places = live.groupBy(key, "_name").agg(F.first("_place").alias("_place"), F.first("_below").alias("_below"))
        live = written(_held(live.select(key, "_name", value, "_n"), places, [key, "_name"], key, value))
    run = Window.partitionBy(key, "_name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = live.withColumn("_upto", F.col("_below") + F.sum("_n").over(run)).where(F.col("_upto") > F.col("_place"))
    found = upto.groupBy(key, "_name").agg(F.min(value).alias("_v"))
    return found.groupBy(key).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in wanted])


def _held(counts: DataFrame, asked: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """The stretches of ``counts`` (by, value, _n) that hold the places asked for (key, _name, _place, _below), with what lies below each."""
    shares = [k / STEPS for k in range(1, STEPS)]
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, shares, 1000).alias("_cuts"))
    cut = counts.join(cuts, by).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    parts = cut.groupBy(*by, "_part").agg(F.sum("_n").alias("_in"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    found = parts.join(asked, by).withColumn("_below", F.col("_below") + F.col("_before"))
    found = found.where((F.col("_below") <= F.col("_place")) & (F.col("_place") < F.col("_below") + F.col("_in")))
    return cut.join(found.select(*by, "_part", *([] if "_name" in by else ["_name"]), "_place", "_below"), [*by, "_part"]).select(key, "_name", "_place", "_below", value, "_n")


def lower_rank(p: float) -> Callable[[Column], Column]:
    """The place below share ``p`` of a sample (an element of it)."""
    return lambda n: F.floor(F.lit(p) * (n - 1))


def upper_rank(p: float) -> Callable[[Column], Column]:
    return lambda n: F.ceil(F.lit(p) * (n - 1))


def middle_rank(n: Column) -> Column:
    """The place at half the count, without averaging."""
    return F.floor(n / 2)


def percentiles(rows: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """Of each key: ``lower`` (the element below share ``p``), ``linear`` (interpolated), ``upper_median`` and ``median``."""
    found = ranks(rows, key, value, {
        "lower": lower_rank(p), "_above": upper_rank(p), "upper_median": middle_rank, "_lower_median": lambda n: F.floor((n - 1) / 2),
    })
    size = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    part = F.lit(p) * (F.col("_size") - 1)
    return found.join(size, key).select(
        key, "lower", (F.col("lower") + (part - F.floor(part)) * (F.col("_above") - F.col("lower"))).alias("linear"),
        "upper_median", ((F.col("_lower_median") + F.col("upper_median")) / 2).alias("median"),
    )


def _float_share(share: float, of: Column) -> Column:
    """A share in single precision, as thresholds of components are."""
    return (F.lit(share).cast("float") * of.cast("float")).cast("float")


def title_components(df: DataFrame, key: str = "key") -> DataFrame:
    """Title glyphs among components (w, h, pixel ``area``) of an image (``rows``, ``cols``).

    At least 2 % of the largest area, 12 % of the image's height, and at most
    half its width.
    """
    largest = F.max("area").over(Window.partitionBy(key))
    return df.withColumn("_most", largest).where(
        (F.col("area") >= _float_share(0.02, F.col("_most"))) & (F.col("h") >= _float_share(0.12, F.col("rows"))) & (F.col("w") <= _float_share(0.5, F.col("cols")))
    ).drop("_most")


def badge_components(df: DataFrame, key: str = "key") -> DataFrame:
    """Badge digits: at least 55 % of the greatest height, and 2 % of all pixels of the image in area."""
    highest = F.max("h").over(Window.partitionBy(key))
    return df.withColumn("_most", highest).where(
        (F.col("h") >= _float_share(0.55, F.col("_most"))) & (F.col("area") >= _float_share(0.02, F.col("rows") * F.col("cols")))
    ).drop("_most")


def score_components(df: DataFrame, key: str = "key") -> DataFrame:
    """Score digits (with mean ``bright``): high, filled and narrow enough, and not much darker than the brightest of those."""
    w = Window.partitionBy(key)
    shaped = df.withColumn("_most", F.max("h").over(w)).where(
        (F.col("h") >= _float_share(0.55, F.col("_most"))) & (F.col("area") >= _float_share(0.05, F.col("w") * F.col("h"))) & (F.col("w") <= 3 * F.col("h"))
    )
    return shaped.withColumn("_most", F.max("bright").over(w)).where(F.col("bright").cast("float") >= _float_share(0.62, F.col("_most"))).drop("_most")


def _near_median(h: Column, middle: Column, share: float) -> Column:
    """Whether a height is near the median, in single precision."""
    return F.abs(h.cast("float") - middle.cast("float")) <= _float_share(share, middle)


def height_filter(df: DataFrame, key: str = "key", share: float = 0.42) -> DataFrame:
    """Components whose height is near the median; all of them where fewer than three would stay."""
    w = Window.partitionBy(key)
    marked = df.withColumn("_m", F.median("h").over(w)).withColumn("_near", _near_median(F.col("h"), F.col("_m"), share)).withColumn("_n", F.count_if("_near").over(w))
    return marked.where(F.col("_near") | (F.col("_n") < 3)).drop("_m", "_near", "_n")


def dominant_line(df: DataFrame, key: str = "key", share: float = 0.42, gap_share: float = 2.6) -> DataFrame:
    """The run of components that makes one line of text, with its number ``run``.

    Components whose height is near the median of all are split where gaps
    between them are wide: above 2.6 medians of their non-negative gaps or 0.9
    of the median height, whichever is more, in single precision. The run with
    the greatest sum of widths stays, the first of equals. Fewer than three
    components, and those of which fewer than three are near the median, all
    stay as they are, as run 0.
    """
    whole, order = Window.partitionBy(key), Window.partitionBy(key, "_near").orderBy("x", "ord")
    out = df.withColumn("_m", F.median("h").over(whole)).withColumn("_near", _near_median(F.col("h"), F.col("_m"), share))
    out = out.withColumn("_all", F.count_if("_near").over(whole) < 3)
    out = out.where(F.col("_all") | F.col("_near")).withColumn("_near", F.when(~F.col("_all"), True))
    gap = F.when(~F.col("_all"), F.col("x") - F.lag(F.col("x") + F.col("w")).over(order))
    out = out.withColumn("_gap", gap)
    between = F.coalesce(F.median(F.when(F.col("_gap") >= 0, F.col("_gap"))).over(whole), F.lit(0.0))
    out = out.withColumn("_limit", F.greatest(_float_share(gap_share, between), _float_share(0.9, F.col("_m"))))
    out = out.withColumn("_new", F.coalesce((F.col("_gap").cast("float") > F.col("_limit")).cast("int"), F.lit(0)))
    out = out.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_width", F.sum("w").over(Window.partitionBy(key, "run")))
    out = out.withColumn("_best", F.first("run").over(Window.partitionBy(key).orderBy(F.desc("_width"), "run")))
    return out.where(F.col("run") == F.col("_best")).drop("_m", "_near", "_all", "_gap", "_limit", "_new", "_width", "_best")


def longest_run(df: DataFrame, on: Column, key: str = "key", at: str = "y") -> DataFrame:
    """The longest stretch of consecutive rows that satisfy ``on``, the first of equals: key, start, length."""
    w = Window.partitionBy(key).orderBy(at)
    islands = df.withColumn("_i", F.row_number().over(w)).where(on)
    islands = islands.withColumn("_run", F.col("_i") - F.row_number().over(w))
    runs = islands.groupBy(key, "_run").agg(F.min(at).alias("start"), F.count(F.lit(1)).alias("length"))
    best = Window.partitionBy(key).orderBy(F.desc("length"), "start")
    return runs.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, "start", "length")


def merge_by_x(df: DataFrame, key: str = "key", share: float = 0.55) -> DataFrame:
    """Components joined with the one before where they overlap it by a share of the narrower width: key, part, x, y, w, h.

    A joined component is the rectangle around both. The comparison is with the
    union so far, in single precision, so it is a fold over the sorted
    components of a crop.
    """
    item = F.struct("x", "ord", (F.col("x") + F.col("w")).alias("x2"), "y", (F.col("y") + F.col("h")).alias("y2"))
    groups = df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("all"))

    def step(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        overlap = F.least(last["x2"], c["x2"]) - F.greatest(last["x"], c["x"])
        narrow = F.least(last["x2"] - last["x"], c["x2"] - c["x"])
        joined = F.struct(
            last["x"].alias("x"), last["ord"].alias("ord"), F.greatest(last["x2"], c["x2"]).alias("x2"), F.least(last["y"], c["y"]).alias("y"), F.greatest(last["y2"], c["y2"]).alias("y2"))
        merge = (F.size(acc) > 0) & (overlap > 0) & (overlap.cast("float") >= _float_share(share, narrow))
        return F.when(merge, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(c)))

    folded = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), step)
    return groups.select(key, F.posexplode(folded).alias("part", "c")).select(
        key, "part", F.col("c.x").alias("x"), F.col("c.y").alias("y"), (F.col("c.x2") - F.col("c.x")).alias("w"), (F.col("c.y2") - F.col("c.y")).alias("h"))


def same_line(df: DataFrame, key: str = "key") -> DataFrame:
    """Components of the main line: the heights of a band, near that band's middle.

    The band is what is 0.68 to 1.45 of the greatest height; of it stay those
    whose centre is within 0.42 median heights of the upper median centre.
    """
    whole = Window.partitionBy(key)
    h = F.col("h").cast("float")
    most = F.max("h").over(whole)
    band = df.withColumn("_max", most).where((h >= _float_share(0.68, F.col("_max"))) & (h <= _float_share(1.45, F.col("_max"))))
    band = band.withColumn("_cy", (F.col("y") + F.col("h") / 2).cast("float"))
    place = F.row_number().over(whole.orderBy("_cy")) - 1
    band = band.withColumn("_place", place).withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_mid", F.median("h").over(whole))
    band = band.withColumn("_line", F.max(F.when(F.col("_place") == F.floor(F.col("_n") / 2), F.col("_cy"))).over(whole))
    return band.where(F.abs(F.col("_cy") - F.col("_line")) <= _float_share(0.42, F.col("_mid"))).drop("_max", "_cy", "_place", "_n", "_mid", "_line")


def coherence(df: DataFrame, key: str = "key") -> DataFrame:
    """Per crop: minus the population deviation of heights over their mean."""
    return df.groupBy(key).agg((-F.stddev_pop("h") / F.avg("h")).alias("coherence"))


def plausibility(df: DataFrame, key: str = "key") -> DataFrame:
    """Per crop: tier by count (2 for 6 or 7, 1 for 4 to 8) and regularity of heights and of gaps between ordered centres."""
    centre = F.col("x") + F.col("w") / 2
    gaps = df.withColumn("_gap", centre - F.lag(centre).over(Window.partitionBy(key).orderBy(centre)))
    cv = lambda c: F.coalesce(F.try_divide(F.stddev_pop(c), F.avg(c)), F.lit(0.0))
    n = F.count(F.lit(1))
    tier = F.when(n.between(6, 7), 2).when(n.between(4, 8), 1).otherwise(0)
    return gaps.groupBy(key).agg(tier.alias("tier"), (-cv("h") - cv("_gap")).alias("regularity"))


def weighted_median(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """The first value, in order, at which the running weight reaches half: key, median."""
    w = Window.partitionBy(key).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("_run", F.sum(weight).over(w)).withColumn("_all", F.sum(weight).over(Window.partitionBy(key)))
    return run.where(F.col("_run") >= F.col("_all") / 2).groupBy(key).agg(F.min(value).alias("median"))


def histogram(df: DataFrame, value: Column, key: str = "key") -> DataFrame:
    """Counts of 256 values: key, v, n."""
    return df.groupBy(key, value.cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def otsu(hist: DataFrame, key: str = "key") -> DataFrame:
    """The value up to which a histogram (key, v, n) splits with the greatest variance between, the first of equals."""
    up = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(key)
    run = hist.withColumn("w0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("n") * F.col("v")).over(up))
    run = run.withColumn("w1", F.sum("n").over(all_) - F.col("w0")).withColumn("s1", F.sum(F.col("n") * F.col("v")).over(all_) - F.col("s0"))
    apart = F.col("s0") / F.col("w0") - F.try_divide("s1", "w1")
    run = run.withColumn("between", F.col("w0") * F.col("w1") * apart * apart).where("w1 > 0")
    best = Window.partitionBy(key).orderBy(F.desc("between"), "v")
    return run.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, F.col("v").alias("threshold"))


#: Hue ranges of chart colours (the first also wraps round).
HUES = (("single", 0, 22), ("coop", 23, 34), ("double", 35, 85), ("halfdouble", 86, 130))


def hue_vote(df: DataFrame, key: str = "key") -> DataFrame:
    """The hue range with most pixels (first of equals), and its share of all: key, chart, conf."""
    counts = []
    for i, (name, low, high) in enumerate(HUES):
        hit = F.col("hue").between(low, high)
        hit = hit | F.col("hue").between(168, 179) if i == 0 else hit
        counts.append(F.struct(F.count_if(hit).alias("n"), F.lit(-i).alias("by"), F.lit(name).alias("chart")))
    votes = df.groupBy(key).agg(F.count(F.lit(1)).alias("all"), F.array(*counts).alias("votes"))
    top = votes.select(key, "all", F.array_max("votes").alias("top"))
    return top.select(key, F.when(F.col("top.n") > 0, F.col("top.chart")).alias("chart"), (F.col("top.n") / F.col("all")).alias("conf"))


def hue_histogram(df: DataFrame, key: str = "key") -> DataFrame:
    """Feature of 20: shares of 18 hue bins, mean saturation and mean value over 255."""
    bins = [(F.count_if(F.least(F.lit(17), F.floor(F.col("hue") / 10)) == i) / F.count(F.lit(1))).alias(f"b{i}") for i in range(18)]
    return df.groupBy(key).agg(F.array(*bins, F.avg("sat") / 255, F.avg("val") / 255).alias("feature"))
