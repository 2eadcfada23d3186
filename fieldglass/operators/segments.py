"""Cutting and choosing: merged glyphs, wanted counts, and the best of several thresholds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_merged(components: DataFrame, profile: DataFrame) -> DataFrame:
    """Components as wide as two glyphs, cut at the emptiest column of their middle.

    ``components`` are (key, ord, x, y, w, h), ``profile`` (key, ord, at, n)
    the foreground pixels of each column of a component. A component over 0.95
    of its height in width and at least 6 wide is cut at the first emptiest
    column from 30 to 70 percent, unless that holds over 0.55 of the fullest.
    """
    # single precision throughout: at 10 columns, 0.70 gives 7 there and 6 in double precision
    low, high = ((F.lit(share).cast("float") * F.col("w")).cast("float").cast("int") for share in (0.30, 0.70))
    cols = profile.join(components.select("key", "ord", "w"), ["key", "ord"])
    most = F.max("n").over(Window.partitionBy("key", "ord"))
    inner = cols.withColumn("most", most).where((F.col("at") >= low) & (F.col("at") < high))
    cut = inner.groupBy("key", "ord").agg(F.min(F.struct("n", "at")).alias("v"), F.first("most").alias("most"))
    joined = components.join(cut, ["key", "ord"], "left")
    apart = (F.col("w") > 0.95 * F.col("h")) & (F.col("w") >= 6) & F.col("v").isNotNull() & (F.col("v.n") <= 0.55 * F.col("most"))
    part = lambda i, x, w: F.struct(F.lit(i).alias("part"), x.alias("x"), w.alias("w"))
    pieces = F.when(apart, F.array(part(0, F.col("x"), F.col("v.at")), part(1, F.col("x") + F.col("v.at"), F.col("w") - F.col("v.at")))).otherwise(
        F.array(part(0, F.col("x"), F.col("w"))))
    return joined.select("key", "ord", "y", "h", F.explode(pieces).alias("p")).select("key", "ord", "p.part", "p.x", "y", "p.w", "h")


def merge_to(components: DataFrame, wanted: int | Column, steps: int = 20) -> DataFrame:
    """Components of each crop joined across the smallest gaps until ``wanted`` are left: key, part, x1, x2.

    At most ``steps`` joins; the first of equal gaps goes first. ``wanted`` may
    be an expression over the key and ``size``, the number of components.
    """
    groups = components.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("x", "ord", (F.col("x") + F.col("w")).alias("x2")))).alias("s"))
    groups = groups.withColumn("s", F.transform("s", lambda c: F.struct(c["x"].alias("x"), c["x2"].alias("x2"))))

    def step(acc: Column, _: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(acc) - 1), lambda i: F.element_at(acc, i + 1)["x"] - F.element_at(acc, i)["x2"])
        i = F.array_position(gaps, F.array_min(gaps)).cast("int")
        both = F.struct(F.element_at(acc, i)["x"].alias("x"), F.greatest(F.element_at(acc, i)["x2"], F.element_at(acc, i + 1)["x2"]).alias("x2"))
        joined = F.concat(F.slice(acc, F.lit(1), i - 1), F.array(both), F.slice(acc, i + 2, F.size(acc)))
        return F.when(F.size(acc) > F.greatest(F.col("_wanted"), F.lit(1)), joined).otherwise(acc)

    groups = groups.withColumn("size", F.size("s")).withColumn("_wanted", F.lit(wanted) if isinstance(wanted, int) else wanted)
    out = groups.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("s"), step))
    return out.select("key", F.posexplode("s").alias("part", "c")).select("key", "part", F.col("c.x").alias("x1"), F.col("c.x2").alias("x2"))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` the value, which is worked out once however often that names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def split_to(components: DataFrame, profile: DataFrame, wanted: Column, steps: int = 20) -> DataFrame:
    """Components (key, ord, x, w) split until ``wanted`` are there: key, part, x1, x2.

    The widest goes first (the first of equals), at its emptiest column from a
    quarter to three quarters (``profile``: key, ord, at, n); nothing below 4
    wide is split, and at most ``steps`` splits are made. ``wanted`` is an
    expression over the key and ``size``, the number of components. Without
    columns a component is split in its middle.
    """
    groups = components.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("x", "ord", "w"))).alias("s")).withColumn("size", F.size("s"))
    groups = groups.withColumn("_more", F.least(F.lit(steps), wanted - F.col("size")).cast("int"))
    # a component is split after all wider ones (and those before it), so only so many can be, and only their columns are gathered
    widest = F.array_sort(F.transform("s", lambda c: F.struct((-c["w"]).alias("w"), c["x"].alias("x"), c["ord"].alias("ord"))))
    first = F.filter(F.slice(widest, F.lit(1), F.greatest(F.col("_more"), F.lit(0))), lambda c: c["w"] <= -4)
    asked = groups.select("key", F.transform(first, lambda c: c["ord"]).alias("_ords")).where(F.size("_ords") > 0)
    # by key alone, as both may lie by it already; what is collected looks small to Spark, so that it would be broadcast
    cols = profile.join(asked.hint("merge"), "key").where(F.array_contains("_ords", F.col("ord")))
    cols = cols.groupBy("key", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda c: c["n"]).alias("cols"))
    cols = cols.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("ord", "cols"))).alias("_cols"))
    none = F.array().cast(f"array<{profile.schema['n'].dataType.simpleString()}>")
    groups = groups.join(cols.hint("merge"), "key", "left")
    groups = groups.withColumn("s", F.transform("s", lambda c: F.struct(c["x"].alias("x"), c["w"].alias("w"), F.coalesce(F.try_element_at("_cols", c["ord"]), none).alias("cols"))))
    single = lambda share, w: (F.lit(share).cast("float") * w).cast("float").cast("int")

    def cut(c: Column) -> Column:
        ends = F.struct(F.greatest(F.lit(1), single(0.25, c["w"])).alias("low"), F.least(c["w"] - 1, single(0.75, c["w"])).alias("high"))
        inner = lambda e: F.slice(c["cols"], e["low"] + 1, F.greatest(e["high"] - e["low"], F.lit(0)))
        emptiest = lambda e: _once(inner(e), lambda v: e["low"] + F.array_position(v, F.array_min(v)).cast("int") - 1)
        at = _once(ends, lambda e: F.coalesce(F.when(e["high"] > e["low"], emptiest(e)), F.floor(c["w"] / 2).cast("int")))
        part = lambda x, w, k: F.struct(x.alias("x"), w.alias("w"), k.alias("cols"))
        return _once(at, lambda at: F.array(part(c["x"], at, F.slice(c["cols"], F.lit(1), at)), part(c["x"] + at, c["w"] - at, F.slice(c["cols"], at + 1, F.greatest(c["w"] - at, F.lit(1))))))

    def step(acc: Column, _: Column) -> Column:
        split = lambda i: F.concat(F.slice(acc, F.lit(1), i - 1), _once(F.element_at(acc, i), cut), F.slice(acc, i + 1, F.size(acc)))
        at = lambda widths, most: _once(F.array_position(widths, most).cast("int"), split)
        return _once(F.transform(acc, lambda c: c["w"]), lambda widths: _once(F.array_max(widths), lambda most: F.when(most >= 4, at(widths, most)).otherwise(acc)))

    times = F.when(F.col("_more") >= 1, F.sequence(F.lit(1), F.col("_more"))).otherwise(F.array().cast("array<int>"))
    out = groups.withColumn("s", F.aggregate(times, F.col("s"), step))
    return out.select("key", F.posexplode("s").alias("part", "c")).select("key", "part", F.col("c.x").alias("x1"), (F.col("c.x") + F.col("c.w")).alias("x2"))


def best_threshold(tries: DataFrame, tier: int = 2, enough: float = 0.10) -> DataFrame:
    """The winning try of each key (key, ord, tier, regularity): highest tier, then regularity, first of equals.

    A sweep ends with the first try at which the best so far has the wanted
    tier and enough regularity, so later tries don't count.
    """
    order = Window.partitionBy("key").orderBy("ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    good = (F.col("tier") == tier) & (F.col("regularity") > enough)
    live = tries.withColumn("_ended", F.coalesce(F.max(good.cast("int")).over(before), F.lit(0))).where("_ended = 0")
    best = Window.partitionBy("key").orderBy(F.desc("tier"), F.desc("regularity"), "ord")
    return live.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "_ended")


def best_readings(tries: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` distinct readings of each key (key, ord, reading, score_a, score_b) by falling scores, ranked."""
    by = Window.partitionBy("key", "reading").orderBy(F.desc("score_a"), F.desc("score_b"), "ord")
    first = tries.where("reading != ''").withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")
    w = Window.partitionBy("key").orderBy(F.desc("score_a"), F.desc("score_b"), "ord")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def homographies(quads: DataFrame, width: float | None = None, height: float | None = None) -> DataFrame:
    """Adds ``h``, the 3 x 3 map (9 numbers) from a flat screen onto the quad of each row (key, quad: 8 numbers); null where there is none.

    The screen's size is given for all rows, or by their columns ``width`` and ``height``.
    """
    sized = quads.select("key", "quad", *(F.col(n).cast("double").alias(n) if v is None else F.lit(float(v)).alias(n) for n, v in (("width", width), ("height", height))))

    def solve(batches):
        for b in batches:
            n = len(b)
            q = np.array(b["quad"].tolist(), float).reshape(n, 4, 2)
            w, t, none = b["width"].to_numpy(float), b["height"].to_numpy(float), np.zeros(n)
            x, y = np.stack([none, w, w, none], axis=1), np.stack([none, none, t, t], axis=1)
            a = np.zeros((n, 8, 8))
            for row, first in ((0, 0), (1, 3)):  # two equations a corner
                a[:, row::2, first], a[:, row::2, first + 1], a[:, row::2, first + 2] = x, y, 1
                a[:, row::2, 6], a[:, row::2, 7] = -q[:, :, row] * x, -q[:, :, row] * y
            fine = np.linalg.cond(a) < 1e12 if n else np.zeros(0, bool)
            h = np.zeros((n, 9))
            h[fine, :8] = np.linalg.solve(a[fine], q[fine].reshape(-1, 8, 1))[:, :, 0]
            h[:, 8] = 1
            yield pd.DataFrame({"key": b["key"], "quad": b["quad"], "width": w, "height": t, "h": [list(r) if ok else None for r, ok in zip(h, fine)]})

    found = sized.mapInPandas(solve, f"key {quads.schema['key'].dataType.simpleString()}, quad array<double>, width double, height double, h array<double>")
    return found if width is None else found.drop("width", "height")
