"""Detections in several passes: turned photos, straightened screens, small screens and tiny titles looked at again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.geometry import crop, map_back, taller, title_crop, translate, turn_back
from fieldglass.operators.boxes import best_box, best_turn, carry_over
from fieldglass.work import written

SCREEN, TITLE = 1, 4
#: A screen below this share of its photo is looked at again, padded, if the crop is so long on both sides.
SMALL_SHARE, ZOOM_PAD, ZOOM_LEAST = 0.40, 0.06, 64

Detect = Callable[[DataFrame], DataFrame]


def zoom_crop(screen: Column, width: Column, height: Column, share: float = SMALL_SHARE, least: int = ZOOM_LEAST) -> Column:
    """What is looked at again of a small screen; null if it is large, or its padded crop too short."""
    w, h = screen["x2"] - screen["x1"], screen["y2"] - screen["y1"]
    single = lambda c: c.cast("float")
    small = single(single(w) * single(h)) < single(single(F.lit(share).cast("float") * single(width)) * single(height))
    grown = crop(screen, width, height, ZOOM_PAD)
    return F.when((w > 0) & (h > 0) & small & (grown["x2"] - grown["x1"] >= least) & (grown["y2"] - grown["y1"] >= least), grown)


def detection_flow(photos: DataFrame, detect: Detect, straighten: Detect | None = None, share: float = SMALL_SHARE, least: int = ZOOM_LEAST) -> DataFrame:
    """The boxes of every photo (key, width, height), in its own frame: key, turn, passed, ord, cls, conf, box.

    ``detect`` is asked with rows (key, pass, turn, part, x1, y1, x2, y2): a
    crop of the photo after its turn (of the straightened picture in the passes
    ``flat`` and ``title``). It answers with (key, pass, turn, part, ord, cls,
    conf, box), boxes in the crop's frame. A pass is asked only for the photos
    that need it:

    * ``upright``: every photo as it is;
    * ``turned``: both quarter turns of photos whose first pass has no screen;
      the turn with the highest score is kept, the first of equals, and photos
      without any box go;
    * ``flat``: screens that ``straighten`` (asked with key, turn, box, width,
      height) gives a map for (key, width, height, h), and ``title`` around
      their tiny titles, which are replaced by taller ones;
    * ``zoom``: the other screens, where small; its boxes stand for their
      classes, and the first pass's for those that it lacks.

    ``passed`` is 2 for boxes of a second look. Each pass is a table that is
    written once, so a photo is looked at once in each.
    """
    sized = photos.select("key", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    zero = F.lit(0)

    def ask(name: str, crops: DataFrame, turn: Column, part: Column, corners: list[Column]) -> DataFrame:
        at = [c.cast("int").alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), corners)]
        found = detect(crops.select("key", F.lit(name).alias("pass"), turn.cast("int").alias("turn"), part.cast("int").alias("part"), *at))
        return written(found.select("key", "turn", "part", "ord", "cls", "conf", "box"))

    first = ask("upright", sized, zero, zero, [zero, zero, F.col("width"), F.col("height")])
    unseen = sized.join(first.where(F.col("cls") == SCREEN).select("key").distinct(), "key", "left_anti")
    both = unseen.withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2))))
    turned = ask("turned", both, F.col("turn"), zero, [zero, zero, F.col("height"), F.col("width")])
    seen = first.unionByName(turned).drop("part")
    seen = written(seen.join(best_turn(seen, SCREEN).select("key", "turn"), ["key", "turn"]))
    across = F.col("turn") > 0
    frames = seen.select("key", "turn").distinct().join(sized, "key").select(
        "key", "turn", F.when(across, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(across, F.col("width")).otherwise(F.col("height")).alias("height"))
    screens = best_box(seen.where(F.col("cls") == SCREEN)).select("key", "box").join(frames, "key")

    done = []
    rest, others = seen, screens
    if straighten is not None:
        maps = written(straighten(screens.select("key", "turn", "box", "width", "height")).select("key", "width", "height", "h"))
        turns = frames.select("key", "turn")
        flat = ask("flat", maps.join(turns, "key"), F.col("turn"), zero, [zero, zero, F.col("width"), F.col("height")]).drop("part")
        in_flat = flat.join(maps, "key")
        around = title_crop(F.col("box"), F.col("width").cast("int"), F.col("height").cast("int"))
        tiny = in_flat.where(F.col("cls") == TITLE).withColumn("at", around).where("at IS NOT NULL")
        again = ask("title", tiny, F.col("turn"), F.col("ord"), [F.col(f"at.{c}") for c in ("x1", "y1", "x2", "y2")])
        best = best_box(again.where(F.col("cls") == TITLE), ("key", "part")).select("key", F.col("part").alias("ord"), F.col("box").alias("found"), F.lit(TITLE).alias("cls"))
        titled = in_flat.join(tiny.select("key", "ord", "cls", "at"), ["key", "ord", "cls"], "left").join(best, ["key", "ord", "cls"], "left")
        box = F.when(F.col("at").isNull(), F.col("box")).otherwise(taller(F.col("found"), F.col("box"), F.col("at")))
        done.append(titled.select("key", "turn", F.lit(2).alias("passed"), "ord", "cls", "conf", map_back(box, F.col("h")).alias("box")))
        rest = rest.join(maps.select("key"), "key", "left_anti")
        others = others.join(maps.select("key"), "key", "left_anti")

    small = others.withColumn("at", zoom_crop(F.col("box"), F.col("width"), F.col("height"), share, least)).where("at IS NOT NULL").select("key", "turn", "at")
    second = ask("zoom", small, F.col("turn"), zero, [F.col(f"at.{c}") for c in ("x1", "y1", "x2", "y2")])
    second = second.join(small.select("key", "at"), "key").withColumn("box", translate(F.col("box"), F.col("at.x1"), F.col("at.y1")))
    columns = ["key", "turn", "ord", "cls", "conf", "box"]
    done.append(carry_over(second.select(*columns), rest.select(*columns)))
    names = ["key", "turn", "passed", "ord", "cls", "conf", "box"]
    out = done[0].select(*names)
    for more in done[1:]:
        out = out.unionByName(more.select(*names))
    return out.join(sized, "key").withColumn("box", turn_back(F.col("box"), F.col("turn"), F.col("width"), F.col("height"))).select(*names)
