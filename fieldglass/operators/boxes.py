"""Detections: suppression, best boxes, merging of passes, recall.

Detections are rows (key, cls, box, conf, ord); ord settles ties in the order
in which a detector gave them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.geometry import iou

NMS_IOU = 0.45


def _best_first(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("conf"), "ord")


def nms(det: DataFrame, threshold: float = NMS_IOU, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Per class, by falling confidence: a box stays unless it overlaps one that stayed.

    One shuffle by key and class; each group folds in the JVM. A group is one
    photo's boxes of one class, of which a detector gives a bounded number.
    """
    item = F.struct(F.negative("conf").alias("by"), "ord", "box", "conf")
    groups = det.groupBy(*keys, "cls").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kept = F.aggregate(
        "all", F.filter("all", lambda x: F.lit(False)),
        lambda acc, b: F.when(F.exists(acc, lambda k: iou(k["box"], b["box"]) > threshold), acc).otherwise(F.concat(acc, F.array(b))),
    )
    return groups.select(*keys, "cls", F.explode(kept).alias("k")).select(*keys, "cls", "k.box", "k.conf", "k.ord")


def best_box(det: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The most confident box of each class, the first of equals."""
    return top_boxes(det, 1, keys).drop("rank")


def top_boxes(det: DataFrame, n: int, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The ``n`` most confident boxes of each class, ranked from 1."""
    return det.withColumn("rank", F.row_number().over(_best_first(*keys, "cls"))).where(F.col("rank") <= n)


def carry_over(second: DataFrame, first: DataFrame) -> DataFrame:
    """The second pass's boxes, and those of classes that it lacks from the first."""
    missing = first.join(second.select("key", "cls").distinct(), ["key", "cls"], "left_anti")
    return second.withColumn("passed", F.lit(2)).unionByName(missing.withColumn("passed", F.lit(1)))


def orientation_scores(det: DataFrame, full_class: int = 1) -> DataFrame:
    """Per (key, turn): the sum over classes of 1 + highest confidence, and 100 for a whole screen."""
    top = det.groupBy("key", "turn", "cls").agg(F.max("conf").alias("top"))
    return top.groupBy("key", "turn").agg(
        (F.sum(1 + F.col("top")) + 100 * F.max((F.col("cls") == full_class).cast("int"))).alias("score")
    )


def best_turn(det: DataFrame, full_class: int = 1) -> DataFrame:
    """The turn of each key: 0 if that shows a whole screen, else the one with the highest orientation score, the smallest of equals.

    Scores are compared at six decimals, so that the order of a sum doesn't decide.
    """
    upright = F.max(F.coalesce((F.col("turn") == 0) & (F.col("cls") == full_class), F.lit(False))).over(Window.partitionBy("key"))
    asked = det.withColumn("_upright", upright).where(~F.col("_upright") | (F.col("turn") == 0)).drop("_upright")
    w = Window.partitionBy("key").orderBy(F.desc(F.floor(F.col("score") * 1e6 + 0.5)), "turn")
    return orientation_scores(asked, full_class).withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def recall(det: DataFrame, reference: DataFrame, least: float = 0.5) -> DataFrame:
    """Per class: reference boxes (the first of a key and class), those found, and their share."""
    first = reference.withColumn("rank", F.row_number().over(Window.partitionBy("key", "cls").orderBy("ord"))).where("rank = 1")
    first = first.select("key", "cls", F.col("box").alias("want"))
    found = first.join(det.select("key", "cls", "box"), ["key", "cls"], "left").groupBy("key", "cls").agg(
        F.max(F.coalesce(iou(F.col("box"), F.col("want")) >= least, F.lit(False))).alias("hit")
    )
    return found.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits")).withColumn("recall", F.col("hits") / F.col("n"))
