"""Connected components of links by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import by_rows, dropped, written


def components(links: DataFrame) -> DataFrame:
    """For each end of the links (a, b): ``rep`` and ``root``, the smallest id it reaches.

    Each round every node takes the least label among its own and its
    neighbours', then the label of that label. Labels only fall, and a round
    without a change ends the loop. Nothing but a count reaches the driver.
    """
    both = written(
        links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct()
    )
    labels = both.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.min("a")).alias("root"))
    labels = written(labels)
    most = labels.count()  # each round has as many
    while True:
        near = both.join(by_rows(labels, most), both["b"] == labels["rep"]).groupBy("a").agg(F.min("root").alias("least"))
        new = labels.join(by_rows(near, most), labels["rep"] == near["a"], "left").select(
            "rep", F.col("root").alias("old"), F.least("root", "least").alias("root")
        )
        labels_ = labels.select("rep", "root")
        jump = labels_.select(F.col("rep").alias("at"), F.col("root").alias("further"))
        new = new.join(by_rows(jump, most), new["root"] == jump["at"], "left").select(
            "rep", "old", F.least("root", "further").alias("root")
        )
        new = written(new)
        done = new.where("old != root").limit(1).count() == 0
        dropped(labels)  # each round reads the one before alone
        labels = new
        if done:
            dropped(both)
            return labels
