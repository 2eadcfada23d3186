"""Resolving noisy text against a closed catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldglass.functions.text import block_similarity, blocks, compact, normalize_match, round_half_even, trigrams

#: Candidates that trigrams let through to the full score.
PREFILTER = 120
WEIGHTS = (0.45, 0.35, 0.20)
#: Rows of a catalog that goes to every task.
INDEXED = 20_000


def with_forms(df: DataFrame, text: str) -> DataFrame:
    """Adds norm, compact and trigrams of a text column."""
    out = df.withColumn("norm", normalize_match(F.col(text)))
    out = out.withColumn("compact", compact(F.col("norm")))
    return out.withColumn("trigrams", trigrams(F.col("compact")))


#: Arrow types of answers; an order has the catalog's own.
KINDS = {"rank": pa.int32(), "name": pa.string(), "entry": pa.string(), "jac": pa.float64(), "score": pa.float64()}


class CatalogIndex:
    """A catalog that a task holds: for each trigram the places of the rows with it."""

    def __init__(self, ords: list, names: list[str], entries: list[str], grams: list[list[str]]) -> None:
        self.ords, self.names, self.entries = ords, names, entries
        self.sizes = np.array([len(g) for g in grams], np.int64)
        posted: dict[str, list[int]] = {}
        for i, g in enumerate(grams):
            for x in g:
                posted.setdefault(x, []).append(i)
        self.posted = {x: np.array(at, np.int64) for x, at in posted.items()}

    def nearest(self, grams: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the ``limit`` rows with the highest overlap, the first of equals, and their overlaps."""
        lists = [self.posted[x] for x in grams if x in self.posted]
        both = np.bincount(np.concatenate(lists), minlength=len(self.sizes)) if lists else np.zeros(len(self.sizes), np.int64)
        at = np.flatnonzero(both)
        jac = both[at] / (len(grams) + self.sizes[at] - both[at])
        if len(at) > limit:
            high = jac >= np.partition(jac, len(jac) - limit)[len(jac) - limit]
            at, jac = at[high], jac[high]
        by = np.lexsort((at, -jac))[:limit]
        at, jac = at[by], jac[by]
        if len(at) < limit:  # rows without overlap fill up, in the catalog's order; so many of the first rows hold enough of them
            free = np.flatnonzero(both[:limit] == 0)[: limit - len(at)]
            at, jac = np.concatenate([at, free]), np.concatenate([jac, np.zeros(len(free))])
        return at, jac

    def best(self, read: str, grams: list[str], k: int, limit: int) -> list[tuple[int, float]]:
        """The ``k`` best of the nearest rows by the full score, with it.

        Rows come by falling overlap. What a score may reach at most, were the
        longest blocks as long as the shorter text, spares the comparison of
        those that can't be among the best.
        """
        found: list[tuple[float, float, int]] = []
        for i, jac in zip(*(x.tolist() for x in self.nearest(grams, limit))):
            entry = self.entries[i]
            short, both = min(len(read), len(entry)), len(read) + len(entry)
            most = WEIGHTS[0] * jac + WEIGHTS[1] * (2 * short / both if both else 1.0) + WEIGHTS[2]
            if len(found) == k and most + 1e-4 < -found[-1][0]:
                continue
            ratio, common = blocks(read, entry)
            score = float(np.rint((WEIGHTS[0] * jac + WEIGHTS[1] * ratio + WEIGHTS[2] * (common / max(short, 1))) * 1e4) / 1e4)
            found = sorted([*found, (-score, -jac, i)])[:k]
        return [(i, -score) for score, _, i in found]


def _indexed(right: DataFrame) -> Broadcast | None:
    """The catalog's index for every task, if it has no more than ``INDEXED`` rows."""
    if right.limit(INDEXED + 1).count() > INDEXED:
        return None
    t = right.orderBy("ord").toArrow()
    return right.sparkSession.sparkContext.broadcast(CatalogIndex(*(t.column(c).to_pylist() for c in ("ord", "name", "entry", "b"))))


def _forms(reads: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = with_forms(reads, "text").where("norm != ''").select("key", F.col("compact").alias("read"), F.col("trigrams").alias("a"))
    return left, with_forms(catalog, "name").select("ord", "name", F.col("compact").alias("entry"), F.col("trigrams").alias("b"))


def _asked(left: DataFrame, right: DataFrame, schema: str, answer: Callable[[str, list[str]], list[tuple]], names: list[str]) -> DataFrame:
    """``answer`` of each read: rows (place in the catalog, number) become the key, the catalog's columns and the number."""
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((left, "key"), (right, "ord"))}
    held = KINDS | {"ord": to_arrow_type(right.schema["ord"].dataType)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [answer(read, grams) for read, grams in zip(b.column("read").to_pylist(), b.column("a").to_pylist())]
            of = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), pa.int64())
            columns = list(zip(*(x for r in rows for x in r))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("key").take(of), b.column("read").take(of), *(pa.array(c, held[n]) for c, n in zip(columns, names))], names=["key", "read", *names])

    return left.mapInArrow(run, f"key {kinds['key']}, read string, {schema.format(ord=kinds['ord'])}")


def trigram_candidates(reads: DataFrame, catalog: DataFrame, limit: int = PREFILTER) -> DataFrame:
    """Pairs (key, read, ord, name, entry, jac) of reads (key, text) and catalog rows (ord, name), best ``limit`` by trigram overlap.

    Equal overlap ranks by the catalog's order, and so do rows without any,
    which fill the places that are left. Reads without a letter or digit match
    nothing. A catalog of up to ``INDEXED`` rows goes to every task as an
    index, so that reads stay where they are. A larger one meets them on
    trigrams; a trigram that many of both hold is a skewed key, which adaptive
    execution splits, only counts go on from there, and only reads that
    overlap with too few rows are filled up.
    """
    left, right = _forms(reads, catalog)
    index = _indexed(right)
    if index is not None:
        def near(read: str, grams: list[str]) -> list[tuple]:
            held = index.value
            return [(held.ords[i], held.names[i], held.entries[i], j) for i, j in zip(*(x.tolist() for x in held.nearest(grams, limit)))]

        return _asked(left, right, "ord {ord}, name string, entry string, jac double", near, ["ord", "name", "entry", "jac"])
    posted = right.select("ord", F.size("b").alias("nb"), F.explode("b").alias("t"))
    asked = left.select("key", F.size("a").alias("na"), F.explode("a").alias("t"))
    common = asked.join(posted, "t").groupBy("key", "ord").agg(F.count(F.lit(1)).alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    found = common.select("key", "ord", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jac"))
    w = Window.partitionBy("key").orderBy(F.desc("jac"), "ord")
    best = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("place")
    # at most ``limit`` of the first rows of the catalog overlap, so they hold all rows that can fill up
    few = left.select("key").join(best.groupBy("key").count().where(F.col("count") >= limit), "key", "left_anti")
    fill = few.join(F.broadcast(right.orderBy("ord").limit(limit).select("ord", F.lit(0.0).alias("jac"))))
    rest = fill.join(best.select("key", "ord"), ["key", "ord"], "left_anti").withColumn("fill", F.row_number().over(Window.partitionBy("key").orderBy("ord")))
    short = few.join(best.groupBy("key").count(), "key", "left").select("key", (F.lit(limit) - F.coalesce("count", F.lit(0))).alias("room"))
    best = best.unionByName(rest.join(short, "key").where(F.col("fill") <= F.col("room")).select("key", "ord", "jac"))
    return best.join(left.select("key", "read"), "key").join(right.select("ord", "name", "entry"), "ord").select("key", "read", "ord", "name", "entry", "jac")


def match_score(jac: Column, ratio: Column, common: Column, a: Column, b: Column) -> Column:
    """Weighted similarity, four decimals, halves to even."""
    partial = common / F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))
    return round_half_even(WEIGHTS[0] * jac + WEIGHTS[1] * ratio + WEIGHTS[2] * partial, 4)


def match(reads: DataFrame, catalog: DataFrame, k: int = 2, limit: int = PREFILTER) -> DataFrame:
    """The ``k`` best catalog rows for each read (key, text): key, rank, ord, name, score.

    Ties rank by trigram overlap, then catalog order. The expensive similarity
    runs only for what the trigrams let through and, where tasks hold the
    catalog, only for what can still be among the best.
    """
    left, right = _forms(reads, catalog)
    index = _indexed(right)
    if index is not None:
        def best(read: str, grams: list[str]) -> list[tuple]:
            held = index.value
            return [(rank, held.ords[i], held.names[i], score) for rank, (i, score) in enumerate(held.best(read, grams, k, limit), 1)]

        return _asked(left, right, "rank int, ord {ord}, name string, score double", best, ["rank", "ord", "name", "score"]).drop("read")
    pairs = trigram_candidates(reads, catalog, limit)
    scored = pairs.withColumn("s", block_similarity(F.col("read"), F.col("entry")))
    scored = scored.withColumn("score", match_score(F.col("jac"), F.col("s.ratio"), F.col("s.common"), F.col("read"), F.col("entry")))
    w = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("jac"), "ord")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("key", "rank", "ord", "name", "score")


def levels_for(songs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Legal levels of songs (key, name, chart): key, levels.

    The first catalog row (ord, name, charts of struct type, level) with the
    same name or normal form counts. Levels of the wanted chart or of no chart
    count; none of them: all levels. Sorted, distinct; null for unknown songs.
    Levels are gathered once for each row and chart of the catalog; a song only
    looks them up, however many its row has.
    """
    wanted = songs.select("key", F.col("chart").alias("_chart"), normalize_match(F.col("name")).alias("_norm"))
    by_norm = Window.partitionBy("_norm").orderBy("ord")
    first = catalog.select(normalize_match(F.col("name")).alias("_norm"), "ord", "charts").withColumn("r", F.row_number().over(by_norm)).where("r = 1")  # equal names have equal normal forms
    levels = lambda charts: F.array_sort(F.array_distinct(F.transform(charts, lambda c: c["level"])))
    of_none = levels(F.filter("charts", lambda c: c["type"] == ""))
    rows = first.select("_norm", levels(F.col("charts")).alias("_all"), of_none.alias("_none"))
    each = first.select("_norm", F.explode("charts").alias("c")).where("c.type != ''")
    held = each.groupBy("_norm", F.col("c.type").alias("_chart")).agg(F.collect_set(F.struct("c.level")).alias("_own"))  # structs, as a set of values leaves out null
    # a catalog's arrays aren't seen in its size, so neither is broadcast by that
    found = wanted.join(held.hint("merge"), ["_norm", "_chart"], "left").join(rows.hint("merge"), "_norm", "left")
    own = F.array_sort(F.array_union(F.transform("_own", lambda c: c["level"]), F.col("_none")))
    used = F.when(F.col("_own").isNotNull(), own).when(F.col("_chart").isNotNull() & (F.size("_none") > 0), F.col("_none")).otherwise(F.col("_all"))
    return found.select("key", used.alias("levels"))


def charts_for(songs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Charts of songs (key, name): those of the first catalog row whose name or key has the same normal form; else none."""
    wanted = songs.select(F.col("key").alias("song"), normalize_match(F.coalesce("name", F.lit(""))).alias("norm"))
    forms = F.array_distinct(F.array(normalize_match(F.col("name")), normalize_match(F.col("key"))))
    entries = catalog.select("ord", "charts", F.explode(forms).alias("norm"))
    first = entries.groupBy("norm").agg(F.min_by("charts", "ord").alias("charts"))
    none = F.array().cast(catalog.schema["charts"].dataType)
    return wanted.join(first, "norm", "left").select(F.col("song").alias("key"), F.coalesce("charts", none).alias("charts"))
