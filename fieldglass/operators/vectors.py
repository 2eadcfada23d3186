"""Feature vectors against template banks and neighbours.

A small bank of templates goes whole to the rows. Otherwise rows and bank meet in tiles: a block of rows and a shard of the bank in one
task, which multiplies them as matrices and hands on its best. A bank of any
size gives the same result; a shard is bounded, and so is a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the bank and of the other side in a tile, about.
SHARD, BLOCK = 8192, 16384
#: Rows that a tile multiplies at a time.
STRIP = 256
#: Rows of a bank that goes whole to every task.
FEW = 4096
MIN_VOTES = 0.6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column) -> Column:
    """A vector of length 1; the zero vector stays."""
    by = F.array(F.sqrt(dot(v, v)))  # worked out once, not for each component
    return F.transform(by, lambda norm: F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v))[0]


def _tiled(rows: DataFrame, bank: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` for each tile; rows go to every shard and the bank to every block, hashed by vector."""
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((bank, SHARD), (rows, BLOCK)))
    spread = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("vec"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = spread(rows, "block", blocks, "shard", shards), spread(bank, "shard", shards, "block", blocks)
    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(work, schema)


def _matrix(t: pa.Table) -> np.ndarray:
    vec = t.column("vec").combine_chunks()
    return vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)


def class_similarities(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """Rows (id, vec) against a bank (label, vec): id, label, sim, the highest of each label."""
    id_type, label_type = (df.schema[c].dataType.simpleString() for df, c in ((rows, "id"), (bank, "label")))

    def best(t: pa.Table, b: pa.Table) -> pa.Table:
        if not t.num_rows or not b.num_rows:
            return pa.table({"id": t.column("id").slice(0, 0), "label": b.column("label").slice(0, 0), "sim": pa.array([], pa.float64())})
        b = b.sort_by("label")
        codes = b.column("label").combine_chunks().dictionary_encode()
        first = np.flatnonzero(np.diff(codes.indices.to_numpy(), prepend=-1))
        x, y = _matrix(t), _matrix(b).T
        sims = [np.maximum.reduceat(x[at : at + STRIP] @ y, first, axis=1) for at in range(0, len(x), STRIP)]
        ids = t.column("id").combine_chunks().take(pa.array(np.repeat(np.arange(len(x)), len(first))))
        labels = codes.dictionary.take(pa.array(np.tile(np.arange(len(first)), len(x))))
        return pa.table({"id": ids, "label": labels, "sim": pa.array(np.concatenate(sims).ravel())})

    schema = f"id {id_type}, label {label_type}, sim double"
    rows, bank = rows.select("id", "vec"), bank.select("label", "vec")
    if bank.limit(FEW + 1).count() <= FEW:  # a small bank goes to the rows
        held = bank.toArrow()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from best(pa.Table.from_batches([b]), held).to_batches()

        found = rows.mapInArrow(run, schema)
    else:
        found = _tiled(rows, bank, best, schema)
    return found.groupBy("id", "label").agg(F.max("sim").alias("sim"))


def classify(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """Best label, its similarity, and the margin to the next label (not below 0): id, label, sim, margin.

    Similarities are compared at nine decimals, so that the order of a sum
    doesn't decide; equals go to the smaller label.
    """
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "label")
    ranked = class_similarities(rows, bank).withColumn("sim", F.round("sim", 9)).withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("sim").over(w))
    return ranked.where("rank = 1").select("id", "label", "sim", (F.col("sim") - F.greatest(F.coalesce("next", F.lit(-1.0)), F.lit(0.0))).alias("margin"))


def digit_scores(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """Ten slots of best similarity by digit, -1 where the bank lacks it: id, scores."""
    by_digit = F.map_from_entries(F.collect_list(F.struct("label", "sim")))
    return class_similarities(rows, bank).where("label BETWEEN 0 AND 9").groupBy("id").agg(by_digit.alias("m")).select(
        "id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(-1.0))).alias("scores")
    )


def nearest(rows: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of a bank (idx, label, vec) nearest to each row (id, vec) by L1 distance: id, rank, idx, label, d.

    Equal distances rank by the bank's index. Each tile hands on its ``k``.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((rows, "id"), (bank, "idx"), (bank, "label"))}

    def near(t: pa.Table, b: pa.Table) -> pa.Table:
        row, place, dist = [], [], []
        if t.num_rows and b.num_rows:
            b = b.sort_by("idx")
            x, y = _matrix(t), _matrix(b)
            for i in range(len(x)):
                d = np.abs(x[i] - y).sum(axis=1)
                at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                at = at[np.argsort(d[at], kind="stable")][:k]
                row.append(np.full(len(at), i))
                place.append(at)
                dist.append(d[at])
        flat = lambda v, kind: np.concatenate(v).astype(kind) if v else np.zeros(0, kind)
        take = lambda c, of, at: of.column(c).combine_chunks().take(pa.array(flat(at, np.int64)))
        return pa.table({"id": take("id", t, row), "idx": take("idx", b, place), "label": take("label", b, place), "d": pa.array(flat(dist, np.float64))})

    schema = ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", d double"
    found = _tiled(rows.select("id", "vec"), bank.select("idx", "label", "vec"), near, schema)
    by = Window.partitionBy("id").orderBy("d", "idx")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def knn_vote(rows: DataFrame, bank: DataFrame, k: int = 5, least: float = MIN_VOTES) -> DataFrame:
    """Majority label among the ``k`` nearest by L1 distance: id, label, conf; rows without a majority go.

    Equal distances rank by the bank's index, equal votes by the smaller label.
    """
    counted = nearest(rows, bank, k).groupBy("id", F.col("label").alias("y")).agg(F.count(F.lit(1)).alias("votes"))
    top = Window.partitionBy("id").orderBy(F.desc("votes"), "y")
    best = counted.withColumn("rank", F.row_number().over(top)).where("rank = 1")
    return best.select("id", F.col("y").alias("label"), (F.col("votes") / k).alias("conf")).where(F.col("conf") >= least)
