"""Exact top-k search: tiled products of query blocks and shards, merged as a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import columns_only, written

SCALE = 1024
#: Rows of a tile: queries and candidates. A task holds one tile.
BLOCK_ROWS = 2048
SHARD_ROWS = 16384
#: Candidates below which a further shard doesn't pay.
LEAST_ROWS = 512
#: Queries whose products are in memory together.
STRIPE = 64


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, dim, v): floor(1024 * x) of each component as packed 64-bit integers.

    Rows without an id, and vectors that are null or empty or hold a null or
    non-finite component, are left out.
    """
    rows = columns_only(vectors, id_col, vec_col).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x")
    ).where("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1)
            flat = x.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes nan
            length = np.asarray(x.value_lengths())
            start = np.concatenate([[0], np.cumsum(length)])
            good = np.add.reduceat(~np.isfinite(values), start[:-1]) == 0
            whole = np.floor(np.where(np.isfinite(values), values, 0.0) * SCALE).astype(np.int64)
            packed = [whole[start[i] : start[i + 1]].tobytes() for i in np.flatnonzero(good)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(good)), pa.array(length[good].astype(np.int32)), pa.array(packed, pa.binary())],
                names=["id", "dim", "v"],
            )

    return rows.mapInArrow(run, "id long, dim int, v binary")


def _matrix(t: pa.Table) -> np.ndarray:
    dim = t.column("dim")[0].as_py()
    return np.frombuffer(b"".join(t.column("v").to_pylist()), dtype=np.int64).reshape(-1, dim)


def _tile(queries: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    """The k best candidates of the shard for each query of the block."""
    out: list[np.ndarray] = []
    if queries.num_rows and shard.num_rows:
        q, c = _matrix(queries), _matrix(shard)
        qid, cid = queries.column("id").to_numpy(), shard.column("id").to_numpy()
        exact = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0**53
        right = (c.astype(np.float64) if exact else c).T
        for at in range(0, len(q), STRIPE):
            part = q[at : at + STRIPE]
            scores = ((part.astype(np.float64) if exact else part) @ right).astype(np.int64)
            for i, row in enumerate(scores):
                other = np.flatnonzero(cid != qid[at + i])
                if not len(other):
                    continue
                s = row[other]
                if len(s) > k:  # all that reach the k-th score, so that ties are settled by id
                    pick = s >= np.partition(s, len(s) - k)[len(s) - k]
                    other, s = other[pick], s[pick]
                order = np.lexsort((cid[other], -s))[:k]
                out.append(np.stack([np.full(len(order), qid[at + i]), cid[other[order]], s[order]]))
    found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})


def top_k(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 10,
) -> DataFrame:
    """Each query's ``k`` best rows by integer inner product: query_id, rank, vec_id, score.

    ``queries`` has the columns of ``vectors``; without it the rows whose id
    is divisible by 100 are asked. Every row of ``vectors`` is a candidate for
    every query but the one with its own id; ties go to the smaller id.
    Shards of candidates meet blocks of queries in tiles of bounded size (each
    shard travels once for each block, each block once for each shard); every
    tile keeps k candidates for a query, which are merged in two levels.

    Vectors that are null, empty or hold a null or non-finite component, and
    rows without an id, take no part. Only vectors of the same length are
    compared. Repeated rows are candidates each; a repeated query id is asked
    once. Fewer than k candidates give them all, an empty table no row.
    Scores are exact while they fit 64 bits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    all_rows = written(quantised(vectors, id_col, vec_col))
    asked = all_rows.where("id % 100 = 0") if queries is None else quantised(queries, id_col, vec_col)
    asked = written(asked.groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select("id", "x.dim", "x.v"))
    rows, q = all_rows.count(), asked.count()
    wide = 3 * spark.sparkContext.defaultParallelism
    shards = max(1, -(-rows // SHARD_ROWS), min(-(-rows // LEAST_ROWS), wide))
    blocks = max(1, -(-q // BLOCK_ROWS))
    left = asked.select(
        "id", "dim", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    right = all_rows.select(
        "id", "dim", "v", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    tile = ["dim", "shard", "block"]

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        found = _tile(a, b, k)
        return found.append_column("branch", pa.array(np.full(found.num_rows, key[1].as_py() // fan), pa.int32()))

    fan = max(1, int(shards**0.5))
    lists = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(
        run, "query_id long, vec_id long, score long, branch int"
    )
    best = [F.desc("score"), F.asc("vec_id")]
    for by in (["query_id", "branch"], ["query_id"]):
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
