"""Vectors compressed to codes of their parts: integer codebooks by rounds, found by partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import columns_only, dropped, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Vectors whose distances are in memory together.
STRIPE = 1 << 14
#: Labels that are joined by broadcast: those of more than rows / HOT rows, so at most HOT.
HOT = 1000
#: Greatest long; a distance beyond it is told as this.
MOST = (1 << 63) - 1
_LIMB = 32


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly: 64-bit, or Python's integers where squares of differences may not fit.

    ``scale`` is a power of two, so a product is exact unless it leaves the doubles.
    """
    if not x.size or float(np.abs(x).max()) * scale < 2.0**24:
        return np.floor(x * scale).astype(np.int64)
    fits = lambda v: int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale))
    return np.array([fits(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def nearest(part: np.ndarray, book: np.ndarray, hint: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``book`` for each row of ``part`` and its squared distance; ties go to the lower index.

    Partial-distance search: components are taken in descending variance of the
    codebook, the rows of a mask go on while what they have gathered doesn't
    exceed the best distance that is known in full, and the rest are dropped.
    ``hint`` is an entry for each row whose distance is known first.
    """
    if object in (part.dtype, book.dtype):
        part, book = part.astype(object), book.astype(object)
    order = np.argsort(-np.array([float(np.var(c.astype(float))) for c in book.T]), kind="stable")
    rows, book = part[:, order], book[:, order]
    at = np.zeros(len(rows), np.int64) if hint is None else hint.astype(np.int64)
    gap = rows - book[at]
    best = (gap * gap).sum(axis=1)
    for entry, centre in enumerate(book):
        left = np.flatnonzero(at != entry)
        gathered = np.zeros(len(left), dtype=rows.dtype)
        for k, c in enumerate(centre):
            gap = rows[left, k] - c
            gathered = gathered + gap * gap
            alive = gathered <= best[left]
            if not alive.all():
                left, gathered = left[alive], gathered[alive]
            if not len(left):
                break
        nearer = (gathered < best[left]) | (entry < at[left])
        left, gathered = left[nearer], gathered[nearer]
        at[left], best[left] = entry, gathered
    return at, best


def _encode(x: np.ndarray, books: list[np.ndarray], hint: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Entries (rows x parts) and the distances' sums of vectors (rows x components)."""
    found = [nearest(part, book, None if hint is None else hint[:, i]) for i, (part, book) in enumerate(zip(np.split(x, len(books), axis=1), books))]
    return np.stack([a for a, _ in found], axis=1), sum(d for _, d in found)


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, STRIPE):
            part = b.slice(at, STRIPE)
            yield part, np.frombuffer(b"".join(part.column("x").to_pylist()), np.float64).reshape(-1, width)


def finite(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None) -> DataFrame:
    """Rows (id, label, dim, x): components as packed doubles, without vectors that are null or empty or hold null or no finite number."""
    label = F.lit(None).cast("int") if label_col is None else F.col(f"`{label_col}`")
    rows = columns_only(vectors, id_col, vec_col, *([label_col] if label_col else [])).select(
        F.col(f"`{id_col}`").alias("id"), label.alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")
    ).where("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, c -> c IS NULL OR isnan(c) OR abs(c) = double('Infinity'))")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            values = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            length = np.asarray(v.value_lengths())
            start = np.concatenate([[0], np.cumsum(length)])
            packed = [values[p:q].tobytes() for p, q in zip(start[:-1], start[1:])]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(length, pa.int32()), pa.array(packed, pa.binary())], names=["id", "label", "dim", "x"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, dim int, x binary")


def _limbs(sums: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Integers of any size as 32-bit digits, of which the last holds the sign, so that Spark can add them up."""
    out, k = [], 0
    while True:
        rest = sums >> _LIMB
        if k and bool(np.all((sums == 0) | (sums == -1))):
            return [*out, (k, sums.astype(np.int64))]
        out.append((k, (sums & ((1 << _LIMB) - 1)).astype(np.int64)))
        sums, k = rest, k + 1


def _moved(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Codebooks after one round: each entry the floor of its parts' mean; unused entries stay.

    Each task adds up its rows; what meets is a sum for each component and
    entry, whatever the number of rows.
    """
    entries, parts = len(books[0]), len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width // parts), dtype=object)
        count = np.zeros((parts, entries), np.int64)
        for _, x in _batches(batches, width):
            v = whole_numbers(x, SCALE)
            codes, _ = _encode(v, books, None)
            for i, part in enumerate(np.split(v, parts, axis=1)):
                for e in np.unique(codes[:, i]):
                    mine = codes[:, i] == e
                    sums[i, e] += part[mine].sum(axis=0).astype(object)
                    count[i, e] += int(mine.sum())
        if not count.any():
            return
        cell = np.arange(sums.size)
        columns = [np.concatenate(c) for c in zip(*[(cell, np.full(sums.size, k), digits.ravel()) for k, digits in _limbs(sums)])]
        columns = [np.concatenate([c, d]) for c, d in zip(columns, (np.arange(count.size), np.full(count.size, -1), count.ravel()))]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["cell", "limb", "n"])

    found = rows.select("x").mapInArrow(run, "cell long, limb int, n long").groupBy("cell", "limb").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(parts * entries * (width // parts), dtype=object)
    count = np.zeros(parts * entries, dtype=object)
    for r in found:
        if r["limb"] < 0:
            count[r["cell"]] += r["n"]
        else:
            sums[r["cell"]] += r["n"] << (_LIMB * r["limb"])
    sums, count = sums.reshape(parts, entries, -1), count.reshape(parts, entries)
    moved = [np.array([[int(s) // int(n) for s in sums[i, e]] if (n := count[i, e]) else book[e].tolist() for e in range(entries)], dtype=object) for i, book in enumerate(books)]
    return [m.astype(np.int64) if m.size and max(abs(c) for c in m.ravel()) < SCALE << 12 else m for m in moved]


def _label_errors(rows: DataFrame) -> DataFrame:
    """Each row with the errors of its label added up; labels that many rows share are told by broadcast, the others by a shuffle."""
    total = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("e"), F.count(F.lit(1)).alias("n"))
    total = written(total.select("label", F.least(F.col("e"), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"), "n"))
    many = total.agg(F.sum("n")).first()[0] or 0
    hot = total.where(F.col("n") > many // HOT).drop("n").withColumnRenamed("label", "_label")
    cold = total.where(F.col("n") <= many // HOT).drop("n").withColumnRenamed("label", "_label")
    same = F.col("label").eqNullSafe(F.col("_label"))
    told = rows.join(F.broadcast(hot), same, "left")
    if not cold.limit(1).count():
        return told.drop("_label")
    rest = rows.join(F.broadcast(hot.select("_label")), same, "left_anti").join(cold, same)
    return told.where("label_error IS NOT NULL").drop("_label").unionByName(rest.drop("_label"))


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | None = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """A code for each vector: id, code, error, label_error, codebooks_sha256.

    Components become floor(4096 * x); vectors are cut into ``parts`` equal
    parts. Each part has a codebook, which begins as that part of the vectors
    with the ``entries`` (at most 256) smallest ids, ascending; every round
    assigns each part to its nearest entry and moves each entry to the floor
    of its parts' mean. Codebooks, a few thousand numbers whatever the input,
    are broadcast; each round reads the vectors once and adds up a sum for
    each component of each entry.

    Vectors that are null or empty or hold a null or non-finite component take
    no part, nor do those of another length than the one with the smallest id.
    A length that ``parts`` doesn't divide is filled up with zeros. With fewer
    than ``entries`` vectors there are as many entries. Ties of ids are
    ordered by the vector; null ids come last, and keep their rows. Repeated
    rows count each. Arithmetic is exact whatever the size of the components;
    an error beyond 64 bits is told as the greatest long. Equal labels share
    their ``label_error``, nulls together. An empty table gives no row. Other
    columns are ignored.
    """
    all_rows = written(finite(vectors, id_col, vec_col, label_col))
    first = [F.col("id").asc_nulls_last(), F.hex("x"), F.col("dim")]
    head = all_rows.orderBy(*first).select("dim").first()
    dim = head["dim"] if head else parts
    width = -(-dim // parts) * parts
    rows = all_rows.where(F.col("dim") == dim)
    if width > dim:
        rows = rows.withColumn("x", F.concat("x", F.lit(bytes(8 * (width - dim)))))
    begin = np.frombuffer(b"".join(r["x"] for r in rows.orderBy(*first).select("x").limit(entries).collect()), np.float64).reshape(-1, width)
    books = np.split(whole_numbers(begin, SCALE), parts, axis=1)
    for _ in range(rounds if len(begin) else 0):
        books = _moved(rows, books, width)
    digest = hashlib.sha256(",".join(str(int(c)) for book in books for entry in book for c in entry).encode()).hexdigest()
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _batches(batches, width):
            codes, error = _encode(whole_numbers(x, SCALE), books, None)
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * parts
            names = [text[i : i + step] for i in range(0, len(text), step)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(names, pa.string()), pa.array([min(int(e), MOST) for e in error], pa.int64())], names=["id", "label", "code", "error"])

    coded = written(rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long"))
    dropped(all_rows)
    return _label_errors(coded).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
