"""Glyph vectors, resampling and threshold sweeps against plain loops over small pictures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import resample, sweep, vectors

#: Seven rows of five pixels for each digit.
FONT = {
    "0": "01110 10001 10011 10101 11001 10001 01110", "1": "00100 01100 00100 00100 00100 00100 01110", "2": "01110 10001 00001 00110 01000 10000 11111",
    "3": "01110 10001 00001 00110 00001 10001 01110", "4": "00010 00110 01010 10010 11111 00010 00010", "5": "11111 10000 11110 00001 00001 10001 01110",
    "6": "00110 01000 10000 11110 10001 10001 01110", "7": "11111 00001 00010 00100 01000 01000 01000", "8": "01110 10001 10001 01110 10001 10001 01110",
    "9": "01110 10001 10001 01111 00001 00010 01100",
}


def drawn(text, scale, pad=3):
    """Gray values of a text: bright on dark."""
    art = [np.kron(np.array([[int(c) for c in row] for row in FONT[d].split()]), np.ones((scale, scale), int)) for d in text]
    gap = np.zeros((7 * scale, scale), int)
    line = np.concatenate([x for a in art for x in (a, gap)], axis=1)
    return np.pad(line, pad) * 190 + 30


def rows(key, picture):
    return [(key, x, y, int(v)) for y, line in enumerate(picture) for x, v in enumerate(line)]


def frame(spark, pictures):
    return spark.createDataFrame([r for k, p in pictures.items() for r in rows(k, p)], "key string, x int, y int, gray int")


def covered(n, m, both):
    """Shares by which target cells cover source cells, the plain way."""
    out = np.zeros((m, n))
    for t in range(m):
        if both or m >= n:
            for s in range(n):
                out[t, s] = max(0, min((t + 1) * n, (s + 1) * m) - max(t * n, s * m)) / n
        else:
            s = math.floor(t * n / m)
            part = (t + 1) - (s + 1) * m / n
            part = 0 if part <= 0 else part - math.floor(part)
            out[t, s] += 1 - part
            out[t, min(s + 1, n - 1)] += part
    return out


def half_even(x):
    return int(np.rint(round(x, 9)))


def glyph(mask, box, line=None):
    x, y, w, h = box
    if line is None:
        th, down = 32, 0
        tw = max(1, min(24, half_even(32 * (w / h))))
    else:
        th = max(1, half_even(32 * h / line[1]))
        tw = max(1, min(24, half_even(th * w / h)))
        down = max(0, min(32 - th, half_even(32 * (y - line[0]) / line[1])))
    both = w >= tw and h >= th
    small = covered(h, th, both) @ (mask[y : y + h, x : x + w] * 255.0) @ covered(w, tw, both).T
    out = np.zeros((32, 24))
    out[down : down + th, (24 - tw) // 2 : (24 - tw) // 2 + tw] = np.rint(np.round(small, 9))
    return out.ravel()


def test_glyph_vectors(spark):
    rng = np.random.default_rng(3)
    mask = rng.random((90, 120)) < 0.5
    boxes = [(0, 0, 9, 20), (10, 5, 60, 50), (70, 0, 30, 85), (3, 60, 1, 1), (20, 70, 40, 12), (100, 20, 14, 32), (60, 60, 10, 30)]
    points = spark.createDataFrame([("a", 0, int(x), int(y)) for y, x in zip(*np.nonzero(mask))], "key string, cut int, x int, y int")
    b = spark.createDataFrame([("a", 0, i, *r) for i, r in enumerate(boxes)], "key string, cut int, place int, x int, y int, w int, h int")
    top, low = min(r[1] for r in boxes), max(r[1] + r[3] for r in boxes)
    for in_line in (False, True):
        got = {r["place"]: r["vec"] for r in resample.glyph_vectors(b, points, ["key", "cut", "place"], in_line).collect()}
        for i, r in enumerate(boxes):
            assert got[i] == glyph(mask, r, (top, low - top) if in_line else None).tolist(), (in_line, r)
    # by hand: a full square of 2 x 2 becomes 24 x 32 of 255 (no wider than it may be)
    two = spark.createDataFrame([("b", 0, 0, 0), ("b", 0, 1, 0), ("b", 0, 0, 1), ("b", 0, 1, 1)], points.schema)
    assert set(resample.glyph_vectors(spark.createDataFrame([("b", 0, 0, 0, 0, 2, 2)], b.schema), two, ["key", "cut", "place"]).first()["vec"]) == {255.0}
    empty = resample.glyph_vectors(spark.createDataFrame([("z", 0, 0, 0, 0, 2, 2)], b.schema), two, ["key", "cut", "place"]).first()
    assert set(empty["vec"]) == {0.0} and len(empty["vec"]) == 768


def test_resampled(spark):
    rng = np.random.default_rng(4)
    pictures = {"a": rng.integers(0, 256, (9, 14)), "b": rng.integers(0, 256, (6, 5)), "c": np.full((3, 3), 77)}
    sizes = {"a": (7, 4), "b": (20, 24), "c": (2, 12)}
    table = spark.createDataFrame([(k, p.shape[1], p.shape[0], *sizes[k]) for k, p in pictures.items()], "key string, width int, height int, to_width int, to_height int")
    got = {}
    for r in resample.resampled(frame(spark, pictures), table).collect():
        got[r["key"], r["x"], r["y"]] = r["gray"]
    for k, p in pictures.items():
        tw, th = sizes[k]
        both = p.shape[1] >= tw and p.shape[0] >= th
        want = np.rint(np.round(covered(p.shape[0], th, both) @ p @ covered(p.shape[1], tw, both).T, 9))
        assert all(got[k, x, y] == want[y, x] for y in range(th) for x in range(tw))
    assert len(got) == sum(w * h for w, h in sizes.values())
    # by hand: cubic enlargement keeps a flat picture, and a step overshoots within 0 to 255
    step = {"s": np.array([[0, 0, 0, 200, 200, 200]] * 2), "f": np.full((2, 2), 9)}
    table = spark.createDataFrame([("s", 6, 2, 24, 8), ("f", 2, 2, 8, 8)], table.schema)
    found = {(r["key"], r["x"], r["y"]): r["gray"] for r in resample.resampled(frame(spark, step), table, "cubic").collect()}
    assert {v for k, v in found.items() if k[0] == "f"} == {9}
    line = [found["s", x, 3] for x in range(24)]
    assert line[:8] == [0] * 8 and line[16:] == [200] * 4 + [200] * 4 or max(line) > 200
    assert line[11] + line[12] == 200 and min(line) >= 0


def labelled(mask):
    """Components by filling, in the order of their first pixel."""
    left = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}
    out = []
    for start in sorted(left):
        if start not in left:
            continue
        left.discard(start)
        heap, mine = [start], [start]
        while heap:
            y, x = heap.pop()
            for near in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if near in left:
                    left.discard(near)
                    heap.append(near)
                    mine.append(near)
        ys, xs = [p[0] for p in mine], [p[1] for p in mine]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(mine), mine))
    return out


def test_threshold_components_are_each_cut_by_itself(spark):
    rng = np.random.default_rng(5)
    pictures = {str(i): rng.integers(0, rng.choice([3, 20, 256]), (rng.integers(1, 15), rng.integers(1, 25))) for i in range(12)}
    cuts = [(k, c, int(t), bool(d)) for k in pictures for c, (t, d) in enumerate([(1, False), (10, False), (1, True), (128, False), (10, True), (300, False), (-1, False), (-1, True), (1, False)])]
    got = {}
    table = spark.createDataFrame(cuts, "key string, cut int, threshold int, dark boolean")
    twice = frame(spark, pictures).unionByName(frame(spark, {"0": pictures["0"] // 2}))  # of repeated pixels the brightest count
    for r in sweep.threshold_components(twice, table).collect():
        got.setdefault((r["key"], r["cut"]), []).append(r)
    for k, c, t, dark in cuts:
        p = pictures[k]
        want = labelled((p <= t) if dark else (p > t))
        mine = sorted(got.pop((k, c), []), key=lambda r: r["ord"])
        assert [tuple(r[n] for n in ("x", "y", "w", "h", "area")) for r in mine] == [w[:5] for w in want]
        assert all(abs(r["bright"] - np.mean([p[y, x] for y, x in w[5]])) < 1e-9 for r, w in zip(mine, want))
    assert not got


@pytest.fixture(scope="module")
def bank(spark):
    pictures = {d: drawn(d, 3) for d in FONT}
    pixels = frame(spark, pictures)
    cuts = sweep.score_cuts(pixels).where("cut = 0")
    found = resample.glyph_vectors(sweep.digit_sweep(pixels, cuts), sweep.cut_mask(pixels, cuts), ["key", "cut", "place"])
    return found.select(F.col("key").cast("int").alias("label"), vectors.normalised(F.col("vec")).alias("vec"))


def test_scores_are_read_from_pixels(spark, bank):
    bonus = drawn("987650", 4, 6)
    bonus[-5:, :60] = 220  # a low bar below the digits
    dim = drawn("0123456", 4)
    dim[:, :23] = np.where(dim[:, :23] > 100, 90, 30)  # a dim leading zero
    pictures = {"plain": drawn("765432", 4), "bar": bonus, "million": drawn("1000000", 5), "dim": dim, "light": 255 - drawn("4455", 4), "flat": np.full((2, 9), 7), "two": drawn("42", 4)}
    got = {r["key"]: r for r in sweep.score_from_pixels(frame(spark, pictures), bank).collect()}
    assert {k: r["score"] for k, r in got.items()} == {"plain": 765432, "bar": 987650, "million": 1000000, "dim": 123456, "light": 4455, "flat": -1, "two": 42}
    assert got["plain"]["digits"] == "765432" and got["plain"]["margin"] == min(got["plain"]["margins"]) > 0.01
    assert got["plain"]["cut"] == 0 and got["flat"]["digits"] == "" and got["flat"]["margin"] == 0.0


def test_titles(spark):
    pictures = {"t": drawn("2468", 4)}
    sizes = spark.createDataFrame([("t", pictures["t"].shape[0], pictures["t"].shape[1])], "key string, rows int, cols int")
    found = sweep.title_sweep(frame(spark, pictures), sizes).collect()
    assert {r["rank"] for r in found} == {1} and len(found) == 4  # all cuts read the same glyphs
    assert [r["x"] for r in sorted(found, key=lambda r: r["place"])] == [3 + 24 * i for i in range(4)]
    assert all(len(r["vec"]) == 768 and max(r["vec"]) == 255 for r in found)


def test_small_banks_give_what_tiles_give(spark, monkeypatch):
    rng = random.Random(2)
    vec = lambda: [rng.random() for _ in range(6)]
    rows_ = spark.createDataFrame([(i, vec()) for i in range(40)], "id int, vec array<double>")
    bank_ = spark.createDataFrame([(i % 5, vec()) for i in range(30)], "label int, vec array<double>")
    read = lambda: sorted((r["id"], r["label"], round(r["sim"], 9), round(r["margin"], 8)) for r in vectors.classify(rows_, bank_).collect())
    small = read()
    monkeypatch.setattr(vectors, "FEW", 3)
    assert small == read() and len(small) == 40
