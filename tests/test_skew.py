"""Slopes of text: edges, line votes and turning."""

import math

import numpy as np

from fieldglass.operators import skew
from tests.test_sweep import frame


def bars(angle, w=90, h=40):
    """Two bright bars that slope down to the right."""
    p = np.full((h, w), 20)
    t = math.tan(math.radians(angle))
    for y in range(h):
        for x in range(8, w - 8):
            for top in (10, 24):
                if 0 <= y - (top + (x - w / 2) * t) < 5:
                    p[y, x] = 220
    return p


def test_gradients_and_edges_by_hand(spark):
    step = np.array([[0, 0, 0, 200, 200, 200]] * 5)
    g = {(r["x"], r["y"]): r for r in skew.gradients(frame(spark, {"a": step})).collect()}
    assert (g[2, 2]["gx"], g[2, 2]["gy"], g[3, 0]["gx"], g[0, 0]["size"]) == (800, 0, 800, 0)
    assert {(r["x"], r["y"]) for r in skew.edges(frame(spark, {"a": step})).collect()} == {(2, y) for y in range(5)}  # one side of the step
    weak = step // 10  # slopes of 80: no strong edge to join
    assert skew.edges(frame(spark, {"a": weak})).count() == 0
    mixed = np.array([[0, 0, 0, 200, 200, 200]] * 3 + [[0, 0, 0, 20, 20, 20]] * 3)
    assert {r["y"] for r in skew.edges(frame(spark, {"a": mixed})).collect()} == set(range(6))  # the weak part hangs on the strong one


def test_angles_of_text_are_found_and_undone(spark):
    pictures = {str(a): bars(a) for a in (-4, -2, 0, 3)} | {"none": np.full((30, 60), 50)}
    widths = spark.createDataFrame([(k, p.shape[1], p.shape[0]) for k, p in pictures.items()], "key string, cols int, rows int")
    pixels = frame(spark, pictures)
    found = skew.text_angle(skew.edges(pixels), widths.select("key", "cols"))
    got = {r["key"]: r["angle"] for r in found.collect()}
    assert got["none"] == 0 and got["0"] == 0 and all(abs(got[str(a)] - a) <= 1 for a in (-4, -2, 3))
    level = skew.turned(pixels, found.join(widths, "key"))
    again = skew.text_angle(skew.edges(level), widths.select("key", "cols"))
    assert all(abs(r["angle"]) <= 1 for r in again.collect())
    assert level.count() == pixels.count()
