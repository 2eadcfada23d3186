"""Outlines, hulls, rectangles, quadrilaterals, warping and the passes of detection."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from fieldglass.functions.geometry import box, map_back
from fieldglass.operators import flow, screens
from tests.test_sweep import frame

KEYED = "key string, x int, y int"


def test_outline_by_hand():
    square = {(x, y) for x in range(4) for y in range(3)}
    line = screens.outline(square, (0, 0))
    assert len(line) == 10 and screens.enclosed(line) == 6.0  # between the middles of pixels
    assert screens.outline({(5, 5)}, (5, 5)) == [(5, 5)] and screens.enclosed([(5, 5)]) == 0
    thin = screens.outline({(0, 0), (1, 1), (2, 2)}, (0, 0))
    assert thin == [(0, 0), (1, 1), (2, 2), (1, 1)] and screens.enclosed(thin) == 0
    ring = square | {(x, y) for x in range(9) for y in range(9)} - {(4, 4), (4, 5), (5, 4)}
    assert screens.enclosed(screens.outline(ring, (0, 0))) == 64.0  # a hole doesn't count


def inside_filled(points):
    """Pixels of a component with its holes, by filling from outside."""
    x0, x1 = min(p[0] for p in points) - 1, max(p[0] for p in points) + 1
    y0, y1 = min(p[1] for p in points) - 1, max(p[1] for p in points) + 1
    out, heap = {(x0, y0)}, [(x0, y0)]
    while heap:
        x, y = heap.pop()
        for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if x0 <= n[0] <= x1 and y0 <= n[1] <= y1 and n not in out and n not in points:
                out.add(n)
                heap.append(n)
    return {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)} - out


def test_outlines_go_round_the_component():
    rng = random.Random(4)
    for _ in range(80):
        points, p = set(), (10, 10)
        for _ in range(rng.randint(1, 60)):
            points.add(p)
            p = (p[0] + rng.choice((-1, 0, 1)), p[1] + rng.choice((-1, 0, 1)))
        start = min(points, key=lambda q: (q[1], q[0]))
        line = screens.outline(points, start)
        assert set(line) <= points and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(line, line[1:] + line[:1]) if len(line) > 1)
        full = inside_filled(points)
        edge = {q for q in full if any((q[0] + dx, q[1] + dy) not in full for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))}
        assert edge == set(line)  # all pixels at the outside, and those alone


def test_hulls_rectangles_and_simple_lines():
    rng = random.Random(5)
    for _ in range(100):
        points = [(rng.randint(0, 12), rng.randint(0, 9)) for _ in range(rng.randint(1, 25))]
        corners = screens.hull(points)
        for a, b in zip(corners, corners[1:] + corners[:1]):
            if len(corners) > 2:
                assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for p in points)
        assert set(corners) <= set(points)
        cx, cy, a, b, angle, four = screens.smallest_rectangle(corners)
        turns = [math.radians(d / 2) for d in range(180)]
        spread = lambda t, s: max(p[0] * math.cos(t) + p[1] * math.sin(t) for p in s) - min(p[0] * math.cos(t) + p[1] * math.sin(t) for p in s)
        assert a * b <= min(spread(t, points) * spread(t + math.pi / 2, points) for t in turns) + 1e-6 and 0 <= angle < 90
        assert abs(cx - sum(p[0] for p in four) / 4) < 1e-9 and abs(cy - sum(p[1] for p in four) / 4) < 1e-9
    noisy = [(0, 0), (5, -0.3), (10, 0), (10.2, 4), (10, 8), (5, 8.2), (0, 8)]
    assert sorted(screens.simplified([(float(x), float(y)) for x, y in noisy], 0.02 * 36)) == [(0.0, 0.0), (0.0, 8.0), (10.0, 0.0), (10.0, 8.0)]
    assert screens.simplified([(1.0, 1.0)], 3) == [(1.0, 1.0)]
    assert round(screens.smallest_rectangle([(0, 0), (3, 3), (0, 6), (-3, 3)])[4]) == 45


def photo(corners, width=200, height=150):
    """A bright quadrilateral on dark, with a mark in it."""
    p = np.full((height, width), 20)
    c = np.array(corners, float)
    for y in range(height):
        for x in range(width):
            side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(c, np.roll(c, -1, axis=0))]
            if min(side) >= 0:
                p[y, x] = 220
    return p


def test_screens_are_found_and_made_upright(spark):
    corners = [(40, 30), (160, 42), (150, 118), (36, 104)]
    tilted = photo(corners)
    tilted[60:75, 80:110] = 120
    pictures = {"s": tilted, "dark": np.full((150, 200), 20), "small": photo([(90, 60), (120, 60), (120, 90), (90, 90)])}
    boxes = spark.createDataFrame([("s", 36, 30, 160, 118, 200, 150), ("dark", 36, 30, 160, 118, 200, 150), ("small", 20, 20, 180, 130, 200, 150), ("s2", 0, 0, 30, 30, 200, 150)],
                                  "key string, x1 int, y1 int, x2 int, y2 int, width int, height int")
    pixels = frame(spark, pictures)
    found = {r["key"]: r for r in screens.screen_quads(pixels, boxes).collect()}
    assert set(found) == {"s"}  # neither a dark photo, a small bright part nor a small box is a screen
    assert np.abs(np.array(found["s"]["quad"]).reshape(4, 2) - corners).max() < 3
    assert 115 < found["s"]["width"] < 125 and 70 < found["s"]["height"] < 82
    maps = spark.createDataFrame([found["s"]])
    upright = {(r["x"], r["y"]): r["gray"] for r in screens.warped(pixels, maps).collect()}
    w, h = int(found["s"]["width"]), int(found["s"]["height"])
    assert len(upright) == w * h
    assert np.mean([v > 100 for v in upright.values()]) > 0.97  # the screen fills its picture
    mark = [p for p, v in upright.items() if 100 < v < 140 and 4 < p[0] < w - 5 and 4 < p[1] < h - 5]
    back = maps.select(map_back(box(*(F.lit(f([p[i] for p in mark])) for f, i in ((min, 0), (min, 1), (max, 0), (max, 1)))), F.col("h")).alias("b")).first()["b"]
    assert abs(back["x1"] - 80) <= 4 and abs(back["y1"] - 60) <= 6 and abs(back["x2"] - 109) <= 4 and abs(back["y2"] - 74) <= 6


def test_tilts(spark):
    pictures = {"straight": photo([(30, 30), (170, 30), (170, 110), (30, 110)]), "turned": photo([(60, 20), (180, 64), (150, 140), (30, 96)]), "none": photo([(90, 60), (110, 60), (110, 70), (90, 70)])}
    got = {r["key"]: r["tilt"] for r in screens.screen_tilts(frame(spark, pictures)).collect()}
    assert got["straight"] == 0 and got["none"] == 0 and 18 < got["turned"] < 23


def test_warp_by_hand(spark):
    p = np.array([[0, 100, 200], [50, 150, 250]])
    h = lambda *m: [float(x) for x in m]
    maps = spark.createDataFrame([("same", 3, 2, h(1, 0, 0, 0, 1, 0, 0, 0, 1)), ("half", 2, 1, h(1, 0, 0.5, 0, 1, 0.5, 0, 0, 1)), ("out", 1, 1, h(1, 0, -0.5, 0, 1, 0, 0, 0, 1)), ("none", 1, 1, h(0, 0, 0, 0, 0, 0, 0, 0, 0))],
                                 "key string, width int, height int, h array<double>")
    got = {(r["key"], r["x"], r["y"]): r["gray"] for r in screens.warped(frame(spark, {k: p for k in ("same", "half", "out", "none")}), maps).collect()}
    assert all(got["same", x, y] == p[y, x] for x in range(3) for y in range(2))
    assert got["half", 0, 0] == 75 and got["half", 1, 0] == 175 and got["out", 0, 0] == 0 and got["none", 0, 0] == 0


DET = "key string, pass string, turn int, part int, ord int, cls int, conf double, x1 int, y1 int, x2 int, y2 int"


def test_detection_flow(spark):
    """What each pass is asked, and which boxes are left."""
    told = [
        ("far", "upright", 0, 0, 0, 1, 0.9, 100, 100, 200, 180), ("far", "upright", 0, 0, 1, 4, 0.3, 110, 102, 150, 110), ("far", "upright", 0, 0, 2, 3, 0.5, 120, 150, 160, 170),
        ("far", "zoom", 0, 0, 0, 4, 0.8, 16, 8, 90, 20), ("far", "zoom", 0, 0, 1, 1, 0.9, 6, 4, 106, 84),
        ("near", "upright", 0, 0, 0, 1, 0.9, 10, 10, 390, 290), ("near", "upright", 0, 0, 1, 3, 0.4, 50, 50, 90, 70),
        ("near", "turned", 1, 0, 0, 1, 0.99, 0, 0, 50, 50), ("near", "zoom", 0, 0, 0, 3, 0.99, 0, 0, 9, 9),
        ("side", "upright", 0, 0, 0, 3, 0.9, 5, 5, 20, 20), ("side", "turned", 1, 0, 0, 1, 0.4, 0, 0, 300, 390), ("side", "turned", 1, 0, 1, 3, 0.6, 10, 20, 40, 60),
        ("side", "turned", 2, 0, 0, 3, 0.7, 1, 1, 9, 9),
        ("even", "upright", 0, 0, 0, 3, 0.5, 5, 5, 20, 20), ("even", "turned", 1, 0, 0, 3, 0.5, 6, 6, 20, 20),
    ]
    detections = spark.createDataFrame(told, DET)
    detections = detections.select(*[F.col(c).alias(f"_{c}") for c in ("key", "pass", "turn", "part")], "ord", "cls", "conf", box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("box"))
    photos = spark.createDataFrame([(k, 400, 300) for k in ("far", "near", "side", "even", "blank")], "key string, width int, height int")
    asked = []

    def detect(requests):
        asked.extend((r["key"], r["pass"], r["turn"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in requests.collect())
        same = [F.col(c) == F.col(f"_{c}") for c in ("key", "pass", "turn", "part")]
        return requests.join(detections, same[0] & same[1] & same[2] & same[3])

    got = {(r["key"], r["turn"], r["passed"], r["cls"], tuple(r["box"])) for r in flow.detection_flow(photos, detect).collect()}
    assert got == {
        ("far", 0, 2, 4, (110, 104, 184, 116)), ("far", 0, 2, 1, (100, 100, 200, 180)), ("far", 0, 1, 3, (120, 150, 160, 170)),  # zoomed at (94, 96)
        ("near", 0, 1, 1, (10, 10, 390, 290)), ("near", 0, 1, 3, (50, 50, 90, 70)),  # upright stays, and the screen is large
        ("side", 1, 1, 1, (0, 0, 390, 300)), ("side", 1, 1, 3, (20, 260, 60, 290)),  # turned back
        ("even", 0, 1, 3, (5, 5, 20, 20)),  # the first of equals; the blank photo has gone
    }
    assert {a[:3] for a in asked if a[1] == "turned"} == {(k, "turned", t) for k in ("side", "even", "blank") for t in (1, 2)}
    assert [a for a in asked if a[1] == "zoom"] == [("far", "zoom", 0, 94, 96, 206, 184)]
    assert ("side", "turned", 1, 0, 0, 300, 400) in asked


def test_detection_flow_of_straightened_screens(spark):
    told = [
        ("a", "upright", 0, 0, 0, 1, 0.9, 50, 50, 250, 200), ("a", "flat", 0, 0, 0, 4, 0.6, 20, 20, 80, 36), ("a", "flat", 0, 0, 1, 3, 0.8, 10, 60, 40, 90), ("a", "flat", 0, 0, 2, 4, 0.5, 20, 5, 60, 15),
        ("a", "title", 0, 0, 0, 4, 0.9, 30, 10, 100, 32), ("a", "title", 0, 2, 0, 4, 0.9, 0, 0, 60, 8), ("b", "upright", 0, 0, 0, 1, 0.9, 50, 50, 350, 290),
    ]
    detections = spark.createDataFrame(told, DET)
    detections = detections.select(*[F.col(c).alias(f"_{c}") for c in ("key", "pass", "turn", "part")], "ord", "cls", "conf", box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("box"))
    photos = spark.createDataFrame([("a", 400, 300), ("b", 400, 300)], "key string, width int, height int")

    def detect(requests):
        same = [F.col(c) == F.col(f"_{c}") for c in ("key", "pass", "turn", "part")]
        return requests.join(detections, same[0] & same[1] & same[2] & same[3])

    def straighten(found):
        return found.where("key = 'a'").select("key", F.lit(200.0).alias("width"), F.lit(150.0).alias("height"), F.array(*[F.lit(float(x)) for x in (1, 0, 50, 0, 1, 50, 0, 0, 1)]).alias("h"))

    got = {(r["key"], r["passed"], r["cls"], tuple(r["box"])) for r in flow.detection_flow(photos, detect, straighten).collect()}
    assert got == {
        ("a", 2, 4, (80, 64, 150, 86)),  # a taller title, found in the crop at (0, 4), on the screen at (50, 50)
        ("a", 2, 3, (60, 110, 90, 140)), ("a", 2, 4, (70, 55, 110, 65)),  # the other title's second look was no taller
        ("b", 1, 1, (50, 50, 350, 290)),
    }
