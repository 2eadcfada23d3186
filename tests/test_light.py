"""Morphology, local equalisation and local thresholds against plain loops."""

import math

import numpy as np

from fieldglass.operators import light, sweep
from tests.test_sweep import bank, drawn, frame  # noqa: F401


def picture(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["key"], {})[r["y"], r["x"]] = r["gray"]
    return {k: np.array([[v[y, x] for x in range(max(p[1] for p in v) + 1)] for y in range(max(p[0] for p in v) + 1)]) for k, v in out.items()}


def around(p, reach, f):
    """``f`` of what lies in the reach (dy, dx pairs) of every pixel; beyond the border nothing does."""
    h, w = p.shape
    return np.array([[f(p[y + dy, x + dx] for dy, dx in reach if 0 <= y + dy < h and 0 <= x + dx < w) for x in range(w)] for y in range(h)])


PICTURES = {k: np.random.default_rng(i).integers(0, 256, s) for i, (k, s) in enumerate({"a": (11, 17), "b": (4, 3), "c": (1, 9), "d": (16, 24)}.items())}


def test_morphology(spark):
    pixels = frame(spark, PICTURES)
    box = lambda n: [(dy, dx) for dy in range(-(n // 2), n // 2 + 1) for dx in range(-(n // 2), n // 2 + 1)]
    disc = lambda n: [(dy, dx) for dy, s in zip(range(-(n // 2), n // 2 + 1), light.ellipse_spans(n)) for dx in range(-s, s + 1)]
    for got, reach, one, two in ((light.opened(pixels), box(3), min, max), (light.closed(pixels), box(7), max, min)):
        for k, p in picture(got).items():
            assert (p == around(around(PICTURES[k], reach, one), reach, two)).all()
    for k, p in picture(light.top_hat(pixels, 7)).items():
        assert (p == PICTURES[k] - around(around(PICTURES[k], disc(7), min), disc(7), max)).all()
    assert light.ellipse_spans(5) == [0, 2, 2, 2, 0] and light.ellipse_spans(3) == [0, 1, 0]
    assert (light.title_hat_size(160), light.title_hat_size(4), light.title_hat_size(10)) == (89, 3, 7)


def even_table(hist, area, clip=2.0):
    limit = max(1, int(clip * area / 256))
    over = sum(max(0, n - limit) for n in hist)
    hist = [min(n, limit) + over // 256 for n in hist]
    rest = over % 256
    if rest:
        step = max(256 // rest, 1)
        for i in range(0, 256, step):
            if rest > 0:
                hist[i] += 1
                rest -= 1
    scale = np.float32(255) / np.float32(area)
    return [min(255, int(np.rint(np.float32(np.float32(s) * scale)))) for s in np.cumsum(hist)]


def even(p, tiles):
    h, w = p.shape
    down, right = (0, 0) if h % tiles == 0 and w % tiles == 0 else (tiles - h % tiles, tiles - w % tiles)
    grown = np.pad(p, ((0, down), (0, right)), mode="reflect") if min(h, w) > 1 else p
    th, tw = grown.shape[0] // tiles, grown.shape[1] // tiles
    tables = [[even_table(np.bincount(grown[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).tolist(), th * tw) for j in range(tiles)] for i in range(tiles)]
    out = np.zeros_like(p)
    for y in range(h):
        for x in range(w):
            fy, fx = (np.float32(np.float32(v) * np.float32(np.float32(1) / np.float32(n))) - np.float32(0.5) for v, n in ((y, th), (x, tw)))
            iy, ix = math.floor(fy), math.floor(fx)
            wy, wx = float(np.float32(fy - np.float32(iy))), float(np.float32(fx - np.float32(ix)))
            y0, y1, x0, x1 = max(iy, 0), min(iy + 1, tiles - 1), max(ix, 0), min(ix + 1, tiles - 1)
            a = p[y, x]
            v = (tables[y0][x0][a] * (1 - wx) + tables[y0][x1][a] * wx) * (1 - wy) + (tables[y1][x0][a] * (1 - wx) + tables[y1][x1][a] * wx) * wy
            out[y, x] = round(v)
    return out


def test_equalised(spark):
    pictures = {k: p for k, p in PICTURES.items() if k != "c"} | {"e": np.arange(40 * 32).reshape(40, 32) % 97 + 60}
    sizes = spark.createDataFrame([(k, p.shape[1], p.shape[0]) for k, p in pictures.items()], "key string, width int, height int")
    for tiles in (8, 3):
        for k, p in picture(light.equalised(frame(spark, pictures), sizes, tiles=tiles)).items():
            off = np.abs(p - even(pictures[k], tiles))
            assert off.max() <= 1 and (off > 0).mean() < 0.02, (k, tiles)  # a sum that lies between two values may go to either


def test_adaptive_mask(spark):
    weights = light.gaussian(11)
    assert abs(sum(weights) - 1) < 1e-12 and weights == weights[::-1]
    for k, p in picture(light.adaptive_mask(frame(spark, PICTURES), 11, 5)).items():
        grown = np.pad(PICTURES[k], 5, mode="edge")
        h, w = PICTURES[k].shape
        mean = np.array([[sum(weights[i] * weights[j] * grown[y + i, x + j] for i in range(11) for j in range(11)) for x in range(w)] for y in range(h)])
        assert (p == np.where(PICTURES[k] > np.rint(np.round(mean, 6)) - 5, 255, 0)).all()
    assert (light.score_window(10), light.score_window(44), light.title_window(160)) == (11, 23, 21)


def test_a_score_in_uneven_light(spark, bank):  # noqa: F811
    """Digits on a band that grows lighter than some of them are, cut as a whole, made even, and locally."""
    p = drawn("765432", 4)
    shade = np.linspace(0, 1, p.shape[1])[None, :]
    p = np.where(p > 100, 170 + 85 * shade, 5 + 200 * shade).astype(int)
    pixels = frame(spark, {"s": p})
    sizes = spark.createDataFrame([("s", p.shape[1], p.shape[0])], "key string, width int, height int")
    sources = light.score_sources(pixels, sizes, p.shape[0], even=True, local=True)
    more = [(sources[0], sweep.score_cuts(sources[0], 8)), (sources[1], sweep.local_cuts(sources[1], 16))]
    found = sweep.score_from_pixels(pixels, bank, more=more).first()
    assert len(found["digits"]) == 6 and sum(a == b for a, b in zip(found["digits"], "765432")) >= 5
    cuts = {r["cut"] for r in sweep.digit_sweep(pixels, sweep.score_cuts(pixels), more).select("cut").distinct().collect()}
    assert cuts <= set(range(18)) and any(8 <= c < 16 for c in cuts) and cuts & {16, 17}  # each picture has readings


def test_titles_of_several_pictures(spark):
    p = drawn("2468", 3)
    sizes = spark.createDataFrame([("t", p.shape[1], p.shape[0], *p.shape)], "key string, width int, height int, rows int, cols int")
    pictures = light.title_sources(frame(spark, {"t": p}), sizes, p.shape[0], even=True, local=True)
    assert len(pictures) == 4
    found = sweep.title_sweep(pictures, sizes.select("key", "rows", "cols"), wanted=4)
    assert {r["rank"] for r in found.collect()} <= {1, 2} and found.where("rank = 1").count() == 4
