"""Queries of pictures that are read at several thresholds: an embedding stands for a crop of 8 by 8."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import light, resample, screens, skew, sweep, vectors
from fieldglass.plans.registry import query, six, six_sql, table
from fieldglass.work import written


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (key, x, y, gray, label) of every embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label", F.posexplode("embedding").alias("i", "v"))
    gray = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * F.col("v").cast("double")))).cast("int")
    return e.select("key", "label", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), gray.alias("gray"))


PIXELS = """p AS (SELECT vec_id AS key, label, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y,
  CAST(greatest(0, least(255, floor(128 + 400 * CAST(embedding[i + 1] AS DOUBLE)))) AS INTEGER) AS gray FROM embeddings, range(64) t(i))"""

_SCORE_CUTS = f"""{PIXELS}, hist AS (SELECT key, gray AS v, count(*) AS n FROM p GROUP BY key, gray),
o1 AS (SELECT key, v, sum(n) OVER u AS w0, sum(n * v) OVER u AS s0, sum(n) OVER a AS w, sum(n * v) OVER a AS s FROM hist
  WINDOW u AS (PARTITION BY key ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY key)),
o2 AS (SELECT key, v, w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) AS apart FROM o1 WHERE w > w0),
o3 AS (SELECT key, v FROM o2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY apart DESC, v) = 1),
srt AS (SELECT key, list_sort(list(gray)) AS s, len(s) AS n FROM p GROUP BY key),
pct AS (SELECT key, 2 + i AS cut, [{", ".join(map(str, sweep.SCORE_CUTS))}][i + 1] / 100.0::DOUBLE * (n - 1) AS place, s FROM srt, range(6) t(i)),
cuts AS (
  SELECT key, 0 AS cut, coalesce(v, 0) AS threshold, false AS dark FROM srt LEFT JOIN o3 USING (key)
  UNION ALL SELECT key, 1, coalesce(v, 0), true FROM srt LEFT JOIN o3 USING (key)
  UNION ALL SELECT key, cut, CAST(floor(CAST(s[CAST(floor(place) AS INTEGER) + 1] + (place - floor(place)) * (coalesce(s[CAST(floor(place) AS INTEGER) + 2], 255) - s[CAST(floor(place) AS INTEGER) + 1]) AS FLOAT)) AS INTEGER), false FROM pct
)"""

_TITLE_CUTS = f"""{PIXELS}, srt AS (SELECT key, list_sort(list(gray)) AS s, len(s) AS n FROM p GROUP BY key),
cuts AS (SELECT key, i AS cut, s[1 + CAST(least(n - 1, floor(CAST([{", ".join(map(str, sweep.TITLE_CUTS))}][i + 1] / 100.0::DOUBLE AS FLOAT) * CAST(n - 1 AS FLOAT))) AS INTEGER)] AS threshold, false AS dark FROM srt, range(6) t(i))"""

#: Components of each cut by itself: pixels that reach each other.
_LABELLED = """mask AS (SELECT key, cut, x, y, gray FROM p JOIN cuts USING (key) WHERE (gray > threshold) <> dark),
reach AS (
  SELECT key, cut, x, y, x AS px, y AS py FROM mask
  UNION SELECT r.key, r.cut, r.x, r.y, m.x, m.y FROM reach r JOIN mask m ON m.key = r.key AND m.cut = r.cut AND m.x BETWEEN r.px - 1 AND r.px + 1 AND m.y BETWEEN r.py - 1 AND r.py + 1
), lab AS (SELECT key, cut, x, y, min(py * 8 + px) AS root FROM reach GROUP BY key, cut, x, y),
comp AS (SELECT key, cut, root, min(l.x) AS x, min(l.y) AS y, max(l.x) - min(l.x) + 1 AS w, max(l.y) - min(l.y) + 1 AS h, count(*) AS area, avg(gray) AS bright
  FROM lab l JOIN mask USING (key, cut, x, y) GROUP BY key, cut, root)"""


def _share(share: float, of: str) -> str:
    return f"CAST({share} AS FLOAT) * CAST({of} AS FLOAT)"


_DIGITS = f"""c1 AS (SELECT *, max(h) OVER (PARTITION BY key, cut) AS mh FROM comp),
c2 AS (SELECT * FROM c1 WHERE h >= {_share(0.55, "mh")} AND area >= {_share(0.05, "w * h")} AND w <= 3 * h),
c3 AS (SELECT *, max(bright) OVER (PARTITION BY key, cut) AS mb FROM c2),
c4 AS (SELECT *, max(h) OVER (PARTITION BY key, cut) AS mx, CAST(y + h / 2 AS FLOAT) AS cy FROM c3 WHERE CAST(bright AS FLOAT) >= {_share(0.62, "mb")}),
c5 AS (SELECT * FROM c4 WHERE CAST(h AS FLOAT) >= {_share(0.68, "mx")}),
c6 AS (SELECT key, cut, median(h) AS mid, list_sort(list(cy))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS line FROM c5 GROUP BY key, cut),
digits AS (SELECT key, cut, CAST(row_number() OVER (PARTITION BY key, cut ORDER BY x, root) - 1 AS INTEGER) AS place, x, y, w, h FROM c5 JOIN c6 USING (key, cut) WHERE abs(cy - line) <= {_share(0.42, "mid")})"""

#: Target size and place of each glyph; a cell's value from what its square covers (no crop here is wider or higher than its target).
_SIZED = """sized AS (SELECT *, greatest(1, least(24, CAST(round_even(32.0::DOUBLE * CAST(CAST(w AS FLOAT) / CAST(h AS FLOAT) AS DOUBLE), 0) AS INTEGER))) AS tw, 32 AS th, 0 AS down FROM {glyphs})"""
_VECTORS = """cell AS (
  SELECT g.key, g.cut, g.place, g.down + ty AS r, (24 - tw) // 2 + tx AS c, sum(
      greatest(0, least((tx + 1) * w, (m.x - g.x + 1) * tw) - greatest(tx * w, (m.x - g.x) * tw))
    * greatest(0, least((ty + 1) * h, (m.y - g.y + 1) * th) - greatest(ty * h, (m.y - g.y) * th))) AS covered, any_value(w * h) AS whole
  FROM sized g JOIN mask m ON m.key = g.key AND m.cut = g.cut AND m.x BETWEEN g.x AND g.x + w - 1 AND m.y BETWEEN g.y AND g.y + h - 1
  JOIN range(32) t(ty) ON ty < th AND (ty + 1) * h > (m.y - g.y) * th AND ty * h < (m.y - g.y + 1) * th
  JOIN range(24) u(tx) ON tx < tw AND (tx + 1) * w > (m.x - g.x) * tw AND tx * w < (m.x - g.x + 1) * tw
  GROUP BY g.key, g.cut, g.place, r, c
), vec AS (
  SELECT key, cut, place, list_transform(range(768), lambda i: coalesce(map_extract_value(cells, i), 0.0::DOUBLE)) AS vec
  FROM (SELECT key, cut, place, map(list(CAST(r * 24 + c AS BIGINT)), list(round_even(CAST(covered AS DOUBLE) * 255 / whole, 0))) AS cells FROM cell GROUP BY key, cut, place)
)"""


@query("score_cuts", f"WITH {_SCORE_CUTS} SELECT key, CAST(cut AS INTEGER) AS cut, CAST(threshold AS INTEGER) AS threshold, dark FROM cuts")
def score_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.score_cuts(crops(spark, sf_dir))


@query("title_cuts", f"WITH {_TITLE_CUTS} SELECT key, CAST(cut AS INTEGER) AS cut, threshold, dark FROM cuts")
def title_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.title_cuts(crops(spark, sf_dir))


@query("threshold_components", f"""WITH RECURSIVE {_SCORE_CUTS}, {_LABELLED}
SELECT key, CAST(cut AS INTEGER) AS cut, CAST(row_number() OVER (PARTITION BY key, cut ORDER BY root) - 1 AS INTEGER) AS ord, x, y, w, h, CAST(area AS INTEGER) AS area, {six_sql('bright')} AS bright FROM comp""")
def threshold_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = crops(spark, sf_dir)
    return sweep.threshold_components(pixels, sweep.score_cuts(pixels)).withColumn("bright", six(F.col("bright")))


@query("digit_sweep", f"WITH RECURSIVE {_SCORE_CUTS}, {_LABELLED}, {_DIGITS} SELECT key, CAST(cut AS INTEGER) AS cut, place, x, y, w, h FROM digits")
def digit_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = crops(spark, sf_dir)
    return sweep.digit_sweep(pixels, sweep.score_cuts(pixels))


def split_glyphs(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The digits at the split by variance, and its mask."""
    cuts = sweep.score_cuts(pixels).where("cut = 0")
    return sweep.digit_sweep(pixels, cuts), sweep.cut_mask(pixels, cuts)


@query("glyph_vectors", f"""WITH RECURSIVE {_SCORE_CUTS.replace("cuts AS (", "every AS (")}, cuts AS (SELECT * FROM every WHERE cut = 0), {_LABELLED}, {_DIGITS}, {_SIZED.format(glyphs="digits")}, {_VECTORS}
SELECT key, place, CAST(list_sum(vec) AS BIGINT) AS total, md5(array_to_string(list_transform(vec, lambda v: CAST(v AS INTEGER)), ',')) AS digest FROM vec""")
def glyph_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.glyph_vectors(*split_glyphs(crops(spark, sf_dir)), ["key", "cut", "place"])
    text = F.array_join(F.transform("vec", lambda v: v.cast("int").cast("string")), ",")
    return found.select("key", "place", F.aggregate("vec", F.lit(0.0), lambda a, v: a + v).cast("long").alias("total"), F.md5(text).alias("digest"))


def bank_of(pixels: DataFrame) -> DataFrame:
    """Templates (label, vec): the first digit of every fifth crop, under the crop's label."""
    fifth = pixels.where("key % 5 = 0")
    glyphs, mask = split_glyphs(fifth.drop("label"))
    drawn = resample.glyph_vectors(glyphs.where("place = 0"), mask, ["key", "cut", "place"])
    labels = fifth.groupBy("key").agg(F.first("label").cast("int").alias("label"))
    return written(drawn.join(labels, "key").select("label", vectors.normalised(F.col("vec")).alias("vec")))


@query("score_from_pixels", f"""WITH RECURSIVE {_SCORE_CUTS}, {_LABELLED}, {_DIGITS},
centred AS (SELECT *, x + w / 2 AS mid FROM digits), gaps AS (SELECT *, mid - lag(mid) OVER (PARTITION BY key, cut ORDER BY mid) AS gap FROM centred),
shape AS (SELECT key, cut, CASE WHEN count(*) BETWEEN 6 AND 7 THEN 2 WHEN count(*) BETWEEN 4 AND 8 THEN 1 ELSE 0 END AS tier,
  {six_sql("-coalesce(stddev_pop(h) / nullif(avg(h), 0), 0) - coalesce(stddev_pop(gap) / nullif(avg(gap), 0), 0)")} AS regularity FROM gaps GROUP BY key, cut),
asked AS (SELECT key, cut FROM shape QUALIFY tier > 0 OR max(tier) OVER (PARTITION BY key) = 0 AND row_number() OVER (PARTITION BY key ORDER BY tier DESC, regularity DESC, cut) = 1),
wanted AS (SELECT digits.* FROM digits LEFT JOIN asked a ON a.key = digits.key AND a.cut = digits.cut WHERE a.key IS NOT NULL AND digits.key % 5 <> 0 OR digits.key % 5 = 0 AND digits.cut = 0 AND place = 0),
{_SIZED.format(glyphs="wanted")}, {_VECTORS},
unit AS (SELECT key, cut, place, list_transform(vec, lambda v: v / sqrt(list_sum(list_transform(vec, lambda u: u * u)))) AS v FROM vec),
bank AS (SELECT DISTINCT label, v AS t FROM unit JOIN (SELECT DISTINCT key, label FROM p) l USING (key) WHERE key % 5 = 0),
sims AS (SELECT key, cut, place, label, round(max(list_dot_product(v, t)), 9) AS sim FROM unit, bank WHERE key % 5 <> 0 GROUP BY key, cut, place, label),
told AS (SELECT key, cut, place, label, CAST(sim - greatest(coalesce(lead(sim) OVER o, -1), 0) AS FLOAT) AS margin, row_number() OVER o AS rank FROM sims WINDOW o AS (PARTITION BY key, cut, place ORDER BY sim DESC, label)),
words AS (SELECT key, cut, string_agg(CAST(label AS VARCHAR), '' ORDER BY place) AS digits, list(CAST(margin AS DOUBLE) ORDER BY place) AS margins, avg(CAST(margin AS DOUBLE)) AS sure FROM told WHERE rank = 1 GROUP BY key, cut),
tries AS (SELECT key, cut, coalesce(tier, -1) AS tier, {six_sql("coalesce(regularity, 0) + CASE WHEN tier > 0 THEN 3 * coalesce(sure, -1) ELSE 0 END")} AS score, coalesce(digits, '') AS digits, coalesce(margins, []) AS margins
  FROM cuts LEFT JOIN shape USING (key, cut) LEFT JOIN words USING (key, cut) WHERE key % 5 <> 0),
live AS (SELECT * FROM tries QUALIFY coalesce(bool_or(tier = 2 AND score > 0.1) OVER (PARTITION BY key ORDER BY cut ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) = false),
best AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier DESC, score DESC, cut) = 1),
used AS (SELECT *, CASE WHEN len(digits) = 7 AND digits <> '1000000' THEN substr(digits, 2) ELSE digits END AS d FROM best)
SELECT key, CAST(cut AS INTEGER) AS cut, digits, CASE WHEN len(d) BETWEEN 1 AND 7 AND CAST(d AS BIGINT) <= 1000000 THEN CAST(d AS INTEGER) ELSE -1 END AS score, {six_sql('coalesce(list_min(margins), 0)')} AS margin FROM used""")
def score_from_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = crops(spark, sf_dir)
    found = sweep.score_from_pixels(pixels.where("key % 5 != 0").drop("label"), bank_of(pixels))
    return found.select("key", "cut", "digits", "score", six(F.col("margin")).alias("margin"))


@query("title_sweep", f"""WITH RECURSIVE {_TITLE_CUTS}, {_LABELLED},
c1 AS (SELECT *, max(area) OVER (PARTITION BY key, cut) AS ma FROM comp),
c2 AS (SELECT * FROM c1 WHERE area >= {_share(0.02, "ma")} AND h >= {_share(0.12, "8")} AND w <= {_share(0.5, "8")}),
fold AS (SELECT key, cut, list_reduce(list(struct_pack(x := x, root := root, x2 := x + w, y := y, y2 := y + h) ORDER BY x, root),
  lambda acc, b: CASE WHEN len(acc) > 0 AND least(acc[-1].x2, b.x2) > greatest(acc[-1].x, b.x)
    AND CAST(least(acc[-1].x2, b.x2) - greatest(acc[-1].x, b.x) AS FLOAT) >= {_share(0.55, "least(acc[-1].x2 - acc[-1].x, b.x2 - b.x)")}
    THEN list_append(acc[:-2], struct_pack(x := acc[-1].x, root := acc[-1].root, x2 := greatest(acc[-1].x2, b.x2), y := least(acc[-1].y, b.y), y2 := greatest(acc[-1].y2, b.y2))) ELSE list_append(acc, b) END,
  CAST([] AS STRUCT(x INTEGER, root INTEGER, x2 INTEGER, y INTEGER, y2 INTEGER)[])) AS m FROM c2 GROUP BY key, cut),
merged AS (SELECT key, cut, i AS ord, m[i].x AS x, m[i].y AS y, m[i].x2 - m[i].x AS w, m[i].y2 - m[i].y AS h FROM (SELECT key, cut, m, unnest(range(1, len(m) + 1)) AS i FROM fold)),
d1 AS (SELECT *, median(h) OVER (PARTITION BY key, cut) AS mid FROM merged), d2 AS (SELECT *, CAST(abs(h - mid) AS FLOAT) <= {_share(0.42, "mid")} AS near FROM d1),
d3 AS (SELECT *, count(*) FILTER (near) OVER (PARTITION BY key, cut) AS k FROM d2),
d4 AS (SELECT *, x - lag(x + w) OVER (PARTITION BY key, cut ORDER BY x, ord) AS gap FROM d3 WHERE near AND k >= 3),
d5 AS (SELECT *, greatest({_share(2.6, "coalesce(median(gap) FILTER (gap >= 0) OVER (PARTITION BY key, cut), 0)")}, {_share(0.9, "mid")}) AS lim FROM d4),
d6 AS (SELECT *, sum(CASE WHEN CAST(gap AS FLOAT) > lim THEN 1 ELSE 0 END) OVER (PARTITION BY key, cut ORDER BY x, ord ROWS UNBOUNDED PRECEDING) AS run FROM d5),
d7 AS (SELECT *, sum(w) OVER (PARTITION BY key, cut, run) AS width FROM d6),
line AS (SELECT key, cut, ord, x, y, w, h FROM (SELECT *, first_value(run) OVER (PARTITION BY key, cut ORDER BY width DESC, run) AS best FROM d7) WHERE run = best
  UNION ALL SELECT key, cut, ord, x, y, w, h FROM d3 WHERE k < 3),
glyphs AS (SELECT *, CAST(row_number() OVER (PARTITION BY key, cut ORDER BY x, ord) - 1 AS INTEGER) AS place, min(y) OVER (PARTITION BY key, cut) AS top, greatest(1, max(y + h) OVER (PARTITION BY key, cut) - min(y) OVER (PARTITION BY key, cut)) AS high FROM line),
s1 AS (SELECT *, greatest(1, CAST(round_even(32.0::DOUBLE * h / high, 0) AS INTEGER)) AS th FROM glyphs),
sized AS (SELECT *, greatest(1, least(24, CAST(round_even(CAST(th AS DOUBLE) * w / h, 0) AS INTEGER))) AS tw, greatest(0, least(32 - th, CAST(round_even(32.0::DOUBLE * (y - top) / high, 0) AS INTEGER))) AS down FROM s1),
{_VECTORS},
shape AS (SELECT key, cut, count(*) AS n, {six_sql("-stddev_pop(h) / avg(h)")} AS even FROM glyphs GROUP BY key, cut),
read AS (SELECT key, cut, string_agg(array_to_string(vec, ','), ';' ORDER BY place) AS reading FROM vec GROUP BY key, cut),
once AS (SELECT key, cut, n, even FROM shape JOIN read USING (key, cut) QUALIFY row_number() OVER (PARTITION BY key, reading ORDER BY n DESC, even DESC, cut) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, even DESC, cut) AS rank FROM once)
SELECT key, CAST(rank AS INTEGER) AS rank, CAST(cut AS INTEGER) AS cut, place, x, y, w, h, CAST(list_sum(vec) AS BIGINT) AS total FROM best JOIN glyphs USING (key, cut) JOIN vec USING (key, cut, place) WHERE rank <= 2""")
def title_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = crops(spark, sf_dir).drop("label")
    sizes = pixels.select("key").distinct().select("key", F.lit(8).alias("rows"), F.lit(8).alias("cols"))
    found = sweep.title_sweep(pixels, sizes)
    return found.select("key", "rank", "cut", "place", "x", "y", "w", "h", F.aggregate("vec", F.lit(0.0), lambda a, v: a + v).cast("long").alias("total"))


def _square(name: str, of: str, size: int, f: str) -> str:
    r = size // 2
    return f"{name} AS (SELECT a.key, a.x, a.y, {f}(b.gray) AS gray FROM {of} a JOIN {of} b ON a.key = b.key AND abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r} GROUP BY ALL)"


@query("opened", f"WITH {PIXELS}, {_square('s1', 'p', 3, 'min')}, {_square('s2', 's1', 3, 'max')} SELECT * FROM s2")
def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return light.opened(crops(spark, sf_dir).drop("label"))


@query("closed", f"WITH {PIXELS}, {_square('s1', 'p', 7, 'max')}, {_square('s2', 's1', 7, 'min')} SELECT * FROM s2")
def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return light.closed(crops(spark, sf_dir).drop("label"))


def _round(name: str, of: str, size: int, f: str) -> str:
    reach = [f"({d - size // 2}, {s})" for d, s in enumerate(light.ellipse_spans(size))]
    return f"{name} AS (SELECT a.key, a.x, a.y, {f}(b.gray) AS gray FROM {of} a JOIN (VALUES {', '.join(reach)}) e(dy, span) ON true JOIN {of} b ON a.key = b.key AND b.y = a.y + e.dy AND abs(a.x - b.x) <= e.span GROUP BY ALL)"


@query("top_hat", f"WITH {PIXELS}, {_round('s1', 'p', 5, 'min')}, {_round('s2', 's1', 5, 'max')} SELECT key, x, y, p.gray - s2.gray AS gray FROM p JOIN s2 USING (key, x, y)")
def top_hat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return light.top_hat(crops(spark, sf_dir).drop("label"), light.title_hat_size(8))


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.select("key").distinct().select("key", F.lit(8).alias("width"), F.lit(8).alias("height"))


# three tiles each way don't divide eight pixels: the ninth is the mirror of the seventh
@query("equalised", f"""WITH {PIXELS}, g AS (SELECT key, gx, gy, gray FROM range(9) a(gx), range(9) b(gy), p WHERE p.x = CASE WHEN gx = 8 THEN 6 ELSE gx END AND p.y = CASE WHEN gy = 8 THEN 6 ELSE gy END),
h0 AS (SELECT key, gy // 3 AS ty, gx // 3 AS tx, gray, count(*) AS n FROM g GROUP BY ALL),
h1 AS (SELECT key, ty, tx, v, coalesce(n, 0) AS n FROM (SELECT DISTINCT key, ty, tx FROM h0) t CROSS JOIN range(256) r(v) LEFT JOIN h0 USING (key, ty, tx) WHERE h0.gray = v OR h0.gray IS NULL
  UNION ALL SELECT key, ty, tx, v, 0 FROM (SELECT DISTINCT key, ty, tx FROM h0) t CROSS JOIN range(256) r(v) WHERE NOT EXISTS (SELECT 1 FROM h0 WHERE h0.key = t.key AND h0.ty = t.ty AND h0.tx = t.tx AND h0.gray = v)),
h2 AS (SELECT *, sum(greatest(n - 1, 0)) OVER (PARTITION BY key, ty, tx) AS excess FROM h1),
h3 AS (SELECT key, ty, tx, v, least(n, 1) + excess // 256 + CASE WHEN excess % 256 > 0 AND v % greatest(256 // greatest(excess % 256, 1), 1) = 0 AND v // greatest(256 // greatest(excess % 256, 1), 1) < excess % 256 THEN 1 ELSE 0 END AS n FROM h2),
lut AS (SELECT key, ty, tx, v, least(255, CAST(round_even(CAST(CAST(sum(n) OVER (PARTITION BY key, ty, tx ORDER BY v ROWS UNBOUNDED PRECEDING) AS FLOAT) * (CAST(255 AS FLOAT) / CAST(9 AS FLOAT)) AS FLOAT), 0) AS INTEGER)) AS u FROM h3),
f AS (SELECT *, CAST(CAST(x AS FLOAT) * (CAST(3 AS FLOAT) / CAST(9 AS FLOAT)) - CAST(0.5 AS FLOAT) AS FLOAT) AS px, CAST(CAST(y AS FLOAT) * (CAST(3 AS FLOAT) / CAST(9 AS FLOAT)) - CAST(0.5 AS FLOAT) AS FLOAT) AS py FROM p),
w AS (SELECT key, x, y, gray, CAST(floor(px) AS INTEGER) AS ix, CAST(floor(py) AS INTEGER) AS iy, CAST(px - CAST(floor(px) AS FLOAT) AS FLOAT) AS fx, CAST(py - CAST(floor(py) AS FLOAT) AS FLOAT) AS fy FROM f),
c AS (SELECT key, x, y, gray, CASE WHEN i = 0 THEN greatest(ix, 0) ELSE least(ix + 1, 2) END AS tx, CASE WHEN j = 0 THEN greatest(iy, 0) ELSE least(iy + 1, 2) END AS ty,
  CAST(CASE WHEN i = 0 THEN CAST(1 AS FLOAT) - fx ELSE fx END AS DOUBLE) * CAST(CASE WHEN j = 0 THEN CAST(1 AS FLOAT) - fy ELSE fy END AS DOUBLE) AS weight FROM w, range(2) a(i), range(2) b(j))
SELECT c.key, c.x, c.y, CAST(round_even(round(sum(weight * u), 6), 0) AS INTEGER) AS gray FROM c JOIN lut ON lut.key = c.key AND lut.ty = c.ty AND lut.tx = c.tx AND lut.v = c.gray GROUP BY ALL""")
def equalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = crops(spark, sf_dir).drop("label")
    return light.equalised(pixels, sizes(pixels), tiles=3)


_WEIGHTS = ", ".join(f"({i - 5}, {w!r}::DOUBLE)" for i, w in enumerate(light.gaussian(11)))


@query("adaptive_mask", f"""WITH {PIXELS}, w AS (SELECT * FROM (VALUES {_WEIGHTS}) t(d, w)),
a AS (SELECT p.key, p.x, p.y, sum(w * q.gray) AS v FROM p, w, p q WHERE q.key = p.key AND q.y = p.y AND q.x = greatest(0, least(7, p.x + d)) GROUP BY ALL),
b AS (SELECT p.key, p.x, p.y, p.gray, sum(w * a.v) AS v FROM p, w, a WHERE a.key = p.key AND a.x = p.x AND a.y = greatest(0, least(7, p.y + d)) GROUP BY ALL)
SELECT key, x, y, CASE WHEN gray > round_even(round(v, 6), 0) - 5 THEN 255 ELSE 0 END AS gray FROM b""")
def adaptive_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return light.adaptive_mask(crops(spark, sf_dir).drop("label"), light.score_window(8), 5)


@query("resampled", f"""WITH {PIXELS}, k AS (SELECT DISTINCT key, 3 + key % 11 AS tw, 3 + key % 7 AS th FROM p),
x AS (SELECT key, t AS tx, s AS x, CASE WHEN tw <= 8 AND th <= 8 OR tw >= 8 THEN greatest(0, least((t + 1) * 8, (s + 1) * tw) - greatest(t * 8, s * tw)) ELSE
  CASE WHEN s = t * 8 // tw THEN 8 - greatest(0, (t + 1) * 8 - (s + 1) * tw) % 8 ELSE 0 END + CASE WHEN s = least(t * 8 // tw + 1, 7) THEN greatest(0, (t + 1) * 8 - (t * 8 // tw + 1) * tw) % 8 ELSE 0 END END AS w FROM k, range(14) a(t), range(8) b(s) WHERE t < tw),
y AS (SELECT key, t AS ty, s AS y, CASE WHEN tw <= 8 AND th <= 8 OR th >= 8 THEN greatest(0, least((t + 1) * 8, (s + 1) * th) - greatest(t * 8, s * th)) ELSE
  CASE WHEN s = t * 8 // th THEN 8 - greatest(0, (t + 1) * 8 - (s + 1) * th) % 8 ELSE 0 END + CASE WHEN s = least(t * 8 // th + 1, 7) THEN greatest(0, (t + 1) * 8 - (t * 8 // th + 1) * th) % 8 ELSE 0 END END AS w FROM k, range(14) a(t), range(8) b(s) WHERE t < th)
SELECT p.key, CAST(tx AS INTEGER) AS x, CAST(ty AS INTEGER) AS y, CAST(round_even(sum(gray * x.w * y.w)::DOUBLE / 64, 0) AS INTEGER) AS gray FROM p JOIN x ON x.key = p.key AND x.x = p.x JOIN y ON y.key = p.key AND y.y = p.y GROUP BY p.key, tx, ty""")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = crops(spark, sf_dir)
    k = F.col("key")
    wanted = sizes(pixels).withColumns({"to_width": (3 + k % 11).cast("int"), "to_height": (3 + k % 7).cast("int")})
    return resample.resampled(pixels, wanted)


#: Corners of the hull of the pixels above the split: ends of edges that have all other points on one side or between their ends.
_HULL = f"""{_SCORE_CUTS.replace("cuts AS (", "every AS (")}, m AS (SELECT key, x, y FROM p JOIN (SELECT * FROM every WHERE cut = 0) c USING (key) WHERE gray > threshold),
sides AS (SELECT a.key, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0
    OR (b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND c.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND c.y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y)) AS edge
  FROM m a JOIN m b ON a.key = b.key AND (a.x, a.y) <> (b.x, b.y) JOIN m c ON c.key = a.key GROUP BY ALL),
edges AS (SELECT * FROM sides WHERE edge)"""


def split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels above each crop's split by variance, as one list."""
    pixels = crops(spark, sf_dir)
    mask = sweep.cut_mask(pixels, sweep.score_cuts(pixels).where("cut = 0"))
    return mask.groupBy("key").agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("outline"))


@query("component_hull", f"WITH {_HULL} SELECT DISTINCT key, ax AS x, ay AS y FROM edges")
def component_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screens.hulls(split_points(spark, sf_dir)).select("key", F.explode("hull").alias("c"))
    return found.select("key", F.col("c.x").cast("int").alias("x"), F.col("c.y").cast("int").alias("y"))


@query("min_rect", f"""WITH {_HULL}, u AS (SELECT DISTINCT key, ax, ay, bx - ax AS dx, by_ - ay AS dy FROM edges),
r AS (SELECT u.key, ax, ay, (max(m.x * dx + m.y * dy) - min(m.x * dx + m.y * dy)) / sqrt(dx * dx + dy * dy) AS a, (max(m.y * dx - m.x * dy) - min(m.y * dx - m.x * dy)) / sqrt(dx * dx + dy * dy) AS b
  FROM u JOIN m USING (key) GROUP BY u.key, ax, ay, dx, dy)
SELECT key, {six_sql('min(a * b)')} AS area FROM r GROUP BY key""")
def min_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screens.rectangles(screens.hulls(split_points(spark, sf_dir)))
    return found.select("key", six(F.col("side_a") * F.col("side_b")).alias("area"))


@query("warped", f"""WITH {PIXELS}, t AS (SELECT DISTINCT key, CAST(tx AS INTEGER) AS x, CAST(ty AS INTEGER) AS y, 1 + 0.01::DOUBLE * tx + 0.02::DOUBLE * ty AS d,
  0.9::DOUBLE * tx + 0.1::DOUBLE * ty + key % 3 - 1 AS nu, 0.05::DOUBLE * tx + 1.1::DOUBLE * ty + key % 2 AS nv FROM p, range(7) a(tx), range(6) b(ty)),
s AS (SELECT key, x, y, nu / d AS u, nv / d AS v FROM t),
c AS (SELECT key, x, y, CAST(floor(u) AS INTEGER) + i AS px, CAST(floor(v) AS INTEGER) + j AS py, CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE WHEN j = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END AS w FROM s, range(2) e(i), range(2) f(j))
SELECT c.key, c.x, c.y, CAST(round_even(round(sum(w * coalesce(gray, 0)), 6), 0) AS INTEGER) AS gray FROM c LEFT JOIN p ON p.key = c.key AND p.x = px AND p.y = py GROUP BY c.key, c.x, c.y""")
def warped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = crops(spark, sf_dir)
    k = F.col("key")
    h = F.array(*[c.cast("double") for c in (F.lit(0.9), F.lit(0.1), k % 3 - 1, F.lit(0.05), F.lit(1.1), k % 2, F.lit(0.01), F.lit(0.02), F.lit(1.0))])
    maps = pixels.select("key").distinct().select("key", h.alias("h"), F.lit(7).alias("width"), F.lit(6).alias("height"))
    return screens.warped(pixels, maps)


_ANGLES = ", ".join(f"({a}::DOUBLE, {math.cos(math.radians(a))!r}::DOUBLE, {math.sin(math.radians(a))!r}::DOUBLE)" for a in range(-10, 11))
_VOTES = f"""{_SCORE_CUTS.replace("cuts AS (", "every AS (")}, m AS (SELECT key, x, y FROM p JOIN (SELECT * FROM every WHERE cut = 0) c USING (key) WHERE gray > threshold),
g AS (SELECT * FROM (VALUES {_ANGLES}) t(angle, c, s)),
v AS (SELECT key, angle, CAST(floor(round(y * c - x * s, 9) + 0.5) AS INTEGER) AS offset_, count(*) AS votes, max(x * c + y * s) - min(x * c + y * s) AS length FROM m, g GROUP BY ALL)"""


@query("line_votes", f"WITH {_VOTES} SELECT key, angle, offset_ AS \"offset\", votes, {six_sql('length')} AS length FROM v")
def line_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = crops(spark, sf_dir)
    mask = sweep.cut_mask(pixels, sweep.score_cuts(pixels).where("cut = 0"))
    return skew.line_votes(mask, 10.0).withColumn("length", six(F.col("length")))


@query("text_angle", f"""WITH {_VOTES}, k AS (SELECT * FROM v WHERE votes >= 4 AND length >= 2 AND votes >= 0.6::DOUBLE * length),
n AS (SELECT a.* FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.key = a.key AND abs(b.angle - a.angle) <= 1 AND abs(b.offset_ - a.offset_) <= 1 AND (b.votes, -b.angle, -b.offset_) > (a.votes, -a.angle, -a.offset_))),
r AS (SELECT key, angle, sum(length) OVER (PARTITION BY key ORDER BY angle RANGE UNBOUNDED PRECEDING) AS run, sum(length) OVER (PARTITION BY key) AS total FROM n),
f AS (SELECT key, min(angle) AS angle FROM r WHERE run >= total / 2 GROUP BY key)
SELECT a.key, CASE WHEN abs(angle) >= 0.3 THEN angle ELSE 0.0::DOUBLE END AS angle FROM (SELECT DISTINCT key FROM p) a LEFT JOIN f USING (key)""")
def text_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = crops(spark, sf_dir)
    mask = sweep.cut_mask(pixels, sweep.score_cuts(pixels).where("cut = 0"))
    return skew.text_angle(mask, pixels.select("key").distinct().withColumn("cols", F.lit(8)), 10.0, 4)
