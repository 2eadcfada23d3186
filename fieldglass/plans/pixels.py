"""Queries of pixel operators: customers' numbers stand for pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import pixels
from fieldglass.plans.registry import query, six, six_sql, table


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a supplier as the pixels of one picture."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("key"), (F.col("l_partkey") % 40).cast("int").alias("x"), (F.col("l_orderkey") % 30).cast("int").alias("y"),
        (F.col("l_partkey") % 251).cast("int").alias("b"), (F.col("l_orderkey") % 256).cast("int").alias("g"), (F.col("l_quantity") * 5).cast("int").alias("r"))


_P = """p AS (SELECT l_suppkey AS key, CAST(l_partkey % 40 AS INTEGER) AS x, CAST(l_orderkey % 30 AS INTEGER) AS y, CAST(l_partkey % 251 AS INTEGER) AS b, CAST(l_orderkey % 256 AS INTEGER) AS g, CAST(l_quantity * 5 AS INTEGER) AS r FROM lineitem),
s AS (SELECT *, greatest(b, g, r) AS val, CAST(greatest(b, g, r) - least(b, g, r) AS DOUBLE) AS span FROM p),
q AS (SELECT *, CASE WHEN span = 0 THEN 0.0::DOUBLE WHEN val = r THEN 60 * (g - b) / span WHEN val = g THEN 120 + 60 * (b - r) / span ELSE 240 + 60 * (r - g) / span END AS hh FROM s),
c AS (SELECT key, x, y, b, g, r, CAST(round(CASE WHEN hh < 0 THEN hh + 360 ELSE hh END / 2) AS INTEGER) % 180 AS hue, CASE WHEN val = 0 THEN 0 ELSE CAST(round(255 * span / val) AS INTEGER) END AS sat, val,
  CAST(round(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r) AS INTEGER) AS gray FROM q)"""


def coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = crops(spark, sf_dir)
    rgb = [F.col("b"), F.col("g"), F.col("r")]
    return c.select("key", "x", "y", pixels.gray(*rgb).alias("gray"), pixels.hsv(*rgb).alias("c")).select("key", "x", "y", "gray", "c.*")


@query("pixel_colours", f"WITH {_P} SELECT key, x, y, hue, sat, val, gray, count(*) AS n FROM c GROUP BY ALL")
def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coloured(spark, sf_dir).groupBy("key", "x", "y", "hue", "sat", "val", "gray").agg(F.count(F.lit(1)).alias("n"))


@query("saturated_pixels", f"""WITH {_P}, i AS (SELECT key, x, y FROM c WHERE pow((x - 19.5::DOUBLE) / 20.0::DOUBLE, 2) + pow((y - 14.5::DOUBLE) / 15.0::DOUBLE, 2) <= 0.8::DOUBLE * 0.8::DOUBLE AND sat > 80 AND val > 60)
SELECT key, x, y FROM i QUALIFY count(*) OVER (PARTITION BY key) >= 20""")
def saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = coloured(spark, sf_dir).withColumn("width", F.lit(40)).withColumn("height", F.lit(30))
    return pixels.coloured(c).select("key", "x", "y")


@query("adaptive_cuts", f"""WITH {_P}, l AS (SELECT key, list_sort(list(sat)) AS s, list_sort(list(val)) AS v FROM c GROUP BY key)
SELECT key, greatest(20.0::DOUBLE, 0.5::DOUBLE * s[CAST(floor(len(s) / 2) AS INTEGER) + 1]) AS sat_cut, greatest(40.0::DOUBLE, 0.5::DOUBLE * v[CAST(floor(0.2::DOUBLE * (len(v) - 1)) AS INTEGER) + 1]) AS val_cut FROM l""")
def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.adaptive_cuts(coloured(spark, sf_dir))


_PROFILE = """m AS (SELECT key, y, avg(gray) AS m FROM c GROUP BY key, y),
n AS (SELECT key, y, m, lag(m) OVER w AS b1, lag(m, 2) OVER w AS b2, lead(m) OVER w AS a1, lead(m, 2) OVER w AS a2 FROM m WINDOW w AS (PARTITION BY key ORDER BY y)),
f AS (SELECT key, y, (coalesce(b2, CASE WHEN b1 IS NOT NULL THEN m END, a2, m) + 4 * coalesce(b1, a1, m) + 6 * m + 4 * coalesce(a1, b1, m) + coalesce(a2, CASE WHEN a1 IS NOT NULL THEN m END, b2, m)) / 16 AS level FROM n)"""


@query("row_profile", f"WITH {_P}, {_PROFILE} SELECT key, y, {six_sql('level')} AS level FROM f")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.row_profile(coloured(spark, sf_dir)).select("key", "y", six(F.col("level")).alias("level"))


@query("photo_measures", f"WITH {_P} SELECT key, {six_sql('avg(gray)')} AS mean_gray, {six_sql('avg(CASE WHEN val > 250 THEN 1 ELSE 0 END)')} AS glare_share FROM c GROUP BY key")
def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.photo_measures(coloured(spark, sf_dir)).select("key", six(F.col("mean_gray")).alias("mean_gray"), six(F.col("glare_share")).alias("glare_share"))


@query("column_profile", f"WITH {_P} SELECT key, x, count(*) AS n FROM c WHERE gray > 128 GROUP BY key, x")
def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.column_profile(coloured(spark, sf_dir).where("gray > 128"))


@query("component_brightness", f"WITH {_P} SELECT key, y AS ord, {six_sql('avg(gray)')} AS bright FROM c GROUP BY key, y")
def brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pixels.component_brightness(coloured(spark, sf_dir).withColumn("ord", F.col("y")))
    return found.select("key", "ord", six(F.col("bright")).alias("bright"))


@query("focus_band", f"""WITH {_P}, {_PROFILE}, st AS (SELECT key, min(level) AS lo, max(level) AS hi, CAST(count(*) AS INTEGER) AS k FROM f GROUP BY key),
ee AS (SELECT f.key, y, level >= lo + 0.55::DOUBLE * (hi - lo) AS on_, row_number() OVER (PARTITION BY f.key ORDER BY y) AS i FROM f JOIN st USING (key)),
gg AS (SELECT key, y, i - row_number() OVER (PARTITION BY key ORDER BY y) AS run FROM ee WHERE on_), rr AS (SELECT key, min(y) AS start, count(*) AS n FROM gg GROUP BY key, run),
best AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, start) = 1), z AS (SELECT key, k, start, n, greatest(2, CAST(trunc(0.18::DOUBLE * n) AS INTEGER)) AS pad,
  k >= 12 AND hi - lo >= 12 AND n >= 0.25::DOUBLE * k AS keep FROM st LEFT JOIN best USING (key))
SELECT key, CAST(CASE WHEN keep THEN greatest(0, start - pad) ELSE 0 END AS INTEGER) AS y0, CAST(CASE WHEN keep THEN least(k, start + n + pad) ELSE k END AS INTEGER) AS y1 FROM z""")
def focus_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.focus_band(coloured(spark, sf_dir))


@query("connected_components", f"""WITH RECURSIVE {_P}, m AS (SELECT DISTINCT key, x, y FROM c WHERE gray > 190), reach AS (
  SELECT key, x, y, x AS px, y AS py FROM m UNION SELECT r.key, r.x, r.y, m.x, m.y FROM reach r JOIN m ON m.key = r.key AND abs(m.x - r.px) <= 1 AND abs(m.y - r.py) <= 1
), l AS (SELECT key, x, y, min(py * 1000 + px) AS root FROM reach GROUP BY key, x, y)
SELECT CAST(key AS VARCHAR) AS key, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, CAST(count(*) AS INTEGER) AS area FROM l GROUP BY l.key, root""")
def connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.components(coloured(spark, sf_dir).where("gray > 190")).drop("ord", "bright")


@query("score_glyphs", f"""WITH RECURSIVE {_P}, m AS (SELECT key, x, y, max(gray) AS gray FROM c WHERE gray > 190 GROUP BY key, x, y), reach AS (
  SELECT key, x, y, x AS px, y AS py FROM m UNION SELECT r.key, r.x, r.y, m.x, m.y FROM reach r JOIN m ON m.key = r.key AND abs(m.x - r.px) <= 1 AND abs(m.y - r.py) <= 1
), l AS (SELECT key, x, y, min(py * 1000 + px) AS root FROM reach GROUP BY key, x, y),
o AS (SELECT key, root, min(l.x) AS x, min(l.y) AS y, max(l.x) - min(l.x) + 1 AS w, max(l.y) - min(l.y) + 1 AS h, count(*) AS area, avg(gray) AS bright FROM l JOIN m USING (key, x, y) GROUP BY key, root),
h AS (SELECT *, max(h) OVER (PARTITION BY key) AS mh FROM o), f AS (SELECT * FROM h WHERE h >= CAST(0.55 AS FLOAT) * CAST(mh AS FLOAT) AND area >= CAST(0.05 AS FLOAT) * CAST(w * h AS FLOAT) AND w <= 3 * h),
b AS (SELECT *, max(bright) OVER (PARTITION BY key) AS mb FROM f), k AS (SELECT *, max(h) OVER (PARTITION BY key) AS mx, CAST(y + h / 2 AS FLOAT) AS cy FROM b WHERE CAST(bright AS FLOAT) >= CAST(0.62 AS FLOAT) * CAST(mb AS FLOAT)),
n AS (SELECT * FROM k WHERE CAST(h AS FLOAT) >= CAST(0.68 AS FLOAT) * CAST(mx AS FLOAT)), z AS (SELECT key, median(h) AS mid, list_sort(list(cy))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS line FROM n GROUP BY key)
SELECT CAST(n.key AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY n.key ORDER BY x, root) - 1 AS INTEGER) AS place, x, y, w, h FROM n JOIN z USING (key) WHERE abs(cy - line) <= CAST(0.42 AS FLOAT) * CAST(mid AS FLOAT)""")
def score_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.score_glyphs(coloured(spark, sf_dir).where("gray > 190"))
