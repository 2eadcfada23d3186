"""Queries of sequence operators: the lines of an order stand for components of a crop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.operators import lines
from fieldglass.plans.registry import LINE_ORDER, ORD_SQL, query, six, six_sql, table


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    return d.select(
        F.col("l_orderkey").alias("key"), ord_.alias("ord"), (F.col("l_partkey") % 97).cast("int").alias("x"), (F.col("l_suppkey") % 13).cast("int").alias("y"),
        (F.col("l_partkey") % 11 + 2).cast("int").alias("w"), (F.col("l_quantity") % 7 + 8).cast("int").alias("h"), "l_discount", "l_quantity",
    )


_C = f"""c AS (SELECT l_orderkey AS key, CAST({ORD_SQL} AS INTEGER) AS ord, CAST(l_partkey % 97 AS INTEGER) AS x, CAST(l_suppkey % 13 AS INTEGER) AS y,
  CAST(l_partkey % 11 + 2 AS INTEGER) AS w, CAST(l_quantity % 7 + 8 AS INTEGER) AS h, l_discount, l_quantity FROM lineitem)"""


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with a pixel area, a brightness, and the size of their image."""
    k = F.col("key")
    more = {"area": (1 + (F.col("x") * 31 + F.col("y") * 7) % (F.col("w") * F.col("h"))).cast("int"), "bright": ((F.col("x") * 13 + F.col("y")) % 256).cast("double"),
            "rows": (60 + k % 60).cast("int"), "cols": (8 + k % 20).cast("int")}
    return components(spark, sf_dir).withColumns(more)


_I = f"""{_C}, i AS (SELECT *, 1 + (x * 31 + y * 7) % (w * h) AS area, CAST((x * 13 + y) % 256 AS DOUBLE) AS bright, 60 + key % 60 AS rows_, 8 + key % 20 AS cols_,
  max(h) OVER (PARTITION BY key) AS mh FROM c)"""


def _part(share: float, of: str) -> str:
    return f"CAST({share} AS FLOAT) * CAST({of} AS FLOAT)"


@query("title_components", f"""WITH {_I}, m AS (SELECT *, max(area) OVER (PARTITION BY key) AS ma FROM i)
SELECT key, ord FROM m WHERE area >= {_part(0.02, "ma")} AND h >= {_part(0.12, "rows_")} AND w <= {_part(0.5, "cols_")}""")
def title_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.title_components(pictures(spark, sf_dir)).select("key", "ord")


@query("badge_components", f"WITH {_I} SELECT key, ord FROM i WHERE h >= {_part(0.55, 'mh')} AND area >= {_part(0.02, 'rows_ * cols_')}")
def badge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.badge_components(pictures(spark, sf_dir)).select("key", "ord")


@query("score_components", f"""WITH {_I}, s AS (SELECT * FROM i WHERE h >= {_part(0.55, "mh")} AND area >= {_part(0.05, "w * h")} AND w <= 3 * h),
b AS (SELECT *, max(bright) OVER (PARTITION BY key) AS mb FROM s) SELECT key, ord FROM b WHERE CAST(bright AS FLOAT) >= {_part(0.62, "mb")}""")
def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.score_components(pictures(spark, sf_dir)).select("key", "ord")


@query("height_filter", f"""WITH {_C}, m AS (SELECT *, median(h) OVER (PARTITION BY key) AS mid FROM c), n AS (SELECT *, CAST(abs(h - mid) AS FLOAT) <= {_part(0.2, "mid")} AS near FROM m)
SELECT key, ord FROM (SELECT *, count(*) FILTER (near) OVER (PARTITION BY key) AS k FROM n) WHERE near OR k < 3""")
def height_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.height_filter(components(spark, sf_dir), share=0.2).select("key", "ord")


@query("dominant_line", f"""WITH {_C}, m AS (SELECT *, median(h) OVER (PARTITION BY key) AS mid FROM c), n AS (SELECT *, CAST(abs(h - mid) AS FLOAT) <= {_part(0.42, "mid")} AS near FROM m),
k AS (SELECT *, count(*) FILTER (near) OVER (PARTITION BY key) AS k FROM n),
g AS (SELECT *, x - lag(x + w) OVER (PARTITION BY key ORDER BY x, ord) AS gap FROM k WHERE near AND k >= 3),
l AS (SELECT *, greatest({_part(2.6, "coalesce(median(gap) FILTER (gap >= 0) OVER (PARTITION BY key), 0)")}, {_part(0.9, "mid")}) AS lim FROM g),
r AS (SELECT *, sum(CASE WHEN CAST(gap AS FLOAT) > lim THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY x, ord ROWS UNBOUNDED PRECEDING) AS run FROM l),
s AS (SELECT *, sum(w) OVER (PARTITION BY key, run) AS width FROM r)
SELECT key, ord, CAST(run AS BIGINT) AS run FROM (SELECT *, first_value(run) OVER (PARTITION BY key ORDER BY width DESC, run) AS best FROM s) WHERE run = best
UNION ALL SELECT key, ord, CAST(0 AS BIGINT) FROM k WHERE k < 3""")
def dominant_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dominant_line(components(spark, sf_dir)).select("key", "ord", "run")


@query("longest_run", """WITH e AS (SELECT user_id AS key, event_id AS y, value >= 20 AS on_, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
g AS (SELECT key, y, i - row_number() OVER (PARTITION BY key ORDER BY y) AS run FROM e WHERE on_), r AS (SELECT key, min(y) AS start, count(*) AS length FROM g GROUP BY key, run)
SELECT key, start, length FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY length DESC, start) = 1""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("y"), "value")
    return lines.longest_run(e, F.col("value") >= 20)


@query("merge_by_x", f"""WITH {_C}, f AS (SELECT key, list_reduce(list(struct_pack(x := x, ord := ord, x2 := x + w, y := y, y2 := y + h) ORDER BY x, ord, w),
  lambda acc, b: CASE WHEN len(acc) > 0 AND least(acc[-1].x2, b.x2) > greatest(acc[-1].x, b.x)
    AND CAST(least(acc[-1].x2, b.x2) - greatest(acc[-1].x, b.x) AS FLOAT) >= {_part(0.55, "least(acc[-1].x2 - acc[-1].x, b.x2 - b.x)")}
    THEN list_append(acc[:-2], struct_pack(x := acc[-1].x, ord := acc[-1].ord, x2 := greatest(acc[-1].x2, b.x2), y := least(acc[-1].y, b.y), y2 := greatest(acc[-1].y2, b.y2))) ELSE list_append(acc, b) END,
  CAST([] AS STRUCT(x INTEGER, ord INTEGER, x2 INTEGER, y INTEGER, y2 INTEGER)[])) AS m FROM c GROUP BY key)
SELECT key, CAST(i - 1 AS INTEGER) AS part, m[i].x AS x, m[i].y AS y, m[i].x2 - m[i].x AS w, m[i].y2 - m[i].y AS h FROM (SELECT key, m, unnest(range(1, len(m) + 1)) AS i FROM f)""")
def merge_by_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.merge_by_x(components(spark, sf_dir))


@query("same_line", f"""WITH {_C}, m AS (SELECT key, ord, y, h * 4 - 24 AS h FROM c), t AS (SELECT *, max(h) OVER (PARTITION BY key) AS mx FROM m),
b AS (SELECT *, CAST(y + h / 2 AS FLOAT) AS cy FROM t WHERE CAST(h AS FLOAT) >= {_part(0.68, "mx")} AND CAST(h AS FLOAT) <= {_part(1.45, "mx")}),
s AS (SELECT key, median(h) AS mid, list_sort(list(cy))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS line FROM b GROUP BY key)
SELECT key, ord FROM b JOIN s USING (key) WHERE abs(cy - line) <= {_part(0.42, "mid")}""")
def same_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.same_line(components(spark, sf_dir).withColumn("h", F.col("h") * 4 - 24)).select("key", "ord")


@query("coherence", f"WITH {_C} SELECT key, {six_sql('-stddev_pop(h) / avg(h)')} AS coherence FROM c GROUP BY key")
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.coherence(components(spark, sf_dir)).select("key", six(F.col("coherence")).alias("coherence"))


@query("plausibility", f"""WITH {_C}, g AS (SELECT *, x + w / 2 - lag(x + w / 2) OVER (PARTITION BY key ORDER BY x + w / 2) AS gap FROM c)
SELECT key, CASE WHEN count(*) BETWEEN 6 AND 7 THEN 2 WHEN count(*) BETWEEN 4 AND 8 THEN 1 ELSE 0 END AS tier,
  {six_sql("-coalesce(stddev_pop(h) / nullif(avg(h), 0), 0) - coalesce(stddev_pop(gap) / nullif(avg(gap), 0), 0)")} AS regularity FROM g GROUP BY key""")
def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.plausibility(components(spark, sf_dir)).select("key", "tier", six(F.col("regularity")).alias("regularity"))


@query("weighted_median", f"""WITH {_C}, r AS (SELECT key, x, sum(w) OVER (PARTITION BY key ORDER BY x RANGE UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY key) AS total FROM c)
SELECT key, min(x) AS median FROM r WHERE run >= total / 2 GROUP BY key""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.weighted_median(components(spark, sf_dir), "key", "x", "w")


@query("percentiles", """WITH v AS (SELECT event_type AS key, value, list_sort(list(value) OVER (PARTITION BY event_type)) AS l FROM events)
SELECT key, floor(quantile_cont(value, 0.9) * 1e6 + 0.5) / 1e6 AS linear, first(l[CAST(floor(0.9::DOUBLE * (len(l) - 1)) AS INTEGER) + 1]) AS lower,
  first(l[CAST(floor(len(l) / 2) AS INTEGER) + 1]) AS upper_median, floor(median(value) * 1e6 + 0.5) / 1e6 AS median FROM v GROUP BY key""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "value")
    found = lines.percentiles(e, "key", "value", 0.9)
    return found.select("key", six(F.col("linear")).alias("linear"), "lower", "upper_median", six(F.col("median")).alias("median"))


_HIST = "h AS (SELECT event_type AS key, CAST(least(255, floor(value)) AS INTEGER) AS v, count(*) AS n FROM events GROUP BY ALL)"


@query("histogram_256", f"WITH {_HIST} SELECT * FROM h")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("key", F.col("event_type"))
    return lines.histogram(e, F.least(F.lit(255), F.floor("value")))


@query("otsu", f"""WITH {_HIST}, r AS (SELECT key, v, sum(n) OVER u AS w0, sum(n * v) OVER u AS s0, sum(n) OVER a AS w, sum(n * v) OVER a AS s FROM h
  WINDOW u AS (PARTITION BY key ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY key)),
b AS (SELECT key, v, w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) AS apart FROM r WHERE w > w0)
SELECT key, v AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY apart DESC, v) = 1""")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.otsu(histogram(spark, sf_dir))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pixels of a user's badge."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), (F.floor("value") % 180).cast("int").alias("hue"), (F.col("event_id") % 256).cast("int").alias("sat"), (F.col("event_id") % 200).cast("int").alias("val"))


_PX = "p AS (SELECT user_id AS key, CAST(floor(value) % 180 AS INTEGER) AS hue, CAST(event_id % 256 AS INTEGER) AS sat, CAST(event_id % 200 AS INTEGER) AS val FROM events)"


@query("hue_vote", f"""WITH {_PX}, n AS (SELECT key, count(*) AS total, count(*) FILTER (hue BETWEEN 0 AND 22 OR hue BETWEEN 168 AND 179) AS s, count(*) FILTER (hue BETWEEN 23 AND 34) AS c,
  count(*) FILTER (hue BETWEEN 35 AND 85) AS d, count(*) FILTER (hue BETWEEN 86 AND 130) AS hd FROM p GROUP BY key), m AS (SELECT *, greatest(s, c, d, hd) AS top FROM n)
SELECT key, CASE WHEN top = 0 THEN NULL WHEN s = top THEN 'single' WHEN c = top THEN 'coop' WHEN d = top THEN 'double' ELSE 'halfdouble' END AS chart, top / total AS conf FROM m""")
def hue_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.hue_vote(pixels(spark, sf_dir))


@query("hue_histogram", f"""WITH {_PX}, b AS (SELECT key, i, count(*) FILTER (least(17, floor(hue / 10)) = i) / count(*) AS share FROM p, (SELECT unnest(range(0, 18)) AS i) GROUP BY key, i),
x AS (SELECT key, i, share FROM b UNION ALL SELECT key, 18, avg(sat) / 255 FROM p GROUP BY key UNION ALL SELECT key, 19, avg(val) / 255 FROM p GROUP BY key)
SELECT key, CAST(i AS INTEGER) AS bin, {six_sql('share')} AS share FROM x""")
def hue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lines.hue_histogram(pixels(spark, sf_dir)).select("key", F.posexplode("feature").alias("bin", "s"))
    return f.select("key", "bin", six(F.col("s")).alias("share"))
