"""Queries of cutting and choosing over order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import segments
from fieldglass.plans.lines import _C, components
from fieldglass.plans.registry import query


@query("best_threshold", f"""WITH {_C}, t AS (SELECT key, ord, CAST(l_quantity % 3 AS INTEGER) AS tier, l_discount AS regularity FROM c),
e AS (SELECT *, coalesce(max(CASE WHEN tier = 2 AND regularity > 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM t)
SELECT key, ord, tier, regularity FROM e WHERE ended = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier DESC, regularity DESC, ord) = 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = components(spark, sf_dir).select("key", "ord", (F.col("l_quantity") % 3).cast("int").alias("tier"), F.col("l_discount").alias("regularity"))
    return segments.best_threshold(tries, enough=0.05)


@query("best_readings", f"""WITH {_C}, t AS (SELECT key, ord, CAST(w AS VARCHAR) AS reading, h AS score_a, l_discount AS score_b FROM c),
d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY key, reading ORDER BY score_a DESC, score_b DESC, ord) = 1)
SELECT key, reading, ord, CAST(row_number() OVER (PARTITION BY key ORDER BY score_a DESC, score_b DESC, ord) AS INTEGER) AS rank FROM d QUALIFY rank <= 2""")
def best_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = components(spark, sf_dir).select("key", "ord", F.col("w").cast("string").alias("reading"), F.col("h").alias("score_a"), F.col("l_discount").alias("score_b"))
    return segments.best_readings(tries).select("key", "reading", "ord", "rank")


@query("force_merge", f"""WITH {_C}, o AS (SELECT key, x, x + w AS x2, row_number() OVER v AS i, lead(x) OVER v - (x + w) AS gap, count(*) OVER (PARTITION BY key) AS k FROM c WINDOW v AS (PARTITION BY key ORDER BY x, ord)),
m AS (SELECT key, min(struct_pack(gap := gap, i := i)).i AS spot FROM o WHERE gap IS NOT NULL GROUP BY key),
j AS (SELECT o.key, i, CASE WHEN i = spot + 1 THEN spot ELSE i END AS g, x, x2 FROM o LEFT JOIN m USING (key))
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY g) - 1 AS INTEGER) AS part, CAST(min(x) AS INTEGER) AS x1, CAST(max(x2) AS INTEGER) AS x2 FROM j GROUP BY key, g""")
def force_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.merge_to(components(spark, sf_dir), F.col("size") - 1)


@query("force_split", f"""WITH {_C}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY x, ord) AS i FROM c),
m AS (SELECT key, min(struct_pack(w := -w, i := i)).i AS spot FROM o GROUP BY key),
p AS (SELECT o.*, CASE WHEN i = spot AND w >= 4 THEN greatest(1, CAST(trunc(CAST(0.25 AS FLOAT) * w) AS INTEGER)) END AS lo, least(w - 1, CAST(trunc(CAST(0.75 AS FLOAT) * w) AS INTEGER)) AS hi FROM o JOIN m USING (key)),
q AS (SELECT *, CASE WHEN lo IS NULL THEN NULL WHEN hi > lo THEN lo + list_position(list_transform(range(lo, hi), lambda a: (a * 7 + x) % 9), list_min(list_transform(range(lo, hi), lambda a: (a * 7 + x) % 9))) - 1 ELSE w // 2 END AS cut FROM p),
s AS (SELECT key, i, 0 AS half, x AS x1, CASE WHEN cut IS NULL THEN x + w ELSE x + cut END AS x2 FROM q UNION ALL SELECT key, i, 1, x + cut, x + w FROM q WHERE cut IS NOT NULL)
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY i, half) - 1 AS INTEGER) AS part, CAST(x1 AS INTEGER) AS x1, CAST(x2 AS INTEGER) AS x2 FROM s""")
def force_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = components(spark, sf_dir)
    profile = c.select("key", "ord", "x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("at")).select("key", "ord", "at", ((F.col("at") * 7 + F.col("x")) % 9).alias("n"))
    return segments.split_to(c, profile, F.col("size") + 1)


@query("split_merged", f"""WITH {_C}, p AS (SELECT key, ord, x, y, w, h, a, (a * 7 + x) % 9 AS n FROM c, (SELECT unnest(range(0, 13)) AS a) WHERE a < w),
m AS (SELECT *, max(n) OVER (PARTITION BY key, ord) AS most FROM p), v AS (SELECT key, ord, min(struct_pack(n := n, at := a)) AS v, first(most) AS most FROM m
  WHERE a >= CAST(trunc(CAST(0.30 AS FLOAT) * w) AS INTEGER) AND a < CAST(trunc(CAST(0.70 AS FLOAT) * w) AS INTEGER) GROUP BY key, ord),
j AS (SELECT c.*, v.v AS v, w > 0.95::DOUBLE * h AND w >= 6 AND v.v IS NOT NULL AND v.v.n <= 0.55::DOUBLE * most AS apart FROM c LEFT JOIN v USING (key, ord))
SELECT key, ord, 0 AS part, x, CAST(CASE WHEN apart THEN v.at ELSE w END AS INTEGER) AS w FROM j UNION ALL SELECT key, ord, 1, CAST(x + v.at AS INTEGER), CAST(w - v.at AS INTEGER) FROM j WHERE apart""")
def split_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = components(spark, sf_dir)
    profile = c.select("key", "ord", "x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("at")).select("key", "ord", "at", ((F.col("at") * 7 + F.col("x")) % 9).alias("n"))
    return segments.split_merged(c, profile).select("key", "ord", "part", "x", "w")
