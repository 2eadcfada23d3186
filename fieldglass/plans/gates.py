"""Queries of the gates: prices, discounts and taxes stand for readings and their margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.operators import resolve
from fieldglass.plans.registry import LINE_ORDER, ORD_SQL, query, six, six_sql, table


@query("pooled_fold", f"""WITH o AS (SELECT l_orderkey AS key, {ORD_SQL} AS ord, l_discount + l_tax AS x FROM lineitem)
SELECT key, {six_sql("list_reduce(list(x ORDER BY ord), lambda acc, v: greatest(acc, v) + 0.15::DOUBLE * least(acc, v), 0.0::DOUBLE)")} AS pooled FROM o GROUP BY key""")
def pooled_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), ord_.alias("ord"), (F.col("l_discount") + F.col("l_tax")).alias("x"))
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("ord", "x"))), lambda s: s["x"])
    return rows.groupBy("key").agg(all_.alias("all")).select("key", six(resolve.pooled(F.col("all"))).alias("pooled"))


@query("margin_gate", f"""WITH r AS (SELECT o_custkey AS key, list(o_totalprice / 1e6 ORDER BY o_totalprice DESC, o_orderkey) AS s FROM orders GROUP BY o_custkey),
m AS (SELECT key, CASE WHEN len(s) > 1 THEN s[1] - s[2] ELSE 1.0::DOUBLE END AS margin FROM r)
SELECT key, {six_sql('margin')} AS margin, CASE WHEN margin >= 0.001 THEN NULL ELSE 'margen_bajo' END AS reason FROM m""")
def margin_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.reverse(F.array_sort(F.collect_list(F.col("o_totalprice") / 1e6))).alias("s"))
    r = r.withColumn("margin", resolve.margin_of(F.col("s")))
    return r.select("key", six(F.col("margin")).alias("margin"), F.when(F.col("margin") < resolve.Gates().song_margin, resolve.LOW_MARGIN).alias("reason"))


@query("score_gate", """WITH s AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS INTEGER) END AS v, (o_orderkey % 25) / 1000 AS m,
  CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS INTEGER) WHEN 1 THEN 5 END AS v2 FROM orders),
r AS (SELECT key, v, CASE WHEN v IS NULL THEN 0 ELSE m END AS conf, CASE WHEN v IS NULL THEN 'sin_glifos' WHEN m >= 0.010 OR v2 = v THEN NULL ELSE 'margen_bajo' END AS reason FROM s)
SELECT key, CASE WHEN reason IS NULL THEN v END AS value, CAST(conf AS FLOAT) AS confidence, reason FROM r""")
def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, v = F.col("o_orderkey"), F.col("o_custkey").cast("int")
    f = resolve.score_gate(F.when(key % 11 != 0, v), (key % 25) / 1000, F.when(key % 3 == 0, v).when(key % 3 == 1, 5))
    return table(spark, sf_dir, "orders").select(key.alias("key"), f.alias("f")).select("key", "f.*")


@query("chart_gate", """WITH c AS (SELECT p_partkey AS key, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS raw, p_size / 100 AS conf FROM part),
r AS (SELECT key, raw, conf, CASE WHEN raw = '' OR conf < 0.15 THEN 'baja_confianza' END AS reason FROM c)
SELECT key, CASE WHEN reason IS NULL THEN raw END AS value, CAST(conf AS FLOAT) AS confidence, reason FROM r""")
def chart_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = resolve.chart_gate(F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")), F.col("p_size") / 100)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), f.alias("f")).select("key", "f.*")


@query("level_decode", f"""WITH l AS (SELECT p_name, list_sort(list(DISTINCT p_size)) AS levels FROM part GROUP BY p_name),
s AS (SELECT p_partkey AS key, p_name, 1 + p_partkey % 2 AS n, list_transform(range(0, 2), lambda i: list_transform(range(0, 10), lambda d: ((p_partkey * 31 + i * 17 + d * 7) % 101) / 128)) AS scores FROM part),
c AS (SELECT key, n, scores, unnest(list_filter(levels, lambda v: len(CAST(v AS VARCHAR)) <= n)) AS level FROM s JOIN l USING (p_name)),
t AS (SELECT key, n, level, list_sum(list_transform(range(1, n + 1), lambda i: scores[i][CAST(substr(lpad(CAST(level AS VARCHAR), CAST(n AS INTEGER), '0'), i, 1) AS INTEGER) + 1])) AS total FROM c),
r AS (SELECT key, n, level, total, lead(total) OVER w AS next, row_number() OVER w AS rank FROM t WINDOW w AS (PARTITION BY key ORDER BY total DESC, level))
SELECT key, level, {six_sql('CASE WHEN next IS NULL THEN 1.0 ELSE (total - next) / n END')} AS margin FROM r WHERE rank = 1""")
def level_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    levels = part.groupBy("p_name").agg(F.array_sort(F.collect_set("p_size")).alias("levels"))
    key = F.col("p_partkey")
    slot = lambda i: F.array(*[((key * 31 + i * 17 + d * 7) % 101) / 128 for d in range(10)])
    scores = F.slice(F.array(slot(0), slot(1)), F.lit(1), (1 + key % 2).cast("int"))
    short = F.exists("levels", lambda l: F.length(l.cast("string")) <= (1 + key % 2))  # else no level is legal
    # scores are worked out before the join, so that they aren't again for every level
    rows = part.select(key, "p_name", scores.alias("scores")).join(levels, "p_name").where(short)
    rows = rows.select(key.alias("key"), resolve.level_choice(F.col("levels"), F.col("scores")).alias("c"))
    return rows.select("key", "c.level", six(F.col("c.margin")).alias("margin"))


@query("title_reads", """WITH t AS (SELECT p_partkey AS key, i AS title, CASE WHEN (p_partkey + i) % 4 <> 0 THEN substr(p_name, i + 1, 5) ELSE '' END AS raw, CASE WHEN (p_partkey + i) % 3 = 0 THEN p_brand ELSE substr(p_name, i + 1, 5) END AS raw2,
  CASE WHEN (p_partkey + i) % 5 <> 0 THEN ((p_partkey * 7 + i * 13) % 20) / 20 END AS conf FROM part, range(8) r(i) WHERE i < p_partkey % 9),
k AS (SELECT key, title, raw, raw2, coalesce(conf, 1.0) AS conf FROM t WHERE title < 5 AND raw <> '' AND coalesce(conf, 1.0) >= 0.2::DOUBLE)
SELECT key, CAST(title AS INTEGER) AS title, 0 AS variant, raw AS text, floor(sqrt(greatest(conf, 0.02)) * 1e6 + 0.5) / 1e6 AS weight FROM k
UNION ALL SELECT key, CAST(title AS INTEGER), 1, raw2, floor(sqrt(greatest(conf, 0.02)) * 0.85::DOUBLE * 1e6 + 0.5) / 1e6 FROM k WHERE raw2 <> raw AND raw2 <> ''""")
def title_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight titles a photo, of which the first five count, with a confidence of 0.2 or more."""
    k, name = F.col("p_partkey"), F.col("p_name")
    each = lambda i: F.struct(
        F.when((k + i) % 4 != 0, F.substring(name, i + 1, 5)).otherwise("").alias("raw"), F.when((k + i) % 3 == 0, F.col("p_brand")).otherwise(F.substring(name, i + 1, 5)).alias("raw2"),
        F.when((k + i) % 5 != 0, ((k * 7 + i * 13) % 20) / 20).alias("conf"))
    photos = table(spark, sf_dir, "part").select(k.alias("key"), F.slice(F.array(*[each(i) for i in range(8)]), F.lit(1), (k % 9).cast("int")).alias("titles"))
    return resolve.title_reads(photos, resolve.Gates(title_conf=0.2)).withColumn("weight", six(F.col("weight")))


@query("level_fallback", """WITH d AS (SELECT p_partkey AS key, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '2-1' WHEN 2 THEN '-12' WHEN 3 THEN '2147483647' WHEN 4 THEN '2147483648' ELSE CAST(p_size AS VARCHAR) END AS t, p_partkey % 5 = 0 AS bare FROM part),
n AS (SELECT *, TRY_CAST(t AS INTEGER) AS v FROM d), r AS (SELECT key, v, CASE WHEN bare OR t IS NULL THEN 'sin_glifos' WHEN v IS NULL THEN 'no_numerico' WHEN v NOT BETWEEN 1 AND 28 THEN 'fuera_de_rango' END AS reason FROM n)
SELECT key, CASE WHEN reason IS NULL THEN v END AS value, CAST(0 AS FLOAT) AS confidence, reason FROM r""")
def level_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels by their digits alone, where the catalog knows none."""
    k, digits = F.col("p_partkey") % 6, lambda *d: F.array(*[F.lit(x) for x in d])
    read = F.when(k == 1, digits(2, -1)).when(k == 2, digits(-1, 2)).when(k == 3, digits(2, 1, 4, 7, 4, 8, 3, 6, 4, 7)).when(k == 4, digits(2, 1, 4, 7, 4, 8, 3, 6, 4, 8)).when(k == 5, F.array("p_size"))
    glyphs = F.when(F.col("p_partkey") % 5 != 0, F.array(F.array(F.lit(0.0))))
    found = resolve.level_field(F.lit(None).cast("array<int>"), read, glyphs)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), found.alias("f")).select("key", "f.*")


@query("score_margins", f"""WITH o AS (SELECT l_orderkey AS key, list(l_discount ORDER BY {", ".join(LINE_ORDER)}) AS m FROM lineitem GROUP BY l_orderkey)
SELECT key, list_min(m) AS least, {six_sql("list_sum(m) / len(m)")} AS mean FROM o""")
def score_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and the mean margin of the glyphs of an order."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sort_array(F.collect_list("l_discount")).alias("m"))
    return rows.select("key", resolve.score_margin(F.col("m")).alias("least"), six(resolve.mean_margin(F.col("m"))).alias("mean"))


@query("second_reading", f"""WITH p AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN '12345678' ELSE lpad(CAST((p_partkey * 7919) % 1000000 AS VARCHAR), 7, '0') END AS d, (p_size % 9) / 100 AS m1, (p_size % 4) / 100 AS m2 FROM part)
SELECT key, CASE WHEN d = '12345678' THEN -1 ELSE CAST(substr(d, 2) AS INTEGER) END AS score, least(m1, m2) AS margin FROM p""")
def second_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    digits = F.when(k % 5 == 0, "12345678").otherwise(F.lpad(((k * 7919) % 1000000).cast("string"), 7, "0"))
    r = resolve.score_reading(digits, F.array((size % 9) / 100, (size % 4) / 100))
    return table(spark, sf_dir, "part").select(k.alias("key"), r.alias("r")).select("key", "r.*")


@query("chart_override", """WITH c AS (SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN 'SINGLE' WHEN 1 THEN 'co' WHEN 2 THEN 'half double' ELSE p_name END AS t, (p_size % 20) / 100 AS m FROM part),
s AS (SELECT key, CASE WHEN m > 0.05 THEN CASE WHEN t = 'SINGLE' THEN 'single' WHEN t = 'half double' THEN 'halfdouble' END END AS named FROM c)
SELECT key, coalesce(named, 'coop') AS chart, CASE WHEN named IS NULL THEN 0.4::DOUBLE ELSE 0.95::DOUBLE END AS conf FROM s""")
def chart_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, "SINGLE").when(k % 4 == 1, "co").when(k % 4 == 2, "half double").otherwise(F.col("p_name"))
    c = resolve.chart_override(text, F.array((F.col("p_size") % 20) / 100), F.lit("coop"), F.lit(0.4))
    return table(spark, sf_dir, "part").select(k.alias("key"), c.alias("c")).select("key", "c.*")
