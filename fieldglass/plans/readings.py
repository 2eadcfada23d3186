"""Queries of whole readings: parts as photos whose titles were misread, their names as the catalog.

Every photo is a reading record in JSON, parsed and gated as recorded ones
are; what comes out is scored against what the part really is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import evaluate, resolve
from fieldglass.plans.registry import query, six, six_sql, table
from fieldglass.plans.text import _BLOCK
from fieldglass.sources.readers import read_native

#: Catalog keys that part types stand for; the last has none.
TYPES = {"ECONOMY": "s", "SMALL": "d", "STANDARD": "hd", "PROMO": "c"}
CHARTS = ("", "single", "double", "coop", "halfdouble")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit("")
    for name, key in TYPES.items():
        kind = F.when(F.col("p_type") == name, key).otherwise(kind)
    charts = F.collect_set(F.struct(kind.alias("type"), F.col("p_size").alias("level")))
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(charts.alias("charts")).withColumn("ord", F.col("name"))


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (key, native): reading records as recognition would write them."""
    k, name = F.col("p_partkey"), F.col("p_name")
    garbled = F.concat(F.lit("Q"), F.replace(name, F.lit("e"), F.lit("")), F.lit(" "), F.substring(name, 1, 2))
    title = lambda raw, raw2, conf: F.struct(raw.alias("raw"), raw2.alias("raw2"), conf.alias("conf"))
    none = F.lit(None).cast("string")
    two = F.array(title(garbled, F.when(k % 4 == 0, F.upper(name)).otherwise(garbled), (k % 50) / 50), title(F.when(k % 3 == 0, F.substring(name, 1, 6)).otherwise(F.lit("")), none, F.lit(0.3)))
    unlike = F.array(title(F.lit("zz"), none, F.lit(0.9)))
    titles = F.when(k % 7 == 0, F.array().cast("array<struct<raw:string,raw2:string,conf:double>>")).when(k % 11 == 0, unlike).otherwise(two)
    slots = F.array(*[F.array(*[((k * 31 + i * 17 + d * 7) % 101) / 128 for d in range(10)]) for i in range(2)])
    score = F.when(k % 13 != 0, (k * 7 % 1000001).cast("int"))
    native = F.to_json(F.struct(
        titles.alias("titles"), F.array(*[F.lit(c) for c in CHARTS])[(k % 5).cast("int")].alias("chart_type"), ((k % 20) / 50).alias("chart_conf"), score.alias("score"),
        ((k % 25) / 1000).alias("score_margin"), F.when(k % 3 == 0, score).when(k % 3 == 1, 5).alias("score2"),
        F.array((k % 3).cast("int"), (k * 7 % 10).cast("int")).alias("level_digits"), F.when(k % 6 != 0, slots).alias("level_scores")))
    return table(spark, sf_dir, "part").select(k.alias("key"), native.alias("native"))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.readings(read_native(photos(spark, sf_dir)), catalog(spark, sf_dir))


_COMPACT = r"replace(trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ', '')"
_GRAMS = "list_distinct(list_transform(range(1, len({0}) + 3), lambda i: substr('  ' || {0} || '  ', i, 3)))"
_ALL = "FROM (SELECT text, name, a, b, CAST(0 AS BIGINT) AS alo, CAST(len(a) AS BIGINT) AS ahi, CAST(0 AS BIGINT) AS blo, CAST(len(b) AS BIGINT) AS bhi FROM p) q"

#: From the parts to one row a photo: key, name (the winner), margin, alike, raw, and the fields' parts.
_READ = f"""WITH RECURSIVE ph AS (
  SELECT p_partkey AS key, p_name, 'Q' || replace(p_name, 'e', '') || ' ' || substr(p_name, 1, 2) AS garbled, (p_partkey % 50) / 50 AS conf,
    ['', 'single', 'double', 'coop', 'halfdouble'][p_partkey % 5 + 1] AS chart_type, (p_partkey % 20) / 50 AS chart_conf, CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_partkey * 7 % 1000001 AS INTEGER) END AS score,
    (p_partkey % 25) / 1000 AS score_margin FROM part
), rd AS (
  SELECT key, 0 AS title, 0 AS variant, garbled AS text, sqrt(greatest(conf, 0.02)) AS weight FROM ph WHERE key % 7 <> 0 AND key % 11 <> 0
  UNION ALL SELECT key, 0, 1, upper(p_name), sqrt(greatest(conf, 0.02)) * 0.85::DOUBLE FROM ph WHERE key % 7 <> 0 AND key % 11 <> 0 AND key % 4 = 0
  UNION ALL SELECT key, 1, 0, substr(p_name, 1, 6), sqrt(0.3::DOUBLE) FROM ph WHERE key % 7 <> 0 AND key % 11 <> 0 AND key % 3 = 0
  UNION ALL SELECT key, 0, 0, 'zz', sqrt(0.9::DOUBLE) FROM ph WHERE key % 7 <> 0 AND key % 11 = 0
), t AS (SELECT DISTINCT text, {_COMPACT.format("text")} AS a FROM rd), c AS (SELECT DISTINCT p_name AS name, {_COMPACT.format("p_name")} AS b FROM part),
tg AS (SELECT *, {_GRAMS.format("a")} AS ta FROM t), cg AS (SELECT *, {_GRAMS.format("b")} AS tb FROM c),
p AS (SELECT text, a, name, b, len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb))) AS jac FROM tg, cg), seg AS (
  SELECT text, name, a, b, CAST(0 AS BIGINT) AS alo, CAST(len(a) AS BIGINT) AS ahi, CAST(0 AS BIGINT) AS blo, CAST(len(b) AS BIGINT) AS bhi, CAST(NULL AS BIGINT) AS k FROM p
  UNION ALL
  SELECT text, name, a, b, unnest([alo, m.i - m.k]), unnest([m.i, ahi]), unnest([blo, m.j - m.k]), unnest([m.j, bhi]), unnest([-m.k, 0])
  FROM (SELECT *, {_BLOCK} AS m FROM seg WHERE ahi > alo AND bhi > blo) x WHERE m.k < 0
), s AS (SELECT text, name, coalesce(sum(k), 0) AS matched FROM seg GROUP BY text, name), l AS (SELECT text, name, -({_BLOCK}).k AS common {_ALL}),
z AS (SELECT p.text, p.name, a, b, jac, 2.0::DOUBLE * matched / (len(a) + len(b)) AS ratio, common FROM p JOIN s USING (text, name) JOIN l USING (text, name)),
y AS (SELECT *, round_even((0.45::DOUBLE * jac + 0.35::DOUBLE * ratio + 0.2::DOUBLE * (common / greatest(least(len(a), len(b)), 1))) * 1e4, 0) / 1e4 AS score FROM z),
m AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, jac DESC, name) AS rank FROM y QUALIFY rank <= 8),
w AS (SELECT key, name, list(m.score * weight ORDER BY title, variant, rank) AS xs, min(struct_pack(title := title, variant := variant, rank := rank)) AS first FROM rd JOIN m USING (text) GROUP BY key, name),
po AS (SELECT key, name, first, list_reduce(xs, lambda acc, v: greatest(acc, v) + 0.15::DOUBLE * least(acc, v), 0.0::DOUBLE) AS pooled FROM w),
rk AS (SELECT key, list(struct_pack(name := name, score := pooled) ORDER BY pooled DESC, first, name) AS r FROM po GROUP BY key),
raws AS (SELECT key, array_to_string(list(text ORDER BY title, variant), ' | ') AS raw FROM rd GROUP BY key),
tp AS (SELECT ph.*, coalesce(raw, '') AS raw, r, CASE WHEN len(r) > 1 THEN r[1].score - r[2].score ELSE 1.0::DOUBLE END AS margin FROM ph LEFT JOIN rk USING (key) LEFT JOIN raws USING (key)),
al AS (SELECT tp.key, bool_or(len(a) >= least(4, len(b)) AND ratio >= CASE WHEN len(b) <= 3 THEN 0.80::DOUBLE ELSE 0.55::DOUBLE END) AS alike FROM tp JOIN rd USING (key) JOIN z ON z.text = rd.text AND z.name = r[1].name GROUP BY tp.key),
sg AS (SELECT tp.*, CASE WHEN r IS NULL OR margin < 0.001 THEN 'margen_bajo' WHEN alike IS NOT TRUE THEN 'sin_parecido' END AS song_reason,
  CASE WHEN chart_type = '' OR chart_conf < 0.15 THEN 'baja_confianza' END AS chart_reason,
  CASE WHEN score IS NULL THEN 'sin_glifos' WHEN score_margin >= 0.010 OR key % 3 = 0 OR (key % 3 = 1 AND score = 5) THEN NULL ELSE 'margen_bajo' END AS score_reason FROM tp LEFT JOIN al USING (key)),
ch AS (SELECT DISTINCT p_name AS name, CASE p_type WHEN 'ECONOMY' THEN 's' WHEN 'SMALL' THEN 'd' WHEN 'STANDARD' THEN 'hd' WHEN 'PROMO' THEN 'c' ELSE '' END AS type, p_size AS level FROM part),
wl AS (SELECT key, r[1].name AS name, CASE WHEN chart_reason IS NULL THEN CASE chart_type WHEN 'single' THEN 's' WHEN 'double' THEN 'd' WHEN 'halfdouble' THEN 'hd' WHEN 'coop' THEN 'c' END END AS want FROM sg WHERE song_reason IS NULL AND key % 6 <> 0),
fl AS (SELECT key, ch.level, want IS NULL OR type = want OR type = '' AS fits FROM wl JOIN ch USING (name)),
lg AS (SELECT DISTINCT key, level FROM (SELECT *, bool_or(fits) OVER (PARTITION BY key) AS any_ FROM fl) WHERE fits OR NOT any_),
lt AS (SELECT key, level, ((key * 31 + (level // 10) * 7) % 101) / 128 + ((key * 31 + 17 + (level % 10) * 7) % 101) / 128 AS total FROM lg WHERE level < 100),
lv AS (SELECT key, level, total, lead(total) OVER v AS next FROM lt WINDOW v AS (PARTITION BY key ORDER BY total DESC, level) QUALIFY row_number() OVER v = 1),
out AS (SELECT sg.*, lv.level AS best, CASE WHEN next IS NULL THEN 1.0::DOUBLE ELSE (total - next) / 2 END AS level_margin, (sg.key % 3) * 10 + sg.key * 7 % 10 AS alone FROM sg LEFT JOIN lv USING (key)),
fin AS (SELECT *, CASE WHEN key % 6 = 0 THEN 'sin_glifos' WHEN best IS NULL AND alone NOT BETWEEN 1 AND 28 THEN 'fuera_de_rango' END AS level_reason FROM out),
g AS (SELECT key, p_name, CASE WHEN song_reason IS NULL THEN r[1].name END AS song, CAST(margin AS FLOAT) AS song_confidence, song_reason,
  CASE WHEN level_reason IS NULL THEN CAST(coalesce(best, alone) AS INTEGER) END AS level, CAST(CASE WHEN key % 6 <> 0 AND best IS NOT NULL THEN level_margin ELSE 0 END AS FLOAT) AS level_confidence, level_reason,
  CASE WHEN chart_reason IS NULL THEN chart_type END AS chart_type, CAST(chart_conf AS FLOAT) AS chart_type_confidence, chart_reason AS chart_type_reason,
  CASE WHEN score_reason IS NULL THEN score END AS score, CAST(CASE WHEN score IS NULL THEN 0 ELSE score_margin END AS FLOAT) AS score_confidence, score_reason, raw,
  array_to_string(list_filter([CASE WHEN song_reason IS NOT NULL THEN 'song' END, CASE WHEN level_reason IS NOT NULL THEN 'level' END, CASE WHEN chart_reason IS NOT NULL THEN 'chart_type' END, CASE WHEN score_reason IS NOT NULL THEN 'score' END], lambda x: x IS NOT NULL), ',') AS needs_llm,
  coalesce(array_to_string(list_transform(r[1:3], lambda x: x.name), ','), '') AS candidates FROM fin)"""


@query("readings", _READ + """ SELECT key, song, floor(song_confidence * 1e6 + 0.5) / 1e6 AS song_confidence, song_reason, level, floor(level_confidence * 1e6 + 0.5) / 1e6 AS level_confidence, level_reason,
chart_type, chart_type_confidence, chart_type_reason, score, score_confidence, score_reason, raw, needs_llm, needs_llm <> '' AS needs_vlm_call, candidates FROM g""")
def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded readings as gated fields, each a value or the reason to escalate."""
    found = gated(spark, sf_dir)
    parts = [F.col(f"{f}.{c}").alias(f if c == "value" else f"{f}_{c}") for f in ("chart_type", "score") for c in ("value", "confidence", "reason")]
    close = [c for f in ("song", "level") for c in (F.col(f"{f}.value").alias(f), six(F.col(f"{f}.confidence")).alias(f"{f}_confidence"), F.col(f"{f}.reason").alias(f"{f}_reason"))]
    return found.select("key", *close, *parts, "raw", F.array_join("needs_llm", ",").alias("needs_llm"), "needs_vlm_call", F.array_join(F.transform("candidates", lambda c: c["name"]), ",").alias("candidates"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the photos show: the part's name in capitals, its size, a chart, and one score or two."""
    k = F.col("p_partkey")
    scores = F.when(k % 9 == 0, F.array(F.lit(1), (k * 7 % 1000001).cast("int"))).when(k % 8 != 0, F.array((k * 7 % 1000001).cast("int"))).otherwise(F.array().cast("array<int>"))
    return table(spark, sf_dir, "part").where(k % 10 != 0).select(
        k.alias("key"), F.upper("p_name").alias("song"), F.col("p_size").alias("level"), F.when(k % 5 != 4, F.array(*[F.lit(c) for c in CHARTS])[(k % 4 + 1).cast("int")]).alias("chart_type"), scores.alias("scores"))


_TRUTH = """, tr AS (SELECT p_partkey AS tkey, upper(p_name) AS t_song, p_size AS t_level, CASE WHEN p_partkey % 5 <> 4 THEN ['single', 'double', 'coop', 'halfdouble'][p_partkey % 4 + 1] END AS t_chart,
  CASE WHEN p_partkey % 9 = 0 THEN [1, CAST(p_partkey * 7 % 1000001 AS INTEGER)] WHEN p_partkey % 8 <> 0 THEN [CAST(p_partkey * 7 % 1000001 AS INTEGER)] END AS t_scores FROM part WHERE p_partkey % 10 <> 0),
an AS (SELECT key, 'song' AS field, song AS value, t_song AS truth, coalesce(lower(song) = lower(t_song), false) AS ok FROM g JOIN tr ON tkey = key
UNION ALL SELECT key, 'level', CAST(level AS VARCHAR), CAST(t_level AS VARCHAR), coalesce(level = t_level, false) FROM g JOIN tr ON tkey = key
UNION ALL SELECT key, 'chart_type', chart_type, t_chart, coalesce(chart_type = t_chart, false) FROM g JOIN tr ON tkey = key
UNION ALL SELECT key, 'score', CAST(score AS VARCHAR), array_to_string(t_scores, '|'), coalesce(list_contains(t_scores, score), false) FROM g JOIN tr ON tkey = key)"""


@query("truth_answers", _READ + _TRUTH + " SELECT key, field, value, truth, ok FROM an")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.truth_answers(gated(spark, sf_dir), truth(spark, sf_dir)).drop("margin")


@query("readings_metrics", _READ + _TRUTH + """ SELECT field, count(*) AS n, count(value) / count(*) AS coverage, coalesce(count(*) FILTER (ok) / nullif(count(value), 0), 0) AS precision, count(*) FILTER (ok) / count(*) AS accuracy
FROM an WHERE truth IS NOT NULL GROUP BY field""")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, precision and accuracy of each field of the readings."""
    return evaluate.field_metrics(answers(spark, sf_dir), ["field"])


@query("escalated", _READ + f" SELECT count(*) AS n, count(*) FILTER (song IS NULL OR score IS NULL OR level IS NULL) AS escalated, {six_sql('count(*) FILTER (song IS NULL OR score IS NULL OR level IS NULL) / count(*)')} AS share FROM g")
def escalated(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = gated(spark, sf_dir).select(*[F.col(f"{f}.value").alias(f) for f in evaluate.FIELDS])
    return evaluate.escalated(values).withColumn("share", six(F.col("share")))
