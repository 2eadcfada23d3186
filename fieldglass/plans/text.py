"""Queries of matching and text expressions: part names are the closed catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions import text as t
from fieldglass.operators import matching
from fieldglass.plans.registry import query, six, six_sql, table


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names; a name is its own place in the order."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_name").alias("ord")).distinct()


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as a bad reader gives them: no e, a q in front, one word repeated."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("key")).distinct().withColumn(
        "text", F.concat(F.lit("Q"), F.replace("key", F.lit("e"), F.lit("")), F.lit(" "), F.substring("key", 1, 2))
    )


_NAMES = r"""names AS (SELECT DISTINCT p_name AS name FROM part),
c AS (SELECT name, row_number() OVER (ORDER BY name) AS ord, replace(trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ', '') AS b FROM names),
r AS (SELECT name AS key, replace(trim(regexp_replace(regexp_replace(lower(strip_accents('Q' || replace(name, 'e', '') || ' ' || substr(name, 1, 2))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ', '') AS a FROM names),
ct AS (SELECT name, ord, b, list_distinct(list_transform(range(1, len(b) + 3), lambda i: substr('  ' || b || '  ', i, 3))) AS tb FROM c),
rt AS (SELECT key, a, list_distinct(list_transform(range(1, len(a) + 3), lambda i: substr('  ' || a || '  ', i, 3))) AS ta FROM r),
p AS (SELECT key, a, name, ord, b, len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb))) AS jac FROM rt, ct)"""


@query("match_trigram_topk", f"""WITH {_NAMES} SELECT key, name, {six_sql("jac")} AS jac, CAST(row_number() OVER (PARTITION BY key ORDER BY jac DESC, ord) AS INTEGER) AS rank
FROM p QUALIFY rank <= 3""")
def trigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.trigram_candidates(reads(spark, sf_dir), catalog(spark, sf_dir), limit=3)
    w = Window.partitionBy("key").orderBy(F.desc("jac"), "ord")
    return pairs.select("key", "name", six(F.col("jac")).alias("jac"), F.row_number().over(w).alias("rank"))


_BLOCK = """list_min(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j:
    struct_pack(k := -len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda n: substr(a, i + 1, n) = substr(b, j + 1, n))), i := i, j := j)))))"""
_WEIGHTED = f"""WITH RECURSIVE {_NAMES}, seg AS (
  SELECT key, name, a, b, CAST(0 AS BIGINT) AS alo, CAST(len(a) AS BIGINT) AS ahi, CAST(0 AS BIGINT) AS blo, CAST(len(b) AS BIGINT) AS bhi, CAST(NULL AS BIGINT) AS k, true AS root FROM p
  UNION ALL
  SELECT key, name, a, b, unnest([alo, m.i - m.k]) AS alo, unnest([m.i, ahi]) AS ahi, unnest([blo, m.j - m.k]) AS blo, unnest([m.j, bhi]) AS bhi, unnest([-m.k, 0]) AS k, false AS root
  FROM (SELECT *, {_BLOCK} AS m FROM seg WHERE ahi > alo AND bhi > blo) x WHERE m.k < 0
), s AS (SELECT key, name, coalesce(sum(k), 0) AS matched FROM seg GROUP BY key, name),
l AS (SELECT key, name, -({_BLOCK}).k AS common FROM (SELECT key, name, a, b, CAST(0 AS BIGINT) AS alo, CAST(len(a) AS BIGINT) AS ahi, CAST(0 AS BIGINT) AS blo, CAST(len(b) AS BIGINT) AS bhi FROM p) q),
z AS (SELECT p.key, p.name, p.ord, p.jac, round_even((0.45::DOUBLE * jac + 0.35::DOUBLE * (2.0::DOUBLE * matched / (len(a) + len(b))) + 0.2::DOUBLE * (common / greatest(least(len(a), len(b)), 1))) * 1e4, 0) / 1e4 AS score
  FROM p JOIN s USING (key, name) JOIN l USING (key, name))
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, jac DESC, ord) AS INTEGER) AS rank, name, score FROM z QUALIFY rank <= 3"""


@query("match_weighted_topk", _WEIGHTED)
def weighted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match(reads(spark, sf_dir), catalog(spark, sf_dir), k=3)
    return found.select("key", "rank", "name", "score")


_LARGE = r"""c AS (SELECT DISTINCT p_name || ' ' || p_brand || ' ' || p_type AS name, replace(trim(regexp_replace(regexp_replace(lower(strip_accents(p_name || ' ' || p_brand || ' ' || p_type)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ', '') AS b FROM part),
r AS (SELECT p_partkey AS key, replace(trim(regexp_replace(regexp_replace(lower(strip_accents('Q' || replace(p_name, 'e', '') || ' ' || p_type || ' ' || substr(p_brand, 3))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ', '') AS a FROM part),
cg AS (SELECT DISTINCT name, substr('  ' || b || '  ', CAST(i AS INTEGER), 3) AS g FROM c, range(1, 200) t(i) WHERE i < len(b) + 3), rg AS (SELECT DISTINCT key, substr('  ' || a || '  ', CAST(i AS INTEGER), 3) AS g FROM r, range(1, 200) t(i) WHERE i < len(a) + 3),
cn AS (SELECT name, count(*) AS nb FROM cg GROUP BY name), rn AS (SELECT key, count(*) AS na FROM rg GROUP BY key), both_ AS (SELECT key, name, count(*) AS n FROM rg JOIN cg USING (g) GROUP BY key, name),
p AS (SELECT rn.key, cn.name, coalesce(n, 0) / (na + nb - coalesce(n, 0)) AS jac FROM rn CROSS JOIN cn LEFT JOIN both_ USING (key, name)),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY jac DESC, name) <= 120)"""


@query("match_prefilter", f"WITH {_LARGE} SELECT key, count(*) AS n, {six_sql('min(jac)')} AS least, md5(string_agg(name, ',' ORDER BY name)) AS names FROM f GROUP BY key")
def match_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 120 rows of a catalog of all names with brand and type that a misread one is compared with."""
    part = table(spark, sf_dir, "part")
    full = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    large = part.select(full.alias("name"), full.alias("ord")).distinct()
    text = F.concat(F.lit("Q"), F.replace("p_name", F.lit("e"), F.lit("")), F.lit(" "), F.col("p_type"), F.lit(" "), F.substring("p_brand", 3, 99))
    found = matching.trigram_candidates(part.select(F.col("p_partkey").alias("key"), text.alias("text")), large)
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), six(F.min("jac")).alias("least"), F.md5(F.array_join(F.array_sort(F.collect_list("name")), ",")).alias("names"))


@query("longest_common_substring", f"""WITH {_NAMES} SELECT key, name, CAST(-({_BLOCK}).k AS INTEGER) AS common
FROM (SELECT key, name, a, b, CAST(0 AS BIGINT) AS alo, CAST(len(a) AS BIGINT) AS ahi, CAST(0 AS BIGINT) AS blo, CAST(len(b) AS BIGINT) AS bhi FROM p) q""")
def common_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.trigram_candidates(reads(spark, sf_dir), catalog(spark, sf_dir), limit=100_000)
    return pairs.select("key", "name", t.block_similarity(F.col("read"), F.col("entry"))["common"].alias("common"))


@query("normalize_match", r"""SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS norm FROM conversations""")
def normalize_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(t.normalize_match(F.col("text"))).alias("norm"))


@query("normalize_key", r"""SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(nfd, '[^\x00-\x7f]', '', 'g')), '\s+', ' ', 'g'))) AS norm
FROM (SELECT doc_id, strip_accents(regexp_replace(text, '[ßæœøØÆŒłŁđĐ]', '', 'g')) AS nfd FROM documents)""")
def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.normalize_key(F.col("text"))).alias("norm"))


@query("levels_for", """WITH c AS (SELECT p_name AS name, list(DISTINCT p_size) AS all_levels FROM part GROUP BY p_name),
t AS (SELECT p_name AS name, p_type AS type, list_sort(list(DISTINCT p_size)) AS levels FROM part GROUP BY p_name, p_type),
w AS (SELECT p_partkey AS key, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_type ELSE 'NONE' END AS chart FROM part)
SELECT w.key, array_to_string(CASE WHEN w.chart IS NOT NULL AND t.levels IS NOT NULL THEN t.levels ELSE list_sort(c.all_levels) END, ',') AS levels
FROM w JOIN c USING (name) LEFT JOIN t ON t.name = w.name AND t.type = w.chart""")
def levels_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    charts = part.groupBy(F.col("p_name").alias("name")).agg(F.collect_set(F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("level"))).alias("charts"))
    entries = charts.withColumn("ord", F.col("name"))
    chart = F.when(F.col("p_partkey") % 3 == 1, F.col("p_type")).when(F.col("p_partkey") % 3 == 2, "NONE")
    songs = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), chart.alias("chart"))
    return matching.levels_for(songs, entries).select("key", F.array_join("levels", ",").alias("levels"))


@query("text_expressions", r"""SELECT p_partkey, CASE WHEN contains(p_type, 'SMALL') THEN 'halfdouble' WHEN contains(p_type, 'STANDARD') THEN 'single' WHEN contains(p_type, 'ECONOMY') THEN 'double' WHEN contains(p_type, 'PROMO') THEN 'coop' END AS chart,
  CASE WHEN p_size BETWEEN 0 AND 9 THEN p_size WHEN p_size BETWEEN 48 AND 57 THEN p_size - 48 ELSE -1 END AS digit,
  CASE p_partkey % 3 WHEN 1 THEN 90 WHEN 2 THEN 270 ELSE 0 END AS turned,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(CASE WHEN p_partkey % 5 = 0 THEN 1000000 ELSE (p_partkey * 7919) % 1000000 END AS INTEGER) END AS score,
  trim(regexp_replace(trim(replace('""' || p_name || '""', '""', '"')), '^"(.*)"$', '\1')) AS name FROM part""")
def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("p_type")
    for a, b in (("SMALL", "HALF DOUBLE"), ("STANDARD", "SINGLE"), ("ECONOMY", "DOUBLE"), ("PROMO", "CO-COOP")):
        label = F.replace(label, F.lit(a), F.lit(b))
    number = (F.col("p_partkey") * 7919) % 1000000
    digits = F.when(F.col("p_partkey") % 7 == 0, "12345678").when(F.col("p_partkey") % 5 == 0, "1000000").otherwise(F.lpad(number.cast("string"), 7, "0"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", t.chart_from_label(label).alias("chart"), t.digit_of(F.col("p_size")).alias("digit"), t.turned_by(F.col("p_partkey") % 3).alias("turned"),
        t.score_value(digits).alias("score"), t.clean_name(F.concat(F.lit('""'), "p_name", F.lit('""'))).alias("name"),
    )


@query("charts_for", """WITH c AS (SELECT 'k ' || p_brand AS ck, lower(ck) AS k1, min(p_partkey) AS ord FROM part GROUP BY p_brand), n AS (SELECT DISTINCT p_brand, first(p_name ORDER BY p_partkey) OVER (PARTITION BY p_brand) AS name FROM part),
e AS (SELECT c.ord, replace(k1, '#', ' ') AS f FROM c UNION SELECT c.ord, lower(name) FROM c JOIN n ON 'k ' || p_brand = ck), f AS (SELECT f, min(ord) AS ord FROM e GROUP BY f),
s AS (SELECT p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'K-' || p_brand ELSE 'nothing' END AS name FROM part)
SELECT key, coalesce(CAST(ord AS VARCHAR), '') AS levels FROM s LEFT JOIN f ON f = replace(replace(lower(name), '-', ' '), '#', ' ')""")
def charts_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    first = part.groupBy("p_brand").agg(F.min(F.struct("p_partkey", "p_name")).alias("f"))
    charts = F.array(F.struct(F.lit("s").alias("type"), F.col("f.p_partkey").cast("int").alias("level")))
    entries = first.select(F.col("f.p_partkey").alias("ord"), F.concat(F.lit("k "), "p_brand").alias("key"), F.col("f.p_name").alias("name"), charts.alias("charts"))
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.concat(F.lit("K-"), "p_brand")).otherwise("nothing")
    found = matching.charts_for(part.select(k.alias("key"), name.alias("name")), entries)
    return found.select("key", F.array_join(F.transform("charts", lambda c: c["level"].cast("string")), ",").alias("levels"))


@query("hue_to_rgb", """WITH h AS (SELECT p_partkey AS key, (p_partkey % 180) / 179.0::DOUBLE AS h, (p_size % 11) / 10.0::DOUBLE AS s, (p_size % 7) / 6.0::DOUBLE AS v FROM part),
t AS (SELECT key, s, v, (h - floor(h)) * 6 AS t FROM h), i AS (SELECT key, s, v, CAST(floor(t) AS INTEGER) AS i, t - floor(t) AS f FROM t),
q AS (SELECT key, v, CASE WHEN s = 0 THEN -1 ELSE i % 6 END AS i, v * (1 - s) AS p, v * (1 - s * f) AS q, v * (1 - s * (1 - f)) AS t FROM i)
SELECT key, CAST(trunc(255 * CASE i WHEN -1 THEN v WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END) AS INTEGER) AS r,
  CAST(trunc(255 * CASE i WHEN -1 THEN v WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q WHEN 4 THEN p ELSE p END) AS INTEGER) AS g,
  CAST(trunc(255 * CASE i WHEN -1 THEN v WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END) AS INTEGER) AS b FROM q""")
def hue_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    rgb = t.hsv_to_rgb((k % 180).cast("double"), (size % 11) / 10.0, (size % 7) / 6.0)
    return table(spark, sf_dir, "part").select(k.alias("key"), rgb.alias("c")).select("key", *[F.col("c")[i].alias(n) for i, n in enumerate("rgb")])
