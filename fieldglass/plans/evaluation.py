"""Queries of evaluation and curation: labels are the truth, text length the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions import geometry, text
from fieldglass.functions.text import normalize_key
from fieldglass.operators import curate, evaluate, segments
from fieldglass.plans.registry import query, six, six_sql, table


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a guess of quality by length, the label, tags and a margin."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    guess = F.when(F.col("doc_id") % 7 != 0, (F.col("n_chars") > 400).cast("int"))
    rows = docs.select("doc_id", F.col("lang"), guess.alias("value"), F.col("quality").alias("truth"), F.col("n_chars"),
                       F.array_compact(F.array(F.col("lang"), F.when(F.col("n_chars") > 2000, "long").otherwise("short"))).alias("tags"),
                       ((F.col("n_chars") % 100) / 100).alias("margin"))
    return rows.withColumn("ok", F.col("value") == F.col("truth"))


_A = """a AS (SELECT d.doc_id, d.lang, CASE WHEN d.doc_id % 7 <> 0 THEN CAST(n_chars > 400 AS INTEGER) END AS value, quality AS truth, n_chars,
  list_filter([d.lang, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END], lambda x: x IS NOT NULL) AS tags, (n_chars % 100) / 100 AS margin FROM documents d LEFT JOIN labels l USING (doc_id)),
k AS (SELECT *, value = truth AS ok FROM a WHERE truth IS NOT NULL)"""
_M = """count(*) AS n, count(value) / count(*) AS coverage, coalesce(count(*) FILTER (ok) / nullif(count(value), 0), 0) AS precision, count(*) FILTER (ok) / count(*) AS accuracy"""


@query("field_metrics", f"WITH {_A} SELECT lang, {_M} FROM k GROUP BY lang")
def field_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.field_metrics(answers(spark, sf_dir), ["lang"])


@query("accepted_error", f"WITH {_A} SELECT lang, count(*) AS n, (count(value) - count(*) FILTER (ok)) / count(*) AS accepted_error, count(*) FILTER (ok) / greatest(count(value), 1) AS precision FROM k GROUP BY lang")
def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accepted_errors(answers(spark, sf_dir), ["lang"])


@query("metrics_by_bucket", f"WITH {_A}, t AS (SELECT unnest(tags) AS tag, value, ok FROM k) SELECT tag, {_M} FROM t GROUP BY tag")
def by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics_by_tag(answers(spark, sf_dir), [])


@query("threshold_sweep", f"WITH {_A}, t AS (SELECT i / 10 AS threshold, CASE WHEN margin >= i / 10 THEN value END AS value, ok AND margin >= i / 10 AS ok FROM k, (SELECT unnest(range(0, 11)) AS i)) SELECT threshold, {_M} FROM t GROUP BY threshold")
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_sweep(answers(spark, sf_dir), spark.range(0, 11).select((F.col("id") / 10).alias("threshold")))


def _side(spark: SparkSession, sf_dir: str, at: int) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"), (F.floor(F.col("n_chars") / at) * at).alias("size"))


_SIDES = "b AS (SELECT doc_id AS key, CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang, floor(n_chars / {0}) * {0} AS l, floor(n_chars / {1}) * {1} AS r FROM documents)"


@query("agreement", f"WITH {_SIDES.format(100, 150)} SELECT 'lang' AS field, avg(CASE WHEN lang IS NOT DISTINCT FROM CASE WHEN key % 3 = 0 THEN NULL ELSE lang END THEN 1 ELSE 0 END) AS agreement FROM b UNION ALL SELECT 'size', avg(CASE WHEN l = r THEN 1 ELSE 0 END) FROM b")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = _side(spark, sf_dir, 150).withColumn("lang", F.when(F.col("key") % 3 != 0, F.col("lang")))
    return evaluate.agreement(_side(spark, sf_dir, 100), right, ["lang", "size"])


@query("field_differences", f"WITH {_SIDES.format(100, 150)} SELECT key, 'size' AS field, CAST(CAST(l AS BIGINT) AS VARCHAR) AS \"left\", CAST(CAST(r AS BIGINT) AS VARCHAR) AS \"right\" FROM b WHERE l <> r")
def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.differences(_side(spark, sf_dir, 100), _side(spark, sf_dir, 150), ["lang", "size"])


@query("baseline_regression", f"""WITH {_A}, c AS (SELECT lang, {_M} FROM k GROUP BY lang), b AS (SELECT lang, {_M} FROM (SELECT lang, value, value IS NOT NULL AND CASE WHEN doc_id % 4 = 0 THEN truth = value ELSE true END AS ok FROM k) GROUP BY lang),
l AS (SELECT c.lang || '.' || m AS metric, CASE m WHEN 'coverage' THEN b.coverage WHEN 'precision' THEN b.precision ELSE b.accuracy END AS was,
  CASE m WHEN 'coverage' THEN c.coverage WHEN 'precision' THEN c.precision ELSE c.accuracy END AS now FROM c JOIN b USING (lang), (SELECT unnest(['coverage', 'precision', 'accuracy']) AS m))
SELECT metric, {six_sql('was')} AS was, {six_sql('now')} AS now FROM l WHERE now < was - 0.05""")
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = answers(spark, sf_dir)
    # the baseline: a run that erred on one document in four only, and answered as often
    then = now.withColumn("ok", F.when(F.col("doc_id") % 4 == 0, F.col("ok")).otherwise(F.lit(True)))
    values = ["n", "coverage", "precision", "accuracy"]
    long_ = [evaluate.long_metrics(evaluate.field_metrics(a, ["lang"]), ["lang"], values) for a in (now, then)]
    return evaluate.regressions(long_[0], long_[1], 0.05).select("metric", six(F.col("was")).alias("was"), six(F.col("now")).alias("now"))


@query("latency", "SELECT avg(value) AS mean, max(value) AS max, list_sort(list(value))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median FROM (SELECT CAST(n_chars AS BIGINT) AS value FROM documents)")
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("ms")))


@query("catalog_upsert", """WITH b AS (SELECT p_partkey AS ord, p_name || CASE WHEN p_partkey % 7 = 0 THEN ' II' ELSE '' END AS name, p_size FROM part),
q AS (SELECT ord, trim(replace(CASE WHEN ord % 3 = 0 THEN '""' || name || '""' ELSE upper(name) END, '""', '"')) AS raw, p_size FROM b),
n AS (SELECT ord, trim(regexp_replace(raw, '^"(.*)"$', '\\1')) AS name, p_size FROM q WHERE p_size % 4 <> 0), k AS (SELECT *, lower(name) AS key FROM n)
SELECT ord, name, key FROM k WHERE key NOT IN (SELECT DISTINCT p_name FROM part) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch in which every seventh name is new."""
    part = table(spark, sf_dir, "part")
    full = F.concat("p_name", F.when(F.col("p_partkey") % 7 == 0, " II").otherwise(""))
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('""'), full, F.lit('""'))).otherwise(F.upper(full))
    chart = F.array(F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("level")))
    batch = part.select(F.col("p_partkey").alias("ord"), name.alias("name"), F.when(F.col("p_size") % 4 == 0, F.array().cast(chart_type())).otherwise(chart).alias("charts"))
    known = part.select(normalize_key(F.col("p_name")).alias("key")).distinct()
    return curate.catalog_upsert(known, batch).select("ord", "name", "key")


def chart_type() -> str:
    return "array<struct<type:string,level:int>>"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as labelled items: a song, what the catalog matched, its status, and whether somebody looked."""
    part, i = table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = part.select(
        i.alias("key"), F.col("p_name").alias("song_ocr"), F.when(i % 5 != 0, F.when(i % 3 == 0, F.upper("p_name")).when(i % 3 == 1, F.concat(F.lit(" "), "p_name", F.lit(" "))).otherwise(F.col("p_type"))).alias("match_name"),
        F.when(i % 4 != 1, i % 4 == 0).alias("validated"), (F.col("p_size") / 50).alias("score"))
    same = text.normalize_match(F.col("match_name")) == text.normalize_match(F.col("song_ocr"))
    return rows.withColumn("match_status", curate.match_status(same, F.when(F.col("match_name").isNotNull(), F.col("score")))).withColumn("mismatch", curate.mismatch(F.col("match_name"), F.col("song_ocr")))


_ITEMS = """i AS (SELECT p_partkey AS key, p_name AS song_ocr, CASE WHEN p_partkey % 5 <> 0 THEN CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN ' ' || p_name || ' ' ELSE p_type END END AS match_name,
  CASE WHEN p_partkey % 4 <> 1 THEN p_partkey % 4 = 0 END AS validated, p_size / 50 AS score FROM part),
t AS (SELECT *, CASE WHEN match_name IS NULL THEN 'none' WHEN trim(lower(match_name)) = trim(lower(song_ocr)) THEN 'exact' WHEN score >= 0.55 THEN 'fuzzy' ELSE 'none' END AS match_status,
  match_name IS NOT NULL AND trim(lower(match_name)) <> trim(lower(song_ocr)) AS mismatch FROM i)"""


@query("match_status", f"WITH {_ITEMS} SELECT key, match_status AS status, mismatch FROM t")
def match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("key", F.col("match_status").alias("status"), "mismatch")


@query("status_counts", f"WITH {_ITEMS} SELECT match_status, count(*) AS n FROM t GROUP BY match_status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.status_counts(items(spark, sf_dir))


@query("progress", f"WITH {_ITEMS} SELECT count(*) FILTER (validated) AS done, count(*) AS total FROM t")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.progress(items(spark, sf_dir))


@query("validator_views", f"""WITH {_ITEMS} SELECT 'all' AS view, key FROM t UNION ALL SELECT 'pending', key FROM t WHERE validated IS NOT TRUE UNION ALL SELECT 'done', key FROM t WHERE validated
UNION ALL SELECT 'suspect', key FROM t WHERE match_status = 'none' OR mismatch""")
def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in curate.VIEWS:
        rows = curate.view(items(spark, sf_dir), name).select(F.lit(name).alias("view"), "key")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("renamed_keys", """SELECT event_id, coalesce('img' || (user_id % 50), event_type || user_id) AS key FROM events""")
def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the new name of their image; old names are the user's."""
    events = table(spark, sf_dir, "events")
    names = events.select(F.concat("event_type", F.col("user_id").cast("string")).alias("old"), F.concat(F.lit("img"), (F.col("user_id") % 50).cast("string")).alias("key")).distinct()
    rows = events.select("event_id", F.concat("event_type", F.col("user_id").cast("string")).alias("old"))
    return rows.join(names, "old", "left").select("event_id", F.coalesce("key", "old").alias("key"))


@query("photo_tags", """SELECT p_partkey AS key, array_to_string(list_filter([CASE WHEN p_size * 4 < 90 THEN 'dark' ELSE 'bright' END, CASE WHEN (p_partkey % 50) / 1000 > 0.02 THEN 'glare' END,
  CASE WHEN (p_partkey % 97) / 97 < 0.40 THEN 'far' END, CASE WHEN abs(p_partkey % 23 - 11) > 8 THEN 'rotated' END, CASE WHEN p_partkey % 6 = 0 THEN 'two_players' END], lambda x: x IS NOT NULL), ',') AS tags FROM part""")
def photo_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("key"), (F.col("p_size") * 4).alias("mean_gray"), ((k % 50) / 1000).alias("glare_share"), ((k % 97) / 97).alias("screen_share"),
        (k % 23 - 11).alias("tilt"), F.when(k % 6 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("scores"))
    return evaluate.photo_tags(rows).select("key", F.array_join("tags", ",").alias("tags"))


@query("case_totals", f"""WITH k AS (SELECT l_orderkey AS key, l_orderkey % 4 * 10 AS angle, bool_and(l_quantity > 8) AS good FROM lineitem GROUP BY ALL)
SELECT angle, count(*) AS total, count(*) FILTER (good) AS complete FROM k GROUP BY angle""")
def case_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_orderkey") % 4 * 10).alias("angle"), (F.col("l_quantity") > 8).alias("ok"))
    return evaluate.case_totals(rows, "angle")


@query("chart_validity", """WITH c AS (SELECT CASE WHEN len(p_name) % 2 = 0 THEN 'the ' ELSE '' END || p_name AS name, list(DISTINCT p_type || ':' || p_size) AS charts FROM part GROUP BY p_name),
i AS (SELECT p_partkey AS key, p_name AS a, CASE WHEN p_partkey % 3 = 0 THEN 'the ' || p_name ELSE 'none' END AS b, p_type || ':' || (p_size + p_partkey % 2) AS want FROM part)
SELECT key, CASE WHEN coalesce(x.charts, y.charts) IS NULL THEN 'unknown' WHEN list_contains(coalesce(x.charts, y.charts), want) THEN 'ok' ELSE 'bad' END AS validity
FROM i LEFT JOIN c x ON x.name = i.a LEFT JOIN c y ON y.name = i.b""")
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items against a catalog that spells half of the names otherwise; every third item also tries that spelling."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    charts = F.collect_set(F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("level")))
    spelled = F.concat(F.when(F.length("p_name") % 2 == 0, "the ").otherwise(""), "p_name")
    catalog = part.groupBy("p_name").agg(charts.alias("charts")).select(spelled.alias("name"), "charts")
    names = F.array("p_name", F.when(k % 3 == 0, F.concat(F.lit("the "), "p_name")).otherwise("none"))
    items = part.select(k.alias("key"), names.alias("names"), F.col("p_type").alias("type"), (F.col("p_size") + (k % 2).cast("int")).alias("level"))
    return curate.chart_validity(items, catalog)


@query("final_rows", """SELECT CAST(doc_id AS VARCHAR) AS file, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, source, '') AS song, coalesce(CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS INTEGER) END, 7) AS score,
CASE WHEN doc_id % 5 = 0 THEN 'single' ELSE '' END AS chart, CASE WHEN doc_id % 4 = 0 THEN 3 END AS level, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS validated FROM documents""")
def final_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    items = table(spark, sf_dir, "documents").select(
        i.cast("string").alias("file"), F.when(i % 3 == 0, F.col("lang")).alias("song_final"), F.col("source").alias("song_ocr"), F.when(i % 2 == 0, F.col("n_chars").cast("int")).alias("score_final"),
        F.lit(7).alias("score_ocr"), F.when(i % 5 == 0, "single").alias("chart_final"), F.when(i % 4 == 0, 3).alias("level_final"), F.when(i % 6 == 0, True).alias("validated"))
    return curate.final_rows(items)


@query("zip_rows", "SELECT a.c_name AS file, b.c_name AS label FROM (SELECT c_name, row_number() OVER (ORDER BY c_name) AS i FROM customer) a JOIN (SELECT c_name, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer) b USING (i)")
def zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return curate.zip_rows(c.select(F.col("c_name").alias("file")), c.select(F.col("c_name").alias("label"), "c_acctbal", "c_custkey"), ["file"], ["c_acctbal", "c_custkey"]).select("file", "label")


@query("json_props_scan", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, coalesce(CAST(json_extract(props, '$.missing') AS INTEGER), -1) AS missing FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "k int, missing int")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["missing"], F.lit(-1)).alias("missing"))


@query("json_roundtrip", """SELECT event_id, '{"key":' || event_id || ',"fields":{"type":"' || event_type || '","n":' || (user_id % 7) || '}}' AS json FROM events""")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.struct(F.col("event_type").alias("type"), (F.col("user_id") % 7).alias("n"))
    out = F.to_json(F.struct(F.col("event_id").alias("key"), inner.alias("fields")))
    back = F.from_json(out, "key long, fields struct<type:string,n:long>")
    return table(spark, sf_dir, "events").select("event_id", F.to_json(back).alias("json"))


@query("keystone", f"""WITH p AS (SELECT p_partkey AS key, sin(radians(CAST(p_size % 31 AS DOUBLE))) * 0.5::DOUBLE * 1600 AS inset, ((p_partkey * 37) % 41 - 20) / 1000 * 1600 AS dx, ((p_partkey * 53) % 41 - 20) / 1000 * 1000 AS dy FROM part),
b AS (SELECT key, [[60 + dx + inset, 60 + dy], [1540 + dx - inset, 60 + dy], [1540 + dx, 940 + dy], [60 + dx, 940 + dy]] AS q FROM p)
SELECT key, CAST(i AS INTEGER) AS corner, {six_sql("q[i + 1][1]")} AS x, {six_sql("q[i + 1][2]")} AS y FROM b, range(4) r(i)""")
def keystone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a flat screen's corners lie in a photo from an angle, by the map that is solved from them."""
    k = F.col("p_partkey")
    shift = lambda by: ((k * by) % 41 - 20) / 1000
    quads = table(spark, sf_dir, "part").select(k.alias("key"), geometry.keystone(F.col("p_size") % 31, shift(37), shift(53), *curate.PHOTO).alias("quad"))
    h, (w, t) = F.col("h"), curate.SCREEN
    at = lambda x, y, i: (h[3 * i] * x + h[3 * i + 1] * y + h[3 * i + 2]) / (h[6] * x + h[7] * y + h[8])
    told = F.array(*[F.struct(F.lit(i).alias("corner"), six(at(x, y, 0)).alias("x"), six(at(x, y, 1)).alias("y")) for i, (x, y) in enumerate(((0, 0), (w, 0), (w, t), (0, t)))])
    return segments.homographies(quads, w, t).select("key", F.explode(told).alias("c")).select("key", "c.*")


@query("synth_cross_product", f"""SELECT n_name AS song, angle, brightness, glare, {six_sql('sin(radians(angle::DOUBLE)) * 0.5')} AS inset FROM nation, (SELECT unnest([0, 10, 20, 30])::INTEGER AS angle), (SELECT unnest([0.4::DOUBLE, 0.7::DOUBLE, 1.0::DOUBLE]) AS brightness), (SELECT unnest([false, true]) AS glare)""")
def synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("song"))
    return curate.synthetic_cases(songs).select("song", "angle", "brightness", "glare", six(F.col("inset")).alias("inset"))
