"""Queries of the detection operators: order lines stand for detections of a photo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions import geometry as g
from fieldglass.operators import boxes, flow, segments
from fieldglass.plans.registry import LINE_ORDER, ORD_SQL, query, six, six_sql, table

W, H = 100, 90


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as detections: key, cls, box, conf, ord, turn."""
    lines = table(spark, sf_dir, "lineitem")
    x1, y1 = F.col("l_partkey") % 40, F.col("l_suppkey") % 30
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    return lines.select(
        F.col("l_orderkey").alias("key"), (F.col("l_linenumber") % 3).cast("int").alias("cls"),
        g.box(x1, y1, x1 + 8 + F.col("l_quantity"), y1 + 6 + F.col("l_quantity")).alias("box"),
        (F.col("l_extendedprice") / 100000).alias("conf"), ord_.alias("ord"), (F.col("l_linenumber") % 3).cast("int").alias("turn"), "l_tax", "l_discount",
    )


DET = f"""det AS (
  SELECT l_orderkey AS key, CAST(l_linenumber % 3 AS INTEGER) AS cls, CAST(l_partkey % 40 AS INTEGER) AS x1, CAST(l_suppkey % 30 AS INTEGER) AS y1,
    CAST(l_partkey % 40 + 8 + l_quantity AS INTEGER) AS x2, CAST(l_suppkey % 30 + 6 + l_quantity AS INTEGER) AS y2,
    l_extendedprice / 100000 AS conf, CAST({ORD_SQL} AS INTEGER) AS ord, CAST(l_linenumber % 3 AS INTEGER) AS turn, l_tax, l_discount
  FROM lineitem)"""


def iou_sql(a: str, b: str) -> str:
    inter = f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    union = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {inter})"
    return f"(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0 END)"


_STRUCT = "STRUCT(x1 INTEGER, y1 INTEGER, x2 INTEGER, y2 INTEGER, conf DOUBLE, ord INTEGER)[]"


@query("nms_per_class", f"""WITH {DET}, folded AS (
  SELECT key, cls, list_reduce(list(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, conf := conf, ord := ord) ORDER BY conf DESC, ord),
    lambda acc, b: CASE WHEN len(list_filter(acc, lambda k: {iou_sql("k", "b")} > 0.45)) > 0 THEN acc ELSE list_append(acc, b) END, CAST([] AS {_STRUCT})) AS kept
  FROM det GROUP BY key, cls), r AS (SELECT key, cls, unnest(kept) AS b FROM folded)
SELECT key, cls, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2, b.conf AS conf, b.ord AS ord FROM r""")
def nms_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = boxes.nms(detections(spark, sf_dir))
    return kept.select("key", "cls", "box.x1", "box.y1", "box.x2", "box.y2", "conf", "ord")


@query("best_box_per_class", f"WITH {DET} SELECT key, cls, conf, ord FROM det QUALIFY row_number() OVER (PARTITION BY key, cls ORDER BY conf DESC, ord) = 1")
def best_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.best_box(detections(spark, sf_dir)).select("key", "cls", "conf", "ord")


@query("top_n_boxes", f"""WITH {DET}, r AS (SELECT key, cls, conf, ord, CAST(row_number() OVER (PARTITION BY key, cls ORDER BY conf DESC, ord) AS INTEGER) AS rank FROM det)
SELECT * FROM r WHERE rank <= 3""")
def top_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.top_boxes(detections(spark, sf_dir), 3).select("key", "cls", "conf", "ord", "rank")


@query("box_turn_back", f"""WITH {DET} SELECT key, ord, turn,
  CASE turn WHEN 1 THEN y1 WHEN 2 THEN {W} - y2 ELSE x1 END AS x1, CASE turn WHEN 1 THEN {H} - x2 WHEN 2 THEN x1 ELSE y1 END AS y1,
  CASE turn WHEN 1 THEN y2 WHEN 2 THEN {W} - y1 ELSE x2 END AS x2, CASE turn WHEN 1 THEN {H} - x1 WHEN 2 THEN x2 ELSE y2 END AS y2 FROM det""")
def turn_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumn("b", g.turn_back(F.col("box"), F.col("turn"), F.lit(W), F.lit(H)))
    return d.select("key", "ord", "turn", "b.x1", "b.y1", "b.x2", "b.y2")


@query("box_crop", f"""WITH {DET}, p AS (SELECT key, ord, x1, y1, x2, y2,
  CAST(trunc(CAST((x2 - x1) * CAST(0.06 AS FLOAT) AS FLOAT)) AS INTEGER) AS px, CAST(trunc(CAST((y2 - y1) * CAST(0.06 AS FLOAT) AS FLOAT)) AS INTEGER) AS py FROM det),
c AS (SELECT key, ord, greatest(0, least(x1 - px, 60)) AS x1, greatest(0, least(y1 - py, 50)) AS y1, greatest(0, least(x2 + px, 60)) AS x2, greatest(0, least(y2 + py, 50)) AS y2 FROM p)
SELECT key, ord, x1, y1, x2, y2 FROM c WHERE x2 > x1 AND y2 > y1""")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumn("b", g.crop(F.col("box"), F.lit(60), F.lit(50), 0.06))
    return d.where("b IS NOT NULL").select("key", "ord", "b.x1", "b.y1", "b.x2", "b.y2")


_H = [1.25, 0.5, 3.0, -0.25, 1.5, 2.0, 0.0, 0.0, 1.0]


@query("box_map_back", f"""WITH {DET}, c AS (SELECT key, ord,
  [1.25 * x1 + 0.5 * y1 + 3.0, 1.25 * x1 + 0.5 * y2 + 3.0, 1.25 * x2 + 0.5 * y1 + 3.0, 1.25 * x2 + 0.5 * y2 + 3.0]::DOUBLE[] AS xs,
  [-0.25 * x1 + 1.5 * y1 + 2.0, -0.25 * x1 + 1.5 * y2 + 2.0, -0.25 * x2 + 1.5 * y1 + 2.0, -0.25 * x2 + 1.5 * y2 + 2.0]::DOUBLE[] AS ys FROM det)
SELECT key, ord, CAST(round(list_min(xs)) AS INTEGER) AS x1, CAST(round(list_min(ys)) AS INTEGER) AS y1, CAST(round(list_max(xs)) AS INTEGER) AS x2, CAST(round(list_max(ys)) AS INTEGER) AS y2 FROM c""")
def map_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumn("b", g.map_back(F.col("box"), F.array(*[F.lit(x) for x in _H])))
    return d.select("key", "ord", "b.x1", "b.y1", "b.x2", "b.y2")


@query("letterbox_decode", f"""WITH {DET}, d AS (SELECT key, ord, CAST((x1 + x2) / 2.0 AS DOUBLE) AS cx, CAST((y1 + y2) / 2.0 AS DOUBLE) AS cy, CAST(x2 - x1 AS DOUBLE) AS w, CAST(y2 - y1 AS DOUBLE) AS h, turn = 1 AS flip FROM det),
r AS (SELECT key, ord, flip, (cx - w / 2 - 4) / 0.8::DOUBLE AS l, (cx + w / 2 - 4) / 0.8::DOUBLE AS r, (cy - h / 2 - 2) / 0.8::DOUBLE AS t, (cy + h / 2 - 2) / 0.8::DOUBLE AS b FROM d),
b AS (SELECT key, ord, greatest(0, least(100, CAST(trunc(CASE WHEN flip THEN 100 - r ELSE l END) AS INTEGER))) AS x1, greatest(0, least(90, CAST(trunc(t) AS INTEGER))) AS y1,
  greatest(0, least(100, CAST(trunc(CASE WHEN flip THEN 100 - l ELSE r END) AS INTEGER))) AS x2, greatest(0, least(90, CAST(trunc(b) AS INTEGER))) AS y2 FROM r)
SELECT * FROM b WHERE x2 - x1 >= 2 AND y2 - y1 >= 2""")
def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    d = detections(spark, sf_dir).withColumn("b", g.letterbox_decode(
        (b["x1"] + b["x2"]) / 2.0, (b["y1"] + b["y2"]) / 2.0, (b["x2"] - b["x1"]).cast("double"), (b["y2"] - b["y1"]).cast("double"),
        F.lit(0.8), F.lit(4), F.lit(2), F.col("turn") == 1, F.lit(W), F.lit(H)))
    return d.where(g.sides_at_least(F.col("b"))).select("key", "ord", "b.x1", "b.y1", "b.x2", "b.y2")


@query("class_argmax", """SELECT vec_id, CAST(CASE WHEN m > 0 THEN list_position(s, m) - 1 ELSE 0 END AS INTEGER) AS cls, CASE WHEN m > 0 THEN m ELSE 0 END AS conf
FROM (SELECT vec_id, CAST(embedding[1:5] AS DOUBLE[]) AS s, list_max(CAST(embedding[1:5] AS DOUBLE[])) AS m FROM embeddings)""")
def class_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", g.class_argmax(F.slice("embedding", 1, 5).cast("array<double>")).alias("a"))
    return e.select("vec_id", "a.cls", "a.conf")


@query("zoom_carry_over", f"""WITH {DET}, a AS (SELECT * FROM det WHERE ord % 2 = 1), b AS (SELECT * FROM det WHERE ord % 2 = 0)
SELECT key, cls, ord, 2 AS passed FROM b UNION ALL SELECT key, cls, ord, 1 AS passed FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.key = a.key AND b.cls = a.cls)""")
def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return boxes.carry_over(d.where("ord % 2 = 0"), d.where("ord % 2 = 1")).select("key", "cls", "ord", "passed")


@query("orientation_score", f"""WITH {DET}, t AS (SELECT key, turn, CAST(ord % 2 AS INTEGER) AS c, max(conf) AS top FROM det GROUP BY ALL)
SELECT key, turn, {six_sql("sum(1 + top) + 100 * max(CASE WHEN c = 1 THEN 1 ELSE 0 END)")} AS score FROM t GROUP BY key, turn""")
def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumn("cls", (F.col("ord") % 2).cast("int"))
    return boxes.orientation_scores(d).select("key", "turn", six(F.col("score")).alias("score"))


@query("best_turn", f"""WITH {DET}, d AS (SELECT *, CAST(ord % 2 AS INTEGER) AS c FROM det), u AS (SELECT *, bool_or(turn = 0 AND c = 1) OVER (PARTITION BY key) AS upright FROM d),
t AS (SELECT key, turn, c, max(conf) AS top FROM u WHERE NOT upright OR turn = 0 GROUP BY ALL), s AS (SELECT key, turn, sum(1 + top) + 100 * max(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS score FROM t GROUP BY key, turn)
SELECT key, turn FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY {six_sql("score")} DESC, turn) = 1""")
def best_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumn("cls", (F.col("ord") % 2).cast("int"))
    return boxes.best_turn(d).select("key", "turn")


#: Detections of each pass, by the line's number in its order: the first ones upright, then turned, then in the crop of a small screen.
_PASSES = f"""{DET}, d AS (SELECT *, CAST((x1 + y1) % 5 AS INTEGER) AS c, CASE ord % 4 WHEN 1 THEN 'upright' WHEN 3 THEN 'zoom' ELSE 'turned' END AS pass, CASE ord % 4 WHEN 2 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS t FROM det)"""


@query("detection_flow", f"""WITH {_PASSES}, keys AS (SELECT DISTINCT key FROM d), up AS (SELECT * FROM d WHERE pass = 'upright'),
screened AS (SELECT DISTINCT key FROM up WHERE c = 1), seen AS (SELECT * FROM up UNION ALL SELECT * FROM d WHERE pass = 'turned' AND key NOT IN (SELECT key FROM screened)),
tops AS (SELECT key, t, c, max(conf) AS top FROM seen GROUP BY ALL), scores AS (SELECT key, t, sum(1 + top) + 100 * max(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS score FROM tops GROUP BY key, t),
chosen AS (SELECT key, t FROM scores QUALIFY row_number() OVER (PARTITION BY key ORDER BY {six_sql("score")} DESC, t) = 1), kept AS (SELECT seen.* FROM seen JOIN chosen USING (key, t)),
panel AS (SELECT key, t, x1, y1, x2, y2, CASE WHEN t > 0 THEN {H} ELSE {W} END AS w, CASE WHEN t > 0 THEN {W} ELSE {H} END AS h FROM kept WHERE c = 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY conf DESC, ord) = 1),
padded AS (SELECT *, greatest(0, x1 - CAST(trunc(CAST((x2 - x1) * CAST(0.06 AS FLOAT) AS FLOAT)) AS INTEGER)) AS a1, greatest(0, y1 - CAST(trunc(CAST((y2 - y1) * CAST(0.06 AS FLOAT) AS FLOAT)) AS INTEGER)) AS b1,
  least(w, x2 + CAST(trunc(CAST((x2 - x1) * CAST(0.06 AS FLOAT) AS FLOAT)) AS INTEGER)) AS a2, least(h, y2 + CAST(trunc(CAST((y2 - y1) * CAST(0.06 AS FLOAT) AS FLOAT)) AS INTEGER)) AS b2 FROM panel),
small AS (SELECT * FROM padded WHERE (x2 - x1) * (y2 - y1) < 0.4::DOUBLE * w * h AND a2 - a1 >= 20 AND b2 - b1 >= 20),
zoomed AS (SELECT d.key, s.t, 2 AS passed, ord, c, conf, d.x1 + a1 AS x1, d.y1 + b1 AS y1, d.x2 + a1 AS x2, d.y2 + b1 AS y2 FROM d JOIN small s USING (key) WHERE pass = 'zoom'),
every AS (SELECT * FROM zoomed UNION ALL SELECT key, t, 1, ord, c, conf, x1, y1, x2, y2 FROM kept k WHERE NOT EXISTS (SELECT 1 FROM zoomed z WHERE z.key = k.key AND z.c = k.c))
SELECT key, CAST(t AS INTEGER) AS turn, passed, CAST(ord AS INTEGER) AS ord, c AS cls, CASE t WHEN 1 THEN y1 WHEN 2 THEN {W} - y2 ELSE x1 END AS x1, CASE t WHEN 1 THEN {H} - x2 WHEN 2 THEN x1 ELSE y1 END AS y1,
  CASE t WHEN 1 THEN y2 WHEN 2 THEN {W} - y1 ELSE x2 END AS x2, CASE t WHEN 1 THEN {H} - x1 WHEN 2 THEN x2 ELSE y2 END AS y2 FROM every""")
def detection_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).drop("turn", "cls")
    part = F.col("ord") % 4
    d = d.withColumns({"cls": ((F.col("box.x1") + F.col("box.y1")) % 5).cast("int"), "pass": F.when(part == 1, "upright").when(part == 3, "zoom").otherwise("turned"),
                       "_turn": F.when(part == 2, 1).when(part == 0, 2)})
    photos = d.select("key").distinct().select("key", F.lit(W).alias("width"), F.lit(H).alias("height"))
    told = d.select(F.col("key").alias("_key"), F.col("pass").alias("_pass"), "_turn", "ord", "cls", "conf", "box")

    def detect(asked: DataFrame) -> DataFrame:
        return asked.join(told, (F.col("key") == F.col("_key")) & (F.col("pass") == F.col("_pass")) & (F.col("_turn").isNull() | (F.col("_turn") == F.col("turn"))))

    return flow.detection_flow(photos, detect, least=20).select("key", "turn", "passed", "ord", "cls", "box.*")


@query("detector_recall", f"""WITH {DET}, f AS (SELECT key, cls, x1, y1, x2, y2 FROM det WHERE ord % 2 = 1 QUALIFY row_number() OVER (PARTITION BY key, cls ORDER BY ord) = 1),
h AS (SELECT f.key, f.cls, max(CASE WHEN d.key IS NOT NULL AND {iou_sql("d", "f")} >= 0.5 THEN 1 ELSE 0 END) AS hit
  FROM f LEFT JOIN (SELECT * FROM det WHERE ord % 2 = 0) d ON d.key = f.key AND d.cls = f.cls GROUP BY f.key, f.cls)
SELECT cls, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, sum(hit) / count(*) AS recall FROM h GROUP BY cls""")
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return boxes.recall(d.where("ord % 2 = 0"), d.where("ord % 2 = 1"))


@query("box_predicates", f"""WITH {DET} SELECT key, ord, (x2 - x1) * (y2 - y1) < CAST(0.40 AS DOUBLE) * {W} * {H} AND x2 - x1 >= 20 AND y2 - y1 >= 20 AS zoom, y2 - y1 < 24 AND x2 - x1 >= 8 AND y2 - y1 >= 4 AS tiny FROM det""")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("key", "ord", g.zoom_eligible(F.col("box"), F.lit(W), F.lit(H), least=20).alias("zoom"), g.tiny_title(F.col("box")).alias("tiny"))


@query("detected_boxes", f"WITH {DET} SELECT key, ord FROM det WHERE l_discount / 10 >= 0.005::DOUBLE AND x2 - x1 >= 2 AND y2 - y1 >= 2")
def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where(g.detected(F.col("box"), F.col("l_discount") / 10)).select("key", "ord")


@query("translate", f"WITH {DET} SELECT key, ord, x1 + 7 AS x1, y1 - 3 AS y1, x2 + 7 AS x2, y2 - 3 AS y2 FROM det")
def translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("key", "ord", g.translate(F.col("box"), F.lit(7), F.lit(-3)).alias("b")).select("key", "ord", "b.*")


@query("second_score_box", f"WITH {DET} SELECT key, ord, x1, y1 + CAST(trunc(CAST(0.15 AS FLOAT) * (y2 - y1)) AS INTEGER) AS y1, x2, y2 FROM det")
def second_score_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("key", "ord", g.second_score_box(F.col("box")).alias("b")).select("key", "ord", "b.*")


@query("tiny_title_zoom", f"""WITH {DET}, c AS (SELECT key, ord, x1, y1, x2, y2, x2 - x1 AS w, y2 - y1 AS h, CAST(l_tax * 100 AS INTEGER) AS grown FROM det),
g AS (SELECT *, greatest(0, x1 - CAST(trunc(CAST(0.6 AS FLOAT) * w) AS INTEGER)) AS a, greatest(0, y1 - h) AS b, least({W}, x2 + CAST(trunc(CAST(0.6 AS FLOAT) * w) AS INTEGER)) AS e, least({H}, y2 + h) AS f FROM c),
k AS (SELECT *, h < 24 AND w >= 8 AND h >= 4 AND e - a >= 20 AND f - b >= 12 AS again FROM g)
SELECT key, ord, CASE WHEN again AND grown > 4 THEN a + 3 ELSE x1 END AS x1, CASE WHEN again AND grown > 4 THEN b + 2 ELSE y1 END AS y1,
  CASE WHEN again AND grown > 4 THEN a + 33 ELSE x2 END AS x2, CASE WHEN again AND grown > 4 THEN b + 2 + h + grown - 4 ELSE y2 END AS y2 FROM k""")
def tiny_title_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles looked at again: the find counts where it is taller."""
    b = F.col("box")
    grown = F.col("l_tax") * 100
    found = g.box(F.lit(3), F.lit(2), F.lit(33), 2 + b["y2"] - b["y1"] + F.round(grown).cast("int") - 4)
    rows = detections(spark, sf_dir).withColumn("at", g.title_crop(b, F.lit(W), F.lit(H))).withColumn("found", F.when(F.col("at").isNotNull(), found))
    return rows.select("key", "ord", g.taller(F.col("found"), b, F.col("at")).alias("b")).select("key", "ord", "b.*")


@query("map_box_half_even", f"""WITH {DET}, c AS (SELECT key, ord, unnest([struct_pack(x := x1, y := y1), struct_pack(x := x1, y := y2), struct_pack(x := x2, y := y1), struct_pack(x := x2, y := y2)]) AS p FROM det),
m AS (SELECT key, ord, (1.5::DOUBLE * p.x + 0.25::DOUBLE * p.y) / (p.y / 64 + 1) AS u, (0.5::DOUBLE * p.y + 3) / (p.y / 64 + 1) AS v FROM c)
SELECT key, ord, CAST(round_even(min(u), 0) AS INTEGER) AS x1, CAST(round_even(min(v), 0) AS INTEGER) AS y1, CAST(round_even(max(u), 0) AS INTEGER) AS x2, CAST(round_even(max(v), 0) AS INTEGER) AS y2 FROM m GROUP BY key, ord""")
def map_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.array(*[F.lit(x) for x in (1.5, 0.25, 0.0, 0.0, 0.5, 3.0, 0.0, 1 / 64, 1.0)])
    return detections(spark, sf_dir).select("key", "ord", g.map_back(F.col("box"), h, half_even=True).alias("b")).select("key", "ord", "b.*")


@query("order_quad", f"""WITH {DET}, c AS (SELECT key, ord, list_sort([struct_pack(y := y1, x := x2), struct_pack(y := y2 + 1, x := x1), struct_pack(y := y2, x := x2 + 3), struct_pack(y := y1 + 2, x := x1)]) AS q FROM det),
t AS (SELECT key, ord, list_sort(list_transform(q[1:2], lambda a: struct_pack(x := a.x, y := a.y))) AS t, list_sort(list_transform(q[3:4], lambda a: struct_pack(x := a.x, y := a.y))) AS l FROM c)
SELECT key, ord, t[1].x || ',' || t[1].y || ' ' || t[2].x || ',' || t[2].y || ' ' || l[2].x || ',' || l[2].y || ' ' || l[1].x || ',' || l[1].y AS quad FROM t""")
def order_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, point = F.col("box"), lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = F.array(point(b["x2"], b["y1"]), point(b["x1"], b["y2"] + 1), point(b["x2"] + 3, b["y2"]), point(b["x1"], b["y1"] + 2))
    shown = F.array_join(F.transform(g.order_quad(corners), lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")
    return detections(spark, sf_dir).select("key", "ord", shown.alias("quad"))


@query("plausible_quad", f"""WITH {DET} SELECT key, ord, x2 - x1 >= 40 AND y2 - y1 >= 40 AND (x2 - x1) * 1.3::DOUBLE >= 60 AND (y2 - y1) * 1.3::DOUBLE >= 60 AND l_discount * 12 BETWEEN 0.30::DOUBLE AND 1.02::DOUBLE
  AND (x2 - x1) * 1.3::DOUBLE / greatest((y2 - y1) * 1.3::DOUBLE, 1) BETWEEN 0.6::DOUBLE AND 5.0::DOUBLE AS fits FROM det""")
def plausible_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("box")["x2"] - F.col("box")["x1"], F.col("box")["y2"] - F.col("box")["y1"]
    return detections(spark, sf_dir).select("key", "ord", g.plausible_quad(w * 1.3, h * 1.3, F.col("l_discount") * 12, w, h).alias("fits"))


@query("homography", f"""WITH {DET} SELECT key, ord, {six_sql("(x2 - x1) / 100.0::DOUBLE")} AS sx, {six_sql("(y2 - y1) / 50.0::DOUBLE")} AS sy, {six_sql("x1")} AS tx, {six_sql("y1")} AS ty FROM det""")
def homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upright boxes as quads: scale and shift of the map from a screen of 100 x 50."""
    b = F.col("box")
    quad = F.array(*[b[c].cast("double") for c in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")])
    rows = detections(spark, sf_dir).select(F.struct("key", "ord").alias("key"), quad.alias("quad"))
    h = F.col("h")
    return segments.homographies(rows, 100, 50).select("key.key", "key.ord", *[six(h[i]).alias(n) for i, n in ((0, "sx"), (4, "sy"), (2, "tx"), (5, "ty"))])


# a keystone: the upper side is shorter than the lower one, so the map is projective; its corners must come back
@query("homography_corners", f"""WITH {DET}, c AS (SELECT key, ord, [x1 + 1, x2 - 2, x2 + 3, x1 - 4] AS xs, [y1, y1 + 1, y2 + 2, y2] AS ys FROM det)
SELECT key, ord, CAST(i AS INTEGER) AS corner, CAST(xs[i + 1] AS DOUBLE) AS x, CAST(ys[i + 1] AS DOUBLE) AS y FROM c, range(4) r(i)""")
def homography_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keystones as quads: where the map from a screen of 100 x 50 takes its corners."""
    b = F.col("box")
    corners = [(b["x1"] + 1, b["y1"]), (b["x2"] - 2, b["y1"] + 1), (b["x2"] + 3, b["y2"] + 2), (b["x1"] - 4, b["y2"])]
    rows = detections(spark, sf_dir).select(F.struct("key", "ord").alias("key"), F.array(*[c.cast("double") for p in corners for c in p]).alias("quad"))
    h = F.col("h")
    at = lambda x, y, i: (h[3 * i] * x + h[3 * i + 1] * y + h[3 * i + 2]) / (h[6] * x + h[7] * y + h[8])
    told = F.array(*[F.struct(F.lit(i).alias("corner"), six(at(x, y, 0)).alias("x"), six(at(x, y, 1)).alias("y")) for i, (x, y) in enumerate(((0, 0), (100, 0), (100, 50), (0, 50)))])
    return segments.homographies(rows, 100, 50).select("key.key", "key.ord", F.explode(told).alias("c")).select("key", "ord", "c.*")
