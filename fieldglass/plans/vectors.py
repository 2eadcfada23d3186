"""Queries of vector classification: a fifth of the embeddings is the bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import evaluate, vectors
from fieldglass.plans.registry import query, six, six_sql, table


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    rows = e.where("vec_id % 5 != 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    bank = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("idx"), "label", F.col("embedding").alias("vec"))
    return rows, bank


_SIM = """r AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 5 <> 0),
b AS (SELECT vec_id AS idx, label, CAST(embedding AS DOUBLE[]) AS t FROM embeddings WHERE vec_id % 5 = 0),
s AS (SELECT id, label, max(list_dot_product(v, t)) AS sim FROM r, b GROUP BY id, label),
m AS (SELECT id, label, sim, lead(sim) OVER w AS next, row_number() OVER w AS rank FROM s WINDOW w AS (PARTITION BY id ORDER BY sim DESC, label)),
best AS (SELECT id, label, sim, sim - greatest(coalesce(next, -1), 0) AS margin FROM m WHERE rank = 1)"""


@query("template_argmax_margin", f"WITH {_SIM} SELECT id, label, {six_sql('sim')} AS sim, {six_sql('margin')} AS margin FROM best")
def argmax_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.classify(*parts(spark, sf_dir)).select("id", "label", six(F.col("sim")).alias("sim"), six(F.col("margin")).alias("margin"))


@query("digit_scores", f"""WITH {_SIM}, d AS (SELECT r.id, x.d AS d FROM r, (SELECT unnest(range(0, 10)) AS d) x)
SELECT d.id, CAST(d.d AS INTEGER) AS digit, {six_sql('coalesce(sim, -1.0::DOUBLE)')} AS score FROM d LEFT JOIN s ON s.id = d.id AND s.label = d.d""")
def digit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.digit_scores(*parts(spark, sf_dir))
    return found.select("id", F.posexplode("scores").alias("digit", "s")).select("id", "digit", six(F.col("s")).alias("score"))


@query("knn_vote_l1", """WITH r AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 5 <> 0),
b AS (SELECT vec_id AS idx, label, CAST(embedding AS DOUBLE[]) AS t FROM embeddings WHERE vec_id % 5 = 0),
d AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - t[i]))), idx) AS rank FROM r, b),
c AS (SELECT id, label, count(*) AS votes FROM d WHERE rank <= 5 GROUP BY id, label)
SELECT id, label, votes / 5 AS conf FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) = 1""")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.knn_vote(*parts(spark, sf_dir), least=0.0)


@query("knn_vote_floor", """WITH r AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 5 <> 0),
b AS (SELECT vec_id AS idx, label, CAST(embedding AS DOUBLE[]) AS t FROM embeddings WHERE vec_id % 5 = 0),
d AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - t[i]))), idx) AS rank FROM r, b),
c AS (SELECT id, label, count(*) AS votes FROM d WHERE rank <= 5 GROUP BY id, label), m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) = 1)
SELECT id, label, votes / 5 AS conf FROM m WHERE votes >= 3""")
def knn_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the floor of 0.6: rows without such a majority have no type."""
    return vectors.knn_vote(*parts(spark, sf_dir))


@query("margin_histogram", f"""WITH {_SIM} SELECT CAST(least(24, greatest(0, floor(margin / 0.01::DOUBLE))) AS INTEGER) AS bin,
CASE WHEN margin < 0.05 THEN 'rejected' WHEN best.label = e.label THEN 'ok' ELSE 'bad' END AS outcome, count(*) AS n FROM best JOIN embeddings e ON e.vec_id = best.id GROUP BY ALL""")
def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("truth"))
    found = vectors.classify(*parts(spark, sf_dir)).join(truth, "id")
    outcome = F.when(F.col("margin") < 0.05, "rejected").when(F.col("label") == F.col("truth"), "ok").otherwise("bad")
    return evaluate.margin_histogram(found.withColumn("outcome", outcome))
