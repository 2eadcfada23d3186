"""Scoring of readings against ground truth: metrics, agreement, sweeps, regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.text import normalize_match
from fieldglass.operators.lines import middle_rank, ranks


def share(part: Column, whole: Column) -> Column:
    """A share, 0 of nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def field_metrics(answers: DataFrame, by: list[str]) -> DataFrame:
    """Coverage, precision and accuracy of rows (by..., value, truth, ok); rows without truth don't count."""
    known = answers.where("truth IS NOT NULL")
    sums = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNotNull()).alias("answered"),
        F.count_if(F.col("value").isNotNull() & F.col("ok")).alias("correct"),
    )
    return sums.select(
        *by, "n", share(F.col("answered"), F.col("n")).alias("coverage"), share(F.col("correct"), F.col("answered")).alias("precision"),
        share(F.col("correct"), F.col("n")).alias("accuracy"),
    )


def accepted_errors(answers: DataFrame, by: list[str]) -> DataFrame:
    """Share of wrong answers among all with truth, beside precision over at least one answer."""
    known = answers.where("truth IS NOT NULL").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNotNull()).alias("answered"),
        F.count_if(F.col("value").isNotNull() & F.col("ok")).alias("correct"),
    )
    return known.select(
        *by, "n", ((F.col("answered") - F.col("correct")) / F.col("n")).alias("accepted_error"),
        (F.col("correct") / F.greatest(F.col("answered"), F.lit(1))).alias("precision"),
    )


def agreement(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """Share of rows of the same key whose fields are equal (two nulls are): field, agreement."""
    both = left.select("key", *[F.col(f).alias(f"l_{f}") for f in fields]).join(right.select("key", *[F.col(f).alias(f"r_{f}") for f in fields]), "key")
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")).alias("same")) for f in fields])).alias("x"))
    return rows.groupBy("x.field").agg(F.avg(F.col("x.same").cast("int")).alias("agreement"))


def differences(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """Fields that differ between two sides of the same key: key, field, left, right."""
    text = lambda c: c.cast("string")
    both = left.select("key", *[F.col(f).alias(f"l_{f}") for f in fields]).join(right.select("key", *[F.col(f).alias(f"r_{f}") for f in fields]), "key")
    rows = both.select("key", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), text(F.col(f"l_{f}")).alias("left"), text(F.col(f"r_{f}")).alias("right")) for f in fields])).alias("x"))
    return rows.select("key", "x.*").where("NOT (left <=> right)")


def metrics_by_tag(answers: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of answers for every one of their ``tags``."""
    return field_metrics(answers.withColumn("tag", F.explode("tags")), ["tag", *by])


def threshold_sweep(answers: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metrics of answers (value, truth, ok, margin) gated at each threshold.

    Thresholds are a small literal table (some tens) that is broadcast; each
    adds one row to a task's partial sums, so nothing but sums is shuffled.
    """
    gated = answers.join(F.broadcast(thresholds)).withColumn("value", F.when(F.col("margin") >= F.col("threshold"), F.col("value")))
    return field_metrics(gated, ["threshold"])


def long_metrics(metrics: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Metrics as rows (metric, value), the name of each joined by dots."""
    parts = F.array(*[F.struct(F.concat_ws(".", *by, F.lit(v)).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    return metrics.select(F.explode(parts).alias("m")).select("m.*")


def regressions(current: DataFrame, baseline: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Metrics that fell below the baseline by more than the tolerance; counts and times aside."""
    base = baseline.where(~(F.col("metric").endswith(".n") | F.col("metric").startswith("native_ms"))).select("metric", F.col("value").alias("was"))
    return current.join(base, "metric").where(F.col("value") < F.col("was") - tolerance).select("metric", "was", F.col("value").alias("now"))


def margin_histogram(rows: DataFrame, low: float = 0.0, high: float = 0.25, bins: int = 25) -> DataFrame:
    """Counts of margins by bin and outcome (rows of margin, outcome)."""
    width = (high - low) / bins
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("margin") - low) / width))).cast("int")
    return rows.groupBy(at.alias("bin"), "outcome").agg(F.count(F.lit(1)).alias("n"))


def latency(rows: DataFrame, ms: str = "ms") -> DataFrame:
    """Mean, greatest and upper-median time."""
    times = rows.select(F.lit(0).alias("_k"), F.col(ms).alias("_ms"))
    sums = times.groupBy("_k").agg(F.avg("_ms").alias("mean"), F.max("_ms").alias("max"))
    return sums.join(ranks(times, "_k", "_ms", {"median": middle_rank}), "_k").drop("_k")


def truth_answers(readings: DataFrame, truth: DataFrame) -> DataFrame:
    """Gated readings beside the truth of their key: key, field, value, truth, ok, margin.

    ``truth`` has key, song, level, chart_type and ``scores`` (an array: a
    screen of two players has two, and either counts). Songs are equal by
    normal form. Readings without a truth row don't count.
    """
    both = readings.select("key", *[F.col(f).alias(f"_{f}") for f in FIELDS]).join(truth.select("key", "song", "level", "chart_type", "scores"), "key")
    text = lambda c: c.cast("string")
    row = lambda f, t, ok: F.struct(
        F.lit(f).alias("field"), text(F.col(f"_{f}.value")).alias("value"), t.alias("truth"), F.coalesce(ok, F.lit(False)).alias("ok"), F.col(f"_{f}.confidence").alias("margin"))
    rows = F.array(
        row("song", F.col("song"), normalize_match(F.col("_song.value")) == normalize_match(F.col("song"))),
        row("level", text(F.col("level")), F.col("_level.value") == F.col("level")),
        row("chart_type", F.col("chart_type"), F.col("_chart_type.value") == F.col("chart_type")),
        row("score", F.when(F.size("scores") > 0, F.array_join("scores", "|")), F.array_contains("scores", F.col("_score.value"))),
    )
    return both.select("key", F.explode(rows).alias("x")).select("key", "x.*")


#: Fields of a reading.
FIELDS = ("song", "level", "chart_type", "score")


def escalated(readings: DataFrame) -> DataFrame:
    """Photos, and those where song, score or level has no value: n, escalated, share. The chart type doesn't count."""
    missing = F.col("song").isNull() | F.col("score").isNull() | F.col("level").isNull()
    out = readings.agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("escalated"))
    return out.select("n", "escalated", share(F.col("escalated"), F.col("n")).alias("share"))


def case_totals(answers: DataFrame, by: str, case: str = "key") -> DataFrame:
    """Cases and those whose fields are all right, by a condition: by, total, complete (rows case, by, ok)."""
    cases = answers.groupBy(case, by).agg(F.every(F.coalesce("ok", F.lit(False))).alias("all"))
    return cases.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if("all").alias("complete"))


def photo_tags(rows: DataFrame) -> DataFrame:
    """Condition tags of photos from their measures: brightness, glare, screen share, tilt, players."""
    return rows.withColumn("tags", F.array_compact(F.array(
        F.when(F.col("mean_gray") < 90, "dark").otherwise("bright"), F.when(F.col("glare_share") > 0.02, "glare"),
        F.when(F.col("screen_share") < 0.40, "far"), F.when(F.abs("tilt") > 8, "rotated"), F.when(F.size("scores") > 1, "two_players"),
    )))
