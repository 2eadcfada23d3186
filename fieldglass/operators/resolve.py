"""Gates: every field is a trusted value, or null with the reason to escalate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.text import block_similarity, chart_from_label, chart_key, compact, normalize_match, score_value, title_weight
from fieldglass.operators.matching import levels_for, match


@dataclass(frozen=True)
class Gates:
    """Thresholds of the gates (fixed values), each of which a sweep can move."""

    song_margin: float = 0.001
    similarity: float = 0.55
    similarity_short: float = 0.80
    short_name: int = 3
    raw_length: int = 4
    score_margin: float = 0.010
    score_agree_margin: float = 0.0
    badge_conf: float = 0.15
    title_conf: float = 0.0
    titles: int = 5
    candidates: int = 3
    pool: int = 8


#: The reasons.
LOW_CONF, LOW_MARGIN, UNLIKE, NO_GLYPHS, NOT_NUMBER, OUT_OF_RANGE = (
    "baja_confianza", "margen_bajo", "sin_parecido", "sin_glifos", "no_numerico", "fuera_de_rango",
)


def field(value: Column, confidence: Column, reason: Column) -> Column:
    return F.struct(F.when(reason.isNull(), value).alias("value"), confidence.cast("float").alias("confidence"), reason.alias("reason"))


@dataclass(frozen=True)
class Options:
    """Options of recognition, out-of-range values mended: modes that don't exist leave the mode as it was."""

    rectify: bool = False
    bin_mode: int = 0
    badge_mode: int = 0
    title_variants: int = 1
    title_boxes: int = 3

    def changed(self, rectify: bool, bin_mode: int, badge_mode: int, title_variants: int, title_boxes: int) -> Options:
        """These options with new values where they are in range (modes 0 to 3 and 0 to 2)."""
        return Options(
            rectify, bin_mode if 0 <= bin_mode <= 3 else self.bin_mode, badge_mode if 0 <= badge_mode <= 2 else self.badge_mode,
            max(title_variants, 1), 3 if title_boxes < 1 else title_boxes,
        )


def score_margin(margins: Column) -> Column:
    """The least margin of a score's digits; 0 without digits."""
    return F.coalesce(F.array_min(margins), F.lit(0.0))


def mean_margin(margins: Column) -> Column:
    """The mean margin of glyphs; -1 without any."""
    return F.when(F.size(margins) > 0, F.aggregate(margins, F.lit(0.0), lambda acc, x: acc + x) / F.size(margins)).otherwise(F.lit(-1.0))


def score_reading(digits: Column, margins: Column) -> Column:
    """Struct (score, margin) of one reading; -1 where the digits are no score."""
    return F.struct(F.coalesce(score_value(digits), F.lit(-1)).alias("score"), score_margin(margins).alias("margin"))


def chart_override(text: Column, margins: Column, chart: Column, conf: Column) -> Column:
    """Struct (chart, conf): a label of four or more glyphs that names a chart with a mean margin over 0.05 overrides the colour, at 0.95."""
    named = chart_from_label(text)
    sure = (F.length(text) >= 4) & named.isNotNull() & (mean_margin(margins) > 0.05)
    return F.struct(F.when(sure, named).otherwise(chart).alias("chart"), F.when(sure, 0.95).otherwise(conf).alias("conf"))


def chart_gate(raw: Column, conf: Column, gates: Gates = Gates()) -> Column:
    raw, conf = F.when(raw != "", raw), F.coalesce(conf, F.lit(0.0))
    return field(raw, conf, F.when(raw.isNull() | (conf < gates.badge_conf), F.lit(LOW_CONF)))


def score_gate(score: Column, margin: Column, second: Column, gates: Gates = Gates()) -> Column:
    """A clear score, or one that a second reading confirms."""
    score, margin, second = F.coalesce(score, F.lit(-1)), F.coalesce(margin, F.lit(0.0)), F.coalesce(second, F.lit(-2))
    sure = (margin >= gates.score_margin) | ((second == score) & (margin >= gates.score_agree_margin))
    none = score < 0
    return field(score, F.when(none, F.lit(0.0)).otherwise(margin), F.when(none, NO_GLYPHS).when(~sure, LOW_MARGIN))


def pooled(scores: Column) -> Column:
    """Fold of an ordered array: the greater of sum and next value, and 0.15 of the lesser."""
    return F.aggregate(scores, F.lit(0.0), lambda acc, x: F.greatest(acc, x) + 0.15 * F.least(acc, x))


def margin_of(ranked: Column) -> Column:
    """First minus second of a falling array; 1 with fewer than two."""
    return F.when(F.size(ranked) > 1, ranked[0] - ranked[1]).otherwise(F.lit(1.0))


def level_choice(levels: Column, scores: Column) -> Column:
    """Struct (level, margin) of the legal level whose zero-padded digits score most; lowest of equals.

    ``scores`` is one array of ten for each glyph, -1 where there is none. Null
    without a legal level. One fold over the levels keeps the best and the
    second best total.
    """
    n = F.size(scores)
    tens = F.array(*[F.lit(10**k) for k in range(11)])
    legal = F.filter(levels, lambda l: (l >= 0) & (l < F.get(tens, F.least(n, F.lit(10)))))

    def total(level: Column) -> Column:
        digit = lambda i: F.pmod(F.floor(level / F.coalesce(F.get(tens, n - 1 - i), F.lit(10**18))), F.lit(10)).cast("int")
        slot = lambda row, i: F.coalesce(F.get(row, digit(i)), F.lit(-1.0))
        return F.aggregate(F.transform(scores, slot), F.lit(0.0), lambda acc, x: acc + x)

    state = lambda level, top, second: F.struct(level.alias("level"), top.alias("top"), second.alias("second"))
    none = F.lit(None).cast("double")
    scored = F.transform(legal, lambda l: F.struct(l.alias("level"), total(l).alias("total")))
    start = state(F.lit(None).cast("int"), none, none)
    ahead = lambda acc, x: acc["level"].isNull() | (x["total"] > acc["top"]) | ((x["total"] == acc["top"]) & (x["level"] < acc["level"]))
    step = lambda acc, x: F.when(ahead(acc, x), state(x["level"].cast("int"), x["total"], acc["top"])).otherwise(
        state(acc["level"], acc["top"], F.greatest(acc["second"], x["total"])))
    margin = lambda acc: F.when(acc["second"].isNull(), F.lit(1.0)).otherwise((acc["top"] - acc["second"]) / n)
    return F.aggregate(scored, start, step, lambda acc: F.when(acc["level"].isNotNull(), F.struct(acc["level"].alias("level"), margin(acc).alias("margin"))))


def level_field(levels: Column, digits: Column, scores: Column) -> Column:
    """Level by the catalog's legal levels, else by the digits alone within 1 to 28."""
    return chosen_level(level_choice(F.coalesce(levels, F.array().cast("array<int>")), scores), digits, scores)


def chosen_level(best: Column, digits: Column, scores: Column) -> Column:
    """The level of a choice (see ``level_choice``), else that of the digits; ``best`` is used several times, so it had better be a column."""
    glyphs = F.size(F.coalesce(scores, F.array().cast("array<array<double>>"))) > 0
    text = F.array_join(F.transform(digits, lambda d: d.cast("string")), "")
    number = F.when(text.rlike("^-?[0-9]+$"), text.try_cast("int"))
    alone = F.when(digits.isNull(), field(F.lit(None).cast("int"), F.lit(0.0), F.lit(NO_GLYPHS))).when(
        number.isNull(), field(number, F.lit(0.0), F.lit(NOT_NUMBER))
    ).otherwise(field(number, F.lit(0.0), F.when(~number.between(1, 28), F.lit(OUT_OF_RANGE))))
    return F.when(~glyphs, field(F.lit(None).cast("int"), F.lit(0.0), F.lit(NO_GLYPHS))).when(
        best.isNotNull(), field(best["level"], best["margin"], F.lit(None).cast("string"))
    ).otherwise(alone)


def needs_llm(song: Column, level: Column, chart: Column, score: Column) -> Column:
    """Names of the fields that carry a reason, in the order of the arguments."""
    named = (("song", song), ("level", level), ("chart_type", chart), ("score", score))
    return F.array_compact(F.array(*[F.when(c["reason"].isNotNull(), F.lit(n)) for n, c in named]))


def title_reads(native: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """The texts of each photo's titles (key, titles) that are matched: key, title, variant, text, weight.

    The first ``gates.titles`` titles count, before those without a text or
    with too little confidence go. A second reading that differs is a variant
    of less weight.
    """
    some = native.select("key", F.posexplode(F.slice(F.coalesce("titles", F.array().cast(dict(native.dtypes)["titles"])), 1, gates.titles)).alias("title", "t")).where("t.raw != ''")
    some = some.where(F.coalesce("t.conf", F.lit(1.0)) >= gates.title_conf)
    weight = title_weight(F.coalesce("t.conf", F.lit(1.0)))
    again = F.when((F.col("t.raw2") != "") & (F.col("t.raw2") != F.col("t.raw")), F.col("t.raw2"))
    texts = F.array_compact(F.array(F.struct(F.lit(0).alias("variant"), F.col("t.raw").alias("text"), weight.alias("weight")),
                                    F.when(again.isNotNull(), F.struct(F.lit(1).alias("variant"), again.alias("text"), (weight * 0.85).alias("weight")))))
    return some.select("key", "title", F.explode(texts).alias("r")).select("key", "title", "r.*")


def readings(native: DataFrame, catalog: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """Native readings (key and the fields of the reading record) as gated fields.

    Chart first, then song from the pooled title readings, then level by the
    gated song and chart, then score. ``catalog`` holds ord, name, charts.
    """
    base = native.withColumn("chart", chart_gate(F.col("chart_type"), F.col("chart_conf"), gates))
    reads = title_reads(base, gates)
    # equal texts of many photos are matched once
    found = match(reads.select(F.col("text").alias("key"), "text").distinct(), catalog, k=gates.pool).withColumnRenamed("key", "text")
    weighted = reads.join(found.select("text", "rank", "name", F.col("score").alias("likeness")), "text").select(
        "key", "name", F.struct("title", "variant", "rank", (F.col("likeness") * F.col("weight")).alias("x")).alias("s")
    )
    pool = weighted.groupBy("key", "name").agg(F.array_sort(F.collect_list("s")).alias("all"))
    pool = pool.select("key", "name", pooled(F.transform("all", lambda s: s["x"])).alias("score"), F.col("all")[0].alias("first"))
    ranked = pool.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), F.col("first.title").alias("t"), F.col("first.variant").alias("v"), F.col("first.rank").alias("r"), "name", "score"))).alias("ranked")
    )
    raws = reads.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("title", "variant", "text"))), lambda r: r["text"]).alias("raws"))
    joined = base.join(ranked, "key", "left").join(raws, "key", "left")
    joined = joined.withColumn("ranked", F.coalesce("ranked", F.array().cast(dict(ranked.dtypes)["ranked"]))).withColumn("raws", F.coalesce("raws", F.array().cast("array<string>")))
    margin = margin_of(F.transform("ranked", lambda r: r["score"]))
    joined = joined.withColumn("margin", margin).withColumn("top", F.try_element_at("ranked", F.lit(1))["name"])
    joined = joined.join(_alike(joined, gates), "key", "left")
    clear = (F.size("ranked") > 0) & (F.col("margin") >= gates.song_margin)
    reason = F.when(~clear, LOW_MARGIN).when(~F.coalesce("alike", F.lit(False)), UNLIKE)
    joined = joined.withColumn("song", field(F.col("top"), F.col("margin"), reason))
    legal = levels_for(joined.where("song.value IS NOT NULL").select("key", F.col("song.value").alias("name"), chart_key(F.col("chart.value")).alias("chart")), catalog)
    joined = joined.join(legal, "key", "left")
    joined = joined.withColumn("best", level_choice(F.coalesce("levels", F.array().cast("array<int>")), F.col("level_scores")))
    joined = joined.withColumn("level", chosen_level(F.col("best"), F.col("level_digits"), F.col("level_scores")))
    joined = joined.withColumn("score_field", score_gate(F.col("score"), F.col("score_margin"), F.col("score2"), gates))
    out = joined.withColumn("needs_llm", needs_llm(F.col("song"), F.col("level"), F.col("chart"), F.col("score_field")))
    return out.select(
        "key", "song", "level", F.col("chart").alias("chart_type"), F.col("score_field").alias("score"), F.array_join("raws", " | ").alias("raw"),
        F.transform(F.slice("ranked", 1, gates.candidates), lambda r: F.struct(r["name"].alias("name"), r["score"].alias("score"))).alias("candidates"),
        "needs_llm", (F.size("needs_llm") > 0).alias("needs_vlm_call"),
    )


def _alike(rows: DataFrame, gates: Gates) -> DataFrame:
    """Whether any raw reading looks like the winning name: key, alike."""
    pairs = rows.where("top IS NOT NULL").select("key", F.explode("raws").alias("raw"), "top")
    pairs = pairs.withColumn("r", compact(normalize_match(F.col("raw")))).withColumn("n", compact(normalize_match(F.col("top"))))
    pairs = pairs.where((F.col("n") != "") & (F.col("r") != "") & (F.length("r") >= F.least(F.lit(gates.raw_length), F.length("n"))))
    need = F.when(F.length("n") <= gates.short_name, gates.similarity_short).otherwise(gates.similarity)
    return pairs.withColumn("s", block_similarity(F.col("r"), F.col("n"))).groupBy("key").agg(F.max(F.col("s.ratio") >= need).alias("alike"))
