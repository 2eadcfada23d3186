"""Mixing sources to target weights: raking of token weights, then sampling."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import whole, written

MARGINS = ("source", "lang", "topic")
#: A category for rows that have none.
NONE = "(none)"
#: Raking rounds between two looks at the marginals; each scales the cells to the three in turn.
ROUNDS = 10
#: Largest relative error of a marginal at which raking ends.
TOLERANCE = 1e-5
#: Raking also ends, with a warning, where this many looks haven't lowered the error by a thousandth.
STALLED = 3
#: Rounds that find the factor at which capped probabilities give the rate.
#: Marginal target shares are proportional to token mass to these powers.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.8}
#: Share of all tokens that the sample is to hold.
RATE = 0.6
#: Cells up to which they are broadcast (some 10 MB).
FEW = 100_000


def topic_of(text: Column) -> Column:
    """A topic by the first marker that occurs in the text."""
    return (
        F.when(F.contains(text, F.lit("token = ")), "configuration")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("License")), "licence")
        .otherwise("prose")
    )


def _uniform(id_col: str) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    head = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10)
    return head.cast("double") / 4294967296.0


def _six(x: Column) -> Column:
    """Six decimals, halves upwards."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def token_weights(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None,
    source_col: str = "source", lang_col: str = "lang", whole_row: bool = False,
) -> DataFrame:
    """Per row: id, source, lang, topic and ``n_tokens`` (words; at least 1); the whole row as ``doc`` if asked for."""
    named = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{source_col}`"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col(f"`{lang_col}`"), F.lit(NONE)).alias("lang"),
        whole(F.col(f"`{text_col}`")).alias("text"),
        *([topic.alias("topic")] if topic is not None else []),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole_row else []),
    )
    if topic is None:
        named = named.withColumn("topic", topic_of(F.col("text")))
    return named.select(
        "id", "source", "lang", F.coalesce("topic", F.lit(NONE)).alias("topic"),
        F.greatest(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long").alias("n_tokens"),
        *(["doc"] if whole_row else []),
    )


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (source, lang, topic, mass) with ``w``: shares fitted to the target marginals.

    Iterative proportional fitting: in each round the cells of every source,
    then language, then topic are scaled to that category's target share.
    Targets are tables (category, share) where given (a category that isn't in
    one gets no weight), else proportional to observed mass to a power. Rounds
    go on until every marginal is within ``tolerance`` of its target; targets
    that contradict each other end in a warning that gives the error left.
    """
    fit = cells.withColumn("w", F.col("mass").cast("double"))
    for m in MARGINS:
        if targets and m in targets:
            share = targets[m].select(F.col("category").alias(m), F.col("share").cast("double").alias(f"{m}_to"))
            fit = fit.join(share, m, "left").withColumn(f"{m}_to", F.coalesce(f"{m}_to", F.lit(0.0)))
        else:
            observed = cells.groupBy(m).agg(F.sum("mass").cast("double").alias("of"))
            powered = observed.select(m, F.pow("of", F.lit(float(powers[m]))).alias("p"))
            total = powered.agg(F.sum("p").alias("all"))
            share = powered.crossJoin(F.broadcast(total)).select(m, (F.col("p") / F.col("all")).alias(f"{m}_to"))
            fit = fit.join(share, m)
    fit = written(fit)
    if fit.count() <= FEW:  # cells that would be broadcast anyway
        return _raked_here(fit, tolerance)
    errors: list[float] = []
    while True:
        for _ in range(ROUNDS):
            for m in MARGINS:
                fit = fit.withColumn("w", F.coalesce(F.try_divide(F.col(f"{m}_to") * F.col("w"), F.sum("w").over(Window.partitionBy(m))), F.lit(0.0)))
        fit = written(fit)
        errors.append(marginal_error(fit))  # one number comes back from each look
        if _ended(errors, tolerance):
            break
    return fit.select(*MARGINS, "mass", "w")


def _ended(errors: list[float], tolerance: float) -> bool:
    """Whether raking is done, or gets no further, by the errors after every ``ROUNDS`` rounds."""
    if errors[-1] <= tolerance:
        return True
    if len(errors) > STALLED and min(errors[-STALLED:]) > 0.999 * min(errors[:-STALLED]):
        warnings.warn(f"raking ends {errors[-1]:.2g} off a marginal's target: the targets contradict each other or are met too slowly", stacklevel=3)
        return True
    return False


def _raked_here(fit: DataFrame, tolerance: float) -> DataFrame:
    """The same rounds over few cells in the driver."""
    cells = fit.collect()
    w = np.array([r["w"] for r in cells], dtype=float)
    place = {m: np.unique(np.array([r[m] for r in cells], dtype=object), return_inverse=True)[1] for m in MARGINS if cells}
    to = {m: np.array([r[f"{m}_to"] for r in cells], dtype=float) for m in MARGINS}
    errors: list[float] = []
    while cells:
        for _ in range(ROUNDS):
            for m in MARGINS:
                of = np.bincount(place[m], weights=w)[place[m]]
                w = np.divide(to[m] * w, of, out=np.zeros_like(w), where=of > 0)
        off = [np.abs(np.bincount(place[m], weights=w)[place[m]][to[m] > 0] / to[m][to[m] > 0] - 1).max(initial=0) for m in MARGINS]
        errors.append(float(max(off)))
        if _ended(errors, tolerance):
            break
    rows = [(*(r[m] for m in MARGINS), r["mass"], float(x)) for r, x in zip(cells, w)]
    return fit.sparkSession.createDataFrame(rows, fit.select(*MARGINS, "mass", "w").schema)


def marginal_error(fit: DataFrame) -> float:
    """The largest error of a marginal, as a share of its target, in cells with weights and targets."""
    off = [F.abs(F.try_divide(F.sum("w").over(Window.partitionBy(m)), F.col(f"{m}_to")) - 1) for m in MARGINS]
    return fit.select(F.greatest(*off).alias("off")).agg(F.max("off")).first()[0] or 0.0


def probabilities(fit: DataFrame, rate: float = RATE) -> DataFrame:
    """Raked cells with ``weight`` (target over observed share) and ``probability``.

    Probabilities are proportional to weights, at most 1, and their expected
    tokens are ``rate`` of all; cells that reach 1 are taken whole and the
    others raised to make up for it. A higher factor makes more cells whole and
    none less, so the search ends with the round that adds none, when the
    expected tokens are met, or with every weighted cell whole.
    """
    fit = written(fit)
    total = fit.agg(F.sum("mass").cast("double").alias("mass"), F.sum("w").alias("w")).first()
    if not total["w"]:  # an empty table
        total = {"mass": 1.0, "w": 1.0}
    cells = fit.select(*MARGINS, "mass", (F.col("w") / total["w"] * total["mass"] / F.col("mass")).alias("weight"))
    k, whole_cells = float(rate), -1
    while True:  # three numbers come back from each round
        full = F.lit(k) * F.col("weight") >= 1
        sums = cells.agg(
            F.count_if(full).alias("cells"), F.sum(F.when(full, F.col("mass")).otherwise(0)).alias("whole"),
            F.sum(F.when(full, 0.0).otherwise(F.col("mass") * F.col("weight"))).alias("rest"),
        ).first()
        if not sums["rest"] or sums["cells"] == whole_cells:
            break
        k, whole_cells = max(k, (total["mass"] * rate - sums["whole"]) / sums["rest"]), sums["cells"]
    return cells.select(*MARGINS, "mass", "weight", F.least(F.lit(1.0), F.lit(k) * F.col("weight")).alias("probability"))


def _drawn(rows: DataFrame, powers: dict[str, float], targets: dict[str, DataFrame] | None, rate: float) -> DataFrame:
    """Cells of rows (source, lang, topic, n_tokens) with weight and probability; broadcast where they are few."""
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("mass")))
    drawn = written(probabilities(rake(cells, powers, targets), rate))
    return F.broadcast(drawn) if drawn.count() <= FEW else drawn.hint("merge")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic: Column | None = None,
    powers: dict[str, float] = POWERS,
    targets: dict[str, DataFrame] | None = None,
    rate: float = RATE,
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per input row: id, source, lang, topic, n_tokens, weight, probability, kept.

    Token mass is summed by cell over all rows, raked until the marginals are
    met (see ``rake``), and each document is kept with its cell's probability
    by a number drawn from its id, so the same id always meets the same
    decision (repeated rows too). Null source, lang or topic are a category of
    their own; null and empty texts weigh one token; a null id draws like the
    empty text. An empty table gives an empty result. Other columns are
    ignored. Cells number at most sources x languages x topics; they are
    broadcast up to ``FEW`` and joined by shuffle beyond.
    """
    rows = token_weights(docs, id_col, text_col, topic, source_col, lang_col)
    told = rows.join(_drawn(rows, powers, targets, rate), list(MARGINS))
    return told.select(
        F.col("id").alias(id_col), *MARGINS, "n_tokens", _six(F.col("weight")).alias("weight"),
        _six(F.col("probability")).alias("probability"), (_uniform("id") < F.col("probability")).alias("kept"),
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic: Column | None = None,
    powers: dict[str, float] = POWERS,
    targets: dict[str, DataFrame] | None = None,
    rate: float = RATE,
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """The documents that ``mix`` keeps, with all their columns.

    Nulls, repeated rows and empty tables are treated as there: a document
    that repeats is kept or goes with all its copies. Columns may have any
    names.
    """
    rows = token_weights(docs, id_col, text_col, topic, source_col, lang_col, whole_row=True)
    told = rows.join(_drawn(rows, powers, targets, rate).select(*MARGINS, "probability"), list(MARGINS))
    return told.where(_uniform("id") < F.col("probability")).select("doc.*")
