"""Text expressions: normal forms, trigrams, similarity, labels and escapes.

Built from SQL functions but for two families that Spark lacks: canonical
decomposition and longest-matching-block similarity, which run as pandas UDFs
over the few strings that need them.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def decomposed(texts: pd.Series) -> pd.Series:
    """Canonical decomposition (NFD); null stays null."""
    return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFD", t))


def normalize_match(text: Column) -> Column:
    """Normal form for matching: no accents, lower case, letters and digits alone, single spaces."""
    plain = F.lower(F.regexp_replace(decomposed(text), r"\p{Mn}", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s]", " "), r"\s+", " "))


def normalize_key(text: Column) -> Column:
    """Normal form for catalog keys: ASCII only, lower case, single spaces; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(decomposed(text), r"[^\x00-\x7f]", "")), r"\s+", " "))


def compact(norm: Column) -> Column:
    """A normal form without its spaces."""
    return F.replace(norm, F.lit(" "), F.lit(""))


def trigrams(compacted: Column) -> Column:
    """Distinct trigrams of a compacted text padded by two spaces on both sides."""
    padded = F.concat(F.lit("  "), compacted, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def blocks(a: str | None, b: str | None) -> tuple[float, int]:
    """What ``block_similarity`` says of two texts."""
    m = SequenceMatcher(None, a or "", b or "", autojunk=False)
    return m.ratio(), m.find_longest_match().size


@F.pandas_udf(T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("common", T.IntegerType())]))
def block_similarity(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Share of characters in recursively longest matching blocks, and the longest common substring.

    The order of the arguments matters: the leftmost longest block in the
    first text wins ties. Two empty texts are alike (1.0).
    """
    seen: dict[tuple[str, str], tuple[float, int]] = {}
    out = []
    for pair in zip(a, b):
        if pair not in seen:
            seen[pair] = blocks(*pair)
        out.append(seen[pair])
    return pd.DataFrame(out, columns=["ratio", "common"])


def round_half_even(x: Column, digits: int = 0) -> Column:
    """Rounds halves to even (the ``round`` of Spark goes away from zero)."""
    scale = F.lit(10.0**digits)
    return F.rint(x * scale) / scale


def significant(x: Column, digits: int = 6) -> Column:
    """A number as it reads back from text with so many significant digits."""
    return F.format_string(f"%.{digits - 1}e", x.cast("double")).cast("double")


def title_weight(conf: Column, second: bool = False) -> Column:
    """Weight of a title by its box's confidence; the second reading counts less."""
    w = F.sqrt(F.greatest(conf, F.lit(0.02)))
    return w * 0.85 if second else w


#: Chart types and their catalog keys.
CHART_KEYS = {"single": "s", "double": "d", "halfdouble": "hd", "coop": "c"}


def chart_key(chart_type: Column) -> Column:
    """Catalog key of a chart type, null for others."""
    out = F.lit(None).cast("string")
    for name, key in CHART_KEYS.items():
        out = F.when(chart_type == name, F.lit(key)).otherwise(out)
    return out


def chart_from_label(text: Column) -> Column:
    """Chart type named by a printed label; the first of the ordered patterns wins."""
    up = F.upper(text)
    return (
        F.when(F.contains(up, F.lit("HALF")), "halfdouble").when(F.contains(up, F.lit("SINGLE")), "single")
        .when(F.contains(up, F.lit("DOUBLE")), "double").when(F.contains(up, F.lit("COOP")), "coop")
    )


def digit_of(label: Column) -> Column:
    """The digit that a class label stands for: 0 to 9 or a digit's code point; else -1."""
    return F.when(label.between(0, 9), label).when(label.between(48, 57), label - 48).otherwise(F.lit(-1))


def clean_name(text: Column) -> Column:
    """A dumped name: doubled quotes made single, trimmed, one pair of wrapping quotes off."""
    single = F.trim(F.replace(text, F.lit('""'), F.lit('"')))
    return F.trim(F.regexp_replace(single, r'^"(.*)"$', "$1"))


def score_value(digits: Column) -> Column:
    """Score read from digits: of seven the first falls away unless they are 1000000; null outside 0 to 1000000."""
    used = F.when((F.length(digits) == 7) & (digits != "1000000"), F.substring(digits, 2, 7)).otherwise(digits)
    value = F.when(F.length(used).between(1, 7), F.try_to_number(used, F.lit("9999999")).cast("int"))
    return F.when(value <= 1000000, value)


def turned_by(turn: Column) -> Column:
    """Degrees of a turn: 1 is 90, 2 is 270, else 0."""
    return F.when(turn == 1, 90).when(turn == 2, 270).otherwise(0)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Array (r, g, b) of 0 to 255, truncated, of a hue of 0 to 179 and shares of saturation and value."""
    turn = F.pmod(h / 179.0, F.lit(1.0)) * 6
    i = F.floor(turn)
    part = turn - i
    p, q, t = v * (1 - s), v * (1 - s * part), v * (1 - s * (1 - part))
    out = F.array(v, p, q)
    for k, rgb in enumerate(((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v))):
        out = F.when(F.pmod(i, F.lit(6)) == k, F.array(*rgb)).otherwise(out)
    return F.transform(F.when(s == 0, F.array(v, v, v)).otherwise(out), lambda x: (x * 255).cast("int"))
