"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import columns_only, held_out, whole_rows, written

#: Characters that are hashed at a time; longer texts go on in the next window.
WINDOW = 1 << 18
#: Labels whose sums (256 KB each) a task holds at a time.
HELD = 64
ORDERS = (1, 2, 3)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(codes: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each n-gram that starts at each code point; shape (orders, n).

    ``codes`` must end with two separators more than the n-grams asked for.
    """
    n = len(codes) - 2
    out = np.empty((len(ORDERS), n), dtype=np.int64)
    c = codes.astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, order in enumerate(ORDERS):
            h = (h + c[order - 1 : order - 1 + n] + np.uint64(order)) * _MULT
            h ^= h >> np.uint64(29)
            out[k] = (h >> np.uint64(64 - bits)).astype(np.int64)
    return out


def _windows(text: str) -> Iterator[np.ndarray]:
    """Padded code points of a text, window by window, each n-gram once."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(codes), WINDOW):
        part = codes[at : at + WINDOW + 2]
        pad = min(WINDOW, len(codes) - at) + 2 - len(part)
        yield np.concatenate([part, np.full(pad, 32, dtype=np.uint32)]) if pad else part


#: Log probabilities that may be broadcast: 128 MB, which at 15 bits is 1,024 languages.
CELLS = 1 << 25


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, bits: int) -> dict:
    """Log-probability matrix over all rows that may be learnt from.

    Every such row and every language counts. The matrix has 2**bits values
    for each language; a label column with more languages than ``CELLS``
    allows for is an error, as none is left out.
    """
    rows = columns_only(docs, id_col, text_col, lang_col).select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("out")
    ).where("NOT out AND lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    size = 1 << bits

    def told(lang: str, s: np.ndarray, n: int) -> pa.RecordBatch:
        at = np.flatnonzero(s)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(s[at], n))], names=["lang", "bucket", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = sums.get(lang)
                if s is None:
                    if len(sums) >= HELD:  # sums of many labels are passed on, not gathered
                        for k in sums:
                            yield told(k, sums[k], n[k])
                        sums, n = {}, {}
                    s = sums[lang] = np.zeros(size, dtype=np.int64)
                n[lang] = n.get(lang, 0) + 1
                for codes in _windows(text):
                    at = ngram_buckets(codes, bits).ravel()
                    if len(at) > size:
                        s += np.bincount(at, minlength=size)
                    else:
                        np.add.at(s, at, 1)
        for lang, s in sums.items():
            yield told(lang, s, n[lang])

    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = written(counts)
    docs_in = counts.where("bucket = -1").select("lang", "n")
    if docs_in.count() * size > CELLS:
        raise ValueError(f"more than {CELLS // size} languages: use fewer bits or map rare labels to one")
    known = {r["lang"]: r["n"] for r in docs_in.collect()}
    langs = sorted(known)
    if not langs:
        return {"langs": [], "bits": bits}
    matrix = np.zeros((len(langs), size))
    place = {k: i for i, k in enumerate(langs)}
    # one row a language comes back, of 2**bits numbers at most
    packed = counts.where("bucket >= 0").groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    for r in packed.toLocalIterator():
        matrix[place[r["lang"]], r["bucket"]] = r["n"]
    docs_of = np.array([known[k] for k in langs], dtype=float)
    logp = np.log((matrix + 0.5) / (matrix.sum(axis=1, keepdims=True) + 0.5 * size))
    return {"langs": langs, "bits": bits, "logp": np.ascontiguousarray(logp.T.astype(np.float32)), "prior": np.log(docs_of / docs_of.sum())}


def _score(model: dict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, bits = model["langs"], model["bits"]
    names, scores = [], []
    for text in texts:
        if not langs or not text or not any(map(str.isalpha, text)):
            names.append("und")
            scores.append(0.0)
            continue
        total = model["prior"].copy()
        for codes in _windows(text):
            # sparse scoring: rows of the matrix for the buckets that occur, and no others
            total += model["logp"][ngram_buckets(codes, bits).ravel()].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        names.append(langs[best])
        scores.append(float(1.0 / np.exp(np.minimum(total - total[best], 0)).sum()))
    return names, scores


def identify_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    bits: int = 15,
) -> DataFrame:
    """One row per input row: id, ``held_out``, ``lang_pred``, ``score`` (0 to 1).

    The model learns n-gram counts from every row with a label whose id isn't
    held out; the label never enters a prediction. ``lang_pred`` is ``und``
    with score 0 if the text is null or has no letter, or if nothing could be
    learnt. Ties between languages go to the first in alphabetical order. Very
    long texts are scored whole, window by window. Repeated rows give repeated
    results, an empty table an empty one; other columns are ignored. A row
    with a null id is learnt from, as it is not held out.
    """
    named = language_of(docs, id_col, text_col, lang_col, bits)
    rows = columns_only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = rows.select("id", held_out("id").alias("held_out"), named(F.col("text")).alias("found"))
    return found.select(F.col("id").alias(id_col), "held_out", "found.lang_pred", "found.score")


def language_of(docs: DataFrame, id_col: str, text_col: str, lang_col: str, bits: int) -> Callable[[Column], Column]:
    """A function of a text column that gives struct(lang_pred, score), learnt from ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col, bits))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = _score(shared.value, texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict.asNondeterministic()  # else a filter on the result would run it a second time


def known_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    bits: int = 15, least: float = 0.5, into: str | None = None,
) -> DataFrame:
    """The documents whose language is found with a score of ``least`` or more, with all their columns.

    Null texts and texts without a letter (``und``) go. ``into`` names a
    column that then holds the language that was found. Repeated rows stay or
    go together; an empty table gives an empty one. Columns may have any names.
    """
    named = language_of(docs, id_col, text_col, lang_col, bits)
    found = whole_rows(docs).withColumn("found", named(F.col("doc").getField(text_col)))
    kept = found.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= least))
    columns = [F.col("found.lang_pred").alias(c) if c == into else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return kept.select(*columns)
