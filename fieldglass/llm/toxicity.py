"""Toxicity: a subsequence string-kernel machine with Nyström landmarks, trained on labelled sentences.

The kernel of two strings sums, over all character triples, the products of how
they occur in order in both; each character that an occurrence spans costs a
factor, so gaps and inserted characters lower the value and don't end it.
Strings are words and pairs of neighbouring words of a sentence (which ends with
a stop before white space, or with its line), with a mark at each border, across which occurrences may reach. A text is scored over all its
words and pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import columns_only, dropped, held_out, whole, written

DECAY = 0.7
#: The most characters behind the first that an occurrence may reach.
REACH = 6
_SPANS = range(2, REACH + 1)
_WEIGHT = {b: DECAY ** (b + 1) for b in _SPANS}
#: Squared weights of the occurrences that start at a character with so many others behind it.
_SQUARES = np.cumsum([0.0, 0.0] + [(b - 1) * _WEIGHT[b] ** 2 for b in _SPANS])
#: Longer words are scored piece by piece, pieces overlapping.
LONGEST = 24
#: So many words of one character each are letters that were spelled out, and read as one word.
SPELLED = 4
#: Characters that are scored together.
SLICE = 1 << 16

#: Labelled documents that are learnt from, at most, of either label; all that follows is learnt from these.
SAMPLE = {1: 2000, 0: 4000}
#: One labelled document in so many is kept for the calibration.
CALIBRATE = 4
#: Words of the sample's clean documents that are looked at as instances: the most frequent ones.
VOCABULARY = 100_000
#: Share of the toxic documents that a word or pair which marks them occurs in, and its least log odds.
SUPPORT, ODDS = 0.004, 2.5
LANDMARKS = 96
#: Rounds in which the worst-looking strings of labelled sentences become instances, and strings of a document that do.
MINING, WORST = 3, 3
INSTANCES = 2000
THRESHOLD = 0.3
#: Word and pair scores that a document is judged by, and its number of words.
FEATURES = 6

_MARK = 1
_STOPS = np.array([ord(c) for c in ".!?"], np.uint32)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its class (0 a sign, 1 white space, 2 to 63 what stands in a word), and the letter it looks like."""
    kind = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isspace():
            kind[c] = _MARK
        elif s.isalnum():
            kind[c] = 2 + c - 97 if 97 <= c <= 122 else 28 + c - 48 if 48 <= c <= 57 else 38 + c % 25
    kind[0] = _MARK
    look = np.zeros(0x110000, dtype=np.uint8)
    # fixed values: digits and signs that stand for letters inside a word
    for sign, letter in zip("013457$@", "oieastsa"):
        look[ord(sign)] = 2 + ord(letter) - 97
    return kind, look


#: A character for each class, so that a cleaned string is read back as itself; other letters share 25.
_NAMES = np.array([" ", " ", *map(chr, range(97, 123)), *map(chr, range(48, 58)), *sorted(map(chr, range(0x430, 0x430 + 25)), key=lambda c: ord(c) % 25), " "])


class Strings:
    """Texts as one row of numbers: a mark before each word and behind the last, ``REACH`` zeros behind each text.

    Signs within a word fall away, and look-alikes are letters where the word
    has others. Every text keeps the words it has, in order.
    """

    _tables: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, texts: list[str]) -> None:
        if Strings._tables is None:
            Strings._tables = _classes()
        kinds, looks = Strings._tables
        low = [t.lower() for t in texts]
        cps = np.frombuffer("".join(t + "\0" for t in low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        text_end = np.cumsum([len(t) + 1 for t in low], dtype=np.int64)
        kind, look = kinds[cps], looks[cps]
        space = kind == _MARK
        begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        token = np.cumsum(~space & np.concatenate([[True], space[:-1]])) - 1
        letter = (kind >= 2) & ~((kind >= 28) & (kind <= 37))
        if len(begin):
            lettered = np.logical_or.reduceat(letter, begin)
            kind = np.where((look > 0) & ~space & lettered[np.maximum(token, 0)], look, kind)
        kept = (kind >= 2) & ~space
        size = np.add.reduceat(kept, begin) if len(begin) else np.zeros(0, np.int64)
        text_of = np.searchsorted(text_end, begin, side="right")
        stops = (cps == 10) | np.isin(cps, _STOPS) & np.concatenate([space[1:], [True]])
        sentence = np.cumsum(stops)[begin]
        begin, text_of, sentence, size = begin[size > 0], text_of[size > 0], sentence[size > 0], size[size > 0]
        # runs of single characters are one word
        single = size == 1
        joins = np.concatenate([[False], single[1:] & single[:-1] & (text_of[1:] == text_of[:-1])]) if len(size) else single
        run = np.cumsum(~joins) - 1
        spelled = np.bincount(run, minlength=1)[run] >= SPELLED if len(run) else joins
        head = ~(joins & spelled)
        word = np.cumsum(head) - 1
        self.size = np.bincount(word, weights=size, minlength=int(head.sum())).astype(np.int64)
        self.text_of, self.texts = text_of[head], len(texts)
        same = (text_of[head][1:] == text_of[head][:-1]) & (sentence[head][1:] == sentence[head][:-1])
        # places: a mark and the characters of each word, then a mark and zeros behind each text
        gap = np.zeros(len(self.size) + 1, np.int64)
        ended = np.searchsorted(self.text_of, np.arange(len(self.size) and self.texts), side="right")
        np.add.at(gap, ended, 1 + REACH)
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)])[: len(self.size)] + np.cumsum(gap)[: len(self.size)]
        total = int((self.size + 1).sum() + gap.sum())
        self.codes = np.zeros(total, np.int64)
        of_char = np.repeat(np.arange(len(self.size)), self.size)
        within = np.arange(len(of_char)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.codes[self.start[of_char] + 1 + within] = kind[kept]
        self.codes[self.start] = self.codes[self.start + self.size + 1] = _MARK
        #: Places up to the mark behind a word, and behind the word after it in the same sentence.
        self.end = self.start + self.size + 1
        follows = np.concatenate([same, [False]]) if len(self.size) else np.zeros(0, bool)
        self.follows, self.second = follows, np.where(follows, np.roll(self.end, -1), self.end)
        self.pieces = [(w, s) for w in np.flatnonzero(self.size > LONGEST) for s in range(int(self.start[w]), int(self.end[w]) - LONGEST // 2, LONGEST // 2)]


class Scores:
    """Sums of a table over all occurrences of triples in words and pairs of words, scaled to length."""

    def __init__(self, s: Strings, table: np.ndarray) -> None:
        n = max(len(s.codes) - REACH, 0)
        one, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = np.repeat(s.start, s.size + 1) + np.arange(int((s.size + 1).sum())) - np.repeat(np.cumsum(s.size + 1) - s.size - 1, s.size + 1)
        one[place] = np.repeat(s.end, s.size + 1) - place  # characters behind, within the word
        two[place] = np.repeat(s.second, s.size + 1) - place
        first = s.codes[:n] << 12
        inner, outer = np.zeros(n), np.zeros(n)
        for b in _SPANS:
            last = first | s.codes[b : b + n]
            value = np.zeros(n)
            for a in range(1, b):
                value += table[last | s.codes[a : a + n] << 6]
            value *= _WEIGHT[b]
            inner += np.where(one >= b, value, 0)
            outer += np.where(two >= b, value, 0)
        reach = lambda x: np.concatenate([[0.0], np.cumsum(x)])
        sums, wide = reach(inner), reach(outer)
        norm, wide_norm = reach(_SQUARES[np.minimum(one, REACH)]), reach(_SQUARES[np.minimum(two, REACH)])
        scaled = lambda x, h: x / np.sqrt(np.maximum(h, 1e-9))
        a, b = s.start, s.end
        self.words = scaled(sums[b] - sums[a], norm[b] - norm[a]) if len(a) else np.zeros(0)
        if s.pieces:  # a long word is as bad as its worst piece
            w = np.array([p[0] for p in s.pieces])
            pa_, pb = np.array([p[1] for p in s.pieces]), np.minimum(np.array([p[1] for p in s.pieces]) + LONGEST, b[w])
            found = scaled(sums[pb] - sums[pa_], norm[pb] - norm[pa_])
            self.words[np.unique(w)] = -np.inf
            np.maximum.at(self.words, w, found)
        i = np.flatnonzero(s.follows)
        self.pair = i  # the first words of pairs
        self.pairs = scaled(wide[b[i]] - wide[a[i]] + sums[b[i + 1]] - sums[a[i + 1]], wide_norm[b[i]] - wide_norm[a[i]] + norm[b[i + 1]] - norm[a[i + 1]]) if len(i) else np.zeros(0)


def _string_codes(strings: list[str]) -> np.ndarray:
    """Cleaned strings (lower-case words, one space between two) as numbers, marks included; 0 behind the end."""
    out = []
    for x in strings:
        s = Strings([x])
        out.append(s.codes[: len(s.codes) - REACH] if len(s.size) else np.zeros(1, np.int64))
    wide = np.zeros((len(out), max(map(len, out), default=0)), np.int64)
    for row, codes in zip(wide, out):
        row[: len(codes)] = codes
    return wide


def triples(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the character triples of each string, and their weights, scaled to length."""
    codes = np.pad(_string_codes(strings), ((0, 0), (0, REACH)))
    width = codes.shape[1] - REACH
    ids, weight = [], []
    for b in _SPANS:
        last = codes[:, b : b + width]
        for a in range(1, b):
            ids.append(codes[:, :width] << 12 | codes[:, a : a + width] << 6 | last)
            weight.append(np.where(last > 0, _WEIGHT[b], 0.0))
    ids, weight = np.concatenate(ids, axis=1), np.concatenate(weight, axis=1)
    return ids, weight / np.sqrt(np.maximum((weight**2).sum(axis=1), 1e-9))[:, None]


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of strings and landmarks."""
    out = np.zeros((len(strings), len(landmarks)))
    parts = [triples(strings[at : at + 256]) for at in range(0, len(strings), 256)]
    li, lw = triples(landmarks)
    for k in range(len(landmarks)):  # one landmark's table is in memory at a time
        table = np.bincount(li[k], weights=lw[k], minlength=1 << 18)
        for n, (i, w) in enumerate(parts):
            out[n * 256 : n * 256 + 256, k] = (table[i] * w).sum(axis=1)
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps; the last value is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        slack = 1 - y * (x @ b)
        on = slack > 0
        g = ridge * b - (x[on] * (weight * y * slack)[on, None]).sum(axis=0)
        h = ridge * np.eye(len(b)) + (x[on] * weight[on, None]).T @ x[on]
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return b


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + ridge * b
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


class Machine:
    """Scores of strings by one table over triples, and of texts by their worst words and pairs."""

    def __init__(self, table: np.ndarray, offset: float, calibration: np.ndarray | None = None) -> None:
        self.table, self.offset = table, offset
        self.calibration = np.zeros(FEATURES + 1) if calibration is None else calibration

    @staticmethod
    def empty() -> Machine:
        """Knows nothing: every score is near 0."""
        return Machine(np.zeros(1 << 18), -1.0, np.array([0.0] * FEATURES + [-20.0]))

    def _slices(self, texts: list[str]) -> Iterator[tuple[int, Strings, Scores]]:
        """Texts of some ``SLICE`` characters together: number of the first, its strings and their scores."""
        at = 0
        while at < len(texts):
            end, room = at, SLICE
            while end < len(texts) and (end == at or room > 0):
                room -= len(texts[end])
                end += 1
            s = Strings(texts[at:end])
            yield at, s, Scores(s, self.table)
            at = end

    def features(self, texts: list[str]) -> np.ndarray:
        """The three highest scores of words, the two highest of pairs, and the logarithm of the number of words."""
        out = np.full((len(texts), FEATURES), -1.0)
        for at, s, found in self._slices(texts):
            n = np.bincount(s.text_of, minlength=s.texts)
            out[at : at + s.texts, 5] = np.log1p(n) / 5
            for column, most, value, of in ((0, 3, found.words, s.text_of), (3, 2, found.pairs, s.text_of[found.pair])):
                by = np.lexsort((-value, of))
                rank = np.arange(len(by)) - np.searchsorted(of, of[by], side="left")
                top = by[rank < most]
                out[at + of[top], column + rank[rank < most]] = value[top] + self.offset
        return out

    def worst(self, texts: list[str], n: int) -> list[list[tuple[str, float]]]:
        """The ``n`` highest-scored words or pairs of each text, cleaned, with their scores."""
        out: list[list[tuple[str, float]]] = [[] for _ in texts]
        for at, s, found in self._slices(texts):
            value = np.concatenate([found.words, found.pairs]) + self.offset
            first = np.concatenate([np.arange(len(s.size)), found.pair])
            end = np.concatenate([s.end, s.second[found.pair]])
            of = s.text_of[first]
            by = np.lexsort((-value, of))
            rank = np.arange(len(by)) - np.searchsorted(np.sort(of), of[by], side="left")
            for k in by[rank < n]:
                codes = s.codes[s.start[first[k]] + 1 : end[k]]
                if len(codes) <= 2 * LONGEST:
                    out[at + of[k]].append(("".join(_NAMES[codes]), float(value[k])))
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.calibration[:-1] + self.calibration[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _spread(strings: list[str], n: int, each: int = 4) -> list[str]:
    """The first strings, at most ``each`` that begin alike."""
    heads: dict[str, int] = {}
    out = []
    for w in strings:
        heads[w[:5]] = heads.get(w[:5], 0) + 1
        if heads[w[:5]] <= each:
            out.append(w)
    return out[:n]


def trained(instances: dict[str, tuple[float, float]], landmarks: list[str]) -> Machine:
    """A machine from strings (1 or -1, weight) seen through the landmarks, as one table over triples."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    strings = list(instances)
    y, weight = (np.array([instances[w][k] for w in strings]) for k in (0, 1))
    beta = _machine(kernel(strings, landmarks) @ whiten, y, weight)
    gamma = whiten @ beta[:-1]
    table = np.zeros(1 << 18)
    li, lw = triples(landmarks)
    for k in range(len(landmarks)):
        np.add.at(table, li[k], gamma[k] * lw[k])
    return Machine(table, float(beta[-1]))


def _instances(texts: list[str]) -> list[list[str]]:
    """The distinct words, and pairs of neighbouring words of a sentence, of each text, cleaned; long words aside."""
    s = Strings(texts)
    line = "".join(_NAMES[s.codes])
    out: list[set[str]] = [set() for _ in texts]
    short = np.append(s.size <= LONGEST, False)
    for i, (of, a, n, follows, end) in enumerate(zip(s.text_of.tolist(), s.start.tolist(), s.size.tolist(), s.follows.tolist(), s.second.tolist())):
        if short[i]:
            out[of].add(line[a + 1 : a + 1 + n])
            if follows and short[i + 1]:
                out[of].add(line[a + 1 : end])
    return [sorted(x) for x in out]


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most ``SAMPLE`` labelled documents of either label, chosen by a hash of their ids: id, toxic, text."""
    known = columns_only(labels, id_col, label_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    known = known.where("id IS NOT NULL AND toxic IN (0, 1)").where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label, n in SAMPLE.items():
        some = known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(n)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = columns_only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), whole(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "toxic", "text")  # at most the sum of SAMPLE rows are broadcast


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Machine:
    """A machine from labelled documents, whose texts stay in Spark.

    A sentence of a toxic document may be harmless, so labels reach strings by
    how they spread over documents. The first instances are words that mark
    toxic documents by their odds, and pairs of words that do without either,
    and the most frequent words and pairs of clean documents. Then the machine
    reads the sample's sentences, and the strings that look worst become
    instances by their document's label, round by round. What comes back is
    bounded: ``VOCABULARY`` counts of words, ``INSTANCES`` strings of each kind,
    ``WORST`` strings a document.
    """
    spark = docs.sparkSession
    sample = written(_sample(docs, labels, id_col, text_col, label_col).repartition(8, "id").withColumn("apart", F.xxhash64("id", F.lit(1)) % CALIBRATE == 0))
    # few labels are used for both
    if sample.where("apart").groupBy("toxic").count().where("count >= 10").count() < 2:
        taught, held = sample, sample
    else:
        taught, held = sample.where("NOT apart"), sample.where("apart")

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _instances(b.column(1).to_pylist())
            toxic = [t for t, ws in zip(b.column(0).to_pylist(), words) for _ in ws]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array([w for ws in words for w in ws], pa.string())], names=["toxic", "word"])

    size = {r["toxic"]: r["count"] for r in taught.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Machine.empty()
    counts = taught.select("toxic", "text").mapInArrow(vocabulary, "toxic int, word string").groupBy("word").agg(
        F.count_if(F.col("toxic") == 1).alias("k1"), F.count_if(F.col("toxic") == 0).alias("k0"))
    counts = written(counts)
    odds = F.log((F.col("k1") + 0.1) / (n1 + 0.2)) - F.log((F.col("k0") + 0.1) / (n0 + 0.2))
    chance = F.col("k0") / n0 * n1
    # favoured by toxic texts clearly more than by chance
    marks = (F.col("k1") >= max(3, SUPPORT * n1)) & (odds > ODDS) & (F.col("k1") - chance > 2.5 * F.sqrt(1 + chance))
    pair = F.contains("word", F.lit(" "))
    first = lambda rows: rows.orderBy(F.desc("k1"), "word").limit(INSTANCES).collect()
    good: dict[str, float] = {r["word"]: r["k1"] for r in first(counts.where(marks & ~pair))}
    good |= {r["word"]: r["k1"] for r in first(counts.where(marks & pair)) if not any(w in good for w in r["word"].split(" "))}
    if not good:
        return Machine.empty()
    instances = {w: (1.0, k**0.8) for w, k in sorted(good.items(), key=lambda x: (-x[1], x[0]))[:INSTANCES]}
    seen = counts.where(~pair).orderBy(F.desc(F.col("k1") + F.col("k0")), "word").limit(VOCABULARY).collect()
    clean = [r for r in seen if r["word"] not in good and r["k0"] > 0]
    common = counts.where(pair & ~marks & (F.col("k0") > 0)).orderBy(F.desc("k0"), "word").limit(INSTANCES // 2).collect()
    instances |= {r["word"]: (-1.0, r["k0"] ** 0.6) for r in [*clean[:INSTANCES], *common]}
    landmarks = [*_spread([w for w, (y, _) in instances.items() if y > 0], LANDMARKS), *[r["word"] for r in clean[: LANDMARKS // 4]]]
    machine = trained(instances, landmarks)
    for _ in range(MINING):
        shared = spark.sparkContext.broadcast((machine.table, machine.offset))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = Machine(*shared.value)
            for b in batches:
                found = now.worst(b.column(1).to_pylist(), WORST)
                rows = [(t, w, v) for t, ws in zip(b.column(0).to_pylist(), found) for w, v in ws]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.float64()))], names=["toxic", "string", "score"])

        mined = taught.select("toxic", "text").mapInArrow(look, "toxic int, string string, score double").groupBy("string").agg(
            F.count_if(F.col("toxic") == 1).alias("k1"), F.count_if(F.col("toxic") == 0).alias("k0"), F.max("score").alias("score"))
        fresh: dict[int, list[str]] = {1: [], 0: []}
        # the worst strings of clean documents are negatives, and those of toxic documents alone, where they look toxic, positives
        for r in mined.orderBy(F.desc("score"), "string").collect():
            if r["string"] in instances:
                continue
            twice = r["k1"] > 1 or any(w in good for w in r["string"].split(" "))  # or it holds a string that marks toxic documents
            label = 1 if not r["k0"] and r["score"] > 0 and twice else 0 if r["k0"] else None
            if label is not None and len(fresh[label]) < INSTANCES:
                fresh[label].append(r["string"])
                instances[r["string"]] = (1.0, r["k1"] ** 0.8) if label else (-1.0, r["k0"] ** 0.6)
        landmarks = list(dict.fromkeys([*landmarks, *_spread(fresh[0], LANDMARKS // 3), *_spread(fresh[1], LANDMARKS // 6)]))
        machine = trained(instances, landmarks)
        shared.unpersist()
    shared = spark.sparkContext.broadcast((machine.table, machine.offset))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Machine(*shared.value)
        for b in batches:
            f = now.features(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(f), pa.list_(pa.float64()))], names=["id", "toxic", "f"])

    id_type = held.schema["id"].dataType.simpleString()
    rows = held.select("id", "toxic", "text").mapInArrow(describe, f"id {id_type}, toxic int, f array<double>").orderBy("id").collect()
    machine.calibration = _logistic(np.array([r["f"] for r in rows]), np.array([float(r["toxic"]) for r in rows]))
    dropped(sample)
    dropped(counts)
    return machine


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """One row per input row: id, ``held_out``, ``score`` (0 to 1), ``predicted``.

    ``labels`` holds (id, label); rows that are held out, have no id or no
    label of 0 or 1 teach nothing. A document's score depends on its text
    alone: the worst words and pairs of words and the number of words,
    calibrated to the probability of label 1; ``predicted`` is 1 from
    ``THRESHOLD`` on. Whole texts are scored, in one pass over their
    characters. Null and empty texts have no word and get the score of the
    calibration there. Without labels of both kinds every score is near 0.
    Repeated rows give repeated results, an empty table an empty one; other
    columns are ignored.
    """
    machine = learn(docs, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast((machine.table, machine.offset, machine.calibration))
    rows = columns_only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), held_out(id_col).alias("held_out"), whole(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Machine(*shared.value)
        for b in batches:
            p = ready.probability(ready.features(b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())],
                names=["id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, f"id {id_type}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
