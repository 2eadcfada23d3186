"""Language-model scores: stupid backoff over hash-partitioned n-gram counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import columns_only, whole, written
from fieldglass.llm.hashing import WordHashes

ORDER = 3
#: N-grams of two and more words that occur less often count as unseen; 1 keeps all counts.
LEAST = 1
BACKOFF = 0.4
#: Characters of the documents that are asked for together, and tokens of one part of the counts.
BLOCK_CHARS = 6_000_000
PART_TOKENS = 4_000_000
#: Bits of a word's number: two fit one key.
ID_BITS = np.uint64(32)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 3)


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(planes), dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _steps(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _planes(np.diff(sorted_keys, prepend=np.uint64(0)))


def _keys(steps: bytes) -> np.ndarray:
    return np.cumsum(_numbers(steps), dtype=np.uint64)


def _part(first: np.ndarray, last: np.ndarray, parts: int) -> np.ndarray:
    """The part that counts a key."""
    with np.errstate(over="ignore"):
        h = (first ^ (last * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(parts)).astype(np.int64)


def _split(first: np.ndarray, last: np.ndarray, n: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """By part: places of a block's distinct keys (sorted by first, then last)."""
    part = _part(first, last, parts)
    by = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            yield p, by[cuts[p] : cuts[p + 1]]


_ASKED = "block long, part int, first binary, last binary, n binary"
_ANSWERED = "block long, part int, n binary, number binary"


def _asked(block: int, first: np.ndarray, last: np.ndarray, n: np.ndarray, parts: int) -> pa.Table:
    rows = [(p, _steps(first[at]), _planes(last[at]), _planes(n[at])) for p, at in _split(first, last, n, parts)]
    return pa.table({
        "block": pa.array([block] * len(rows), pa.int64()), "part": pa.array([r[0] for r in rows], pa.int32()),
        **{name: pa.array([r[i] for r in rows], pa.binary()) for i, name in ((1, "first"), (2, "last"), (3, "n"))},
    })


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents, a row each: (block, n_tokens, ids, sizes, words, tokens).

    ``words`` are the sorted 64-bit hashes of the block's distinct words, and
    ``tokens`` the place of each token's word among them; sizes are tokens.
    """
    names = ["block", "n_tokens", "ids", "sizes", "words", "tokens"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def row(ids: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
        name = xxhash.xxh3_64_intdigest(f"{ids[0]} {ids[-1]} {len(ids)} {uuid.uuid4()}".encode()) >> 1
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        tokens = np.ascontiguousarray(place.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        values = [name, len(place), ids, [len(h) for h in hashes], _steps(distinct), zstandard.compress(tokens, 3)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        hashes: list[np.ndarray] = []
        room = BLOCK_CHARS
        words = WordHashes()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                ids.append(i)
                hashes.append(words.of_bytes(raw))
                room -= len(raw)
                if room <= 0:
                    yield row(ids, hashes)
                    ids, hashes, room = [], [], BLOCK_CHARS
        if ids:
            yield row(ids, hashes)

    return docs.mapInArrow(run, "block long, n_tokens long, ids array<long>, sizes array<long>, words binary, tokens binary")


def _count_part(t: pa.Table, parts: int, numbered: bool) -> pa.Table:
    """Sums the blocks' counts of one part and answers each block; words also get numbers of their own."""
    first = [_keys(x.as_py()) for x in t.column("first")]
    lengths = [len(k) for k in first]
    n = np.concatenate([_numbers(x.as_py()) for x in t.column("n")])
    heads, key = np.unique(np.concatenate(first), return_inverse=True)
    if not numbered:
        last = np.concatenate([_numbers(x.as_py()) for x in t.column("last")])
        heads, key = np.unique((key.astype(np.uint64) << ID_BITS) | last, return_inverse=True)
    counts = np.bincount(key, weights=n, minlength=len(heads)).astype(np.int64)[key]
    number = key * parts + t.column("part")[0].as_py() if numbered else None
    if numbered and number.max(initial=0) >> int(ID_BITS):
        raise ValueError("words outnumber their 32-bit numbers")
    cuts = np.cumsum([0, *lengths])
    return pa.table({
        "block": t.column("block"), "part": t.column("part"),
        "n": pa.array([_planes(counts[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
        "number": pa.array([_planes(number[a:b]) if numbered else b"" for a, b in zip(cuts, cuts[1:])], pa.binary()),
    })


def _answer(first: np.ndarray, last: np.ndarray, parts: int, answers: pa.Table, column: str = "n") -> np.ndarray:
    """What the parts said of each key."""
    said = dict(zip(answers.column("part").to_pylist(), answers.column(column).to_pylist()))
    out = np.zeros(len(first), np.uint64)
    for p, at in _split(first, last, first, parts):
        out[at] = _numbers(said[p])
    return out.astype(np.int64)


class _Block:
    """The tokens of one block and the counts of its n-grams, as far as they have been answered.

    An n-gram that holds a word or shorter n-gram that occurs once occurs
    once itself, so it is known without asking.
    """

    def __init__(self, row: pa.Table, parts: int) -> None:
        self.name, self.ids, self.parts = row.column("block")[0].as_py(), row.column("ids")[0].as_py(), parts
        self.sizes = np.array(row.column("sizes")[0].as_py(), dtype=np.int64)
        self.words = _keys(row.column("words")[0].as_py())
        raw = np.frombuffer(zstandard.decompress(row.column("tokens")[0].as_py()), dtype=np.uint8).reshape(4, -1)
        self.tokens = np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.none = np.zeros(len(self.words), np.uint64)

    def ask1(self) -> pa.Table:
        return _asked(self.name, self.words, self.none, np.bincount(self.tokens, minlength=len(self.words)), self.parts)

    def told1(self, answers: pa.Table) -> None:
        self.c1 = _answer(self.words, self.none, self.parts, answers)[self.tokens]
        self.number = _answer(self.words, self.none, self.parts, answers, "number").astype(np.uint64)[self.tokens]
        self.in2 = self.doc[:-1] == self.doc[1:]
        self.open2 = self.in2 & (self.c1[:-1] > 1) & (self.c1[1:] > 1)
        pairs = ((self.number[:-1] << ID_BITS) | self.number[1:])[self.open2]
        self.pairs, self.place2, self.n2 = np.unique(pairs, return_inverse=True, return_counts=True)

    def ask2(self) -> pa.Table:
        return _asked(self.name, self.pairs, np.zeros(len(self.pairs), np.uint64), self.n2, self.parts)

    def told2(self, answers: pa.Table) -> None:
        self.c2 = self.in2.astype(np.int64)
        self.c2[self.open2] = _answer(self.pairs, np.zeros(len(self.pairs), np.uint64), self.parts, answers)[self.place2]
        self.in3 = self.in2[:-1] & self.in2[1:]
        self.open3 = self.in3 & (self.c2[:-1] > 1) & (self.c2[1:] > 1)
        place = np.zeros(len(self.in2), np.uint64)
        place[self.open2] = self.place2.astype(np.uint64)
        long = ((place[:-1] << ID_BITS) | self.number[2:])[self.open3]
        long, self.place3, self.n3 = np.unique(long, return_inverse=True, return_counts=True)
        self.heads, self.tails = self.pairs[(long >> ID_BITS).astype(np.int64)], long & np.uint64(0xFFFFFFFF)

    def ask3(self) -> pa.Table:
        return _asked(self.name, self.heads, self.tails, self.n3, self.parts)

    def told3(self, answers: pa.Table) -> None:
        self.c3 = self.in3.astype(np.int64)
        self.c3[self.open3] = _answer(self.heads, self.tails, self.parts, answers)[self.place3]

    def scores(self, total: int, least: int) -> np.ndarray:
        """Each document's sum of logarithms."""
        step = float(np.log(BACKOFF))
        at = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        # words near the beginning have shorter histories and aren't backed off for that
        history = np.minimum(at, ORDER - 1)
        log = np.log(self.c1 / total) + step * history
        shorter = self.c1
        for o, c in ((2, self.c2), (3, self.c3)):
            c = np.where(c >= least, c, 0)
            seen = np.flatnonzero(c)
            log[seen + o - 1] = np.log(c[seen] / shorter[seen]) + step * (history[seen + o - 1] - (o - 1))
            shorter = c
        return np.bincount(self.doc, weights=log, minlength=len(self.sizes))


def _told(row: pa.Table, answers: pa.Table, parts: int, upto: int) -> _Block:
    """A block with the answers for n-grams up to a length."""
    block = _Block(row, parts)
    for order, tell in enumerate((block.told1, block.told2, block.told3)[:upto], 1):
        tell(answers.filter(pc.equal(answers.column("ord"), order)))
    return block


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``log_score``, ``mean_log_score``.

    Words are what ASCII white space separates, with A-Z lower-cased. Counts
    of 1- to 3-grams cover all documents, and none is dropped unless ``least``
    asks for that: longer n-grams that occur less often are then unseen. A word's score is the share of its longest
    seen n-gram in that n-gram's context, times 0.4 for each word of history
    given up; the document's is the sum of logarithms.

    Documents are read in blocks. Each block asks for its distinct words by
    64-bit hash; the tables of counts are partitioned by hash, so that one
    part sums the blocks' numbers and answers them, and gives each word a
    number of its own. Then blocks ask for 2-grams by their words' numbers,
    and for 3-grams by 2-gram and word, so that different n-grams never share
    a count. N-grams that hold a rarer one that occurs once aren't asked for,
    as they occur once too. A frequent n-gram is one number for a block,
    however often it occurs.

    Null and empty texts have no token and score 0 (mean null). Repeated rows
    are counted and returned each. An empty table gives an empty result. Other
    columns are ignored; ids are whole numbers and may be null.
    """
    base = columns_only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole(text_col).alias("text"))
    blocks = written(_blocks(base))
    total = int(blocks.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0)
    parts = max(1, -(-total // PART_TOKENS))

    def ask1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from _Block(pa.Table.from_batches([b.slice(i, 1)]), parts).ask1().to_batches()

    def ask2(a: pa.Table, answers: pa.Table) -> pa.Table:
        return _told(a, answers, parts, 1).ask2()

    def ask3(a: pa.Table, answers: pa.Table) -> pa.Table:
        return _told(a, answers, parts, 2).ask3()

    def score(a: pa.Table, answers: pa.Table) -> pa.Table:
        block = _told(a, answers, parts, ORDER)
        found = block.scores(total, least)
        return pa.table({"id": pa.array(block.ids, pa.int64()), "n_tokens": pa.array(block.sizes, pa.int64()), "log_score": pa.array(found, pa.float64())})

    def counted(asked: DataFrame, order: int) -> DataFrame:
        return asked.groupBy("part").applyInArrow(lambda t: _count_part(t, parts, order == 1), _ANSWERED).withColumn("ord", F.lit(order))

    def told(answers: DataFrame, what: Callable, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(what, schema)

    one = written(counted(blocks.mapInArrow(ask1, _ASKED), 1))
    two = one.unionByName(written(counted(told(one, ask2, _ASKED), 2)))
    three = two.unionByName(counted(told(two, ask3, _ASKED), 3))
    out = told(three, score, "id long, n_tokens long, log_score double")
    return out.select(
        F.col("id").alias(id_col), "n_tokens", F.round("log_score", 3).alias("log_score"),
        F.round(F.col("log_score") / F.nullif(F.col("n_tokens"), F.lit(0)), 6).alias("mean_log_score"),
    )
