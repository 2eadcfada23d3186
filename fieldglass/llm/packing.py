"""Documents packed into sequences by order-preserving dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import columns_only, whole
from fieldglass.llm.word_codec import WordCodec

SIZE = 4096
END = 2
#: What a cut costs, in tokens of padding: at the end of a sentence, and inside one.
SENTENCE_CUT = 16
INNER_CUT = 256
#: A stretch of so many tokens without a boundary may be cut inside, at every so many-th token.
GAP = 512
STEP = 16
#: Windows that are decided together, and of those the last ones that wait for the tokens that follow.
DECIDED = 64
WAITING = 8


def padding(length: int, size: int = SIZE) -> int:
    """Tokens that are added to a sequence: none at a power of two."""
    return 0 if length & (length - 1) == 0 else size - length


def best_cuts(place: np.ndarray, cost: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The boundaries at which windows of at most ``size`` tokens end, so that padding and the cuts' costs are least.

    ``place`` holds the tokens before each boundary, ascending from 0 (the
    start, no cut) to the end; no two are further apart than ``size``. A
    window that is padded to ``size`` costs ``size`` less its length: with the
    start's cost plus its place as the value, the best start is the least
    value within ``size`` tokens, which a queue of rising values gives. Windows
    of a power of two aren't padded; they are asked one by one. On ties the
    longest padded window wins.
    """
    at, due = place.tolist(), cost.tolist()
    n = len(at)
    exact: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range((size - 1).bit_length() + 1):
        if 1 << k <= size:
            start = np.searchsorted(place, place - (1 << k))
            hit = np.flatnonzero(place[start] == place - (1 << k))
            exact.append((hit, start[hit]))
    to, from_ = (np.concatenate(x) for x in zip(*exact))
    by = np.argsort(to, kind="stable")
    to, from_ = to[by], from_[by].tolist()
    first = np.searchsorted(to, np.arange(n + 1)).tolist()
    total, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque()  # value, boundary
    for j in range(1, n):
        value = total[j - 1] + at[j - 1]
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j - 1))
        least = at[j] - size
        while at[queue[0][1]] < least:
            queue.popleft()
        found, i = queue[0]
        found += size - at[j]
        for x in from_[first[j] : first[j + 1]]:
            if total[x] < found:
                found, i = total[x], x
        total[j], back[j] = found + due[j], i
    cuts = [n - 1] if n > 1 else []
    while cuts and back[cuts[-1]]:
        cuts.append(back[cuts[-1]])
    return place[np.array(cuts[::-1], np.int64)]


class Packer:
    """Windows over documents in the order in which they come, and the documents' pieces in them."""

    def __init__(self, size: int, end_id: int, sentence_cut: int, inner_cut: int) -> None:
        self.size, self.end_id, self.costs = size, end_id, (sentence_cut, inner_cut)
        self.windows = 0
        self.ids: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int, int]] = []  # id, where its held ids begin, ids gone before, all ids
        self.held = 0

    def add(self, doc_id: object, ids: np.ndarray, sentences: np.ndarray) -> None:
        n = len(ids) + 1
        self.docs.append((doc_id, self.held, 0, n))
        self.ids.append(np.append(ids, np.uint32(self.end_id)).astype(np.uint32))
        cuts = sentences[(sentences > 0) & (sentences < n - 1)]
        cuts = cuts[np.diff(cuts, prepend=0) > 0]
        edge = np.concatenate([[0], cuts, [n]])
        gap, step = min(GAP, self.size), min(STEP, self.size)
        inner = [np.arange(a + step, b, step) for a, b in zip(edge[:-1], edge[1:]) if b - a > gap] if (np.diff(edge) > gap).any() else []
        free = np.concatenate([np.zeros(0, np.int64), *inner])
        place = np.concatenate([cuts, free, [n]]).astype(np.int64)
        cost = np.concatenate([np.full(len(cuts), self.costs[0]), np.full(len(free), self.costs[1]), [0]]).astype(np.int64)
        by = np.argsort(place, kind="stable")
        self.place.append(place[by] + self.held)
        self.cost.append(cost[by])
        self.held += n

    def take(self, all_: bool) -> list[tuple]:
        """Pieces of the windows that are decided (doc_id, start, length, crc, all ids, window, offset); all windows at the end."""
        if not self.held or not all_ and self.held < DECIDED * self.size:
            return []
        ids, place = np.concatenate(self.ids), np.concatenate([[0], *self.place])
        cost = np.concatenate([[0], *self.cost])
        ends = best_cuts(place, cost, self.size)
        if not all_:
            ends = ends[ends <= self.held - WAITING * self.size]
        edge = np.concatenate([[0], ends])
        begin = np.array([d[1] for d in self.docs], np.int64)
        cut = np.union1d(edge, begin[begin < edge[-1]])
        window = np.searchsorted(edge, cut[:-1], "right") - 1
        doc = np.searchsorted(begin, cut[:-1], "right") - 1
        out = []
        for a, b, w, d in zip(cut[:-1].tolist(), cut[1:].tolist(), window.tolist(), doc.tolist()):
            doc_id, at, gone, all_ids = self.docs[d]
            out.append((doc_id, a - at + gone, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), all_ids, self.windows + w, a - int(edge[w])))
        self.windows += len(ends)
        done = int(edge[-1])
        keep = place > done
        self.ids, self.place, self.cost = [ids[done:]], [place[keep] - done], [cost[keep]]
        last = int(np.searchsorted(begin, done, "right")) - 1
        self.docs = [(i, max(at - done, 0), gone + max(done - at, 0), n) for i, at, gone, n in self.docs[last:]] if done < self.held else []
        self.held -= done
        return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    end_id: int = END,
    sentence_cut: int = SENTENCE_CUT,
    inner_cut: int = INNER_CUT,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its tokenizer's ids and ``end_id``. Documents follow each
    other in the order of the table's partitions and rows; sequences end at
    documents' ends, at sentences' ends for ``sentence_cut`` or, where there is
    no boundary for GAP tokens, inside for ``inner_cut``, so that padding and
    these costs together are least. Every task packs the rows that it reads:
    nothing is shuffled, and a task that is lost packs the same rows again. It
    holds some DECIDED windows and its longest document at a time, and the
    windows of a stretch but the last few are decided when it is full. A sequence's
    number is the task's, times 2^33, and its own.

    A null text is empty and a piece of one id, like an empty one; a null id
    is kept. Repeated rows are documents each. An empty table gives no row.
    Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, packer = WordCodec.of(tokenizer), Packer(size, end_id, sentence_cut, inner_cut)
        base = TaskContext.get().partitionId() << 33
        schema = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

        def rows(found: list[tuple], of: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*found))
            columns[5] = [base + w for w in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], of), *(pa.array(c, f.type) for c, f in zip(columns[1:], schema))], names=["id", *schema.names])

        of = pa.int64()
        for b in batches:
            of = b.column(0).type
            for i, (ids, sentences) in zip(b.column(0).to_pylist(), codec.documents(b.column(1).to_pylist())):
                packer.add(i, ids, sentences)
                if found := packer.take(False):
                    yield rows(found, of)
        if found := packer.take(True):
            yield rows(found, of)

    rows = columns_only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), whole(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
