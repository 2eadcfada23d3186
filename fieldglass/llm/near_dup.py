"""Near duplicates: MinHash signatures joined coordinate by coordinate.

Each distinct shingle set has a signature of ``COORDS`` minima. Sets are posted
under their coordinate-value pairs; two sets whose signatures agree in at least
``MATCHES`` coordinates are compared in full. At a similarity of 0.75 a pair
agrees in 36 of 48 coordinates on average, with a deviation of 3, so that fewer
than 22 matches are about one case in 100,000; above 0.75 rarer still.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import by_rows, columns_only, dropped, one_of_each, whole_rows, written
from fieldglass.llm.graph import components
from fieldglass.llm.hashing import P, WordHashes, mix

WORDS = 5
COORDS = 48
MATCHES = 22
#: Sets of one list that a task compares with as many others.
BLOCK = 512
#: Members of one leader that a task compares with it, about.
STAR = 256
#: Rows of ids and places that may be broadcast (some 20 MB).
FEW = 300_000


class Shingler:
    """Hashes (64 bits) of the distinct word shingles of texts; each mixes its words' hashes in order."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self.hashes = WordHashes()

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; one for all words where there are fewer than a shingle has."""
        w = self.hashes.of(text)
        if not len(w):
            return w
        size = min(len(w), self.words)
        n = len(w) - size + 1
        h = np.full(n, size, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size):
                h = mix(h * P + w[j : j + n])
        return np.unique(h)


def multipliers(count: int) -> np.ndarray:
    """Odd multipliers, one for each coordinate of a signature."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, count + 1, dtype=np.uint64) * P) | np.uint64(1)


def signature(hashes: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """For each multiplier the least of the multiplied hashes, its upper 32 bits."""
    low = np.full(len(mult), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 512):
            np.minimum(low, (hashes[at : at + 512, None] * mult[None, :]).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketches(docs: DataFrame) -> DataFrame:
    """Of rows (id, text): set size, 128-bit name of the set, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, mult = Shingler(), multipliers(COORDS)
        for b in batches:
            n, name, sig = [], [], []
            for text in b.column(1):
                s = shingler.set_of(text.as_py())
                n.append(len(s))
                name.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s, mult).view(np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(sig, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "name", "sig"])

    return docs.mapInArrow(run, "id long, n long, name binary, sig array<int>")


def _shared_lists(reps: DataFrame) -> DataFrame:
    """Prefix postings (rep, key, size, mask): lists of two or more that can yield a match.

    A set's coordinates are ordered by how many sets share them. Two sets with
    ``MATCHES`` equal coordinates share one among the first COORDS - MATCHES + 1
    of either, so the longer lists are skipped; the full signatures are merged
    when a pair is looked at.
    """
    posts = reps.select("rep", F.posexplode("sig").alias("c", "v")).select(
        "rep", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("key")
    )
    count = posts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    count = by_rows(count, reps.count() * COORDS // 2)
    shared = posts.join(count, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("size", "key"))).alias("at"))
    free = F.lit(COORDS) - F.size("at")
    shared = shared.where(F.size("at") >= MATCHES).select(
        "rep", F.slice("at", 1, F.lit(COORDS - MATCHES + 1) - free).alias("at")
    )
    mask = F.aggregate("at", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x["key"], 32).cast("int"))))
    return shared.withColumn("mask", mask).select("rep", "mask", F.explode("at").alias("x")).select("rep", "mask", "x.key")


def _with_sets(docs: DataFrame, ask: DataFrame) -> DataFrame:
    """Rows (key, i, j, side, rep, root, mask) of ``ask`` with the full shingle set and signature of their document."""
    ask = F.broadcast(ask) if ask.count() <= FEW else ask.hint("merge")
    rows = docs.join(ask, docs["id"] == ask["rep"]).select(*PLACES, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, mult = Shingler(), multipliers(COORDS)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                p = b.slice(at, 200)
                last, sets, sigs = None, [], []
                for rep, text in zip(p.column("rep").to_pylist(), p.column("text")):
                    if rep != last:  # a document's rows follow each other
                        last, s = rep, shingler.set_of(text.as_py())
                        packed, sig = s.tobytes(), signature(s, mult).tobytes()
                    sets.append(packed)
                    sigs.append(sig)
                cols = [*p.columns[:-1], pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[*PLACES, "n", "sig", "hashes"])

    return rows.mapInArrow(run, f"{_PLACED}, n long, sig binary, hashes binary")


#: Where a set is compared: list or leader, two block numbers, side (0 left, 1 right, 2 both), and what is known of the set.
PLACES = ["key", "i", "j", "side", "rep", "root", "mask"]
_PLACED = "key long, i int, j int, side int, rep long, root long, mask long"


def _star_pairs(lists: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (rep, lead) of each list's leader and members whose signatures agree often enough."""
    leader = lists.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep")).alias("lead"))
    pairs = lists.join(by_rows(leader, lists.count()), "key").select("rep", F.col("lead.rep").alias("lead")).where("rep != lead").distinct()
    sig, n = reps.select("rep", "sig"), reps.count()
    rows = pairs.join(by_rows(sig, n), "rep").join(by_rows(sig.select(F.col("rep").alias("lead"), F.col("sig").alias("sig2")), n), "lead").select("rep", "lead", "sig", "sig2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = (b.column(k).flatten().to_numpy().reshape(-1, COORDS) for k in (2, 3))
            yield b.select([0, 1]).filter(pa.array((s == t).sum(axis=1) >= MATCHES))

    return rows.mapInArrow(run, "rep long, lead long")


def _star_links(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among pairs (rep, lead), confirmed on full sets.

    A leader's members are dealt out in blocks of some ``STAR``, to each of
    which the leader's set is copied.
    """
    size = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("blocks"))
    members = pairs.join(by_rows(size, pairs.count()), "lead").select("rep", "lead", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("i"))
    leads = size.select(F.col("lead").alias("rep"), "lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    ask = members.withColumn("side", F.lit(1)).unionByName(leads.withColumn("side", F.lit(0)))
    ask = written(ask.select(F.col("lead").alias("key"), "i", F.lit(0).alias("j"), "side", "rep", F.col("rep").alias("root"), F.lit(0).cast("long").alias("mask")))

    def compare(t: pa.Table) -> pa.Table:
        side, rep = t.column("side").to_numpy(), t.column("rep").to_numpy()
        sets = _sets_of(t)
        lead = np.flatnonzero(side == 0)[0]
        a = [int(rep[k]) for k in np.flatnonzero(side == 1) if alike(sets[k], sets[lead], percent)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array([int(rep[lead])] * len(a), pa.int64())})

    out = _with_sets(docs, ask).select("key", "i", "side", "rep", "hashes").groupBy("key", "i").applyInArrow(compare, "a long, b long")
    links = written(out)
    dropped(ask)
    return links


def _sets_of(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u8") for c in t.column("hashes").chunks for x in c]


class _Block:
    """The sets of one list that two blocks hold, and which pairs of them the signatures leave open."""

    def __init__(self, t: pa.Table, percent: int) -> None:
        self.percent, self.coord = percent, t.column("key")[0].as_py() >> 32
        side = t.column("side").to_numpy()
        self.root, self.n = t.column("root").to_numpy(), t.column("n").to_numpy()
        self.bits = (t.column("mask").to_numpy()[:, None] >> np.arange(COORDS)[None, :]) & 1 == 1
        sig = t.column("sig").combine_chunks()
        flat = sig.flatten().to_numpy() if pa.types.is_list(sig.type) else np.frombuffer(b"".join(x.as_py() for x in sig), dtype="<i4")
        self.sig = flat.reshape(-1, COORDS)
        self.same = bool((side == 2).any())  # a block with itself
        self.left = np.flatnonzero((side == 0) | (side == 2))
        self.right = np.flatnonzero(side == 1) if not self.same else self.left

    def open_pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each left set, the right ones that may be alike, aren't connected yet and meet first in this list."""
        sig, root, n, bits = self.sig, self.root, self.n, self.bits
        for i in self.left:
            others = self.right[self.right > i] if self.same else self.right
            eq = sig[others] == sig[i]
            ok = (eq.sum(axis=1) >= MATCHES) & (root[others] != root[i])
            ok &= 100 * np.minimum(n[others], n[i]) >= self.percent * np.maximum(n[others], n[i])
            # a pair belongs to the first list that both prefixes share
            ok &= (eq & bits[others] & bits[i]).argmax(axis=1) == self.coord
            if ok.any():
                yield int(i), others[ok]


def _open_rows(t: pa.Table, percent: int) -> pa.Table:
    """Rows of one block pair that have a partner by the signatures."""
    hit = np.zeros(t.num_rows, dtype=bool)
    for i, others in _Block(t, percent).open_pairs():
        hit[i] = True
        hit[others] = True
    return t.select(PLACES).filter(pa.array(hit))


def _compare_block(t: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links that join different roots among one block pair of one list."""
    block, sets, rep = _Block(t, percent), _sets_of(t), t.column("rep").to_numpy()
    up = {r: r for r in block.root.tolist()}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, others in block.open_pairs():
        for j in others:
            x, y = top(int(block.root[i])), top(int(block.root[j]))
            if x != y and alike(sets[i], sets[j], percent):
                up[max(x, y)] = min(x, y)
                out.append((int(rep[i]), int(rep[j])))
    return out


def _other_links(docs: DataFrame, lists: DataFrame, roots: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links between sets of one list that are not yet connected.

    In each list the sets outside its largest component (the minor ones) are
    compared with each other and with the rest, block by block: first by
    signatures, then, for sets that have a partner left, in full. Lists that
    are one component cost nothing further, and a large group that is mostly
    connected costs minor sets times group size, in tasks of bounded size.
    """
    rows = written(lists.join(by_rows(roots), "rep", "left").select("rep", "mask", "key", F.coalesce("root", "rep").alias("root")))
    per = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
    major = per.groupBy("key").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("size"))
    major = major.where("m.k < size").select("key", F.col("m.root").alias("major"), F.col("m.k").alias("k"), "size")
    open_ = rows.join(by_rows(major, rows.count()), "key")
    minors, majors = F.ceil((F.col("size") - F.col("k")) / BLOCK), F.ceil(F.col("k") / BLOCK)
    open_ = open_.select("rep", "mask", "key", "root", (F.col("root") != F.col("major")).alias("minor"), minors.cast("int").alias("nm"), majors.cast("int").alias("nj"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("minor"), F.col("nm")).otherwise(F.col("nj"))).cast("int")
    struct = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    # a minor block meets minor blocks (numbered from 0) and major ones (numbered behind them)
    minor_tiles = F.concat(
        F.array(struct(F.col("own"), F.col("own"), 2)),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("nm") - 1), lambda j: j < F.col("own")), lambda j: struct(j, F.col("own"), 1)),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("nm") - 1), lambda j: j > F.col("own")), lambda j: struct(F.col("own"), j, 0)),
        F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda j: struct(F.col("own"), j + F.col("nm"), 0)),
    )
    major_tiles = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda i: struct(i, F.col("own") + F.col("nm"), 1))
    tiles = open_.withColumn("own", own).join(by_rows(reps.select("rep", "n", "sig"), reps.count()), "rep")
    tiles = tiles.select("rep", "mask", "key", "root", "n", "sig", F.explode(F.when(F.col("minor"), minor_tiles).otherwise(major_tiles)).alias("t"))
    tiles = tiles.select("key", "t.*", "rep", "root", "mask", "n", "sig")
    # tiles are small in bytes and heavy to compare: as many tasks as there are partitions, not fewer
    tiles = tiles.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "i", "j")
    left = written(tiles.groupBy("key", "i", "j").applyInArrow(lambda t: _open_rows(t, percent), _PLACED))
    dropped(rows)

    def compare(t: pa.Table) -> pa.Table:
        found = _compare_block(t, percent)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    links = written(_with_sets(docs, left).groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"))
    dropped(left)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked where 100 * intersection >= ``percent`` * union of
    their distinct five-word shingles (A-Z lower-cased, words separated by
    ASCII white space; fewer words are one shingle). ``component_id`` is the
    smallest id that links reach.

    Equal sets are one class from the start, however many documents hold them.
    Class representatives are posted under their coordinates; each list's
    leader is compared with the members first, then all pairs of a list that
    are not connected yet, in bounded blocks. Signatures are compared before
    full sets are made, and every link is confirmed on full sets. No list is
    capped.

    Texts that are null or hold no word have no shingles and stand alone. Rows
    whose id is null are returned with a null component and aren't kept.
    Repeated rows are documents with equal sets: each is returned, all with
    the same decision. An empty table gives an empty result. Other columns are
    ignored; ids are whole numbers.
    """
    base = columns_only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketch = written(_sketches(base))
    some = sketch.where("n > 0 AND id IS NOT NULL")
    reps = written(some.groupBy("name").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    lists = written(_shared_lists(reps.select("rep", "sig")))
    pairs = written(_star_pairs(lists, reps))
    star = _star_links(base, pairs, percent)
    dropped(pairs)
    roots = components(star)
    rest = _other_links(base, lists, roots, reps, percent)
    dropped(lists)
    dropped(roots)
    roots = components(star.unionByName(rest))
    dropped(star)
    dropped(rest)
    told = reps.select("name", "rep").join(by_rows(roots), "rep", "left").select("name", F.coalesce("root", "rep").alias("component"))
    hit = some.select("id", "n", "name").join(by_rows(told, reps.count()), "name").select("id", "n", "component")
    rest = sketch.where("NOT (n > 0 AND id IS NOT NULL)").select("id", "n", F.col("id").alias("component"))
    return hit.unionByName(rest).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates, with all its columns.

    Texts that are null or hold no word stay: they are linked with nothing.
    Documents with a null id stay too, as nothing can be said of them. A
    document that repeats with the same id and text stays once; different
    texts under one id stay or go together. An empty table gives an empty one.
    Columns may have any names.
    """
    keep = near_duplicates(docs, id_col, text_col).where("kept").groupBy(F.col(f"`{id_col}`").alias("keep")).agg(F.count(F.lit(1)).alias("copies"))
    rows = whole_rows(docs).withColumns({"id": F.col("doc").getField(id_col).cast("long"), "text": F.col("doc").getField(text_col)})
    found = one_of_each(rows, written(keep), F.col("id") == F.col("keep"), "id", "text")
    return found.unionByName(rows.where("id IS NULL").select("doc.*"))
