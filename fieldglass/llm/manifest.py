"""A Merkle manifest of a dataset: mountain ranges of indexed partitions, merged into trees, with every leaf's proof."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import dropped, whole_rows, written

#: Consecutive nodes that become one.
FANOUT = 2
#: Leaves of an indexed partition.
LEAVES = 1 << 16
#: Leaves below which a further partition doesn't pay.
LEAST_LEAVES = 1 << 9
#: Partitions whose open nodes one merging group takes.
MERGED = 32
#: Bytes of a digest as hex text.
HEX = 64


def sealed(*parts: bytes) -> bytes:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def sealed_fields(*fields: Column) -> Column:
    """The same digest of a row's fields: ``-`` for null, else the bytes in UTF-8, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told), 256)


class MountainRange:
    """The completed nodes over consecutive nodes of one tree, as a stack that carries in base ``fanout``.

    A node is (level, index); one of level k covers fanout ** k leaves. Nodes
    are pushed from left to right, of any levels, as long as they follow each
    other. Whenever the top of the stack holds a whole aligned run (or, at the
    tree's right edge, the run that is shorter because the leaves end), it is
    carried: replaced by the digest of its members, which is recorded with
    their places. What is left at the end are the peaks: nodes whose run began
    before the first node that was pushed or goes on behind the last.
    """

    def __init__(self, leaves: int, fanout: int) -> None:
        self.fanout, self.sizes = fanout, [leaves]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // fanout))
        self.stack: list[tuple[int, int, bytes]] = []
        self.parent: dict[tuple[int, int], list[bytes]] = {}  # a completed node's members

    def push(self, level: int, index: int, digest: bytes) -> None:
        self.stack.append((level, index, digest))
        while True:
            level, index, _ = self.stack[-1]
            if level + 1 >= len(self.sizes) or (index % self.fanout != self.fanout - 1 and index != self.sizes[level] - 1):
                return
            n = index % self.fanout + 1
            run = self.stack[-n:]
            if len(run) < n or any(x[:2] != (level, index - n + 1 + i) for i, x in enumerate(run)):
                return
            members = [x[2] for x in run]
            del self.stack[-n:]
            self.parent[level + 1, index // self.fanout] = members
            self.stack.append((level + 1, index // self.fanout, sealed(*members)))

    def climb(self, level: int, index: int) -> tuple[int, int, list[tuple[int, bytes, bytes]]]:
        """The peak above a node, and on the way there the siblings left and right of each step."""
        steps: list[tuple[int, bytes, bytes]] = []
        while (members := self.parent.get((level + 1, index // self.fanout))) is not None:
            own = index % self.fanout
            steps.append((own, b"".join(members[:own]), b"".join(members[own + 1 :])))
            level, index = level + 1, index // self.fanout
        return level, index, steps


def packed(steps: list[tuple[int, bytes, bytes]]) -> bytes:
    """Siblings of each step: how many stand left and right (two bytes each), then their digests."""
    return b"".join((len(left) // HEX).to_bytes(2, "big") + (len(right) // HEX).to_bytes(2, "big") + left + right for _, left, right in steps)


def unpacked(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(path):
        left, right = int.from_bytes(path[at : at + 2], "big") * HEX, int.from_bytes(path[at + 2 : at + 4], "big") * HEX
        at += 4
        yield path[at : at + left], path[at + left : at + left + right]
        at += left + right


def _ordered(t: pa.Table, *by: str) -> pa.Table:
    return t.sort_by([(c, "ascending") for c in by])


def _ranges(t: pa.Table, fanout: int) -> Iterator[tuple[pa.Table, MountainRange]]:
    """The nodes of each tree in ``t`` (tree, first, level, index, leaves, digest) from left to right, and their range."""
    t = _ordered(t, "tree", "first")
    tree = t.column("tree").to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1], [True]])) if len(tree) else np.zeros(1, int)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        nodes = t.slice(a, b - a)
        range_ = MountainRange(nodes.column("leaves")[0].as_py(), fanout)
        for level, index, digest in zip(*(nodes.column(c).to_pylist() for c in ("level", "index", "digest"))):
            range_.push(level, index, digest.encode())
        yield nodes, range_


_NODE = pa.schema([("tree", pa.int64()), ("first", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("leaves", pa.int64()), ("digest", pa.string())])
_NODE_SQL = "tree long, first long, level int, index long, leaves long, digest string"


def _peaks(t: pa.Table, fanout: int) -> pa.Table:
    rows = []
    for nodes, range_ in _ranges(t, fanout):
        tree, leaves = nodes.column("tree")[0].as_py(), nodes.column("leaves")[0].as_py()
        rows += [(tree, index * fanout**level, level, index, leaves, digest.decode()) for level, index, digest in range_.stack]
    return pa.Table.from_pylist([dict(zip(_NODE.names, r)) for r in rows], schema=_NODE)


def _merged(t: pa.Table, fanout: int) -> pa.Table:
    """For each node of a group its peak with the siblings on the way: tree, level, index, up (a node), path."""
    rows = []
    for nodes, range_ in _ranges(t, fanout):
        peak = {x[:2]: x[2].decode() for x in range_.stack}
        for tree, level, index, leaves in zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "index", "leaves"))):
            up, at, steps = range_.climb(level, index)
            rows.append({"tree": tree, "level": level, "index": index, "leaves": leaves, "up_level": up, "up_index": at, "up_first": at * fanout**up, "up_digest": peak[up, at], "path": packed(steps)})
    schema = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("leaves", pa.int64()), ("up_level", pa.int32()), ("up_index", pa.int64()), ("up_first", pa.int64()), ("up_digest", pa.string()), ("path", pa.binary())])
    return pa.Table.from_pylist(rows, schema=schema)


_UP_SQL = "tree long, level int, index long, leaves long, up_level int, up_index long, up_first long, up_digest string, path binary"


def _paths(nodes: DataFrame, span: int, height: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """For open nodes that tile their trees: each one's path to its root (tree, level, index, path), and the roots (tree, leaves, digest).

    Rounds: nodes meet in groups of an aligned stretch of ``span`` leaves, which
    covers the open nodes of MERGED partitions, then in stretches MERGED times as
    long, until a stretch is a whole tree. Each round's peaks are the next one's
    nodes; paths are joined back from the last round to the first.
    """
    rounds: list[DataFrame] = []
    here = nodes
    power = lambda least: next(fanout**k for k in range(64) if fanout**k >= least)
    span = power(span)
    while True:
        span *= power(MERGED)
        group = F.floor(F.col("first") / F.lit(span)).cast("long").alias("group")
        met = here.select("*", group).groupBy("tree", "group").applyInArrow(lambda t: _merged(t.drop_columns(["group"]), fanout), _UP_SQL)
        rounds.append(written(met))
        here = rounds[-1].groupBy("tree", F.col("up_level").alias("level"), F.col("up_index").alias("index")).agg(
            F.first("up_first").alias("first"), F.first("leaves").alias("leaves"), F.first("up_digest").alias("digest")).select(*_NODE.names)
        if span >= height:
            break
    roots = here.select("tree", "leaves", "digest")
    path = rounds[-1].select("tree", "level", "index", "path")
    for below in reversed(rounds[:-1]):
        above = path.select("tree", F.col("level").alias("up_level"), F.col("index").alias("up_index"), F.col("path").alias("rest"))
        path = below.join(above, ["tree", "up_level", "up_index"]).select("tree", "level", "index", F.concat("path", "rest").alias("path"))
    return path, roots


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    fields: tuple[str, ...] = ("source", "lang", "n_chars", "text"),
    tree_col: str = "lang",
    tampered_col: str = "n_chars",
    fanout: int = FANOUT,
    leaves: int = LEAVES,
) -> DataFrame:
    """Every row's leaf and proof: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the id and ``fields``. The rows of each value of
    ``tree_col`` (null is one) are the leaves of a tree, ordered by id; every
    ``fanout`` consecutive nodes become one, the last run of a level as it is,
    however short. The trees' roots, ordered by that value (null first, then by
    bytes), are the leaves of a last tree. ``proof_sha256`` is the digest of a
    leaf's siblings on the way to the root. Rows whose id has a CRC-32 that 7
    divides are tampered with (1 is added to ``tampered_col``); ``folded_root`` is what
    their leaf and the original siblings give, ``verified`` whether that is
    ``root``.

    Texts are read once and become digests. Those are dealt out by ranges of
    tree and id, and written; each indexed partition builds its mountain range,
    and only the open nodes at its two ends go on, to be merged by aligned
    stretches in rounds. Each partition then meets the paths of its own open
    nodes and proves its leaves. No group holds more than a partition, or the
    open nodes of MERGED partitions or trees.

    Null ids come first and have ``-`` in their leaf; they aren't tampered
    with. Rows with equal ids are ordered by their leaf, and repeated rows
    are leaves each. A null in ``tampered_col`` stays null, and a number that can't grow becomes null. An empty table gives no row. Other
    columns are ignored.
    """
    row = lambda c: F.col("doc").getField(c)
    all_fields = lambda extra: sealed_fields(row(id_col), *[F.try_add(row(f), F.lit(extra)) if extra and f == tampered_col else row(f) for f in fields])
    hit = F.coalesce(F.crc32(row(id_col).cast("string")) % 7 == 0, F.lit(False))
    base = whole_rows(docs).select(
        row(id_col).alias("id"), row(tree_col).cast("string").alias("name"), all_fields(0).alias("leaf"), F.when(hit, all_fields(1)).alias("tampered"))
    base = written(base)
    total = base.count()
    spread = 3 * docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-total // leaves), min(spread, total // LEAST_LEAVES))
    order = [F.col("name").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    dealt = base.withColumn("row", F.monotonically_increasing_id())  # keeps repeated rows apart
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    indexed = written(dealt.select("id", "name", "leaf", "tampered", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")))
    dropped(base)

    # where each tree's rows of a partition begin among the tree's leaves
    pieces = indexed.groupBy("name", "part").agg(F.min("at").alias("at0"), F.count(F.lit(1)).alias("n"))
    by_name = Window.partitionBy("name")
    pieces = pieces.select(
        F.col("name").alias("_name"), F.col("part").alias("_part"), "at0",
        (F.sum("n").over(by_name.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(by_name).alias("leaves"))
    pieces = written(pieces)
    names = _trees(pieces.select(F.col("_name").alias("name"), "leaves").distinct())
    numbered = written(
        pieces.join(names, F.col("_name").eqNullSafe(F.col("name"))).select("_name", "_part", "at0", "before", "leaves", "tree"))
    here = (F.col("name").eqNullSafe(F.col("_name"))) & (F.col("part") == F.col("_part"))
    nodes = indexed.join(numbered, here).select(
        "part", "id", "tampered", "tree", (F.col("at") - F.col("at0") + F.col("before")).alias("first"), F.lit(0).alias("level"),
        (F.col("at") - F.col("at0") + F.col("before")).alias("index"), "leaves", F.col("leaf").alias("digest"))
    nodes = written(nodes)
    for used in (indexed, pieces):
        dropped(used)

    mine = [F.col(c) for c in ("part", *_NODE.names)]
    open_ = nodes.select(*mine).groupBy("part").applyInArrow(
        lambda key, t: _with(_peaks(t.drop_columns(["part"]), fanout), key[0]), f"{_NODE_SQL}, part long")
    open_ = written(open_)
    tallest, used_parts = numbered.agg(F.max("leaves"), F.countDistinct("_part")).first()
    path, roots = _paths(open_.drop("part"), max(1, total // max(1, used_parts)), tallest or 1, fanout)
    roots = written(roots)
    top = _paths(
        roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("first"), F.lit(0).alias("level"), F.col("tree").alias("index"),
                     F.lit(roots.count()).cast("long").alias("leaves"), "digest"), 1, max(1, roots.count()), fanout)
    root = top[1].select("digest").first()
    above = top[0].select(F.col("index").alias("tree"), F.col("path").alias("rest")).join(roots.select("tree", F.col("digest").alias("subroot")), "tree")
    proven = open_.select("part", "tree", "level", "index").join(path, ["tree", "level", "index"]).join(above, "tree")
    proven = written(proven.select("part", "tree", "level", "index", F.concat("path", "rest").alias("path"), "subroot", F.lit(root and root["digest"]).cast("string").alias("root")))

    kind = docs.schema[id_col].dataType.simpleString()
    out = nodes.groupBy("part").cogroup(proven.groupBy("part")).applyInArrow(
        lambda a, b: _proofs(a, b, fanout), f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col)


def _with(t: pa.Table, part: pa.Scalar) -> pa.Table:
    return t.append_column("part", pa.array(np.full(t.num_rows, part.as_py()), pa.int64()))


def _trees(names: DataFrame) -> DataFrame:
    """Numbers the trees in the order of their names (null first): by ranges, each range behind the rows of those before it."""
    dealt = names.repartitionByRange(F.col("name").asc_nulls_first()).sortWithinPartitions(F.col("name").asc_nulls_first())
    dealt = written(dealt.select("name", F.monotonically_increasing_id().alias("at")).select("name", F.shiftright("at", 33).alias("p"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")))
    counts = {r["p"]: r["n"] for r in dealt.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a range
    before, rows = 0, []
    for p in sorted(counts):
        rows.append((p, before))
        before += counts[p]
    ranges = names.sparkSession.createDataFrame(rows, "p long, before long")
    return dealt.join(F.broadcast(ranges), "p").select("name", (F.col("before") + F.col("at")).alias("tree"))


def _proofs(leaves: pa.Table, open_: pa.Table, fanout: int) -> pa.Table:
    """The proofs of a partition's leaves, below its open nodes by its own range, above by their paths."""
    upper = {(t, level, i): (path, sub, root) for t, level, i, path, sub, root in zip(*(open_.column(c).to_pylist() for c in ("tree", "level", "index", "path", "subroot", "root")))}
    columns: list[list] = [[] for _ in range(7)]
    for nodes, range_ in _ranges(leaves, fanout):
        for id_, tampered, tree, index, digest in zip(*(nodes.column(c).to_pylist() for c in ("id", "tampered", "tree", "index", "digest"))):
            level, at, steps = range_.climb(0, index)
            path, sub, root = upper[tree, level, at]
            way = [(left, right) for _, left, right in steps] + list(unpacked(path))
            folded = (tampered or digest).encode()
            for left, right in way:
                folded = sealed(left, folded, right)
            folded = folded.decode()
            for column, value in zip(columns, (id_, digest, sub, root, sealed(*[s for pair in way for s in pair]).decode(), folded, folded == root)):
                column.append(value)
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return pa.table({n: pa.array(c, leaves.schema.field("id").type if n == "id" else pa.bool_() if n == "verified" else pa.string()) for n, c in zip(names, columns)})
