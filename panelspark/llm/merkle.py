"""A Merkle manifest of a dataset: Pregel-style supersteps over an RDD of vertices.

Every row is a leaf, the hash of its fields. Leaves of a group (``lang``) ascend by key (``doc_id``); of each
level, runs of ``arity`` nodes hash to their parent until one is left, the group's subroot; the subroots
in order of their groups make a tree of the same kind, whose last node is the root.

A vertex is a subtree of ``depth`` levels over at most arity ** depth nodes. In a superstep, children
message their hash upward; a vertex that holds all its children, which it can tell from the size of its
tree, hashes them and forwards its own; a tree that is done halts and sends its subroot to the tree of groups.
The reverse supersteps send the root's side down: a parent broadcasts to each child the siblings on the
child's path, until every leaf holds its proof. So a tree of n leaves takes log n / (depth log arity)
supersteps each way, what is shuffled falls by arity ** depth with each, and a task holds a vertex at a time.

Leaves are hashed by Spark's own functions as the table is read, and 64 bytes a row are sorted by range (equal
rows are told apart by number, so no key is too hot for a range). A leaf's place follows from the rows of its group
in the ranges before, a table of one row a range and group. Lineage is cut by written tables before the supersteps;
lost partitions of a superstep are computed again from there.

Cases: a null field is '-'; leaves of one doc_id, or none, are ordered by (doc_id, nulls first; leaf);
a null group comes first; extra columns don't count; an empty table gives no rows. A group of any size is
spread over vertices; groups may be as many as rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.llm.shared import written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, DEPTH = 2, 10
SIZE = 32  # bytes of a digest


def h(digests: Sequence[bytes]) -> bytes:
    """The hash of nodes, which are concatenated as hexadecimal text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def leaf(columns: Sequence[Column]) -> Column:
    """The hash of a row's fields, in binary."""
    fields = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def height(total: int, arity: int) -> int:
    n = 0
    while total > 1:
        total, n = -(-total // arity), n + 1
    return n


def hashed(nodes: list[bytes], levels: int, arity: int) -> list[list[bytes]]:
    """The nodes and so many levels above them."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([h(below[i : i + arity]) for i in range(0, len(below), arity)])
    return out


def siblings(levels: list[list[bytes]], at: int, arity: int) -> bytes:
    """What stands beside a node's path through these levels, each level left to right."""
    out = []
    for nodes in levels[:-1]:
        first = at // arity * arity
        out += nodes[first:at] + nodes[at + 1 : first + arity]
        at //= arity
    return b"".join(out)


def folded(node: bytes, proof: bytes, places: Sequence[tuple[int, int]], arity: int) -> bytes:
    """The root that follows from a leaf and its proof; places: (place, total) in its group and of the group."""
    used = 0
    for at, total in places:
        while total > 1:
            first = at // arity * arity
            others = min(arity, total - first) - 1
            beside = [proof[used + SIZE * i : used + SIZE * (i + 1)] for i in range(others)]
            node = h([*beside[: at - first], node, *beside[at - first :]])
            used += SIZE * others
            at, total = at // arity, -(-total // arity)
    return node


def _partition(key: tuple[int, int]) -> int:
    return zlib.crc32(b"%d:%d" % key)


class Tree:
    """Trees numbered by group, as RDDs of vertices: (group, block) -> (total, nodes by place), a list for each superstep."""

    def __init__(self, leaves: RDD, largest: int, arity: int, depth: int, partitions: int):
        """leaves: (group, block) -> (place in the block, total, bytes of nodes), any number of them a vertex."""
        self.arity, self.depth, self.size, self.partitions = arity, depth, arity**depth, partitions
        self.steps: list[RDD] = []
        self.done: list[RDD] = []
        for step in range(max(1, -(-height(largest, arity) // depth))):
            vertices = leaves.groupByKey(partitions, _partition)
            self.steps.append(vertices)
            sent = vertices.map(self._up(step))
            self.done.append(sent.filter(lambda m: m[2]).map(lambda m: (m[0][0], m[1][2])))
            leaves = sent.filter(lambda m: not m[2]).map(lambda m: m[:2])

    def _levels(self, step: int):
        arity, depth, size = self.arity, self.depth, self.size

        def run(key: tuple[int, int], messages) -> tuple[int, list[list[bytes]], bool]:
            parts = sorted((first, total, data) for first, total, data, *_ in messages)
            total, data = parts[0][1], b"".join(x[2] for x in parts)
            nodes = [data[i : i + SIZE] for i in range(0, len(data), SIZE)]
            there = total
            for _ in range(step):
                there = -(-there // size)
            if len(nodes) != min(size, there - key[1] * size):
                raise RuntimeError(f"vertex {key} of superstep {step} has {len(nodes)} of its children")
            left = height(total, arity) - step * depth
            return total, hashed(nodes, min(depth, left), arity), left <= depth

        return run

    def _up(self, step: int):
        levels, size = self._levels(step), self.size

        def run(vertex):
            key, messages = vertex
            total, found, done = levels(key, messages)
            return (key[0], key[1] // size), (key[1] % size, total, found[-1][0]), done

        return run

    def subroots(self) -> RDD:
        """(group, last node)"""
        out = self.done[0]
        for more in self.done[1:]:
            out = out.union(more)
        return out

    def down(self, above: RDD) -> RDD:
        """above: group -> what is sent down to its last node: (siblings, ...). Result: (key, messages to the vertex, levels, what reaches it)."""
        said = above.map(lambda x: ((x[0], 0), x[1]))  # to the vertex where the tree is done
        for step in range(len(self.steps) - 1, -1, -1):
            met = self._meet(step, said)
            if not step:
                return met
            # trees that are done in an earlier superstep have no vertex here: what is for them goes on
            said = met.flatMap(self._down())
        raise AssertionError

    def _meet(self, step: int, said: RDD) -> RDD:
        levels = self._levels(step)

        def both(x):
            key, found = x
            found = list(found)
            messages, came = [y for kind, y in found if not kind], [y for kind, y in found if kind]
            return key, messages, levels(key, messages) if messages else None, came[0]

        vertices = self.steps[step].flatMapValues(lambda v: [(0, x) for x in v])
        sent = said.partitionBy(self.partitions, _partition).mapValues(lambda v: (1, v))
        return vertices.union(sent).groupByKey(self.partitions, _partition).map(both)

    def _down(self):
        arity, size = self.arity, self.size

        def run(x):
            key, messages, found, came = x
            if found is None:
                yield key, came
                return
            _, levels, _ = found
            for place in range(len(levels[0])):
                yield (key[0], key[1] * size + place), (siblings(levels, place, arity) + came[0], *came[1:])

        return run


_PACKED = pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("total", pa.int64()), ("nodes", pa.binary()), ("ids", pa.binary()), ("no_id", pa.binary()), ("claims", pa.binary()), ("claimed", pa.binary())])
_PACKED_DDL = "grp long, block long, first long, total long, nodes binary, ids binary, no_id binary, claims binary, claimed binary"
_VERTEX_DDL = "grp long, groups long, first long, total long, levels binary, above binary, subroot binary, root binary, ids binary, no_id binary, claims binary, claimed binary"
_LEAVES = pa.schema([("doc_id", pa.int64()), ("leaf", pa.binary()), ("claim", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary()), ("proof", pa.binary()), ("place", pa.int64()), ("total", pa.int64()), ("grp", pa.int64()), ("groups", pa.int64())])
_LEAVES_DDL = "doc_id long, leaf binary, claim binary, subroot binary, root binary, proof binary, place long, total long, grp long, groups long"


def _packed(size: int):
    """Consecutive leaves of a vertex as one message."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            group, place, total = (batch.column(c).to_numpy() for c in ("grp", "place", "total"))
            block = place // size
            cut = np.flatnonzero((np.diff(group) != 0) | (np.diff(block) != 0) | (np.diff(place) != 1)) + 1
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            missing = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            nodes, claims = batch.column("leaf").to_pylist(), batch.column("claim").to_pylist()
            rows = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(group)], strict=True):
                held = np.array([c is not None for c in claims[a:b]])
                rows.append((int(group[a]), int(block[a]), int(place[a] % size), int(total[a]), b"".join(nodes[a:b]), ids[a:b].tobytes(), missing[a:b].tobytes(), b"".join(c for c in claims[a:b] if c is not None), held.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PACKED.types, strict=True)], schema=_PACKED)

    return run


def _vertex(size: int):
    """A vertex of the last reverse superstep as one row."""

    def run(x):
        key, messages, (total, levels, _), came = x
        above, subroot, root, groups = came
        joined = [b"".join(y) for y in zip(*(m[2:] for m in sorted(messages)), strict=True)]
        return (key[0], groups, key[1] * size, total, b"".join(b"".join(level) for level in levels), above, subroot, root, *joined[1:])

    return run


def _leaves(arity: int):
    """A row for each leaf of a vertex."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                ids, missing, claimed = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["no_id"], bool), np.frombuffer(r["claimed"], bool)
                n, levels, used = len(ids), [], 0
                while used < len(r["levels"]):
                    levels.append([r["levels"][used + SIZE * i : used + SIZE * (i + 1)] for i in range(n)])
                    used, n = used + SIZE * n, -(-n // arity)
                claims = iter([r["claims"][i : i + SIZE] for i in range(0, len(r["claims"]), SIZE)])
                n = len(ids)
                columns = [
                    pa.array(ids, pa.int64(), mask=missing),
                    pa.array(levels[0], pa.binary()),
                    pa.array([next(claims) if c else None for c in claimed.tolist()], pa.binary()),
                    pa.array([r["subroot"]] * n, pa.binary()),
                    pa.array([r["root"]] * n, pa.binary()),
                    pa.array([siblings(levels, i, arity) + r["above"] for i in range(n)], pa.binary()),
                    pa.array(np.arange(r["first"], r["first"] + n), pa.int64()),
                    *(pa.array(np.full(n, r[c]), pa.int64()) for c in ("total", "grp", "groups")),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_LEAVES)

    return run


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, claim: Column | None = None, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """docs(doc_id, lang, ...) -> a row a leaf: doc_id, leaf, claim, subroot, root, proof (digests joined), place and total in its group, grp (place of the group), groups.

    ``claim`` is a leaf that is to be verified in the place of the row's own; null: the row's own.
    """
    spark = docs.sparkSession
    own = leaf([F.col(c) for c in columns])
    claim = F.lit(None).cast("binary") if claim is None else claim
    hashes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("name"), own.alias("leaf"), claim.alias("claim")), "leaves")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("name"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("row")]
    ordered = hashes.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions, *order).sortWithinPartitions(*order).drop("row")
    ordered = written(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    # rows of a group in a range are consecutive: their places follow from the first one's
    lots = ordered.groupBy("name", "part").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("name").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lots = written(lots.select("name", "part", "first_at", before.alias("before"), F.sum("n").over(W.partitionBy("name")).alias("total")), "lots")
    names = lots.groupBy("name").agg(F.max("total").alias("total")).orderBy(F.asc_nulls_first("name"))
    numbered = spark.createDataFrame(names.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1], x[0][1])), "name string, grp long, total long")
    numbered = written(numbered, "groups")
    largest, groups = numbered.agg(F.max("total"), F.count("*")).head()
    if not groups:
        return spark.createDataFrame([], _LEAVES_DDL)
    lots = lots.select(F.col("name").alias("own"), F.col("part").alias("own_part"), "first_at", "before").join(numbered, F.col("own").eqNullSafe(F.col("name"))).drop("name")
    placed = ordered.join(lots, F.col("name").eqNullSafe(F.col("own")) & (F.col("part") == F.col("own_part")))
    placed = placed.select("grp", (F.col("at") - F.col("first_at") + F.col("before")).alias("place"), "total", "doc_id", "leaf", "claim")

    size = arity**depth
    messages = placed.mapInArrow(_packed(size), _PACKED_DDL).rdd.map(lambda r: ((r[0], r[1]), (r[2], r[3], bytes(r[4]), *map(bytes, r[5:]))))
    trees = Tree(messages, largest, arity, depth, partitions)
    subroots = trees.subroots()
    few = max(1, min(partitions, groups // size))
    top = Tree(subroots.map(lambda x: ((0, x[0] // size), (x[0] % size, groups, x[1]))), groups, arity, depth, few)
    ends = top.down(top.subroots().map(lambda x: (0, (b"", x[1]))))

    def told(x):
        key, _, (_, levels, _), (above, root) = x
        for i, subroot in enumerate(levels[0]):
            yield key[1] * size + i, (siblings(levels, i, arity) + above, subroot, root, groups)

    vertices = trees.down(ends.flatMap(told)).map(_vertex(size))
    return spark.createDataFrame(vertices, _VERTEX_DDL, verifySchema=False).mapInArrow(_leaves(arity), _LEAVES_DDL)


_VERIFIED = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
_VERIFIED_DDL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """Each leaf, or the one claimed in its place, folded with its proof and held against the root."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for r in batch.to_pylist():
                up = folded(r["claim"] or r["leaf"], r["proof"], ((r["place"], r["total"]), (r["grp"], r["groups"])), arity)
                rows.append((r["doc_id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), hashlib.sha256(r["proof"].hex().encode()).hexdigest(), up.hex(), up == r["root"]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_VERIFIED), _VERIFIED.types, strict=True)], schema=_VERIFIED)

    return leaves.mapInArrow(run, _VERIFIED_DDL)


def tampered(every: int = 7, columns: Sequence[str] = COLUMNS) -> Column:
    """The leaf of a row whose n_chars is one too large, where ``every`` divides the crc32 of its doc_id; else null."""
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, leaf(changed))
