"""A Merkle manifest of a dataset by time-forward processing.

Nodes are labelled (height, place) and handled in the order of their labels. A node sends its digest
forward to its parent through a priority queue ordered by the receiver's label; when a label comes
up, all digests sent to it lie at the front of the queue, and its own digest is made. The queue is
external: what stays inside a block of ``ARITY ** STEP`` neighbouring nodes waits in a heap of the
task that has the block, everything else goes through Spark's exchange, sorted by (tree, block,
place), which spills and survives lost executors. So a round climbs ``STEP`` levels, its nodes are
written, and the next has ``ARITY ** STEP`` times fewer of them.

The reversed sweep takes the labels from the highest down: a node that knows the digests beside its
path to the root, its proof suffix, sends each child that suffix with the child's siblings before it.

Places are counted in two passes: rows are range-partitioned and sorted by (tree, order), and the
counts of trees in partitions give offsets by a prefix sum. A tree of any size is thus spread over
tasks; none holds more than one partition or block.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitloom.llm.common import materialize, only

#: Children of a node, and levels that a block climbs.
ARITY, STEP = 16, 2
PROOF = "array<struct<before: string, after: string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(x: str) -> str:
    """H: lowercase hex SHA-256."""
    return hashlib.sha256(x.encode()).hexdigest()


def field(col: Column) -> Column:
    """A value as it enters a leaf: its length in bytes, a colon and itself; a dash if null."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row: H of its fields in the order given."""
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda at, p: F.sha2(F.concat(p["before"], at, p["after"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """H of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "").cast("binary"), 256)


def in_order(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``place`` (0, 1, ... without gaps inside each tree, in the order given, nulls first) and ``size`` (rows of the tree).

    Rows alike in all of ``tree`` and ``order`` are placed among themselves arbitrarily; even they are spread over partitions.
    """
    keys = ["tree", *order]
    rows = rows.withColumn("__salt", F.monotonically_increasing_id())
    # the number says partition and row of the sorted table
    sorted_ = rows.repartitionByRange(*keys, "__salt").sortWithinPartitions(*keys).withColumn("__salt", F.monotonically_increasing_id())
    rows = materialize(sorted_, "merkle-leaves")
    part = F.shiftright("__salt", 33)
    runs = rows.groupBy("tree", part.alias("__part")).agg(F.min("__salt").alias("__first"), F.count(F.lit(1)).alias("__n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        F.col("tree").alias("__tree"), "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(tree).alias("size")
    )
    joined = rows.join(offsets, (F.col("tree") == F.col("__tree")) & (part == F.col("__part")))
    return joined.withColumn("place", F.col("__salt") + F.col("__shift")).drop("__salt", "__tree", "__part", "__shift")


def height(size: int) -> int:
    """Levels that a block of a tree of so many nodes climbs."""
    h = 0
    while size > 1 and h < STEP:
        size, h = -(-size // ARITY), h + 1
    return h


def sweep_up(digests: Sequence[str], levels: int) -> list[list[str]]:
    """The digests of a block by height, from its lowest nodes to its root."""
    out: list[list[str]] = [list(digests), *([] for _ in range(levels))]
    queue = [(1, i // ARITY, i, d) for i, d in enumerate(digests)] if levels else []  # (receiver's label, sender, digest): sorted, so a heap
    while queue:
        level, place = queue[0][:2]
        got = []
        while queue and queue[0][:2] == (level, place):
            got.append(heapq.heappop(queue)[3])
        out[level].append(digest("".join(got)))
        if level < levels:
            heapq.heappush(queue, (level + 1, place // ARITY, place, out[level][-1]))
    return out


def sweep_down(levels: list[list[str]], above: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The proofs of a block's lowest nodes, given the proof suffix of its root: (siblings before, siblings after) from the lowest level up."""
    out: list[list[tuple[str, str]]] = [above] * len(levels[0])
    queue = [(1 - len(levels), 0, above)]  # (label negated, proof suffix)
    while queue:
        level, place, suffix = heapq.heappop(queue)
        level, place = -level, -place
        if not level:
            out[place] = suffix
            continue
        first = place * ARITY
        kids = levels[level - 1][first : first + ARITY]
        for i in range(len(kids)):
            heapq.heappush(queue, (1 - level, -(first + i), [("".join(kids[:i]), "".join(kids[i + 1 :])), *suffix]))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (tree, block), which stand together in the sorted stream; a block has at most ARITY ** STEP nodes."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        trees, blocks = batch.column("tree").to_pylist(), batch.column("block").to_pylist()
        begin = 0
        for i in range(batch.num_rows + 1):
            now = (trees[i], blocks[i]) if i < batch.num_rows else None
            if now != key and i < batch.num_rows:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, key = [], i, now
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["tree", "place", "digest", "size"])

    for block in _blocks(batches):
        size = block.column("size")[0].as_py()
        top = sweep_up(block.column("digest").to_pylist(), height(size))[-1][0]
        rows.append((block.column("tree")[0].as_py(), block.column("block")[0].as_py(), top, -(-size // ARITY**STEP)))
        if len(rows) >= 4096:
            yield flush()
    if rows:
        yield flush()


def _down(keep: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            above = [(p["before"], p["after"]) for p in block.column("proof")[0].as_py()]  # the root's row comes first
            nodes = block.slice(1)
            proofs = sweep_down(sweep_up(nodes.column("digest").to_pylist(), height(nodes.column("size")[0].as_py())), above)
            steps = [p for proof in proofs for p in proof]
            offsets = np.append(0, np.cumsum([len(p) for p in proofs])).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array([p[k] for p in steps], pa.string()) for k in (0, 1)], names=["before", "after"])
            subroot = pa.array([block.column("subroot")[0].as_py()] * len(nodes), pa.string())
            columns = [nodes.column(c).combine_chunks() for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, subroot, pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=[*keep, "subroot", "proof"])

    return run


def _queued(rows: DataFrame, *more: str) -> DataFrame:
    """Rows dealt by block and sorted by label: what a task's heap takes in."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *more)


@dataclass
class Forest:
    """Trees of digests: the nodes where the rounds begin, lowest first, and the roots (tree, root)."""

    rounds: list[DataFrame]
    roots: DataFrame


def grow(leaves: DataFrame) -> Forest:
    """Trees over rows (tree, place, size, digest, ...): the forward sweep."""
    rounds, nodes = [], leaves
    while True:
        most = nodes.agg(F.max("size")).first()[0] or 0
        if most <= 1:
            return Forest(rounds, nodes.select("tree", F.col("digest").alias("root")))
        rounds.append(nodes)
        dealt = _queued(nodes.select("tree", F.floor(F.col("place") / ARITY**STEP).alias("block"), "place", "digest", "size"), "place")
        nodes = materialize(dealt.mapInArrow(_up, "tree string, place long, digest string, size long"), "merkle-nodes")


def prove(forest: Forest, suffixes: DataFrame) -> DataFrame:
    """The reversed sweep: the leaves' own columns, and ``subroot`` and ``proof``.

    ``suffixes`` (tree, subroot, proof) says what each root has above it.
    """
    down = suffixes.select("tree", F.lit(0).cast("long").alias("place"), "subroot", "proof")
    for k in range(len(forest.rounds) - 1, -1, -1):
        nodes = forest.rounds[k]
        keep = [c for c in nodes.columns if c not in ("digest", "size")] if k else list(nodes.columns)
        rows = nodes.withColumn("block", F.floor(F.col("place") / ARITY**STEP))
        roots = down.select("tree", F.col("place").alias("block"), "subroot", "proof")
        both = roots.withColumn("__node", F.lit(0)).unionByName(rows.withColumn("__node", F.lit(1)), allowMissingColumns=True)
        kinds = dict(nodes.dtypes)
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "subroot string", f"proof {PROOF}"])
        down = _queued(both, "__node", "place").mapInArrow(_down(keep), schema)
    return down


def manifest(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, str | None]:
    """Proofs of all rows and the root of everything.

    ``rows`` has tree (not null), digest, the order columns and any others. Inside a tree leaves
    ascend by ``order``; while a level has several nodes, every ``ARITY`` neighbours (the last run
    fewer, even one) become H of their digests. The trees' roots, by tree bytewise, are the leaves of one more
    tree, whose root is returned. The DataFrame has the columns of ``rows`` and place, size,
    subroot, proof. No rows: no proofs and no root.
    """
    leaves = in_order(rows, order)
    trees = grow(leaves)
    if not trees.rounds:  # every tree is one leaf
        trees.rounds = [leaves]
    tops = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    tops = in_order(tops, ["name"])
    top = grow(tops)
    root = top.roots.first()
    if root is None:
        return leaves.withColumn("subroot", F.lit(None).cast("string")).withColumn("proof", F.lit(None).cast(PROOF)), None
    top.rounds = top.rounds or [tops]
    nothing = top.roots.select("tree", F.col("root").alias("subroot"), F.array().cast(PROOF).alias("proof"))
    above = prove(top, nothing).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "proof")
    return prove(trees, above), root["root"]


def source_tree(source: Column) -> Column:
    """A name of a source's tree that is never null: no source comes before every source, the others follow bytewise."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def op12_manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows of one doc_id follow each other by their leaves, rows without one come first in their
    source; rows repeated whole are leaves of their own. A row without doc_id is not tampered with. Other columns are not read.
    """
    fields = [F.col(c) for c in FIELDS]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = leaf([*fields[:-1], F.translate("text", upper, upper.lower())])
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = only(docs, *FIELDS).select("doc_id", source_tree(F.col("source")).alias("tree"), leaf(fields).alias("digest"), F.when(chosen, tampered).alias("changed"))
    proofs, root = manifest(rows, ["doc_id", "digest"])
    folded = fold(F.coalesce("changed", "digest"), F.col("proof"))
    out = proofs.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
