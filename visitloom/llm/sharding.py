"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Items enter, largest first, the bin with the least remaining capacity that still holds them; the
bins stand in a balanced tree ordered by remaining capacity. The work is done in two levels so
that no task and no driver ever holds all groups:

1. every hash partition of groups packs its own groups into small bins of ``capacity / parts``
   (a group above that is a bin of its own);
2. the small bins, whose number depends on the capacity and not on the number of groups (all but
   one of a partition are at least half full), are packed into the real bins in the same way.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm.common import as_text, materialize, number_gapless, only


class CapacityTree:
    """Bins ordered by (remaining capacity, bin): a B-tree of height two, its leaves split when they reach ``width``."""

    def __init__(self, width: int = 512):
        self.width = width
        self.leaves: list[list[tuple[int, int]]] = []
        self.lows: list[tuple[int, int]] = []

    def add(self, room: int, bin_id: int) -> None:
        x = (room, bin_id)
        if not self.leaves:
            self.leaves, self.lows = [[x]], [x]
            return
        i = max(0, bisect_left(self.lows, x) - 1)
        leaf = self.leaves[i]
        insort(leaf, x)
        self.lows[i] = leaf[0]
        if len(leaf) > self.width:
            half = len(leaf) // 2
            self.leaves[i : i + 1] = [leaf[:half], leaf[half:]]
            self.lows[i : i + 1] = [leaf[0], leaf[half]]

    def _take(self, i: int, k: int) -> tuple[int, int]:
        leaf = self.leaves[i]
        x = leaf.pop(k)
        if leaf:
            self.lows[i] = leaf[0]
        else:
            del self.leaves[i], self.lows[i]
        return x

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least room of at least ``size``."""
        if not self.leaves:
            return None
        x = (size, -1)
        i = max(0, bisect_left(self.lows, x) - 1)
        k = bisect_left(self.leaves[i], x)
        if k == len(self.leaves[i]):
            i, k = i + 1, 0
        return self._take(i, k) if i < len(self.leaves) else None

    def take_roomiest(self) -> tuple[int, int]:
        """Removes and returns the bin with the most room."""
        return self._take(len(self.leaves) - 1, len(self.leaves[-1]) - 1)


def best_fit_decreasing(sizes: Iterable[int], capacity: int, fixed_bins: int | None = None) -> list[int]:
    """Bin numbers for ``sizes``, which must come largest first.

    Without ``fixed_bins`` a new bin opens when nothing fits (an item above the capacity fills a
    bin alone). With it, that many bins stand open and an item that fits nowhere enters the
    emptiest one, so that the bins stay near equal.
    """
    tree, out, opened = CapacityTree(), [], 0
    if fixed_bins:
        for b in range(fixed_bins):
            tree.add(capacity, b)
        opened = fixed_bins
    for size in sizes:
        got = tree.take_tightest(size)
        if got is None:
            if fixed_bins:
                got = tree.take_roomiest()
            else:
                got, opened = (max(capacity, size), opened), opened + 1
        out.append(got[1])
        tree.add(got[0] - size, got[1])
    return out


def _small_bins(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([("size", "descending"), ("group_id", "ascending")])
        bins = best_fit_decreasing(table["size"].to_pylist(), capacity)
        part = TaskContext.get().partitionId()
        out = pa.table({"group_id": table["group_id"], "size": table["size"], "part": pa.array([part] * len(bins), pa.int32()), "bin": pa.array(bins, pa.int32())})
        yield from out.to_batches(max_chunksize=20_000)

    return run


def pack_groups(groups: DataFrame, capacity: int, parts: int = 256, fixed_bins: int | None = None, per_task: int = 100_000) -> DataFrame:
    """Bins for ``groups`` (group_id string, size long): rows (group_id, shard).

    Level two runs on the driver over at most ``2 * total / capacity * parts`` small bins plus one
    per task of level one. Null sizes count as 0; equal sizes are ordered by group_id.
    """
    spark = groups.sparkSession
    n = groups.count()
    small = max(1, capacity // parts)
    cut = groups.select("group_id", F.coalesce("size", F.lit(0)).cast("long").alias("size")).repartition(max(1, -(-n // per_task)), "group_id")
    packed = materialize(cut.mapInArrow(_small_bins(small), "group_id string, size long, part int, bin int"), "small-bins")
    sums = packed.groupBy("part", "bin").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "part", "bin").toPandas()
    sums["shard"] = best_fit_decreasing(sums["size"].tolist(), capacity, fixed_bins)
    chosen = spark.createDataFrame(sums[["part", "bin", "shard"]].astype("int32"), "part int, bin int, shard int") if len(sums) else spark.createDataFrame([], "part int, bin int, shard int")
    return packed.join(chosen, ["part", "bin"]).select("group_id", "shard")


def shard_documents(docs: DataFrame, n_shards: int = 8, parts: int = 256) -> DataFrame:
    """Every document in one of ``n_shards`` shards of near equal bytes, equal texts together.

    Size is the UTF-8 length of the text plus 1; a null text is empty, and equal to an empty one.
    A group of copies larger than a shard's share makes its shard larger: groups are indivisible.
    Rows repeated whole are rows of the same group. ``grown_shard`` is null: under the law of
    bytes another shard moves groups between shards. Empty input gives no rows.
    """
    base = only(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(as_text("text")) + 1).cast("long").alias("size"),
        F.crc32(as_text("text").cast("binary")).alias("text_crc32"),
        F.sha2(as_text("text").cast("binary"), 256).alias("group_id"),
    )
    rows = materialize(base, "shard-rows")
    groups = rows.groupBy("group_id").agg(F.sum("size").alias("size"))
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    shards = pack_groups(groups, max(1, -(-(total or 0) // n_shards)), parts, n_shards)
    placed = materialize(rows.join(shards, "group_id").select("doc_id", "size", "text_crc32", "shard"), "shard-placed")
    numbered = number_gapless(placed, ["shard"], ["doc_id"], "slot", count)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_shard_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return shard_documents(docs)
