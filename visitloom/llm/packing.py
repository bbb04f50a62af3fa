"""Packing by concatenation and cutting.

Pass one encodes every document where it was read, adds the end id, and writes the ids with each
document's offset inside its partition. The token totals of the partitions, one number each, give
global offsets by a prefix sum. Pass two cuts the one long stream into fixed windows: a document
that crosses window edges becomes several pieces, the boundary records. Ids are written once and
never shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitloom.llm.common import materialize, only
from visitloom.llm.tokens import public_tokenizer_path, word_encoder

#: Up to so many partition totals the offsets are broadcast (16 bytes each).
BROADCAST_PARTS = 500_000


def _encode(path: str, end_id: int, pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = word_encoder(path, pieces), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                cut = batch.slice(k, 512)
                coded = encoder.encode([t or "" for t in cut.column(1).to_pylist()])
                ids = [np.frombuffer(c, encoder.dtype).astype("<u4").tobytes() + end for c in coded]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), pa.array([part] * cut.num_rows, pa.int32()), pa.array(starts), pa.array(sizes), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "at", "doc_tokens", "ids"],
                )

    return run


def encode_documents(docs: DataFrame, path: str, end_id: int = 1, pieces: int = 0) -> DataFrame:
    """Pass one: (doc_id, part, at, doc_tokens, ids), ids as little-endian unsigned 32-bit integers with ``end_id`` last.

    The rows are written, so part and at stay what they are when executors are lost later. A smaller
    cache of ``pieces`` takes less memory and more time.
    """
    return materialize(only(docs, "doc_id", "text").mapInArrow(_encode(path, end_id, pieces), "doc_id long, part int, at long, doc_tokens long, ids binary"), "ids")


def cut_windows(encoded: DataFrame, window: int = 2048) -> DataFrame:
    """Pass two: one row per piece with its ids.

    Columns: doc_id, start (ids of the document before the piece), length, ids, doc_tokens,
    sequence_id, offset (place in the sequence). All sequences but the last are full.
    """
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if encoded.sparkSession and totals.count() <= BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    g, last = F.col("base") + F.col("at"), F.col("base") + F.col("at") + F.col("doc_tokens") - 1
    w = F.lit(window)
    pieces = encoded.join(offsets, "part").select(
        "doc_id", "doc_tokens", "ids", g.alias("g"),
        F.explode(F.sequence(F.floor(g / w).cast("long"), F.floor(last / w).cast("long"))).alias("sequence_id"),
    )
    begin = F.greatest(F.col("sequence_id") * w, F.col("g"))
    end = F.least((F.col("sequence_id") + 1) * w, F.col("g") + F.col("doc_tokens"))
    return pieces.select(
        "doc_id", (begin - F.col("g")).alias("start"), (end - begin).alias("length"), "doc_tokens", "sequence_id",
        (begin - F.col("sequence_id") * w).alias("offset"),
        F.substring("ids", ((begin - F.col("g")) * 4 + 1).cast("int"), ((end - begin) * 4).cast("int")).alias("ids"),
    )


def op8_pack(spark: SparkSession, docs: DataFrame, window: int = 2048, pieces: int = 0) -> DataFrame:
    """All documents packed; null and empty texts are the end id alone, repeated rows are packed as often as they stand there."""
    pieces = cut_windows(encode_documents(docs, public_tokenizer_path("word_bpe_49k.json"), pieces=pieces), window)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
