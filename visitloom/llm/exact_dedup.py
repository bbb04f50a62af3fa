"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest: one row per distinct text. New
documents are reduced to one row per digest by a partial aggregate, compared with the index by a
sort-merge anti-join (the index side is neither shuffled nor, while each bucket is one file,
sorted) and only unseen digests are appended. Texts never shuffle, only 64-character digests.

Two texts are equal when they are identical after each run of space, tab, newline, vertical tab,
form feed or carriage return has become one space; null counts as empty. Rows repeated whole count
in ``group_size`` and share their fate. A null doc_id ranks after every other id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm.common import as_text, materialize, only, scratch_path

BLANKS = r"[\x20\x09-\x0D]+"


def text_digest(col: str = "text"):
    """Lowercase hex SHA-256 of the normalised text."""
    return F.sha2(F.regexp_replace(as_text(col), BLANKS, " ").cast("binary"), 256)


class DigestIndex:
    """A digest index at ``path``; it outlives the session and is opened again by its path and bucket count."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        """(digest, keep_id), one row per distinct text seen so far."""
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        """Adds rows (digest, keep_id) that the index does not hold: one file per bucket."""
        (
            fresh.select("digest", "keep_id")
            .repartition(self.buckets, "digest")
            .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def compact(self, path: str) -> DigestIndex:
        """A copy with one sorted file per bucket, after many appends."""
        other = DigestIndex(self.spark, path, self.buckets)
        other.append(self.rows())
        return other


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Appends the unseen texts of ``docs`` to the index; one row per document tells what stays.

    Columns: doc_id, keep_id, group_size (rows of this batch with the text), kept, text_sha256.
    ``kept`` is true for the row that entered the index in this call. Empty input gives no rows.
    """
    digests = only(docs.select("doc_id", text_digest().alias("digest")), "doc_id", "digest")
    groups = materialize(
        digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups"
    )
    seen = index.rows()
    fresh = groups.join(seen.hint("merge"), "digest", "left_anti").select("digest", F.col("first_id").alias("keep_id"))
    index.append(materialize(fresh, "digest-fresh"))
    now = index.rows()
    owners = groups.join(now.hint("merge"), "digest", "left").select("digest", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("first_id")).alias("entered"))
    return (
        digests.join(owners, "digest")
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("entered") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def op6_exact_dedup(spark: SparkSession, docs: DataFrame, buckets: int = 64) -> DataFrame:
    """All documents as one batch against a new index in the shared folder."""
    return deduplicate(docs, DigestIndex(spark, scratch_path(spark, "digest-index"), buckets))


def without_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of each text the row that op6 keeps; rows of equal text and id stay once.

    Rows are told by text and id together, so different texts under one id, or without one, all stay.
    """
    kept = op6_exact_dedup(spark, docs).filter("kept").select(F.col("text_sha256").alias("__vl_digest"), F.col("doc_id").alias("__vl_id"))
    kept = materialize(kept, "digest-kept")
    keyed = docs.withColumn("__vl_text", text_digest())
    out = keyed.join(kept, (keyed["__vl_text"] == kept["__vl_digest"]) & keyed["doc_id"].eqNullSafe(kept["__vl_id"]), "left_semi")
    repeated = not kept.groupBy("__vl_digest").count().filter("count > 1").isEmpty()
    return (out.dropDuplicates(["__vl_text", "doc_id"]) if repeated else out).drop("__vl_text")
