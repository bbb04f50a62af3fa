"""What the corpus operators share: scratch tables, gapless numbering, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitloom.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to a table in the shared folder and reads them back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_text(col: Column | str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def text_key(col: Column | str = "text") -> Column:
    """The first 16 bytes of the SHA-256 of a text, null read as empty: with doc_id it tells rows whose ids repeat or are null."""
    return F.unhex(F.substring(F.sha2(as_text(col).cast("binary"), 256), 1, 32))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that other columns of a table can never clash with an operator's own."""
    return df.select(*names)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that Python copies of their texts stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def number_gapless(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str, rows: int, per_bucket: int = 50_000) -> DataFrame:
    """Adds ``out``: positions 0, 1, ... without gaps inside each group, for groups of any size.

    No group is sorted in one task. Rows fall into hash buckets of about ``per_bucket`` rows by
    their order columns; bucket counts give offsets by a prefix sum, and only a bucket is sorted.
    The order inside a group is by (bucket, order columns): arbitrary but the same in every run.
    ``df`` is read twice and should be cheap to read or materialized.
    """
    n = max(1, -(-rows // per_bucket))
    keyed = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    counts = keyed.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(*groups, "__bucket").orderBy(*order))
    numbered = keyed.withColumn("__row", local)
    right = offsets.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__bucket").alias("__b"), "__before")
    on = F.col("__bucket") == F.col("__b")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = numbered.join(right, on, "left")
    return joined.withColumn(out, F.col("__before") + F.col("__row") - 1).select(*df.columns, out)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as (a, b) long columns: rows (node, component), component being the smallest node.

    Alternates large-star and small-star steps (each a min aggregate and a join on the node);
    every round is written to the shared folder. Nodes without edges are not returned.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = materialize(e, "cc")
    signature = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(first, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = materialize(small.filter("u <> v").distinct(), "cc")
        now = tuple(e.agg(F.count(F.lit(1)), F.countDistinct("u"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == signature and now[0] == now[1]:
            break
        signature = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
