"""Incremental loading with Structured Streaming: the resumable append of ``sources.packages`` for files that keep arriving.

An extension: the batch operators work the same without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from visitloom.sources.packages import append_results


def follow(spark: SparkSession, directory: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files of a folder, old ones first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(directory)


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends rows whose key the table does not hold yet; a batch that is run again adds nothing.

    The stream stops when all present files are read. Keys repeated inside a batch enter once.
    """

    def batch(df: DataFrame, _: int) -> None:
        append_results(df.dropDuplicates([key]), path, key)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, groups: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by tumbling window and group; rows later than the watermark are left out."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), *groups).agg(F.count(F.lit(1)).alias("rows"))
