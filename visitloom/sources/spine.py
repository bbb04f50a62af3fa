"""Tables laid out by participant or visit once, so that later joins and groupings by it move no rows.

Tables that are laid out together share bucket columns, bucket count and the keys set apart. A key with more rows
than an even share of a bucket would make one bucket as long as itself, so its rows stand apart, spread evenly,
and are joined by a shuffle of their own. The split is a partition column: rows of other splits are not opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.session import shared_folder

BUCKETS = 64
#: A key is set apart from so many rows on, and only when it also exceeds the even share of a bucket.
CROWDED_ROWS = 1_000_000


@dataclass
class Laid:
    """One table by buckets (``even``) and the rows of the keys set apart (``crowded``)."""

    spark: SparkSession
    name: str
    apart: str | None
    key: str

    def even(self) -> DataFrame:
        return self.spark.table(self.name)

    def crowded(self) -> DataFrame | None:
        return None if self.apart is None else self.spark.read.schema(self.even().schema).parquet(self.apart)

    def rows(self) -> DataFrame:
        """All rows, in no order."""
        return self.even() if self.apart is None else self.even().unionByName(self.crowded())

    def drop(self) -> None:
        """Takes the table out of the catalog; files stay in the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def lay_out(tables: Mapping[str, DataFrame], key: str, split: str = "split", buckets: int = BUCKETS, crowded_rows: int = CROWDED_ROWS) -> dict[str, Laid]:
    """Writes the tables side by side below the shared folder: ``buckets`` sorted buckets by ``key``, each in one file for each split.

    A table without a column ``split`` is not partitioned. Rows with a null key are kept, in one bucket or apart; they match
    nothing. Columns beyond the key may have any name. Empty tables stay empty tables.
    """
    spark = next(iter(tables.values())).sparkSession
    heavy: set = set()
    for df in tables.values():  # a table has at most ``buckets`` keys above the even share
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
        share = df.count() / buckets
        heavy |= {r[key] for r in counts.filter(F.col("__n") > max(share, crowded_rows)).collect()}
    known = sorted(k for k in heavy if k is not None)
    apart = F.when(F.col(key).isNull(), F.lit(None in heavy)).otherwise(F.col(key).isin(known)) if heavy else None
    out = {}
    for label, df in tables.items():
        at = f"{shared_folder(spark)}/laid-{uuid.uuid4().hex}"
        name = f"laid_{uuid.uuid4().hex[:12]}"
        parts = [split] if split in df.columns else []
        columns = [c for c in df.columns if c not in parts] + parts
        even = (df if apart is None else df.filter(~apart)).select(*columns)
        w = even.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{at}/even")
        (w.partitionBy(*parts) if parts else w).saveAsTable(name)
        if apart is not None:
            df.filter(apart).select(*columns).repartition(buckets).write.parquet(f"{at}/crowded")
        out[label] = Laid(spark, name, None if apart is None else f"{at}/crowded", key)
    return out


def left_join_laid(left: Laid, right: Laid, splits: Sequence[str] | None = None, split: str = "split") -> DataFrame:
    """J01 and J02 over tables laid out together: all left rows (of ``splits`` alone, S05) with the columns of the right row of their key.

    The right side holds a key once; ``repeated_keys`` finds what breaks that. Bucket meets bucket without an exchange. Keys set apart
    are few (at most ``buckets`` for each table), and so are their right rows, which are sent to all tasks.
    Beyond the key the right side's column names must differ from the left's.
    """
    pick = (lambda d: d) if splits is None else (lambda d: d.filter(F.col(split).isin(*splits)))
    out = pick(left.even()).join(right.even().hint("merge"), left.key, "left")
    if left.apart is None:
        return out
    return out.unionByName(pick(left.crowded()).join(F.broadcast(right.crowded()), left.key, "left"))
