"""Aggregations: counts, profiles, suppression, hashes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitloom.functions import scalars as S
from visitloom.operators.quantiles import exact_quantiles
from visitloom.operators.tables import keyed

RARE_BELOW, SMALL_BELOW = 5, 5
RARE_LABEL = "__RARE__"


def counts_by(df: DataFrame, groups: Sequence[str], within: Sequence[str] = (), participant: str | None = None) -> DataFrame:
    """Rows (and participants) by group, NULL groups kept, with their percentage of the ``within`` total."""
    aggs = [F.count(F.lit(1)).alias("rows")] + ([F.count_distinct(participant).alias("participants")] if participant else [])
    out = df.groupBy(*groups).agg(*aggs)
    total = F.sum("rows").over(Window.partitionBy(*within)) if within else F.sum("rows").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("percent", F.round(F.col("rows") * 100 / total, 6))


def load_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, rows without a whole key, rows of repeated keys: one row."""
    per_key = df.filter(keyed(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    dup = per_key.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_key_rows"), F.count(F.lit(1)).alias("distinct_keys"))
    rows = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~keyed(keys)).alias("missing_key_rows"))
    return rows.crossJoin(dup)  # one row each


def disagreeing_groups(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """By column, groups with more than one different observed value: one row. Minimum and maximum tell, so nothing is expanded."""
    seen = {c: F.when(F.col(c).isNotNull(), S.audit_text(F.col(c).cast("string"))) for c in columns}
    per = df.groupBy(*keys).agg(*[(F.min(v) != F.max(v)).alias(c) for c, v in seen.items()])
    return per.agg(*[F.count_if(F.col(c)).alias(c) for c in columns])


def any_first_all(df: DataFrame, keys: Sequence[str], position: str, flags: Sequence[str]) -> DataFrame:
    """By key: any, first (smallest position) and all of boolean flags, and their mean."""
    return df.groupBy(*keys).agg(
        *[f(c).alias(f"{n}_{c}") for c in flags for n, f in (("any", F.bool_or), ("all", F.bool_and))],
        *[F.min_by(c, position).alias(f"first_{c}") for c in flags],
        *[F.avg(F.col(c).cast("int")).alias(f"rate_{c}") for c in flags],
    )


def distribution(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Count, min, quartiles (exact, linear), mean, max of the observed values; no group needs all its values in one place."""
    facts = df.groupBy(*groups).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"))
    q = exact_quantiles(df, groups, [value], [0.25, 0.5, 0.75]).select(*[F.col(g).alias(f"__{g}") for g in groups], "q")
    on = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups], F.lit(True))
    return facts.join(q, on, "left").select(*groups, "n", "low", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), "mean", F.col("q")[2].alias("q75"), "high")


def equivalence_classes(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Different observed values under tolerant equality, and the verdict."""
    n = F.count_distinct(S.code_label(F.col(column)))
    verdict = F.when(F.col("classes") == 0, "missing").when(F.col("classes") == 1, "consensus").otherwise("conflict")
    return df.groupBy(*keys).agg(n.alias("classes"), F.min(S.code_label(F.col(column))).alias("value")).select(
        *keys, "classes", verdict.alias("verdict"), F.when(F.col("classes") == 1, F.col("value")).alias("value")
    )


def collapse_rare(df: DataFrame, column: str, out: str | None = None, below: int = RARE_BELOW) -> DataFrame:
    """NULL becomes a category, and categories of fewer than ``below`` rows become one.

    Counts come from an aggregate joined back, so that a frequent category is never sorted in one task.
    """
    label = F.coalesce(F.col(column), F.lit(S.MISSING_LABEL))
    counts = df.groupBy(label.alias("__cat")).agg((F.count(F.lit(1)) < below).alias("__rare"))
    joined = df.withColumn("__cat0", label).join(counts, F.col("__cat0") == F.col("__cat"))
    return joined.withColumn(out or column, F.when(F.col("__rare"), F.lit(RARE_LABEL)).otherwise(F.col("__cat0"))).drop("__cat0", "__cat", "__rare")


def suppressed(n: Column, style: str = "null", below: int = SMALL_BELOW) -> Column:
    """Small counts (1 to below - 1): NULL, or the text ``<5``; zero is shown."""
    small = (n > 0) & (n < below)
    return F.when(small, F.lit(f"<{below}")).otherwise(n.cast("string")) if style == "text" else F.when(~small, n)


def safe_distribution(counts: DataFrame, label: str, n: str, pseudonyms: bool = False, below: int = SMALL_BELOW) -> DataFrame:
    """Categories with small counts removed; each row carries what was removed. Pseudonyms follow the label order."""
    ranked = counts.withColumn("__k", F.row_number().over(Window.orderBy(label))) if pseudonyms else counts
    small = (F.col(n) > 0) & (F.col(n) < below)
    gone = counts.agg(F.count_if(small).alias("suppressed_categories"), F.coalesce(F.sum(F.when(small, F.col(n))), F.lit(0)).alias("suppressed_rows"))
    shown = ranked.filter(~small)
    name = F.format_string("category_%03d", "__k") if pseudonyms else F.col(label)
    return shown.select(name.alias(label), n).crossJoin(gone)  # one row on the right


def sets_as_text(df: DataFrame, keys: Sequence[str], item: str, n: str) -> DataFrame:
    """By key: number of items, sum of ``n``, and the sorted items joined by ``|``."""
    return df.groupBy(*keys).agg(F.count_distinct(item).alias("sources"), F.sum(n).alias("total"), F.array_join(F.array_sort(F.collect_set(item)), "|").alias("items"))


#: Bytes of lines that a sorted partition holds on average, and that travel in one block.
SORTED_BYTES, BLOCK_BYTES = 32_000_000, 1_000_000


def _line_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines as compressed blocks with their bytes and rows."""

    def block() -> pa.RecordBatch:
        data = "\n".join(held).encode()
        return pa.RecordBatch.from_arrays([pa.array([zlib.compress(data)], pa.binary()), pa.array([len(held)], pa.int64())], names=["block", "rows"])

    held, size = [], 0
    for batch in batches:
        for line in batch.column(0).to_pylist():
            held.append(line)
            size += len(line)
            if size >= BLOCK_BYTES:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def table_hash(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A10: SHA-256 over the rows' canonical lines in order (then by line): one row (rows, digest), for tables of any size.

    A sort over range partitions of about ``SORTED_BYTES`` puts the lines in order, tasks join them to blocks and compress these, and
    the digest takes up one block after the other, partition by partition: such a hash is sequential by its nature, but
    the driver holds one partition of compressed lines at most. Rows alike in all of these columns are spread as well.
    """
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(S.NULL_MARK)) for c in columns])
    lines = df.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], line.alias("__line"))
    size = lines.agg(F.sum(F.octet_length("__line"))).first()[0] or 0
    keys = [f"__o{i}" for i in range(len(order))] + ["__line"]
    salted = lines.withColumn("__salt", F.monotonically_increasing_id())
    parts = max(1, -(-size // SORTED_BYTES))
    blocks = salted.repartitionByRange(parts, *keys, "__salt").sortWithinPartitions(*keys).select("__line").mapInArrow(_line_blocks, "block binary, rows long")
    state, rows = hashlib.sha256(), 0
    for r in blocks.toLocalIterator():
        state.update((b"\n" if rows else b"") + zlib.decompress(r["block"]))
        rows += r["rows"]
    return df.sparkSession.createDataFrame([(rows, state.hexdigest())], "rows long, digest string")


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A10 for tables of any size: row count and an order-free sum of row hashes; one partial aggregate, no sort."""
    cols = list(columns or df.columns)
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit(S.NULL_MARK)) for c in cols]).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("decimal(38,0)").alias("fingerprint"))


def scope_profile(long: DataFrame, groups: Sequence[str], value: str, participant: str) -> DataFrame:
    """The profile of each feature over a long (feature, value, participant) table, in one shuffle for all features."""
    v = F.nullif(S.strip(F.col(value)), F.lit(""))
    rows = long.select(*groups, v.alias("v"), F.col(participant).alias("p"))
    out = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("p").alias("participants"), F.count("v").alias("observed_rows"),
        F.count_distinct(F.when(F.col("v").isNotNull(), F.col("p"))).alias("observed_participants"), F.count_distinct("v").alias("distinct_observed"),
    )
    missing = F.col("rows") - F.col("observed_rows")
    effective = F.col("distinct_observed") + (missing > 0).cast("int")
    return out.select(
        *groups, "rows", "participants", "observed_rows", missing.alias("missing_rows"), F.try_divide("observed_rows", "rows").alias("observed_fraction"),
        "observed_participants", F.try_divide("observed_participants", "participants").alias("observed_participant_fraction"), "distinct_observed",
        effective.alias("distinct_with_missing"), (F.col("observed_rows") == 0).alias("all_missing"),
        ((F.col("observed_rows") > 0) & (F.col("distinct_observed") == 1)).alias("observed_constant"), (effective <= 1).alias("effective_constant"),
    )


def support_counts(long: DataFrame, groups: Sequence[str], value: str, participant: str, split: str, least: int = 50) -> DataFrame:
    """Train participants with the feature observed, whether that is enough, and the support band."""
    seen = F.when((F.col(split) == "train") & F.col(value).isNotNull(), F.col(participant))
    out = long.groupBy(*groups).agg(F.count_distinct(seen).alias("train_participants"))
    return out.select(*groups, "train_participants", (F.col("train_participants") >= least).alias("retained"), S.band(F.col("train_participants")).alias("band"))


def missingness(long: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Cells, missing cells and their share by group."""
    out = long.groupBy(*groups).agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col(value).isNull()).alias("missing_cells"))
    return out.withColumn("missing_share", F.try_divide("missing_cells", "cells"))


def unknown_values(train: DataFrame, other: DataFrame, feature: str, value: str) -> DataFrame:
    """Values of ``other`` that ``train`` never has, by feature: cells and different values."""
    vocabulary = train.filter(F.col(value).isNotNull()).select(feature, value).distinct()
    return other.filter(F.col(value).isNotNull()).join(vocabulary, [feature, value], "left_anti").groupBy(feature).agg(F.count(F.lit(1)).alias("unknown_cells"), F.count_distinct(value).alias("unknown_values"))

