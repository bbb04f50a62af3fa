"""Filters, joins, set operations, sorting and selection over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side of at most so many rows may be broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it is measured to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# --- filters ---


def keyed(keys: Sequence[str]) -> Column:
    """all key columns are observed."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def split_keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """rows with a whole key, and the others (counted, never lost)."""
    return df.filter(keyed(keys)), df.filter(~keyed(keys))


def development(df: DataFrame, column: str = "split", splits: Sequence[str] = ("train", "validation")) -> DataFrame:
    """The development rows; the filter reaches a Parquet scan."""
    return df.filter(F.col(column).isin(*splits))


def with_content(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with any substantive cell."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])) if columns else df.limit(0)


def domain_violations(df: DataFrame, domains: Mapping[str, Sequence]) -> DataFrame:
    """one row: cells outside their domain by column, counted in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*d)).alias(c) for c, d in domains.items()])


def unsafe_in_time(previous: Column, current: Column) -> Column:
    """both days known and the previous one not before the current one."""
    return previous.isNotNull() & current.isNotNull() & (previous >= current)


def substantive(columns: Sequence[str], keys: Sequence[str], administrative: Sequence[str] = (), only: Sequence[str] | None = None) -> list[str]:
    """the columns that carry content."""
    if only is not None:
        return [c for c in columns if c in set(only)]
    return [c for c in columns if not c.startswith("__") and c not in {*keys, *administrative}]


# --- joins ---


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def left_join_one(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """A left join that keeps the left rows; with ``check`` a repeated right key is an error."""
    if check and not repeated_keys(right, keys).isEmpty():
        raise ValueError(f"the right side repeats keys {list(keys)}")
    return left.join(right, list(keys), "left")


def membership(left: DataFrame, right: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Whether the key stands on the right."""
    marked = right.select(*keys).distinct().withColumn(flag, F.lit(True))
    return left.join(marked, list(keys), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def semi_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J03 and S06 as a filter: rows whose key is in the key set."""
    return left.join(right.select(*keys), list(keys), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key stands not on the right."""
    return left.join(right.select(*keys), list(keys), "left_anti")


def left_join_marked(left: DataFrame, right: DataFrame, keys: Sequence[str], mark: str = "match") -> DataFrame:
    """A left join with ``both`` or ``left_only``."""
    return left.join(right.withColumn("__there", F.lit(True)), list(keys), "left").withColumn(mark, F.when(F.col("__there"), "both").otherwise("left_only")).drop("__there")


def precedence_lookup(base: DataFrame, lookups: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """The first lookup that knows the key decides; every lookup has keys and ``value``."""
    out, names = base, []
    for i, t in enumerate(lookups):
        names.append(f"__v{i}")
        out = out.join(t.select(*keys, F.col(value).alias(names[-1])), list(keys), "left")
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def compare_keyed(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row of counts: keys on one side alone, shared keys, and differing cells by column."""
    x = a.select(*keys, *[F.col(v).alias(f"__a_{v}") for v in values], F.lit(1).alias("__a"))
    y = b.select(*keys, *[F.col(v).alias(f"__b_{v}") for v in values], F.lit(1).alias("__b"))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return x.join(y, list(keys), "full").agg(
        F.count_if(F.col("__b").isNull()).alias("left_only"),
        F.count_if(F.col("__a").isNull()).alias("right_only"),
        F.count_if(both).alias("shared"),
        *[F.count_if(both & ~F.col(f"__a_{v}").eqNullSafe(F.col(f"__b_{v}"))).alias(f"diff_{v}") for v in values],
    )


# --- sets ---


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b lacks."""
    return a.subtract(b)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def distinct_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


# --- windows, order, selection ---


#: Rows of one key above which they are numbered in several stretches, and stretches of such a key.
HOT_ROWS, STRETCHES = 1_000_000, 64


def _stretch_ends(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int) -> DataFrame | None:
    """For every key of more than ``hot_rows`` rows the values of the order columns that begin its stretches, from a sample of
    its rows by hash; None without such a key."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n")
    if hot.isEmpty():
        return None
    every = F.greatest(F.lit(1).cast("long"), F.floor(F.col("__n") / (16 * STRETCHES)))
    chosen = df.join(small_side(hot), _on_keys(keys)).filter(F.pmod(F.xxhash64(*order), every) == 0)
    sample = chosen.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.array_sort(F.collect_set(_ordered(order))).alias("s"))
    step = F.greatest(F.lit(1), F.floor(F.size("s") / STRETCHES).cast("int"))
    return sample.select(*[f"__k{i}" for i in range(len(keys))], F.filter("s", lambda x, i: i % step == 0).alias("__ends"))


def _on_keys(keys: Sequence[str], other: str = "__k") -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{other}{i}")) for i, k in enumerate(keys)])


def _ordered(order: Sequence[str]) -> Column:
    """The order columns as one comparable value with NULL last."""
    return F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"o{i}"))])


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "position", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Positions from 1, NULL last; the last order column should be unique within a key.

    A key of more than ``hot_rows`` rows is numbered in two passes over stretches of its order: the
    rows of each stretch are counted, prefix sums say where it begins, and only a stretch is sorted in one task.
    """
    in_order = [F.col(c).asc_nulls_last() for c in order]
    ends = _stretch_ends(df, keys, order, hot_rows)
    if ends is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*in_order)))
    at = F.coalesce(F.size(F.filter("__ends", lambda e: e <= _ordered(order))), F.lit(0))
    placed = df.join(small_side(ends), _on_keys(keys), "left").withColumn("__at", F.when(F.col("__ends").isNull(), 0).otherwise(at)).select(*df.columns, "__at", F.col("__ends").isNotNull().alias("__hot"))
    counts = placed.filter("__hot").groupBy(*keys, "__at").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)  # at most STRETCHES + a few rows a key
    offsets = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__at").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    row = F.row_number().over(Window.partitionBy(*keys, "__at").orderBy(*in_order))
    joined = placed.withColumn("__row", row).join(small_side(offsets), _on_keys(keys) & (F.col("__at") == F.col("__b")), "left")
    return joined.select(*df.columns, (F.col("__row") + F.coalesce("__before", F.lit(0))).cast("int").alias(out))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], observed: str | None = None) -> DataFrame:
    """The first row of each key, or the first with ``observed`` known."""
    rows = df.filter(F.col(observed).isNotNull()) if observed else df
    return distinct_by(rows, keys, [F.col(c).asc_nulls_last() for c in order])


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; NULL counts as latest, as in W01."""
    return distinct_by(df, keys, [F.col(c).desc_nulls_first() for c in order])


def competition_rank(df: DataFrame, keys: Sequence[str], metric: str, out: str = "rank") -> DataFrame:
    """Equal values share the smallest rank."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(*keys).orderBy(F.col(metric).asc_nulls_last())))


def group_extreme(df: DataFrame, keys: Sequence[str], by: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows at the extreme of several columns in turn (``max`` or ``min``): one lexicographic rank."""
    order = [F.col(c).desc_nulls_last() if how == "max" else F.col(c).asc_nulls_last() for c, how in by]
    return df.withColumn("__rk", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rk = 1").drop("__rk")


def positions_consecutive(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Whether the positions of each key are exactly 1 to n."""
    return df.groupBy(*keys).agg(
        ((F.min(position) == 1) & (F.max(position) == F.count(F.lit(1))) & (F.count_distinct(position) == F.count(F.lit(1)))).alias("consecutive")
    )


def stable_sort(df: DataFrame, order: Sequence[str], unique: str) -> DataFrame:
    """NULL last; a unique last key makes the order total."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order], unique)


def best_candidates(df: DataFrame, order: Sequence[str], valid: str = "is_valid", n: int = 1) -> DataFrame:
    """The best valid candidates; a top-n, not a whole sort."""
    return df.filter(F.col(valid)).orderBy(*order).limit(n)


def best_configurations(trials: DataFrame, groups: Sequence[str], order: Sequence[str], converged: str, parameter: str) -> DataFrame:
    """The best trial of each group, converged ones first, and whether its parameter lies on the grid's edge."""
    g = Window.partitionBy(*groups)
    w = g.orderBy(F.col(converged).desc(), *order)
    ranked = trials.withColumns({"__rn": F.row_number().over(w), "__lo": F.min(parameter).over(g), "__hi": F.max(parameter).over(g)})
    edge = F.when(F.col("__lo") == F.col("__hi"), "single").when(F.col(parameter) == F.col("__lo"), "low").when(F.col(parameter) == F.col("__hi"), "high").otherwise("inside")
    return ranked.filter("__rn = 1").withColumn("boundary", edge).drop("__rn", "__lo", "__hi")
