"""Exact quantiles of any number of columns and groups without an unbounded buffer: distributed selection.

A group of at most ``SMALL`` observed values is sorted where it is. Of larger ones different values are counted, which is the
only pass over their rows; the counts are dealt out by ranges of (group, column, value), and the ranges' totals, one row
each, tell in which range every wanted rank lies. Only these ranges are sorted, each by itself, and running counts give
the value. All columns, groups and ranks go through together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitloom.operators.tables import small_side
from visitloom.session import staged

#: Values of a group that are sorted in one place.
SMALL = 200_000


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def select_ranks(values: DataFrame, targets: DataFrame, names: Sequence[str]) -> DataFrame:
    """The value at each target's rank.

    ``values`` has the columns ``names`` and v (no nulls), ``targets`` has ``names`` and rank (from 0). The result has names, rank,
    value. Every group of ``targets`` has more than rank values.
    """
    counts = values.groupBy(*names, "v").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(*names, "v")
    counts = staged(counts.withColumn("range", F.spark_partition_id()), "rank-counts")  # the ranges stay what they are
    order = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy(*names, "range").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(order), F.lit(0)))
    at = (F.col("a.rank") >= F.col("b.before")) & (F.col("a.rank") < F.col("b.before") + F.col("b.m"))
    hit = staged(targets.alias("a").join(ranges.alias("b"), _same("a", "b", names) & at).select("a.*", "b.range", (F.col("a.rank") - F.col("b.before")).alias("k")), "rank-ranges")
    place = [*names, "range"]
    needed = counts.alias("a").join(small_side(hit.select(*place).distinct()).alias("b"), _same("a", "b", place), "left_semi")
    running = needed.withColumn("upto", F.sum("n").over(Window.partitionBy(*place).orderBy("v")))
    inside = (F.col("b.k") < F.col("a.upto")) & (F.col("b.k") >= F.col("a.upto") - F.col("a.n"))
    return running.alias("a").join(small_side(hit).alias("b"), _same("a", "b", place) & inside).select(*[F.col(f"b.{n}").alias(n) for n in names], "b.rank", F.col("a.v").alias("value"))


def exact_quantiles(df: DataFrame, groups: Sequence[str], columns: Sequence[str], shares: Sequence[float], small: int = SMALL, accuracy: int | None = None) -> DataFrame:
    """One row for each group and column: groups, feature (the column's name), n (observed values), q (the quantiles at ``shares``, linear between neighbours).

    A null group is a group. A column without observed values in a group has no row there. NaN counts as larger than all numbers.
    ``accuracy`` has no effect any more: nothing is sketched.
    """
    names = [*groups, "feature"]
    long = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(groups), list(columns), "feature", "v").filter("v IS NOT NULL")
    sizes = staged(long.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "sizes")
    asked = F.array(*[F.lit(float(s)) for s in shares])
    many = sizes.filter(F.col("n") > small)
    if many.isEmpty():
        return long.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.percentile("v", asked).alias("q"))
    few = sizes.filter(F.col("n") <= small)
    direct = long.alias("a").join(small_side(few.select(*names)).alias("b"), _same("a", "b", names), "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.percentile("v", asked).alias("q"))
    big = long.alias("a").join(small_side(many.select(*names)).alias("b"), _same("a", "b", names), "left_semi")
    wanted = many.select(*names, "n", F.posexplode(asked).alias("i", "share")).withColumn("place", F.col("share") * (F.col("n") - 1))
    wanted = wanted.withColumns({"below": F.floor("place"), "above": F.ceil("place")})
    targets = wanted.select(*names, "n", F.explode(F.array("below", "above")).alias("rank")).distinct()
    found = staged(select_ranks(big, targets, names), "ranks")
    at = lambda side: found.select(*[F.col(n).alias(f"__{side}{i}") for i, n in enumerate([*names, "rank"])], F.col("value").alias(f"v_{side}"))
    for side in ("below", "above"):
        on = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"__{side}{i}")) for i, n in enumerate([*names, side])])
        wanted = wanted.join(at(side), on)
    value = F.col("v_below") + (F.col("v_above") - F.col("v_below")) * (F.col("place") - F.col("below"))
    value = F.when(F.col("below") == F.col("above"), F.col("v_below")).otherwise(value)
    picked = wanted.groupBy(*names, "n").agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("a"))
    return direct.unionByName(picked.select(*names, "n", F.transform("a", lambda s: s["v"]).alias("q")))
