"""Metrics over long (row, participant, target, truth, prediction) tables, comparisons of trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def macro_metrics(long: DataFrame, groups: Sequence[str] = (), row: str = "row", participant: str = "participant", y: str = "y", p: str = "p") -> DataFrame:
    """Participant-macro and visit-weighted RMSE and MAE, by aggregates of aggregates."""
    e = F.col(y) - F.col(p)
    per_row = long.groupBy(*groups, participant, row).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))
    per_person = per_row.groupBy(*groups, participant).agg(F.avg("mse").alias("pm"), F.avg("mae").alias("pa"), F.sum("mse").alias("sm"), F.sum("mae").alias("sa"), F.count(F.lit(1)).alias("k"))
    return per_person.groupBy(*groups).agg(
        F.avg(F.sqrt("pm")).alias("participant_macro_rmse"), F.avg("pa").alias("participant_macro_mae"),
        F.sqrt(F.sum("sm") / F.sum("k")).alias("visit_weighted_rmse"), (F.sum("sa") / F.sum("k")).alias("visit_weighted_mae"),
        F.count(F.lit(1)).alias("participants"), F.sum("k").alias("rows"),
    )


def target_scores(long: DataFrame, groups: Sequence[str] = (), target: str = "target", y: str = "y", p: str = "p") -> DataFrame:
    """R2 (a constant target scores 1 when predicted exactly, else 0) and Pearson (NULL without spread) by target."""
    e = F.col(y) - F.col(p)
    a = long.groupBy(*groups, target).agg(F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"), F.stddev_pop(y).alias("sy"), F.stddev_pop(p).alias("sp"), F.covar_pop(y, p).alias("c"))
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    pearson = F.when((F.col("sy") > 1e-12) & (F.col("sp") > 1e-12), F.col("c") / (F.col("sy") * F.col("sp")))
    return a.select(*groups, target, r2.alias("r2"), pearson.alias("pearson"), "sst", "sse")


def score_summary(scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Uniform and variance-weighted R2, medians and the share of positive R2."""
    return scores.groupBy(*groups).agg(
        F.avg("r2").alias("r2_uniform"), (1 - F.sum("sse") / F.sum("sst")).alias("r2_weighted"), F.percentile("pearson", 0.5).alias("median_pearson"),
        F.percentile("r2", 0.5).alias("median_r2"), F.avg((F.col("r2") > 0).cast("double")).alias("positive_r2_share"),
    )


def paired_difference(best: DataFrame, groups: Sequence[str], variant: str, base: str, other: str, metric: str) -> DataFrame:
    """Other minus base of a metric, absolute and in percent, by conditional aggregates."""
    a = best.groupBy(*groups).agg(F.max(F.when(F.col(variant) == base, F.col(metric))).alias("base"), F.max(F.when(F.col(variant) == other, F.col(metric))).alias("other"))
    d = F.col("other") - F.col("base")
    return a.filter("base IS NOT NULL AND other IS NOT NULL").select(*groups, "base", "other", d.alias("difference"), F.try_divide(d * 100, "base").alias("percent"))
