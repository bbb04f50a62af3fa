"""Time: date profiles of visits, the previous visit of a current one, and policies for ties."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitloom.operators.features import decision_id
from visitloom.operators.tables import unsafe_in_time

# Reasons of pairing, date states, and the explicit order of codes at month 0.
ELIGIBLE_UNIQUE, ELIGIBLE_STRICT = "eligible_unique_previous_visit", "eligible_strict_date_interval_winner"
NO_MONTH, NO_HISTORY, NO_EARLIER = "current_target_unknown_protocol_month", "no_strictly_earlier_known_protocol_visit", "only_unknown_or_non_earlier_history"
NO_WINNER, NO_CURRENT_DATE, NOT_BEFORE = "ambiguous_same_wave_no_strict_interval_winner", "ambiguous_same_wave_current_date_unavailable", "strict_latest_not_fully_before_current"
BY_MONTH, BY_DATES = "unique_most_recent_prior_protocol_month", "strict_date_intervals"
ZERO_ORDER = ("sc", "scmri", "bl", "m00")


def _day(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(days).cast("int"))


def date_profile(evidence: DataFrame, keys: Sequence[str], day: str, source: str, column: str) -> DataFrame:
    """By visit over long (day, source, column) evidence: extremes, median day, counts, span and status.

    Different days and fields are sets in the one aggregate, bounded by the number of days and of fields there are, so no row is multiplied for them.
    """
    d = evidence.filter(F.col(day).isNotNull())
    facts = d.groupBy(*keys).agg(
        F.min(day).alias("date_min"), F.max(day).alias("date_max"), F.percentile(F.unix_date(day), 0.5).alias("__med"),
        F.count(F.lit(1)).alias("observed_cells"), F.collect_set(F.unix_date(day)).alias("__days"), F.collect_set(F.struct(F.col(source).alias("s"), F.col(column).alias("c"))).alias("__fields"),
    )
    whole = F.size(F.filter("__fields", lambda f: f["s"].isNotNull() & f["c"].isNotNull()))
    sources = F.size(F.array_distinct(F.filter(F.col("__fields.s"), lambda s: s.isNotNull())))
    out = facts.select("*", F.size("__days").cast("long").alias("distinct_dates"), sources.cast("long").alias("sources"), whole.cast("long").alias("fields"))
    span = F.datediff("date_max", "date_min")
    status = F.when(span == 0, "exact_date_consensus").when(span <= 7, "date_range_within_7_days").when(span <= 30, "date_range_8_to_30_days").otherwise("date_range_over_30_days")
    return out.select(*keys, "date_min", "date_max", _day(F.col("__med")).alias("date_median"), "observed_cells", "distinct_dates", "sources", "fields", span.alias("span_days"), status.alias("status"))


def with_date_profile(visits: DataFrame, profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Visits with their profile; a visit without any day has the status ``no_clinical_date``."""
    return visits.join(profile, list(keys), "left").withColumn("status", F.coalesce("status", F.lit("no_clinical_date")))


#: A policy takes the only candidate at the largest value (a number), if every candidate is allowed.
Policy = tuple[Column, Column]


def by_consensus() -> Policy:
    """All candidates have one exact date each, and one is latest."""
    return F.unix_date("date_min"), F.col("status") == "exact_date_consensus"


def by_median() -> Policy:
    """All candidates are dated, and one has the latest median."""
    return F.unix_date("date_median"), F.col("date_min").isNotNull()


def by_explicit_order(code: Column, order: Sequence[str] = ZERO_ORDER) -> Policy:
    """The last of a fixed order of codes, if all candidates are in it."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), code), code.isin(*order)


def decide_ties(candidates: DataFrame, keys: Sequence[str], code: str, policies: Mapping[str, Policy], low: str = "date_min", high: str = "date_max", carry: Sequence[str] = (), extremes: Sequence[str] = ()) -> DataFrame:
    """By key the number of candidates, how many are dated, the strict winner, and the winner under each policy; NULL where one decides nothing.

    ``candidates`` holds a code of a key once; a key may be null, which is a key like any other. ``strict`` is the candidate whose first
    day lies after the last day of every other, if all are dated; a single candidate gives NULL there. ``last`` is the candidate that
    ends last (ties: the later beginning, the larger code), with its days and the columns of ``carry``; ``next_high`` is the last
    day of the others. Of each column of ``extremes`` there are ``min_`` and ``max_`` over the key.

    Two aggregates with partial steps and no join: by key and last day, then by key over its last days. So a key
    with any number of candidates is spread over its days, and what is listed for a key is bounded by the number of days there are.
    A maximum is unique when the largest and the smallest code at it are the same.
    """
    rows = candidates.select(*keys, low, high, code, *carry, *[F.col(c).alias(f"__x_{c}") for c in extremes], *[c for n, (v, ok) in policies.items() for c in (v.alias(f"__v_{n}"), F.coalesce(ok, F.lit(False)).alias(f"__ok_{n}"))])
    at = [
        c for n in policies for v in [F.col(f"__v_{n}")]
        for c in (
            F.max(F.when(v.isNotNull(), F.struct(v, code))).alias(f"__hi_{n}"),
            F.min(F.when(v.isNotNull(), F.struct((-v).alias("__neg"), code))).alias(f"__lo_{n}"), F.bool_and(f"__ok_{n}").alias(f"__ok_{n}"),
        )
    ] + [f(f"__x_{c}").alias(f"{n}_{c}") for c in extremes for n, f in (("min", F.min), ("max", F.max))]
    days = rows.groupBy(*keys, high).agg(F.count(F.lit(1)).alias("__n"), F.count(low).alias("__d"), F.max(F.struct(low, code, *carry)).alias("__top"), *at)
    merged = [c for n in policies for c in (F.max(f"__hi_{n}").alias(f"__hi_{n}"), F.min(f"__lo_{n}").alias(f"__lo_{n}"), F.bool_and(f"__ok_{n}").alias(f"__ok_{n}"))]
    merged += [f(f"{n}_{c}").alias(f"{n}_{c}") for c in extremes for n, f in (("min", F.min), ("max", F.max))]
    out = days.groupBy(*keys).agg(
        F.sum("__n").alias("candidates"), F.sum("__d").alias("dated"), F.slice(F.sort_array(F.collect_list(F.struct(high, "__top", "__n")), False), 1, 2).alias("__ends"), *merged
    )
    first, then = F.get("__ends", F.lit(0)), F.get("__ends", F.lit(1))
    last = F.struct(first[high].alias(high), *[first["__top"][c].alias(c) for c in (low, code, *carry)])
    next_high = F.when(first["__n"] > 1, first[high]).otherwise(then[high])
    wins = (F.col("candidates") > 1) & (F.col("candidates") == F.col("dated")) & (F.col(f"last.{low}") > F.col("next_high"))
    out = out.select("*", last.alias("last"), next_high.alias("next_high"))
    unique = [F.when(F.col(f"__ok_{n}") & (F.col(f"__hi_{n}")[code] == F.col(f"__lo_{n}")[code]), F.col(f"__hi_{n}")[code]).alias(n) for n in policies]
    return out.select(*keys, "candidates", "dated", "last", "next_high", F.when(wins, F.col("last")[code]).alias("strict"), *unique, *[f"{n}_{c}" for c in extremes for n in ("min", "max")])


def strict_interval_winner(candidates: DataFrame, keys: Sequence[str], code: str, low: str = "date_min", high: str = "date_max", least: int = 1) -> DataFrame:
    """The strict winner of each key with at least ``least`` candidates (see ``decide_ties``)."""
    out = decide_ties(candidates, keys, code, {}, low, high)
    return out.filter(F.col("candidates") >= least).select(*keys, F.col("strict").alias("winner"))


def coverage_label(dated: Column, candidates: Column) -> Column:
    """Whether none, some or all candidates are dated."""
    return F.when(dated == 0, "none_dated").when(dated == candidates, "all_dated").otherwise("partially_dated")


def median_gaps(c: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """Days between the medians of each pair of dated candidates of one key (a handful of tied visits)."""
    d = c.filter(F.col("date_median").isNotNull())
    a, b = d.select(*keys, F.col(code).alias("first"), F.col("date_median").alias("x")), d.select(*keys, F.col(code).alias("second"), F.col("date_median").alias("y"))
    return a.join(b, list(keys)).filter("first < second").select(*keys, "first", "second", F.abs(F.datediff("y", "x")).alias("gap_days"))


def pair_previous(current: DataFrame, visits: DataFrame, person: str, code: str, month: str, boundary: bool = True) -> DataFrame:
    """The previous visit of each current visit.

    ``current`` has one row for each person, ``visits`` one for each (person, code); both sides have
    (person, code, month) and the date profile columns. Of the visits of an earlier month the latest
    month's are the candidates; one is taken, several are decided by strict date intervals as in
    ``strict_interval_winner``, whose winner must end before the current visit begins
    (``boundary``). Everything else is excluded with its reason. Visits are first reduced to one row for each
    person and month (``decide_ties``), then to one list of months for each person, which meets the current visit: visits
    themselves never move by person, and no table is joined with itself. ``visits`` is read once.
    """
    cur = current.select(person, F.col(code).alias("current_code"), F.col(month).alias("current_month"), F.col("date_min").alias("__cmin"), F.col("date_median").alias("__cmed"))
    hist = visits.select(F.col(person).alias("__p"), F.col(code).alias("code"), F.col(month).alias("month"), "date_min", "date_max", "date_median")
    waves = decide_ties(hist, ["__p", "month"], "code", {}, carry=["date_median"])
    wins = (F.col("candidates") == 1) | F.col("strict").isNotNull()
    wave = F.struct("month", "candidates", *[F.when(wins, F.col(f"last.{c}")).alias(n) for c, n in (("code", "pick"), ("date_max", "pmax"), ("date_median", "pmed"))])
    seen = waves.groupBy("__p").agg(F.collect_list(wave).alias("__waves"))
    earlier = F.array_max(F.filter("__waves", lambda w: w["month"] < F.col("current_month")))
    facts = cur.join(seen, F.col(person) == F.col("__p"), "left").withColumns(
        {"__before": earlier, "__other": F.exists("__waves", lambda w: w["month"].isNull() | (w["month"] >= F.col("current_month")))}
    )
    all_ = facts.select(
        *cur.columns, "__other", F.col("__before.month").alias("__latest"), *[F.col(f"__before.{c}").alias(n) for c, n in (("candidates", "candidates"), ("pick", "__pick"), ("pmax", "__pmax"), ("pmed", "__pmed"))]
    )
    late = F.lit(boundary) & ~F.coalesce(F.col("__pmax") < F.col("__cmin"), F.lit(False))
    reason = (
        F.when(F.col("current_month").isNull(), NO_MONTH)
        .when(F.col("__latest").isNull() & F.coalesce("__other", F.lit(False)), NO_EARLIER)
        .when(F.col("__latest").isNull(), NO_HISTORY)
        .when(F.col("candidates") == 1, ELIGIBLE_UNIQUE)
        .when(F.col("__pick").isNull(), NO_WINNER)
        .when(F.lit(boundary) & F.col("__cmin").isNull(), NO_CURRENT_DATE)
        .when(late, NOT_BEFORE)
        .otherwise(ELIGIBLE_STRICT)
    )
    ok = F.col("reason").isin(ELIGIBLE_UNIQUE, ELIGIBLE_STRICT)
    method = F.when(F.col("__latest").isNull() | F.col("current_month").isNull(), "none").when(F.col("candidates") == 1, BY_MONTH).otherwise(BY_DATES)
    return all_.withColumn("reason", reason).select(
        person, "current_code", "current_month", F.when(ok, F.col("__pick")).alias("previous_code"), F.when(ok, F.col("__latest")).alias("previous_month"),
        F.when(ok, "eligible").otherwise("excluded").alias("status"), "reason", method.alias("method"), F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.when(ok, F.col("current_month") - F.col("__latest")).alias("gap_months"), F.when(ok, F.datediff("__cmin", "__pmax")).alias("conservative_gap_days"),
        F.when(ok, F.datediff("__cmed", "__pmed")).alias("median_gap_days"),
    )


def same_wave_audit(visits: DataFrame, keys: Sequence[str], code: str, order: Sequence[str] = ZERO_ORDER, least: int = 1) -> DataFrame:
    """Every key of at least ``least`` visits with what each tie policy decides: strict, consensus, median and explicit_order
    winner, how many of the dated policies decide, whether any two of them disagree, date coverage and the widest gap between medians.
    """
    policies = {"consensus": by_consensus(), "median": by_median(), "explicit_order": by_explicit_order(F.col(code).cast("string"), order)}
    out = decide_ties(visits, keys, code, policies, extremes=["date_median"]).filter(F.col("candidates") >= least)
    out = out.select(
        *keys, "candidates", F.datediff("max_date_median", "min_date_median").alias("widest_gap_days"), coverage_label(F.col("dated"), F.col("candidates")).alias("coverage"), "strict", *policies
    )
    dated = [F.col(c) for c in ("strict", "consensus", "median")]
    decided = sum((c.isNotNull().cast("int") for c in dated[1:]), dated[0].isNotNull().cast("int"))
    return out.withColumns({"decided_by": decided, "disagree": F.coalesce(F.greatest(*dated) != F.least(*dated), F.lit(False))})


def strict_date_freeze(pairs: DataFrame, policy: Mapping[str, object]) -> tuple[DataFrame, dict]:
    """The eligible pairs with the id of the policy they were made by, and the lock: policy, its id and the number of pairs."""
    lock_id = decision_id(dict(policy))
    frozen = pairs.filter("status = 'eligible'").withColumn("policy_id", F.lit(lock_id))
    return frozen, {"policy": dict(policy), "policy_id": lock_id}


def check_lock(lock: Mapping[str, object], policy: Mapping[str, object]) -> None:
    """A lock holds only for the very policy it was made with."""
    if decision_id(dict(policy)) != lock["policy_id"] or lock["policy"] != dict(policy):
        raise ValueError("the pairs were frozen under another policy")


def current_visits(visits: DataFrame, person: str, order: Sequence[str]) -> DataFrame:
    """The last visit of each person, as the largest struct of the order columns: a partial aggregate."""
    cols = visits.columns
    key = [F.col(c).isNull().alias(f"__n{i}") for i, c in enumerate(order)]
    order_struct = F.struct(*[x for k, c in zip(key, order, strict=True) for x in (k, F.col(c))])
    return visits.groupBy(person).agg(F.max_by(F.struct(*cols), order_struct).alias("s")).select("s.*")


def exclusion_actions(pairs: DataFrame, dates: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """Pairs and sources whose previous day is not before the current day.

    ``pairs``: keys and current_date; ``dates``: keys, source and previous_date.
    """
    j = pairs.join(dates, list(keys)).filter(unsafe_in_time(F.col("previous_date"), F.col("current_date")))
    kind = F.when(F.col("previous_date") == F.col("current_date"), "same_day").otherwise("after_current")
    return j.select(*keys, source, kind.alias("action"))


def apply_exclusions(pairs: DataFrame, content: DataFrame, actions: DataFrame, keys: Sequence[str], source: str, n: str) -> DataFrame:
    """Pairs with what stays of their previous visit: flags, source count, features, source list; pairs left with nothing are marked."""
    kept = content.join(actions.select(*keys, source), [*keys, source], "left_anti")
    rest = kept.groupBy(*keys).agg(F.count_distinct(source).alias("sources"), F.sum(n).alias("features"), F.array_join(F.array_sort(F.collect_set(source)), "|").alias("items"))
    flags = actions.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(source)), "|").alias("excluded"))
    out = pairs.join(rest, list(keys), "left").join(flags, list(keys), "left")
    return out.select(*pairs.columns, F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("features", F.lit(0)).alias("features"), F.coalesce("items", F.lit("")).alias("items"), F.coalesce("excluded", F.lit("")).alias("excluded"), (F.coalesce("features", F.lit(0)) > 0).alias("retained"))


def follow_up(visits: DataFrame, person: str, day: str, month: str) -> DataFrame:
    """Months of follow-up: by dates if two visits are dated, else by protocol months, else 0."""
    a = visits.groupBy(person).agg(F.count(day).alias("d"), F.datediff(F.max(day), F.min(day)).alias("days"), F.count(month).alias("m"), (F.max(month) - F.min(month)).alias("months"))
    return a.select(person, F.when(F.col("d") >= 2, F.col("days") / 30.4375).when(F.col("m") >= 2, F.col("months").cast("double")).otherwise(0.0).alias("followup_months"))


def visit_order(df: DataFrame, person: str, order: Sequence[str]) -> DataFrame:
    """Positions of visits, and the previous and next code: for reports over single persons' few visits."""
    w = Window.partitionBy(person).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("position", F.row_number().over(w))
