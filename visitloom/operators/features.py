"""Feature profiles, type inference, schema, scenarios and the population they rest on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitloom.functions import scalars as S
from visitloom.operators import resolve as V
from visitloom.operators.aggregates import scope_profile
from visitloom.operators.tables import anti_join, left_join_one, membership, precedence_lookup, with_position

# Thresholds of type inference and patterns of names that ask for a review.
NUMERIC_SHARE, INTEGER_SHARE, LOW_CARDINALITY = 0.98, 0.98, 20
NAME_FLAGS = [
    ("identifier_name_pattern", r"(?i)(^|_)(RID|ID|UID|IMAGEUID|PTID|SITEID|ROWID|RECORDID)($|_)"),
    ("date_or_time_name_pattern", r"(?i)(DATE|TIME|TIMESTAMP|MONTH|YEAR|DAY)"),
    ("administrative_name_pattern", r"(?i)(PHASE|VISCODE|VERSION|STATUS|SOURCE|SITE|PROTOCOL|UPDATE|USER|COMMENT)"),
]


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, feature, value) with text values: the shape in which all features share one shuffle."""
    text = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot(list(keys), list(columns), "feature", "value")


def type_facts(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Counts by feature on which its type is inferred."""
    v = F.nullif(S.strip(F.col(value)), F.lit(""))
    x = S.number(v)
    multi = v.rlike("[|;]")
    tokens = S.multi_tokens(v)
    return long.select(feature, v.alias("v"), x.alias("x"), F.when(multi, F.size(tokens)).alias("k")).groupBy(feature).agg(
        F.count("v").alias("observed"), F.count_distinct("v").alias("distinct_values"), F.count("x").alias("numeric_cells"),
        F.count_if(F.abs(F.col("x") - F.round("x")) <= 1e-8 + 1e-5 * F.abs(F.round("x"))).alias("integer_cells"),
        F.count("k").alias("multi_cells"), F.coalesce(F.max("k"), F.lit(0)).alias("max_tokens"),
    )


def infer_types(facts: DataFrame, feature: str = "feature") -> DataFrame:
    """Suggested type, encoding and review flags of each feature."""
    numeric = F.try_divide("numeric_cells", "observed") >= NUMERIC_SHARE
    whole = F.try_divide("integer_cells", "numeric_cells") >= INTEGER_SHARE
    few = F.col("distinct_values") <= 2
    kind = (
        F.when(F.col("observed") == 0, "undetermined_all_missing")
        .when(F.col("multi_cells") > 0, "multi_response_candidate")
        .when(numeric & few, "binary_numeric_candidate")
        .when(numeric & (F.col("distinct_values") <= LOW_CARDINALITY) & whole, "categorical_numeric_code_candidate")
        .when(numeric, "numeric_candidate")
        .when(few, "binary_categorical_candidate")
        .otherwise("categorical_candidate")
    )
    encoding = (
        F.when(kind == "undetermined_all_missing", "manual_review").when(kind == "multi_response_candidate", "multi_hot")
        .when(kind == "binary_numeric_candidate", "binary_or_one_hot_review").when(kind == "categorical_numeric_code_candidate", "one_hot_or_numeric_review")
        .when(kind == "numeric_candidate", "numeric_median_imputation").otherwise("one_hot")
    )
    named = [F.when(F.col(feature).rlike(p), n) for n, p in NAME_FLAGS]
    flags = F.concat_ws(
        "|", *named,
        F.when(kind.isin("categorical_numeric_code_candidate", "binary_numeric_candidate"), "numeric_looking_code_requires_semantic_review"),
        F.when(kind == "multi_response_candidate", "multi_response_requires_token_semantics_review"),
        F.when((kind == "categorical_candidate") & (F.col("distinct_values") > 100), "high_cardinality_categorical"),
    )
    return facts.select("*", kind.alias("suggested_type"), encoding.alias("suggested_encoding"), flags.alias("review_flags"))


def profile_features(native: DataFrame, aligned: DataFrame, feature: str, value: str, participant: str) -> DataFrame:
    """Scope profile over native train rows and over anchor-aligned train rows, with the inferred type. Only train rows go in."""
    n = scope_profile(native, [feature], value, participant)
    a = scope_profile(aligned, [feature], value, participant)
    t = infer_types(type_facts(native, feature, value), feature)
    def pre(d: DataFrame, p: str) -> DataFrame:
        return d.select(feature, *[F.col(c).alias(f"{p}_{c}") for c in d.columns if c != feature])

    return pre(n, "native").join(pre(a, "aligned"), feature, "left").join(t.select(feature, "suggested_type", "suggested_encoding", "review_flags"), feature)


# --- schema ---


def directive_table(catalog: DataFrame, directives: DataFrame, legacy: DataFrame, keys: Sequence[str], value: str = "decision", default: str = "exclude") -> DataFrame:
    """The decision for every feature of the catalog: directive, else legacy, else the default."""
    return precedence_lookup(catalog, [directives, legacy], keys, value).withColumn(value, F.coalesce(F.col(value), F.lit(default)))


# How a baseline record was found and how it was judged.
WAVE_BASIS, DATE_BASIS, NO_BASIS, DATED = "earliest_protocol_wave", "earliest_available_clinical_date", "no_temporal_evidence", "+earliest_date_within_wave"
BASELINE_STATUS = {
    V.UNIQUE: "unique_temporal_candidate", V.EQUIVALENT: "same_time_equivalent_duplicate",
    V.DOMINANT: "same_time_unique_dominant_record", V.UNRESOLVED: "same_time_unresolved_conflict",
}
NO_EVIDENCE = "unresolved_no_temporal_evidence"


def refine_baseline(rows: DataFrame, person: str, wave: str, day: str, compared: Sequence[str]) -> DataFrame:
    """One baseline record for each person, and always one row for each person.

    Candidates are the rows of the earliest known wave, else of the earliest known day, else all;
    where several are left and one has a day, those of the earliest day. They are judged as any group (J09):
    cells of different rows are never merged. Without wave and day only equivalent rows resolve.

    Columns: person, candidates, basis, status, and the compared columns of the record that stays (NULL
    when unresolved). Aggregates by (person, wave, day), then (person, wave), then person: a person
    with a third of all rows is pre-aggregated, and no rows are joined back.
    """
    types = {f.name: f.dataType for f in rows.schema.fields}
    values = F.struct(*[F.col(c) for c in compared])
    facts = V.judgement(compared, types, S.row_hash(compared), F.col("__id"), F.struct(F.col("__id").alias("id"), values.alias("v")))
    late = lambda c: F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("at"))  # noqa: E731, nulls last
    rows = rows.withColumn("__id", F.monotonically_increasing_id())  # tells rows apart that are alike; read by one branch of the plan alone
    at = rows.groupBy(person, F.col(wave).alias("__w"), F.col(day).alias("__t")).agg(F.struct(*[c.alias(k) for k, c in facts.items()]).alias("__j"))
    by_wave = at.groupBy(person, "__w").agg(F.min_by(F.struct("__t", "__j"), late("__t")).alias("__b"), F.sum("__j.n").alias("__n"))
    first = by_wave.groupBy(person).agg(F.min_by(F.struct("__w", "__n", "__b"), late("__w")).alias("__f"))
    out = first.select(person, F.col("__f.__w").alias("w"), F.col("__f.__n").alias("nw"), F.col("__f.__b.__t").alias("t"), F.col("__f.__b.__j").alias("j"))
    several = F.when(F.col("w").isNull(), F.col("j.n")).otherwise(F.col("nw")) > 1
    basis = F.when(F.col("w").isNotNull(), WAVE_BASIS).when(F.col("t").isNotNull(), DATE_BASIS).otherwise(NO_BASIS)
    judged = V.verdict("j")
    status = F.when((basis == NO_BASIS) & judged.isin(V.DOMINANT, V.UNRESOLVED), NO_EVIDENCE)
    for k, v in BASELINE_STATUS.items():
        status = status.when(judged == k, v)
    out = out.select(
        person, F.col("j.n").alias("candidates"), F.when(several & F.col("t").isNotNull(), F.concat(basis, F.lit(DATED))).otherwise(basis).alias("basis"), status.alias("status"), F.col("j.pick.source.v").alias("v")
    )
    kept = F.col("status").isin(*[v for k, v in BASELINE_STATUS.items() if k != V.UNRESOLVED])
    return out.select(person, "candidates", "basis", "status", *[F.when(kept, F.col("v")[c]).alias(c) for c in compared])


def canonical_json(payload) -> str:
    """Sorted keys, no spaces, no NaN."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def decision_id(payload, digits: int = 24) -> str:
    """The first hex digits of the SHA-256 of the canonical JSON."""
    return hashlib.sha256(canonical_json(payload).encode()).hexdigest()[:digits]


def freeze_schema(schema: DataFrame, order: Sequence[str], upstream: Mapping[str, str]) -> str:
    """The decision id of a schema table (one row for each feature) and the ids it rests on."""
    rows = [r.asDict() for r in schema.orderBy(*order).collect()]
    return decision_id({"schema": rows, "upstream": dict(upstream)})


# --- population and scenarios ---


def supervised_population(targets: DataFrame, resolved: Mapping[str, DataFrame], unresolved: Mapping[str, DataFrame], keys: Sequence[str], order: Sequence[str], complete: str, content: Mapping[str, Sequence[str]]) -> DataFrame:
    """Target-complete visits in order, with flags for each source: available, conflict, resolved but empty, absent."""
    out = with_position(targets.filter(F.col(complete)), [keys[0]], order)
    for name, table in resolved.items():
        on = [k for k in keys if k in table.columns]
        seen = F.coalesce(*[F.col(c).cast("string") for c in content[name]]).isNotNull()
        some = table.groupBy(*on).agg(F.bool_or(seen).alias(f"__c_{name}"))
        out = left_join_one(out, some, on, check=False)
        u = unresolved.get(name)
        if u is not None:
            out = membership(out, u, [k for k in keys if k in u.columns], f"conflict_{name}")
        else:
            out = out.withColumn(f"conflict_{name}", F.lit(False))
        c = F.col(f"__c_{name}")
        out = out.withColumns({f"available_{name}": F.coalesce(c, F.lit(False)), f"empty_{name}": F.coalesce(~c, F.lit(False)), f"absent_{name}": c.isNull() & ~F.col(f"conflict_{name}")}).drop(f"__c_{name}")
    n = sum((F.col(f"available_{s}").cast("int") for s in resolved), F.lit(0))
    level = F.when(F.col("available_count") == 0, "no_input_modality_available").when(F.col("available_count") == len(resolved), "all_input_modalities_available").otherwise("partially_available_inputs")
    out = out.withColumn("available_count", n)
    return out.withColumns({"completeness": level, "combination": S.combination_label({s: F.col(f"available_{s}") for s in resolved}), "pattern": S.pattern_label({s: F.col(f"available_{s}") for s in resolved})})


def participant_rollup(anchor: DataFrame, person: str, sources: Sequence[str]) -> DataFrame:
    """Visits, class, and any / first / all availability and rates by participant."""
    return anchor.groupBy(person).agg(
        F.count(F.lit(1)).alias("visits"), S.longitudinal_class(F.count(F.lit(1))).alias("longitudinal_class"),
        F.min_by("pattern", "position").alias("first_pattern"), F.avg("available_count").alias("modality_count_mean"),
        *[F.bool_or(f"available_{s}").alias(f"any_{s}") for s in sources], *[F.bool_and(f"available_{s}").alias(f"all_{s}") for s in sources],
        *[F.avg(F.col(f"available_{s}").cast("int")).alias(f"rate_{s}") for s in sources],
    )


def first_observed(anchor: DataFrame, attribute: DataFrame, keys: Sequence[str], value: str, position: str = "position") -> DataFrame:
    """The first observed value by position, with its position."""
    j = anchor.select(*keys, position).join(attribute.filter(F.col(value).isNotNull()).select(*keys, value), list(keys))
    return j.groupBy(keys[0]).agg(F.min_by(value, position).alias(value), F.min(position).alias(position))


def snapshot_all(anchor: DataFrame) -> DataFrame:
    """Every target visit."""
    return anchor.withColumn("scenario", F.lit("snapshot_all"))


def snapshot_matched(anchor: DataFrame, pairs: DataFrame, person: str, code: str) -> DataFrame:
    """The last visit of the participants that have an eligible pair."""
    ok = pairs.filter("status = 'eligible'").select(F.col(person).alias("__p"), F.col("current_code").alias("__c"))
    return anchor.join(ok, (F.col(person) == F.col("__p")) & (F.col(code) == F.col("__c")), "left_semi").withColumn("scenario", F.lit("snapshot_matched"))


def longitudinal(anchor: DataFrame, pairs: DataFrame, features: DataFrame, person: str, code: str, columns: Sequence[str]) -> DataFrame:
    """As ``snapshot_matched`` with the features of the previous visit beside the current ones."""
    ok = pairs.filter("status = 'eligible'").select(F.col(person).alias("__p"), F.col("current_code").alias("__c"), F.col("previous_code").alias("previous_code"))
    cur = anchor.join(ok, (F.col(person) == F.col("__p")) & (F.col(code) == F.col("__c"))).drop("__p", "__c")
    now = features.select(F.col(person).alias("__p"), F.col(code).alias("__c"), *[F.col(c).alias(f"current__{c}") for c in columns])
    then = features.select(F.col(person).alias("__q"), F.col(code).alias("__d"), *[F.col(c).alias(f"previous__{c}") for c in columns])
    a = cur.join(now, (F.col(person) == F.col("__p")) & (F.col(code) == F.col("__c")), "left").drop("__p", "__c")
    b = a.join(then, (F.col(person) == F.col("__q")) & (F.col("previous_code") == F.col("__d")), "left").drop("__q", "__d")
    return b.withColumn("scenario", F.lit("longitudinal"))


def availability_timeline(sources: Mapping[str, DataFrame], keys: Sequence[str], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """By visit the number of sources with content, of observed features, and the list of sources."""
    parts = [t.select(*keys, F.lit(s).alias("source"), S.observed_count(columns[s]).alias("n")).filter("n > 0") for s, t in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.count_distinct("source").alias("sources"), F.sum("n").alias("features"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("items"))


def rebuilt_source(selected: DataFrame, excluded: DataFrame) -> DataFrame:
    """U01 within R12: a source from its selected and its excluded rows."""
    return selected.unionByName(excluded, allowMissingColumns=True)


def unselected(source: DataFrame, selected: DataFrame) -> DataFrame:
    return anti_join(source, selected, ["__source_row"])


def safe_percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part * 100, whole), 6)


def running_positions(df: DataFrame, person: str, position: str) -> DataFrame:
    """Position minus row number by participant: 0 throughout for positions 1 to n."""
    return df.withColumn("shift", F.col(position) - F.row_number().over(Window.partitionBy(person).orderBy(position)))
