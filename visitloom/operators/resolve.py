"""Record resolution: one row for each key without ever merging cells of different rows.

Groups are judged by aggregates alone, in time linear in their rows. For a group and a column, the
observed cells disagree when the smallest and the largest equality key differ. Without
disagreement, a row covers the group when it observes every column that any row observes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.functions import scalars as S
from visitloom.operators.tables import keyed, substantive
from visitloom.session import staged

# Outcomes of resolution.
UNIQUE, EQUIVALENT, DOMINANT, UNRESOLVED = "unique_record", "exact_or_equivalent_duplicate", "dominant_record", "unresolved_conflict"
ONE_CANDIDATE, MOST_COMPLETE = "unique_candidate", "unique_maximum_target_completeness"
EQUAL_TARGETS, TARGET_CONFLICT = "equivalent_maximum_target_candidates", "unresolved_maximum_target_conflict"


@dataclass(frozen=True)
class Contract:
    """Grain and columns of a source: ``visit``, ``participant`` or ``participant_baseline``."""

    name: str
    grain: str
    keys: tuple[str, ...]
    required: tuple[str, ...] = ()
    administrative: tuple[str, ...] = ()
    compared: tuple[str, ...] | None = None
    code_column: str = "VISCODE2"
    date_columns: tuple[str, ...] = ("VISDATE", "EXAMDATE")
    extra: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.keys or not set(self.keys) <= {*self.required, *self.keys}:
            raise ValueError(f"{self.name}: keys must be required columns")

    def compare(self, columns: Sequence[str]) -> list[str]:
        return substantive(columns, self.keys, self.administrative, self.compared)


def with_source_row(df: DataFrame) -> DataFrame:
    """An explicit row number for tables that come without one; numbers are not gapless.

    The numbered rows are written once: plans meet on the number from several sides, and a number
    made anew in each of them could differ after a shuffle or a lost executor. Give it narrow tables.
    """
    return df if "__source_row" in df.columns else staged(df.withColumn("__source_row", F.monotonically_increasing_id()), "numbered")


def _key(c: str, types: Mapping[str, T.DataType]) -> Column:
    if isinstance(types[c], T.StringType):
        return F.when(F.col(c).isNotNull(), S.equality_key(F.col(c)))
    return F.col(c)


def earliest_wave(df: DataFrame, contract: Contract) -> DataFrame:
    """Baseline grain: the rows of the earliest known wave of each key, else of the earliest known date, else all."""
    if contract.grain != "participant_baseline" or contract.code_column not in df.columns:
        return df
    dated = next((c for c in contract.date_columns if c in df.columns), None)
    day = S.parse_day(F.col(dated).cast("string")) if dated else F.lit(None).cast("date")
    rows = df.withColumns({"__m": S.protocol_month(F.col(contract.code_column)), "__d": day})
    first = rows.groupBy(*contract.keys).agg(F.min("__m").alias("__m0"), F.min("__d").alias("__d0"))
    near = F.when(F.col("__m0").isNotNull(), F.col("__m") == F.col("__m0")).when(F.col("__d0").isNotNull(), F.col("__d") == F.col("__d0")).otherwise(True)
    return rows.join(first, list(contract.keys)).filter(near).drop("__m", "__d", "__m0", "__d0")


def judgement(columns: Sequence[str], types: Mapping[str, T.DataType], order: Column, row: Column, source: Column | None = None) -> dict[str, Column]:
    """J09 and W06 as aggregates of a group's rows, without pairs: n, least, conflict, all, pick, first, last.

    ``all`` counts the columns that any row observes. A row observes at most those, so the rows that
    cover the group are the ones with the most observed columns, if these are all; ``pick`` is the one
    of them with the smallest (order, source, row), ``first`` and ``last`` the ones with the smallest and the largest row, so that
    only one row covers when both are the same.
    """
    seen = S.observed_count(columns) if columns else F.lit(0)
    disagree = [F.coalesce(F.min(_key(c, types)) != F.max(_key(c, types)), F.lit(False)) for c in columns]
    any_seen = [F.max(F.col(c).isNotNull().cast("int")) for c in columns]
    return {
        "n": F.count(F.lit(1)),
        "least": F.min(seen),
        "conflict": reduce(lambda a, b: a | b, disagree) if disagree else F.lit(False),
        "all": reduce(lambda a, b: a + b, any_seen) if any_seen else F.lit(0),
        "pick": F.min(F.struct((-seen).alias("seen"), order.alias("order"), *([] if source is None else [source.alias("source")]))),
        "first": F.min(F.struct((-seen).alias("seen"), row.alias("row"))),
        "last": F.max(F.struct(seen.alias("seen"), row.alias("row"))),
    }


def verdict(of: str = "") -> Column:
    """The outcome of a group from its judgement, which stands in columns or in the struct column ``of``."""
    c = {k: F.col(f"{of}.{k}" if of else k) for k in ("n", "least", "conflict", "all", "first", "last")}
    covered = (c["last"]["seen"] == c["all"]) & (c["first"]["row"] == c["last"]["row"])
    return F.when(c["n"] == 1, UNIQUE).when(c["conflict"], UNRESOLVED).when(c["least"] == c["all"], EQUIVALENT).when(covered, DOMINANT).otherwise(UNRESOLVED)


def judge_groups(df: DataFrame, keys: Sequence[str], columns: Sequence[str], unique: Column) -> DataFrame:
    """One row for each key, in one aggregate: n, status, and ``__kept``, the value of ``unique`` in the row to keep (NULL when unresolved).
    Where rows have a ``__source_row``, ``__chosen`` is the smallest one of the rows with that value.

    The kept row is the covering one with the smallest ``unique`` (W06); a key's only row is kept as it is.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.withColumn("__id", F.monotonically_increasing_id())  # tells rows apart that are alike, in this aggregate alone
    numbered = "__source_row" in df.columns
    facts = judgement(columns, types, unique, F.col("__id"), F.col("__source_row") if numbered else None)
    stats = rows.groupBy(*keys).agg(F.struct(*[c.alias(k) for k, c in facts.items()]).alias("__j"))
    out = stats.select(*keys, F.col("__j.n").alias("n"), verdict("__j").alias("status"), F.col("__j.pick.order").alias("__order"), *([F.col("__j.pick.source").alias("__row")] if numbered else []))
    kept = lambda c: F.when(F.col("status") != UNRESOLVED, F.col(c))
    return out.select(*keys, "n", "status", kept("__order").alias("__kept"), *([kept("__row").alias("__chosen")] if numbered else []))


@dataclass
class Resolution:
    """Resolved rows, unresolved keys, and the judgement of every key; rows without a whole key are counted in the summary.

    A row is known by its key and row hash; of rows that are alike in all cells any one stands for the others. Nothing wide is written.
    """

    source: DataFrame
    contract: Contract
    judged: DataFrame

    def resolved(self) -> DataFrame:
        keys = list(self.contract.keys)
        j = self.judged.filter(F.col("__kept").isNotNull()).select(*keys, F.col("__kept").alias("__row_hash"), F.col("status").alias("__resolution_status"))
        return self.source.join(j, [*keys, "__row_hash"]).dropDuplicates([*keys, "__row_hash"]).select(*[c for c in self.source.columns if c != "__row_hash"], "__resolution_status")

    def unresolved(self) -> DataFrame:
        return self.judged.filter(F.col("__kept").isNull()).select(
            *self.contract.keys, F.lit(self.contract.name).alias("source_name"), F.col("group_rows").alias("n_source_rows"), F.col("n").alias("n_candidate_rows"), F.col("status").alias("resolution_status")
        )

    def summary(self) -> DataFrame:
        """One row of counts; the identities rows = valid + missing and groups = resolved + unresolved hold in it."""
        rows = self.source.agg(F.count(F.lit(1)).alias("original_rows"), F.count_if(keyed(self.contract.keys)).alias("valid_key_rows"))
        groups = self.judged.agg(
            F.count(F.lit(1)).alias("valid_key_groups"),
            F.count_if(F.col("group_rows") > 1).alias("duplicate_groups"),
            F.count_if(F.col("__kept").isNotNull()).alias("resolved_rows"),
            *[F.count_if(F.col("status") == s).alias(s) for s in (UNIQUE, EQUIVALENT, DOMINANT, UNRESOLVED)],
        )
        return rows.crossJoin(groups)  # two rows of counts, one each

    def ledger(self) -> DataFrame:
        """Every source row with its action, reason and group size.

        Numbered rows meet the judgement of their key once. Where they come without a number, keys, hashes and numbers are written once, as two branches read them.
        """
        keys = list(self.contract.keys)
        if "__source_row" in self.source.columns:
            j = self.judged.select(*keys, "group_rows", F.col("status").alias("__st"), "__chosen", F.lit(True).alias("__judged"))
            return self._actions(self.source.select(*keys, "__source_row").join(j, keys, "left"), F.col("__judged").isNull() | (F.col("__st") == UNRESOLVED))
        rows = with_source_row(self.source.select(*keys, "__row_hash", *[c for c in self.source.columns if c == "__source_row"]))
        j = self.judged.select(*keys, "group_rows", F.col("status").alias("__st"), "__kept")
        alike = rows.join(j.select(*keys, F.col("__kept").alias("__row_hash")), [*keys, "__row_hash"])
        chosen = alike.groupBy(*keys).agg(F.min("__source_row").alias("__chosen"))
        return self._actions(rows.join(j.join(chosen, keys, "left"), keys, "left"), F.col("__kept").isNull())

    def _actions(self, out: DataFrame, unresolved: Column) -> DataFrame:
        keys = list(self.contract.keys)
        reason = (
            F.when(~keyed(keys), "missing_key")
            .when(unresolved, "unresolved_group")
            .when(F.col("__chosen") == F.col("__source_row"), F.col("__st"))
            .otherwise("not_selected")
        )
        action = F.when(F.col("__chosen") == F.col("__source_row"), "selected").otherwise("excluded")
        return out.select("__source_row", *keys, action.alias("action"), reason.alias("reason"), F.coalesce("group_rows", F.lit(0)).alias("group_rows"))


def resolve(df: DataFrame, contract: Contract) -> Resolution:
    """Resolves a source by its contract."""
    real = [c for c in df.columns if not c.startswith("__")]
    source = df.withColumn("__row_hash", S.row_hash(real))
    valid = source.filter(keyed(contract.keys))
    candidates = earliest_wave(valid, contract)
    judged = judge_groups(candidates, contract.keys, contract.compare(real), F.col("__row_hash"))
    if candidates is valid:
        return Resolution(source, contract, judged.withColumn("group_rows", F.col("n")))
    sizes = valid.groupBy(*contract.keys).agg(F.count(F.lit(1)).alias("group_rows"))
    return Resolution(source, contract, judged.join(sizes, list(contract.keys)))


def resolve_all(sources: Mapping[str, DataFrame], contracts: Mapping[str, Contract]) -> dict[str, Resolution]:
    """Every source by its contract, in registry order; the plans are independent."""
    return {name: resolve(sources[name], c) for name, c in contracts.items() if name in sources}


def resolve_by_completeness(df: DataFrame, keys: Sequence[str], targets: Sequence[str], image: str, rtol: float = 1e-6, atol: float = 1e-8) -> DataFrame:
    """One row for each key: n, n_best, best_count, status, ``__source_row`` (NULL when unresolved).

    The most observed targets win. Ties that agree with their first row (smallest image id, then
    row hash) within the tolerance, NULL with NULL, give that row; others stay unresolved.
    """
    real = [c for c in df.columns if not c.startswith("__")]
    numbered = df if "__source_row" in df.columns else df.withColumn("__source_row", F.monotonically_increasing_id())
    rows = numbered.filter(keyed(keys)).select(
        *keys, "__source_row", F.col(image).cast("long").alias("__image"), S.row_hash(real).alias("__hash"),
        F.array(*[F.col(t).cast("double") for t in targets]).alias("__t"), S.observed_count(targets).alias("__n"),
    )
    best = rows.groupBy(*keys).agg(F.max("__n").alias("best_count"), F.count(F.lit(1)).alias("n"))
    top = rows.join(best, list(keys)).filter("__n = best_count")
    first = top.groupBy(*keys).agg(F.min(F.struct("__image", "__hash", "__t")).alias("__f"))
    close = lambda a, b: (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))
    pair = F.zip_with("__t", F.col("__f.__t"), close)
    judged = top.join(first, list(keys)).groupBy(*keys).agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("n_best"), F.first("best_count").alias("best_count"),
        F.bool_and(F.forall(pair, lambda x: x)).alias("__same"), F.min(F.when(F.col("__hash") == F.col("__f.__hash"), F.col("__source_row"))).alias("__row"),
    )
    status = (
        F.when(F.col("n") == 1, ONE_CANDIDATE).when(F.col("n_best") == 1, MOST_COMPLETE).when(F.col("__same"), EQUAL_TARGETS).otherwise(TARGET_CONFLICT)
    )
    return judged.select(*keys, "n", "n_best", "best_count", status.alias("status"), F.when(status != TARGET_CONFLICT, F.col("__row")).alias("__source_row"))


def tie_funnel(df: DataFrame, keys: Sequence[str], targets: Sequence[str], measures: Sequence[str], qc: Sequence[str], overall: str, regional: Sequence[str], rtol: float = 1e-6, atol: float = 1e-8) -> DataFrame:
    """The audit of ties at the most observed targets: step, entering, resolved, remaining. It selects nothing."""
    rows = df.filter(keyed(keys)).select(
        *keys, S.observed_count(targets).alias("t"), S.observed_count(measures).alias("m"), S.observed_count(qc).alias("q"),
        (F.coalesce(S.audit_text(F.col(overall)) == "PASS", F.lit(False))).cast("int").alias("p"),
        F.aggregate(F.array(*[(S.audit_text(F.col(c)) == "FAIL").cast("int") for c in regional]), F.lit(0), lambda a, x: a + x).alias("f"),
        F.array(*[F.col(t).cast("double") for t in targets]).alias("v"),
    )

    # The cascade keeps the lexicographic maximum, so one aggregate finds what survives every step.
    best = rows.groupBy(*keys).agg(F.max(F.struct("t", "m", "q", "p", (-F.col("f")).alias("nf"))).alias("b"), F.count(F.lit(1)).alias("c"))
    j = rows.join(best.filter("c > 1"), list(keys))
    at = F.col("t") == F.col("b.t")
    reach = []
    for column, value in (("m", F.col("m")), ("q", F.col("q")), ("p", F.col("p")), ("nf", -F.col("f"))):
        at = at & (value == F.col(f"b.{column}"))
        reach.append(at)
    last = j.filter(reach[-1]).groupBy(*keys).agg(F.min("v").alias("v0"))
    close = lambda a, b: (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))
    per = j.join(last, list(keys)).groupBy(*keys).agg(
        F.count_if(F.col("t") == F.col("b.t")).alias("c0"), *[F.count_if(r).alias(f"c{i + 1}") for i, r in enumerate(reach)],
        F.bool_and(F.when(reach[-1], F.forall(F.zip_with("v", "v0", close), lambda x: x)).otherwise(True)).alias("same"),
    )
    names = ("measure_completeness", "qc_availability", "unique_overall_pass", "fewer_regional_failures", "numerical_equivalence")
    total = per.agg(
        *[F.count_if(F.col(f"c{i}") > 1).alias(f"e{i}") for i in range(5)],
        *[F.count_if((F.col(f"c{i}") > 1) & (F.col(f"c{i + 1}") == 1)).alias(f"r{i}") for i in range(4)],
        F.count_if((F.col("c4") > 1) & F.col("same")).alias("r4"),
    )
    steps = F.array(*[F.struct(F.lit(i + 1).alias("step_no"), F.lit(n).alias("step"), F.col(f"e{i}").alias("entering"), F.col(f"r{i}").alias("resolved")) for i, n in enumerate(names)])
    return total.select(F.inline(steps)).withColumn("remaining", F.col("entering") - F.col("resolved"))


def conflict_impact(unresolved: DataFrame, visits: DataFrame, keys: Sequence[str], participant: str, complete: str) -> DataFrame:
    """Resolved and complete visits and participants that unresolved groups touch (on the keys both sides have)."""
    on = [k for k in keys if k in unresolved.columns and k in visits.columns]
    touched = visits.join(unresolved.select(*on).distinct(), on, "left_semi")
    return touched.agg(
        F.count(F.lit(1)).alias("visits"), F.count_distinct(participant).alias("participants"),
        F.count_if(F.col(complete)).alias("complete_visits"), F.count_distinct(F.when(F.col(complete), F.col(participant))).alias("complete_participants"),
    )


def disagreement_profile(df: DataFrame, groups: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For each given group and column with a disagreement: differing values, or values beside missing cells."""
    text = df.join(groups.select(*keys).distinct(), list(keys), "left_semi").select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot(list(keys), list(columns), "column", "value").withColumn("__eq", F.when(F.col("value").isNotNull(), S.equality_key(F.col("value"))))
    per = long.groupBy(*keys, "column").agg(
        F.coalesce(F.min("__eq") != F.max("__eq"), F.lit(False)).alias("value_disagreement"),
        ((F.count("value") > 0) & (F.count("value") < F.count(F.lit(1)))).alias("missingness_disagreement"),
    )
    return per.filter("value_disagreement OR missingness_disagreement")
