"""Directives for the features of corrected tables, and the check of every feature against its directive."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, NumericType, ShortType

from visitloom.functions import scalars as S
from visitloom.operators.governance import Checks

# What a directive can ask for, and the kinds of change that it allows.
EXCLUDE, DERIVE_RETAIN, DERIVE_LATER = "exclude", "derive_retain", "derive_later"
ALLOWED = {"retain": (), "retain_retype": (), "retain_transform_retype": ("changed",), "retain_harmonized": ("changed", "filled", "emptied")}


@dataclass(frozen=True)
class Directive:
    """What is decided about one column of one source."""

    source: str
    column: str
    action: str
    feature_type: str
    transform: str = "none"
    role: str = ""
    reason: str = ""


@dataclass(frozen=True)
class Rule:
    """Directives for the named columns of a source that its corrected table has; ``later`` columns need not exist yet."""

    source: str
    columns: tuple[str, ...]
    action: str
    feature_type: str
    transform: str = "none"
    role: str = ""
    reason: str = ""
    later: bool = False


def build_directives(rules: Iterable[Rule], corrected: Mapping[str, Sequence[str]], removed: Mapping[str, Sequence[str]]) -> list[Directive]:
    """Directives by source and column: removed columns are excluded, the rest follows the rules. Works on names alone.

    Two directives for one column are an error, as is an action that is not known.
    """
    out = [Directive(s, c, EXCLUDE, "excluded", reason="removed") for s, columns in removed.items() for c in columns]
    for r in rules:
        if r.action not in (*ALLOWED, EXCLUDE, DERIVE_RETAIN, DERIVE_LATER):
            raise ValueError(f"unknown action: {r.action}")
        out += [Directive(r.source, c, r.action, r.feature_type, r.transform, r.role, r.reason) for c in r.columns if r.later or c in corrected.get(r.source, ())]
    seen: set[tuple[str, str]] = set()
    twice = sorted({k for k in ((d.source, d.column) for d in out) if k in seen or seen.add(k)})
    if twice:
        raise ValueError(f"several directives for {twice}")
    return sorted(out, key=lambda d: (d.source, d.column))


def check_policy(checks: Checks, directives: Sequence[Directive], groups: Mapping[str, Rule], corrected: Mapping[str, Sequence[str]]) -> None:
    """G01 over directives: each group's columns have exactly the action, type and transform that the policy names, and what is kept exists."""
    by_key = {(d.source, d.column): d for d in directives}
    for name, g in groups.items():
        want = [(c, g.action, g.feature_type, g.transform) for c in sorted(g.columns)]
        found = [by_key.get((g.source, c)) for c in sorted(g.columns)]
        checks.equal(f"policy_{name}", [(d.column, d.action, d.feature_type, d.transform) for d in found if d], want)
    kept = [d for d in directives if d.action in (*ALLOWED, DERIVE_RETAIN)]
    checks.equal("kept_features_exist", [f"{d.source}.{d.column}" for d in kept if d.column not in corrected.get(d.source, ())], [])


def _cell_type(a: DataType, b: DataType) -> str:
    whole = (ByteType, ShortType, IntegerType, LongType)
    if isinstance(a, whole) and isinstance(b, whole):
        return "bigint"
    return "double" if isinstance(a, NumericType) and isinstance(b, NumericType) else "string"


def _cell(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`").cast(kind)
    return F.nullif(S.strip(c), F.lit("")) if kind == "string" else c


def _same(a: Column, b: Column, kind: str, tolerance: float) -> Column:
    if kind == "string":
        return S.equal_for_audit(a, b, tolerance)
    return (a == b) if kind == "bigint" else (a == b) | (F.abs(a - b) <= tolerance)


def compare_features(original: DataFrame, corrected: DataFrame, keys: Sequence[str], tolerance: float = 1e-12) -> tuple[list[str], DataFrame]:
    """Shared features of two forms of a table, and one row of counts for them: ``rows`` holds keys on one side alone and keys
    that one side repeats, ``cells`` kept, changed, filled and emptied cells of each feature over the keys that both sides hold once.

    Cells are equal as in P27 (blank is NULL, numbers within the tolerance, text without case). Null keys are keys like any
    other. Both tables are put under one another and aggregated by key once, with a partial step, so that a repeated key of any
    number of rows is no large group; one more aggregate counts. No join.
    """
    types = [{f.name: f.dataType for f in d.schema.fields} for d in (original, corrected)]
    shared = [c for c in original.columns if c in types[1] and c not in keys]
    kinds = [_cell_type(types[0][c], types[1][c]) for c in shared]
    one = [d.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.lit(n).alias("__side"), *[_cell(c, k).alias(f"__v{i}") for i, (c, k) in enumerate(zip(shared, kinds, strict=True))]) for n, d in enumerate((original, corrected))]
    side = lambda n, c: F.max(F.when(F.col("__side") == n, F.col(c)))
    at = one[0].union(one[1]).groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(
        F.count_if(F.col("__side") == 0).alias("__o"), F.count_if(F.col("__side") == 1).alias("__c"),
        *[side(n, f"__v{i}").alias(f"__{t}{i}") for i in range(len(shared)) for n, t in enumerate("ab")],
    )
    both = (F.col("__o") == 1) & (F.col("__c") == 1)
    counts = []
    for i, kind in enumerate(kinds):
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        kept = F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(_same(a, b, kind, tolerance))
        parts = {"kept": kept, "changed": a.isNotNull() & b.isNotNull() & ~kept, "filled": a.isNull() & b.isNotNull(), "emptied": a.isNotNull() & b.isNull()}
        counts.append(F.struct(*[F.count_if(both & p).alias(n) for n, p in parts.items()]))
    rows = F.struct(
        F.count_if(both).alias("compared"), F.count_if(F.col("__c") == 0).alias("only_original"), F.count_if(F.col("__o") == 0).alias("only_corrected"),
        F.count_if((F.col("__o") > 0) & (F.col("__c") > 0) & ~both).alias("repeated"),
    )
    none = F.array().cast("array<struct<kept:bigint,changed:bigint,filled:bigint,emptied:bigint>>")
    return shared, at.agg(rows.alias("rows"), (F.array(*counts) if counts else none).alias("cells"))


def _verdict(action: str | None, before: bool, after: bool) -> Column:
    if action is None:
        return F.lit("no_directive" if after else "removed_without_directive")
    if action == EXCLUDE:
        return F.lit("excluded_but_present" if after else "ok")
    if action == DERIVE_LATER:
        return F.lit("derived_too_early" if after else "ok")
    if not after:
        return F.lit("missing")
    if action == DERIVE_RETAIN:
        return F.lit("not_derived" if before else "ok")
    if not before:
        return F.lit("not_in_original")
    forbidden = [k for k in ("changed", "filled", "emptied") if k not in ALLOWED[action]]
    return F.when(reduce(add, [F.col(k) for k in forbidden], F.lit(0)) > 0, "changed_beyond_directive").otherwise("ok")


def cross_check(sources: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]], directives: Sequence[Directive], tolerance: float = 1e-12) -> DataFrame:
    """One row for each feature of each source (original, corrected, keys): its directive, where it exists, what became of its cells, and a verdict.

    Features are those of either table and those with a directive. ``position`` is the place among the corrected table's features,
    NULL for others. Counts are NULL where the feature is not in both tables. Verdicts: ``ok``; ``changed_beyond_directive``,
    ``excluded_but_present``, ``derived_too_early``, ``not_derived``, ``missing``, ``not_in_original``, ``no_directive``,
    ``removed_without_directive``. Empty tables give rows with counts of 0, a source without features none (it is an error if
    no source has any). The names are on the driver, the cells never are.
    """
    decided = {(d.source, d.column): d for d in directives}
    out = []
    for source, (original, corrected, keys) in sources.items():
        shared, counted = compare_features(original, corrected, keys, tolerance)
        after = [c for c in corrected.columns if c not in keys]
        names = list(dict.fromkeys([*after, *[c for c in original.columns if c not in keys], *[c for s, c in decided if s == source]]))
        if not names:
            continue
        features = []
        for n in names:
            d = decided.get((source, n))
            cells = F.col("cells")[shared.index(n)] if n in shared else F.lit(None).cast("struct<kept:bigint,changed:bigint,filled:bigint,emptied:bigint>")
            features.append(F.struct(
                F.lit(source).alias("source"), F.lit(n).alias("feature"), F.lit(after.index(n) + 1 if n in after else None).cast("int").alias("position"),
                F.lit(d.action if d else None).cast("string").alias("action"), F.lit(d.feature_type if d else None).cast("string").alias("feature_type"),
                F.lit(n in original.columns).alias("in_original"), F.lit(n in after).alias("in_corrected"), cells.alias("cells"),
            ))
        long = counted.select("rows", F.explode(F.array(*features)).alias("f")).select("f.*", "rows.*").select("*", "cells.*").drop("cells")
        verdict = reduce(lambda w, n: w.when(F.col("feature") == n, _verdict(d.action if (d := decided.get((source, n))) else None, n in original.columns, n in after)), names, F.when(F.lit(False), ""))
        out.append(long.withColumn("verdict", verdict))
    if not out:
        raise ValueError("no source has a feature")
    return reduce(DataFrame.unionAll, out)
