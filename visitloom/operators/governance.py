"""Checks, gates and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.operators.tables import compare_keyed


class GateError(RuntimeError):
    """A gate found failed checks."""


@dataclass
class Checks:
    """Named assertions, collected; the gate stops if one failed."""

    records: list[tuple[str, bool, str, str]] = field(default_factory=list)

    def equal(self, name: str, observed, expected) -> bool:
        self.records.append((name, observed == expected, str(expected), str(observed)))
        return observed == expected

    def true(self, name: str, passed: bool, detail: str = "") -> bool:
        self.records.append((name, bool(passed), "true", detail or str(bool(passed))))
        return bool(passed)

    def counts(self, df: DataFrame, expected: Mapping[str, tuple[Column, int]]) -> None:
        """Many counts in one aggregate over a table."""
        row = df.agg(*[c.alias(n) for n, (c, _) in expected.items()]).first()
        for name, (_, want) in expected.items():
            self.equal(name, row[name], want)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records, "check string, passed boolean, expected string, observed string")

    def gate(self) -> None:
        if failed := [r[0] for r in self.records if not r[1]]:
            raise GateError(f"{len(failed)} checks failed: {failed[:10]}")


def validate_package(checks: Checks, splits: DataFrame, visits: DataFrame, targets: DataFrame, sources: Mapping[str, DataFrame], person: str, keys: Sequence[str], position: str, complete: Sequence[str]) -> None:
    """Keys, splits, positions, targets and sources of a package against each other."""
    checks.counts(splits, {
        "split_participants_unique": (F.count(F.lit(1)) - F.count_distinct(person), 0),
        "split_names_known": (F.count_if(~F.col("split").isin("train", "validation", "test")), 0),
    })
    checks.counts(visits, {
        "visit_keys_complete": (F.count_if(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) > 0), 0),
        "visit_keys_unique": (F.count(F.lit(1)) - F.count_distinct(*keys), 0),
    })
    p = visits.groupBy(person).agg(F.min(position).alias("a"), F.max(position).alias("b"), F.count_distinct(position).alias("d"), F.count(F.lit(1)).alias("n"))
    checks.equal("positions_consecutive", p.filter("a <> 1 OR b <> n OR d <> n").count(), 0)
    checks.equal("visits_have_a_split", visits.join(splits, person, "left_anti").count(), 0)
    both = compare_keyed(visits, targets, keys, []).first()
    checks.equal("visit_and_target_keys_equal", (both["left_only"], both["right_only"]), (0, 0))
    checks.counts(targets, {"targets_complete": (F.count_if(F.greatest(*[F.col(t).isNull().cast("int") for t in complete], F.lit(0)) > 0), 0)})
    for name, table in sources.items():
        on = [k for k in keys if k in table.columns]
        checks.equal(f"{name}_keys_unique", table.groupBy(*on).count().filter("count > 1").count(), 0)


def safe_report(df: DataFrame, allowed: Sequence[str], private: Sequence[str]) -> DataFrame:
    """The allowed columns only; a private column among them is an error."""
    if bad := sorted(set(allowed) & set(private)):
        raise GateError(f"private columns in a report: {bad}")
    return df.select(*allowed)


def story(title: str, facts: Mapping[str, object], checks: Checks | None = None) -> str:
    """A short text report of aggregate facts."""
    lines = [f"# {title}", ""] + [f"- {k}: {v}" for k, v in facts.items()]
    if checks is not None:
        lines += ["", f"Checks: {sum(r[1] for r in checks.records)} of {len(checks.records)} passed."]
    return "\n".join(lines) + "\n"


def failure_record(error: BaseException, stage: str) -> dict[str, str]:
    """What is kept of a failed stage: no rows, no values."""
    return {"stage": stage, "error": type(error).__name__, "status": "failed"}
