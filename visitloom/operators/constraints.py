"""What must hold in a package of tables, declared, compiled into one job a table, and checked.

An ``Entity`` says of one table its columns, key, parents, positions and row rules; a ``Twin`` says that
two tables have the same keys and agree in some columns; ``facts`` compares values of a manifest or
policy by path. The plan of an entity is one chain: the rows are read once, their counts are
observed (``DataFrame.observe``) while they flow on to the parents and the grouping by key, whose counts
are observed in turn. Only the last counts are collected. An observed metric can count a task twice
that ran again after a lost executor, so rows are counted at the end of the chain
as well, and a chain whose counts differ runs again.

Every check is named ``<entity>_<what>`` and lands in ``Checks`` with the expected and the observed value.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from visitloom.operators.features import canonical_json, decision_id
from visitloom.operators.governance import Checks, GateError
from visitloom.operators.tables import small_side

ATTEMPTS = 3


@dataclass(frozen=True)
class Parent:
    """Rows of an entity belong to a row of ``entity`` (``on``: own column to the parent's) and repeat some of its columns (``same``)."""

    entity: str
    on: Mapping[str, str]
    same: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Entity:
    """A table and what must hold in it. A rule is a predicate that no row may fulfil; null does not."""

    frame: DataFrame
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    catalog: tuple[str, ...] = ()
    rows: int | None = None
    domains: Mapping[str, Sequence] = field(default_factory=dict)
    numeric: tuple[str, ...] = ()
    finite: tuple[str, ...] = ()
    rules: Mapping[str, Column] = field(default_factory=dict)
    counts: Mapping[str, tuple[Column, int]] = field(default_factory=dict)
    parents: Mapping[str, Parent] = field(default_factory=dict)
    positions: tuple[tuple[str, ...], str] | None = None

    def columns(self) -> list[str]:
        """The columns that constraints read, besides those in rules and counts, which name their own."""
        own = [*self.key, *self.domains, *self.numeric, *self.finite, *(c for p in self.parents.values() for c in (*p.on, *p.same))]
        if self.positions:
            own += [*self.positions[0], self.positions[1]]
        return list(dict.fromkeys(own))


@dataclass(frozen=True)
class Twin:
    """Two entities have the same keys and agree in the columns ``same`` (left's to right's)."""

    left: str
    right: str
    same: Mapping[str, str] = field(default_factory=dict)


def _run(make, total: str, last: str) -> dict[str, int]:
    """All counts of a chain. ``make`` gives the observations and the last frame, of one row; ``total`` and ``last`` name the same count, observed and collected."""
    for _ in range(ATTEMPTS):
        observed, frame = make()
        row = frame.first().asDict()
        facts = {k: v or 0 for o in observed for k, v in o.get.items()} | {k: v or 0 for k, v in row.items()}
        if facts[total] == facts[last]:
            return facts
    raise GateError(f"tasks ran again in each of {ATTEMPTS} attempts, so that observed counts are not to be relied on")


def _chain(e: Entity, entities: Mapping[str, Entity]) -> dict[str, int]:
    """The counts of one entity."""

    def make() -> tuple[list[Observation], DataFrame]:
        flags = {f"rule_{n}": c for n, c in e.rules.items()} | {f"count_{n}": c for n, (c, _) in e.counts.items()}
        rows = e.frame.select(*e.columns(), *[c.alias(f"__{n}") for n, c in flags.items()])
        number = {c: F.expr(f"try_cast(`{c}` AS double)") for c in {*e.numeric, *e.finite}}
        first = Observation(f"rows-{uuid.uuid4().hex}")
        rows = rows.observe(
            first, F.count(F.lit(1)).alias("rows"),
            F.count_if(reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.col(k).cast("string") == "") for k in e.key])).alias("missing_key"),
            *[F.count_if(~F.coalesce(F.col(c).isin(*d), F.lit(False))).alias(f"domain_{c}") for c, d in e.domains.items()],
            *[F.count_if(number[c].isNull()).alias(f"numeric_{c}") for c in e.numeric],
            *[F.count_if(number[c].isNull() | F.isnan(number[c]) | (F.abs(number[c]) == float("inf"))).alias(f"finite_{c}") for c in e.finite],
            *[F.count_if(F.col(f"__{n}")).alias(n) for n in flags],
        ).drop(*[f"__{n}" for n in flags])
        observed = [first]
        for name, p in e.parents.items():
            other = entities[p.entity].frame
            side = other.groupBy(*[F.col(c).alias(f"__on{i}") for i, c in enumerate(p.on.values())]).agg(F.lit(True).alias("__there"), *[F.min(c).alias(f"__same{i}") for i, c in enumerate(p.same.values())])
            on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__on{i}") for i, c in enumerate(p.on)])
            seen = Observation(f"parent-{uuid.uuid4().hex}")
            joined = rows.join(small_side(side), on, "left").observe(
                seen, F.count_if(F.col("__there").isNull()).alias(f"orphans_{name}"),
                *[F.count_if(F.col("__there") & ~F.col(c).eqNullSafe(F.col(f"__same{i}"))).alias(f"differ_{name}_{c}") for i, c in enumerate(p.same)],
            )
            rows = joined.drop("__there", *[f"__on{i}" for i in range(len(p.on))], *[f"__same{i}" for i in range(len(p.same))])
            observed.append(seen)
        grouped = Observation(f"keys-{uuid.uuid4().hex}")
        observed.append(grouped)
        if not e.positions:
            keyed = rows.groupBy(*e.key).agg(F.count(F.lit(1)).alias("__n")).observe(grouped, F.count(F.lit(1)).alias("keys"), F.sum(F.col("__n") - 1).alias("duplicate_key"))
            return observed, keyed.agg(F.sum("__n").alias("rows_at_the_end"))
        # Rows by key and rows by group and position, in one pass: rows of one key may have different positions.
        group, position = e.positions
        rows = rows.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(e.key)], *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col(position).cast("long").alias("__at"))
        key, place = [c for c in rows.columns if c.startswith("__k")], [c for c in rows.columns if not c.startswith("__k")]
        both = rows.groupingSets([key, place], *key, *place).agg(F.grouping("__at").cast("boolean").alias("__by_key"), F.count(F.lit(1)).alias("__n"))
        both = both.observe(grouped, F.count_if("__by_key").alias("keys"), F.sum(F.when(F.col("__by_key"), F.col("__n") - 1)).alias("duplicate_key"))
        run = both.filter(~F.col("__by_key")).groupBy(*place[:-1]).agg(F.sum("__n").alias("__n"), F.min("__at").alias("__lo"), F.max("__at").alias("__hi"), F.count("__at").alias("__d"))
        whole = (F.col("__lo") == 1) & (F.col("__hi") == F.col("__n")) & (F.col("__d") == F.col("__n"))
        return observed, run.agg(F.sum("__n").alias("rows_at_the_end"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("broken_positions"))

    return _run(make, "rows", "rows_at_the_end")


def _pair(t: Twin, entities: Mapping[str, Entity]) -> dict[str, int]:
    """Common and single keys of two entities, and the common ones that differ."""

    def make() -> tuple[list[Observation], DataFrame]:
        sides = []
        for name, columns in ((t.left, t.same), (t.right, t.same.values())):
            e = entities[name]
            key = [F.col(k).alias(f"__k{i}") for i, k in enumerate(e.key)]
            sides.append(e.frame.groupBy(*key).agg(F.lit(True).alias("__in"), *[F.min(c).alias(f"__c{i}") for i, c in enumerate(columns)]))
        a, b = (s.alias(n) for s, n in zip(sides, "ab", strict=True))
        on = reduce(lambda x, y: x & y, [F.col(f"a.__k{i}") == F.col(f"b.__k{i}") for i in range(len(entities[t.left].key))])
        both = F.col("a.__in") & F.col("b.__in")
        seen = Observation(f"twin-{uuid.uuid4().hex}")
        joined = a.join(b, on, "full").observe(
            seen, F.count(F.lit(1)).alias("keys"), F.count_if(F.col("b.__in").isNull()).alias("left_only"), F.count_if(F.col("a.__in").isNull()).alias("right_only"),
            *[F.count_if(both & ~F.col(f"a.__c{i}").eqNullSafe(F.col(f"b.__c{i}"))).alias(f"differ_{c}") for i, c in enumerate(t.same)],
        )
        return [seen], joined.agg(F.count(F.lit(1)).alias("keys_at_the_end"))

    return _run(make, "keys", "keys_at_the_end")


def validate(checks: Checks, entities: Mapping[str, Entity], twins: Mapping[str, Twin] | None = None) -> None:
    """Runs all constraints of a package; an entity without its required columns fails that check and is not read."""
    whole = {}
    for name, e in entities.items():
        missing = sorted({*e.required, *e.key} - set(e.frame.columns))
        whole[name] = not missing
        checks.equal(f"{name}_required_columns", ",".join(missing), "")
        if e.catalog:
            checks.equal(f"{name}_catalog_order", ",".join(e.frame.columns), ",".join(e.catalog))
    for name, e in entities.items():
        if not whole[name] or any(not whole[p.entity] for p in e.parents.values()):
            continue
        got = _chain(e, entities)
        if e.rows is not None:
            checks.equal(f"{name}_total", got["rows"], e.rows)
        zero = ["missing_key", "duplicate_key", *[k for k in got if k.startswith(("domain_", "numeric_", "finite_", "rule_", "orphans_", "differ_"))]]
        if e.positions:
            zero.append("broken_positions")
        for k in zero:
            checks.equal(f"{name}_{k.removeprefix('rule_')}", got[k], 0)
        for k, (_, want) in e.counts.items():
            checks.equal(f"{name}_{k}", got[f"count_{k}"], want)
    for name, t in (twins or {}).items():
        if whole[t.left] and whole[t.right]:
            got = _pair(t, entities)
            for k in ("left_only", "right_only", *[f"differ_{c}" for c in t.same]):
                checks.equal(f"{name}_{k}", got[k], 0)


def at(payload: Mapping, path: str):
    """The value of a nested mapping at a dotted path; None where there is none."""
    for part in path.split("."):
        payload = payload.get(part) if isinstance(payload, Mapping) else None
    return payload


def facts(checks: Checks, name: str, payload: Mapping, expected: Mapping[str, object]) -> None:
    """Values of a manifest or policy by path, types included."""
    for path, want in expected.items():
        got = at(payload, path)
        checks.equal(f"{name}_{path.replace('.', '_')}", canonical_json([got]), canonical_json([want]))


def locked(checks: Checks, name: str, payload: Mapping, id_field: str, outside: Sequence[str] = ()) -> None:
    """A payload carries the id of its own canonical JSON without that id and the fields ``outside``."""
    inner = {k: v for k, v in payload.items() if k not in {id_field, *outside}}
    checks.equal(f"{name}_{id_field}", payload.get(id_field), decision_id(inner))
