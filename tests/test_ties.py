"""J06, J07, J08, R09 against loops over all pairs, and the exchanges of their plans."""

import datetime
import random
import re

import pytest

from visitloom import plans
from visitloom.operators import temporal as T

SCHEMA = "p string, m double, c string, date_min date, date_max date, date_median date, status string, extra int, candidates string"
CODES = [*T.ZERO_ORDER, "m06", "zz"]


def day(n):
    return None if n is None else datetime.date(2020, 1, 1) + datetime.timedelta(days=n)


def some_visits(seed, people=150):
    """Visits with few different days, so that ties are frequent; some without days, months or person."""
    r = random.Random(seed)
    rows = []
    for p in range(people):
        months = {c: r.choice([0.0, 0.0, 6.0, 12.0, None]) for c in r.sample(CODES, r.randint(1, len(CODES)))}
        for c, m in months.items():
            low = None if r.random() < 0.15 else r.randint(0, 6)
            high = None if low is None else low + r.choice([0, 0, 1, 3])
            status = "exact_date_consensus" if low is not None and low == high else "other"
            rows.append((None if p == 0 else f"p{p}", m, c, day(low), day(high), day(None if low is None else (low + high) // 2), status, 1, "x"))
    return rows


def strict(ties):
    if len(ties) < 2 or any(t[3] is None for t in ties):
        return None
    return next((a[2] for a in ties if all(b is a or b[4] < a[3] for b in ties)), None)


def unique(ties, value, ok):
    if not all(ok(t) for t in ties):
        return None
    best = max(value(t) for t in ties)
    at = [t[2] for t in ties if value(t) == best]
    return at[0] if len(at) == 1 else None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_policies_against_loops(spark, seed):
    rows = some_visits(seed)
    keys = {(r[0], r[1]) for r in rows}
    got = T.same_wave_audit(spark.createDataFrame(rows, SCHEMA), ["p", "m"], "c").collect()
    assert len(got) == len(keys)
    for g in got:
        ties = [r for r in rows if (r[0], r[1]) == (g["p"], g["m"])]
        dated = [t for t in ties if t[3] is not None]
        want = {
            "candidates": len(ties), "strict": strict(ties), "consensus": unique(ties, lambda t: t[3], lambda t: t[6] == "exact_date_consensus"),
            "median": unique(ties, lambda t: t[5], lambda t: t[3] is not None), "explicit_order": unique(ties, lambda t: CODES.index(t[2]), lambda t: t[2] in T.ZERO_ORDER),
            "coverage": "none_dated" if not dated else "all_dated" if len(dated) == len(ties) else "partially_dated",
            "widest_gap_days": (max(t[5] for t in dated) - min(t[5] for t in dated)).days if dated else None,
        }
        assert {k: g[k] for k in want} == want
        decided = [want[k] for k in ("strict", "consensus", "median") if want[k] is not None]
        assert g["decided_by"] == len(decided) and g["disagree"] == (len(set(decided)) > 1)


@pytest.mark.parametrize("seed", [4, 5])
def test_pairing_against_loops(spark, seed):
    rows = some_visits(seed)
    current = [(p, m, "now", day(lo), day(lo), day(lo), "other", 1, "x") for p, m, lo in ((f"p{i}", random.Random(i).choice([0.0, 6.0, 12.0, 24.0, None]), random.Random(i).choice([None, 3, 6, 9])) for i in range(160))]
    got = {g["p"]: g for g in T.pair_previous(spark.createDataFrame(current, SCHEMA), spark.createDataFrame(rows, SCHEMA), "p", "c", "m").collect()}
    assert set(got) == {c[0] for c in current}
    for c in current:
        g, own = got[c[0]], [r for r in rows if r[0] == c[0]]
        months = [r[1] for r in own if r[1] is not None and c[1] is not None and r[1] < c[1]]
        ties = [r for r in own if months and r[1] == max(months)]
        pick = ties[0][2] if len(ties) == 1 else strict(ties)
        end = next((t[4] for t in ties if t[2] == pick), None)
        if c[1] is None:
            want = T.NO_MONTH
        elif not ties:
            want = T.NO_EARLIER if own else T.NO_HISTORY
        elif len(ties) == 1:
            want = T.ELIGIBLE_UNIQUE
        elif pick is None:
            want = T.NO_WINNER
        elif c[3] is None:
            want = T.NO_CURRENT_DATE
        else:
            want = T.ELIGIBLE_STRICT if end < c[3] else T.NOT_BEFORE
        eligible = want in (T.ELIGIBLE_UNIQUE, T.ELIGIBLE_STRICT)
        assert (g["reason"], g["previous_code"], g["candidates"]) == (want, pick if eligible else None, len(ties))


def test_no_visits(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert T.same_wave_audit(none, ["p", "m"], "c").collect() == []
    assert T.strict_interval_winner(none, ["p", "m"], "c").collect() == []
    assert T.pair_previous(none, none, "p", "c", "m").collect() == []


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|single|round)", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name", ["same_wave_tie_strict", "same_wave_policies", "same_wave_audit", "prev_visit_pairing", "previous_visits"])
def test_few_exchanges(spark, small, name):
    assert exchanges(plans.QUERIES[name](spark, small)) < 6


def test_no_self_join(spark):
    v = spark.createDataFrame(some_visits(1), SCHEMA)
    plan = T.pair_previous(v.filter("c = 'zz'"), v, "p", "c", "m")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join ", plan)) == 1
    assert "Join" not in T.same_wave_audit(v, ["p", "m"], "c")._jdf.queryExecution().optimizedPlan().toString()
