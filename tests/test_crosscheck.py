"""Directives and the cross-check of features."""

import random

import pytest

from visitloom.operators import crosscheck as C
from visitloom.operators.governance import Checks, GateError

KEEP = C.Rule("s", ("x",), "retain", "numeric")


def test_directives_and_policy():
    rules = [KEEP, C.Rule("s", ("absent",), "retain", "numeric"), C.Rule("s", ("age",), C.DERIVE_LATER, "numeric", later=True)]
    got = C.build_directives(rules, {"s": ["k", "x", "y"]}, {"s": ["gone"], "t": ["id"]})
    assert [(d.source, d.column, d.action) for d in got] == [("s", "age", "derive_later"), ("s", "gone", "exclude"), ("s", "x", "retain"), ("t", "id", "exclude")]
    with pytest.raises(ValueError, match="several directives"):
        C.build_directives([KEEP, KEEP], {"s": ["x"]}, {})
    with pytest.raises(ValueError, match="unknown action"):
        C.build_directives([C.Rule("s", ("x",), "keep", "numeric")], {"s": ["x"]}, {})
    checks = Checks()
    C.check_policy(checks, got, {"x": KEEP}, {"s": ["x"]})
    checks.gate()
    C.check_policy(checks, got, {"retyped": C.Rule("s", ("x",), "retain", "categorical")}, {"s": ["x"]})
    C.check_policy(checks, got, {}, {"s": []})
    assert [n for n, ok, _, _ in checks.records if not ok] == ["policy_retyped", "kept_features_exist"]
    with pytest.raises(GateError):
        checks.gate()


def same(a, b):
    a, b = (None if v is None or not str(v).strip() else str(v).strip().lower() for v in (a, b))
    if a is None or b is None:
        return a is b
    try:
        return abs(float(a) - float(b)) <= 1e-12
    except ValueError:
        return a == b


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_against_a_loop(spark, seed):
    r = random.Random(seed)
    cells = [None, "", " ", "a", "A", "1", "1.0", "2"]
    old = [(r.choice([None, *range(60)]), r.choice(cells), r.choice([None, 1, 2]), r.choice([None, 0.5, float("nan")])) for _ in range(80)]
    new = [(k, x if r.random() < 0.5 else r.choice(cells), n, y) for k, x, n, y in old if r.random() < 0.9] + [(100, "a", 1, 0.5)]
    a, b = spark.createDataFrame(old, "k int, x string, n int, y double"), spark.createDataFrame([(k, x, str(n) if n else None, y) for k, x, n, y in new], "k int, x string, n string, y double")
    got = {g["feature"]: g for g in C.cross_check({"s": (a, b, ["k"])}, [C.Directive("s", "x", "retain", "numeric"), C.Directive("s", "n", "retain_retype", "categorical"), C.Directive("s", "y", "retain", "numeric")]).collect()}
    count = lambda rows, k: sum(row[0] == k for row in rows)
    keys = {row[0] for row in old + new}
    once = [k for k in keys if count(old, k) == 1 and count(new, k) == 1]
    pairs = [(next(o for o in old if o[0] == k), next(n for n in new if n[0] == k)) for k in once]
    blank = lambda v: v is None or not v.strip()
    x = [(p[1], q[1]) for p, q in pairs]
    want = {
        "compared": len(once), "only_original": sum(not count(new, k) for k in keys), "only_corrected": sum(not count(old, k) for k in keys),
        "repeated": sum(count(old, k) > 0 and count(new, k) > 0 and k not in once for k in keys), "kept": sum(same(*v) for v in x),
        "filled": sum(blank(p) and not blank(q) for p, q in x), "emptied": sum(not blank(p) and blank(q) for p, q in x),
        "changed": sum(not blank(p) and not blank(q) and not same(p, q) for p, q in x),
    }
    assert {k: got["x"][k] for k in want} == want
    assert want["repeated"] and want["changed"] and got["x"]["verdict"] == "changed_beyond_directive"
    assert got["n"]["verdict"] == got["y"]["verdict"] == "ok" and got["n"]["kept"] == len(once)


def test_verdicts(spark):
    old = spark.createDataFrame([(1, "a", "b", "c", 1, 2, None)], "k int, gone string, left string, free string, late int, mapped int, harmonized string")
    new = spark.createDataFrame([(1, "b", "c", 1, 3, "q", 5, 6, "z")], "k int, left string, free string, late int, mapped int, harmonized string, derived int, early int, strange string")
    ask = {"gone": "exclude", "left": "exclude", "late": "derive_retain", "mapped": "retain_transform_retype", "harmonized": "retain_harmonized", "derived": "derive_retain", "early": "derive_later", "lost": "retain", "strange": "retain", "age": "derive_later"}
    got = {g["feature"]: (g["verdict"], g["position"]) for g in C.cross_check({"s": (old, new, ["k"])}, [C.Directive("s", c, a, "") for c, a in ask.items()]).collect()}
    assert got == {
        "gone": ("ok", None), "left": ("excluded_but_present", 1), "free": ("no_directive", 2), "late": ("not_derived", 3), "mapped": ("ok", 4), "harmonized": ("ok", 5),
        "derived": ("ok", 6), "early": ("derived_too_early", 7), "strange": ("not_in_original", 8), "lost": ("missing", None), "age": ("ok", None),
    }
    bare = {g["feature"]: g["verdict"] for g in C.cross_check({"s": (old, new.select("k"), ["k"])}, []).collect()}
    assert set(bare.values()) == {"removed_without_directive"}
    none = C.cross_check({"s": (old.limit(0), new.limit(0), ["k"])}, [C.Directive("s", "mapped", "retain", "")]).filter("feature = 'mapped'").first()
    assert (none["compared"], none["kept"], none["verdict"]) == (0, 0, "ok")
    with pytest.raises(ValueError, match="no source"):
        C.cross_check({"s": (old.select("k"), new.select("k"), ["k"])}, [])
