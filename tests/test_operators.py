"""Operators on small tables with known outcomes."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from visitloom.functions import scalars as S
from visitloom.operators import aggregates as A
from visitloom.operators import balance as B
from visitloom.operators import constraints as K
from visitloom.operators import features as X
from visitloom.operators import governance as G
from visitloom.operators import metrics as M
from visitloom.operators import models as L
from visitloom.operators import preprocess as P
from visitloom.operators import resolve as V
from visitloom.operators import tables as R
from visitloom.operators import temporal as T
from visitloom.operators.quantiles import exact_quantiles
from visitloom.sources import packages, shared, tables

VISIT = V.Contract("S", "visit", ("RID", "VISCODE2"), administrative=("USERDATE",))


def col(spark, values, f, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {type_}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


# --- scalars ---


def test_missing_ids_codes(spark):
    assert col(spark, [" observed ", "", "-1", " -4 "], S.missing_to_null) == ["observed", None, None, None]
    assert col(spark, ["001", "2.0", None, "2.5", "XX11"], S.canonical_id) == ["1", "2", None, None, None]
    assert col(spark, ["001", None, "2.5", "XX11"], S.id_violation) == [False, False, True, True]
    assert col(spark, ["bl", "SC", "m12", "y2", "unknown", None], S.protocol_month) == [0.0, 0.0, 12.0, 24.0, None, None]


def test_labels_like_python(spark):
    values = ["1.0", "2.50", "1e-7", "123456789.125", "0.1", "1e300", "-3.25e-05", "abc ", "1.0d", "inf", "nan", None, "0.30000000000000004"]

    def want(v):
        if v is None:
            return None
        try:
            d = float(v)
        except ValueError:
            return v.strip()
        if v in ("inf", "nan"):
            return v
        return str(int(d)) if d == int(d) and abs(d) < 1e30 else f"{d:.15g}"

    got = col(spark, values, lambda c: S.code_label(c))
    for v, g in zip(values, got, strict=True):
        if v != "1e300":
            assert g == want(v), v


def test_dates_flags_tokens(spark):
    days = col(spark, ["2026-01-02 14:15:00", "2026-01-03", "1/2/2020", "x", None], S.parse_day)
    assert [str(d) if d else None for d in days] == ["2026-01-02", "2026-01-03", "2020-01-02", None, None]
    assert col(spark, ["Yes", "0", None, "", "maybe"], S.parse_flag) == [True, False, False, False, None]
    assert col(spark, ["sim"], lambda c: S.parse_flag(c, ["sim"], ["nao"])) == [True]
    assert col(spark, ["1|2;3", "", None], S.multi_tokens) == [["1", "2", "3"], [], []]
    assert col(spark, ["8", "9", "1|5", "5", None], lambda c: S.collapsed_code(c, {"8": "3", "9": "3"}, "6")) == ["3", "3", "6", "5", None]
    assert col(spark, ["1999-01-01 00:00", "1999-02-01"], S.placeholder_year) == [1999.0, None]


def test_score_completion_bands(spark):
    df = spark.createDataFrame([("1", "1", "1", "0", "1", None), (None, None, None, None, None, "3"), ("1", "0", "1", "0", "1", None), ("1", "1", "1", "1", "1", "2"), ("2", "1", "1", "1", "1", None)], "a string, b string, c string, d string, e string, n string")
    got = [r[0] for r in df.select(S.merged_score([F.col(x) for x in "abcde"], F.col("n"))).collect()]
    assert got == [4.0, 3.0, 3.0, None, None]
    df = spark.createDataFrame([(None, "4"), ("2", None), (None, None)], "u string, s string")
    assert [r[0] for r in df.select(S.implied_zero(F.col("u"), [F.col("s")])).collect()] == ["0", "2", None]
    assert col(spark, [0, 5, 10, 20, 30, 50, 100, 250, 500, 501], lambda c: S.band(c), "int") == [b for _, b in S.SUPPORT_BANDS] + ["009_over_500"]


def test_equality_modes(spark):
    df = spark.createDataFrame([("1", "1.0"), ("A", "a"), (None, ""), ("1", "1.0000000000001"), (None, None)], "x string, y string")
    a = [r[0] for r in df.select(S.equality_key(F.col("x")).eqNullSafe(S.equality_key(F.col("y")))).collect()]
    b = [r[0] for r in df.select(S.equal_for_audit(F.col("x"), F.col("y"))).collect()]
    assert a == [True, False, False, False, True] and b == [True, True, True, True, True]


def test_columns(spark):
    assert S.column_catalog(["RID", "st1sv", "ST8SV", "ST2TA", "STX"], r"ST\d+(SV|CV|SA|TA|TS)", ["ST8SV"]) == ["st1sv", "ST2TA"]
    df = spark.createDataFrame([(1, 2, 3)], "RID int, X_1 int, __h int")
    assert S.drop_columns(df, ["RID"], patterns=[r"X_\d"]).columns == ["RID", "__h"]
    with pytest.raises(ValueError):
        S.drop_columns(df, ["RID"], exact=["RID"])
    assert S.project(df, ["h", "RID"]).columns == ["h", "RID", "X_1"]


# --- resolution ---


def status_of(spark, rows, schema, contract=VISIT):
    r = V.resolve(spark.createDataFrame(rows, schema), contract)
    return r, {tuple(x[k] for k in contract.keys): x["status"] for x in r.judged.collect()}


def test_resolution_rules(spark):
    rows = [
        ("1", "bl", "10", None, "d1"), ("1", "bl", "10.0", None, "d2"),
        ("2", "bl", "1", None, "d"), ("2", "bl", "1", "2", "d"),
        ("3", "bl", "1", None, "d"), ("3", "bl", "2", None, "d"),
        ("4", "bl", "1", None, "d"), ("4", "bl", None, "2", "d"),
        ("5", "bl", "1", "1", "d"),
        ("6", "bl", "1", "2", "a"), ("6", "bl", "1", "2", "b"), ("6", "bl", "1", None, "c"),
        (None, "bl", "1", "1", "d"),
    ]
    r, s = status_of(spark, rows, "RID string, VISCODE2 string, A string, B string, USERDATE string")
    assert [s[(str(i), "bl")] for i in range(1, 7)] == ["exact_or_equivalent_duplicate", "dominant_record", "unresolved_conflict", "unresolved_conflict", "unique_record", "unresolved_conflict"]
    assert r.resolved().filter("RID = '2'").first()["B"] == "2"
    one = r.summary().first()
    assert one["original_rows"] == 13 and one["valid_key_rows"] == 12 and one["resolved_rows"] + one["unresolved_conflict"] == one["valid_key_groups"] == 6
    ledger = {(x["action"], x["reason"]): x["n"] for x in r.ledger().groupBy("action", "reason").agg(F.count("*").alias("n")).collect()}
    assert ledger[("excluded", "missing_key")] == 1 and ledger[("excluded", "unresolved_group")] == 7 and sum(ledger.values()) == 13


def test_resolution_against_pairs(spark):
    """The aggregate rule equals the rule over all pairs of rows."""
    rng = np.random.default_rng(4)
    cells = [None, None, "1", "1.0", "2", "x"]
    rows = [(str(g), "bl", *[cells[k] for k in rng.integers(0, len(cells), 3)], "d") for g in range(300) for _ in range(rng.integers(1, 5))]
    _, got = status_of(spark, rows, "RID string, VISCODE2 string, A string, B string, C string, USERDATE string")
    same = lambda a, b: (a is None and b is None) or (a is not None and b is not None and (a == b or {a, b} == {"1", "1.0"}))
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r[2:5])
    for g, members in groups.items():
        if len(members) == 1:
            want = "unique_record"
        elif all(same(x, y) for m in members for x, y in zip(m, members[0], strict=True)):
            want = "exact_or_equivalent_duplicate"
        else:
            beats = lambda a, b: all(y is None or same(x, y) for x, y in zip(a, b, strict=True))
            more = lambda a, b: any(x is not None and y is None for x, y in zip(a, b, strict=True))
            tops = [i for i, a in enumerate(members) if all(beats(a, b) and more(a, b) for j, b in enumerate(members) if j != i)]
            want = "dominant_record" if len(tops) == 1 else "unresolved_conflict"
        assert got[(g, "bl")] == want, members


def test_baseline_grain(spark):
    c = V.Contract("P", "participant_baseline", ("RID",))
    schema = "RID string, VISCODE2 string, VISDATE string, PTGENDER string"
    r, s = status_of(spark, [("1", "m12", "2020-01-01", "A"), ("1", "sc", "2021-01-01", "B"), ("2", "zz", "2020-05-01", "A"), ("2", "yy", "2020-01-01", "B")], schema, c)
    kept = {x["RID"]: x["PTGENDER"] for x in r.resolved().collect()}
    assert kept == {"1": "B", "2": "B"} and set(s.values()) == {"unique_record"}


def test_completeness_resolution(spark):
    rows = [
        ("1", "bl", 100, 1.0, None), ("1", "bl", 101, 1.0, 2.0), ("2", "bl", 200, 1.0, 2.0), ("2", "bl", 100, 1.0, 2.0000001),
        ("3", "bl", 1, 1.0, 2.0), ("3", "bl", 2, 9.0, 2.0), ("4", "bl", 5, None, None),
    ]
    df = V.with_source_row(spark.createDataFrame(rows, "RID string, VISCODE2 string, IMAGEUID int, A double, B double"))
    got = {r["RID"]: (r["status"], r["__source_row"]) for r in V.resolve_by_completeness(df, ["RID", "VISCODE2"], ["A", "B"], "IMAGEUID").collect()}
    image = {r["__source_row"]: r["IMAGEUID"] for r in df.collect()}
    assert {k: (s, image.get(i)) for k, (s, i) in got.items()} == {
        "1": (V.MOST_COMPLETE, 101), "2": (V.EQUAL_TARGETS, 100), "3": (V.TARGET_CONFLICT, None), "4": (V.ONE_CANDIDATE, 5)
    }


# --- time ---


def test_pairing_reasons(spark):
    d = lambda s: pd.Timestamp(s).date() if s else None
    rows = [
        ("a", "bl", 0.0, "2020-01-01", "2020-01-01"), ("a", "m12", 12.0, "2021-01-01", "2021-01-02"),
        ("b", "sc", 0.0, "2020-01-01", "2020-01-02"), ("b", "bl", 0.0, "2020-01-10", "2020-01-11"), ("b", "m12", 12.0, "2021-01-01", "2021-01-01"),
        ("c", "sc", 0.0, "2020-01-01", "2020-01-12"), ("c", "bl", 0.0, "2020-01-10", "2020-01-11"), ("c", "m12", 12.0, "2021-01-01", "2021-01-01"),
        ("d", "sc", 0.0, "2020-01-01", "2020-01-01"), ("d", "bl", 0.0, "2020-02-10", "2020-02-10"), ("d", "m12", 12.0, "2020-02-05", "2020-02-05"),
        ("e", "sc", 0.0, None, None), ("e", "bl", 0.0, "2020-02-10", "2020-02-10"), ("e", "m12", 12.0, "2021-02-05", "2021-02-05"),
        ("f", "zz", None, None, None), ("f", "m12", 12.0, None, None), ("g", "zz", None, None, None),
        ("h", "sc", 0.0, "2020-01-01", "2020-01-01"), ("h", "bl", 0.0, "2020-02-10", "2020-02-10"), ("h", "m12", 12.0, None, None),
    ]
    v = spark.createDataFrame([(p, c, m, d(a), d(b), d(a)) for p, c, m, a, b in rows], "p string, c string, m double, date_min date, date_max date, date_median date")
    cur = v.filter("c = 'm12' OR p = 'g'")
    got = {r["p"]: r for r in T.pair_previous(cur, v.filter("c <> 'm12'"), "p", "c", "m").collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "a": T.ELIGIBLE_UNIQUE, "b": T.ELIGIBLE_STRICT, "c": T.NO_WINNER, "d": T.NOT_BEFORE, "e": T.NO_WINNER, "f": T.NO_EARLIER, "g": T.NO_MONTH, "h": T.NO_CURRENT_DATE,
    }
    assert got["a"]["gap_months"] == 12.0 and got["b"]["previous_code"] == "bl" and got["b"]["conservative_gap_days"] > 0
    alone = T.pair_previous(cur.filter("p = 'a'"), v.filter("p = 'zzz'"), "p", "c", "m").first()
    assert alone["reason"] == T.NO_HISTORY


def test_follow_up_and_profile(spark):
    d = pd.Timestamp
    v = spark.createDataFrame([("a", d("2020-01-01").date(), 0.0), ("a", d("2021-01-01").date(), 12.0), ("b", None, 0.0), ("b", None, 12.0), ("c", None, 0.0)], "p string, day date, m double")
    got = {r["p"]: r["followup_months"] for r in T.follow_up(v, "p", "day", "m").collect()}
    assert got["a"] == pytest.approx(366 / 30.4375) and got["b"] == 12.0 and got["c"] == 0.0
    e = spark.createDataFrame([("x", d("2020-01-01").date(), s, "EXAMDATE") for s in ("A", "B", "C")], "k string, day date, s string, f string")
    one = T.date_profile(e, ["k"], "day", "s", "f").first()
    assert (one["status"], one["sources"], one["fields"]) == ("exact_date_consensus", 3, 3)


# --- aggregates, balance, metrics ---


def test_suppression_and_rare(spark):
    assert col(spark, [0, 1, 4, 5], lambda c: A.suppressed(c), "int") == [0, None, None, 5]
    df = spark.createDataFrame([("SECRET_A", 3), ("SECRET_B", 7)], "l string, n int")
    r = A.safe_distribution(df, "l", "n", pseudonyms=True).collect()
    assert [(x["l"], x["n"], x["suppressed_categories"], x["suppressed_rows"]) for x in r] == [("category_002", 7, 1, 3)]
    df = spark.createDataFrame([("common",)] * 5 + [("rare",)] * 4 + [(None,)], "c string")
    assert {r["c"]: r["count"] for r in A.collapse_rare(df, "c").groupBy("c").count().collect()} == {"common": 5, "__RARE__": 5}


def test_scope_profile(spark):
    df = spark.createDataFrame([("f", "1", "1"), ("f", "", "1"), ("f", "2", "2"), ("f", None, "3")], "feature string, value string, p string")
    r = A.scope_profile(df, ["feature"], "value", "p").first()
    assert (r["rows"], r["participants"], r["observed_rows"], r["observed_participants"]) == (4, 3, 2, 2)


def js_of(p, q):
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.sqrt(max(0.0, (np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()) / 2)))


def w1_of(u, v):
    u, v, both = np.sort(u), np.sort(v), np.sort(np.concatenate([u, v]))
    return float((np.abs(np.searchsorted(u, both[:-1], side="right") / len(u) - np.searchsorted(v, both[:-1], side="right") / len(v)) * np.diff(both)).sum())


def test_split_sizes_and_score(spark):
    assert list(B.split_sizes(2839).values()) == [1987, 426, 426]
    df = spark.createDataFrame([("c", "train", 0.1), ("c", "validation", 0.2), ("c", "test", 0.3)], "criterion string, split string, distance double")
    assert B.score_criteria(df).first()["score_final"] == pytest.approx(0.25)
    p, q = np.array([0.5, 0.5]), np.array([1.0, 0.0])
    assert js_of(p, p) == 0 and 0 < js_of(p, q) < 1
    assert w1_of(np.array([0.0, 1.0]), np.array([1.0, 2.0])) == pytest.approx(1.0)


def test_distances_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"split": rng.choice(["train", "validation", "test"], 400), "c": rng.choice(list("abcd"), 400), "v": rng.normal(size=400).round(1)})
    df = spark.createDataFrame(pdf)
    js = {r["split"]: r["distance"] for r in B.js_distance(df, "c", "split").collect()}
    w1 = {r["split"]: r["distance"] for r in B.wasserstein(df, "v", "split").collect()}
    z = (pdf["v"] - pdf["v"].mean()) / pdf["v"].std(ddof=0)
    share = pdf["c"].value_counts(normalize=True).sort_index()
    for s, g in pdf.groupby("split"):
        assert js[s] == pytest.approx(js_of(share.to_numpy(), g["c"].value_counts(normalize=True).reindex(share.index, fill_value=0).to_numpy()))
        assert w1[s] == pytest.approx(w1_of(z.to_numpy(), z[g.index].to_numpy()))


def test_metrics(spark):
    df = spark.createDataFrame([("A", 1, "t", 0.0, 0.0), ("A", 2, "t", 0.0, 0.0), ("B", 3, "t", 0.0, 0.0)], "participant string, row int, target string, y double, p double")
    m = M.macro_metrics(df).first()
    assert m["participant_macro_rmse"] == 0.0 and m["participants"] == 2
    assert M.target_scores(df).first()["r2"] == 1.0


# --- preprocessing and models ---


def test_preprocessor(spark):
    df = spark.createDataFrame([(1, 1.0, None, "a", "x|y"), (2, 3.0, 4.0, None, None), (3, 5.0, 6.0, "b", "x")], "k int, u double, v double, c string, m string")
    assert P.medians(df, ["u", "v"]) == {"u": 3.0, "v": 5.0}
    pre = P.Preprocessor(["u", "v"], [], ["c"], ["m"]).fit(df)
    assert "u__missing" in pre.dropped and "v__missing" not in pre.dropped and "m~__UNKNOWN__" in pre.dropped
    row = pre.transform(spark.createDataFrame([(9, 3.0, None, "zzz", "q")], df.schema), ["k"]).first()
    x = dict(zip(pre.names(), row["x"], strict=True))
    assert x["u"] == 0.0 and x["v__missing"] == 1.0 and x["c=a"] == x["c=b"] == 0.0


def moments(x, y):
    z = np.c_[np.ones(len(x)), x, y]
    return L.Moments.from_products(z.T @ z, x.shape[1])


def nipals(x, y, components):
    """Brute force: partial least squares by alternating over the rows."""
    xk, yk = x - x.mean(0), y - y.mean(0)
    w_all, p_all, q_all = [], [], []
    for _ in range(components):
        u = yk[:, 0]
        for _ in range(2000):
            w = xk.T @ u
            w /= np.linalg.norm(w)
            t = xk @ w
            q = yk.T @ t / (t @ t)
            u = yk @ q / (q @ q)
        p = xk.T @ t / (t @ t)
        xk, yk = xk - np.outer(t, p), yk - np.outer(t, q)
        w_all.append(w), p_all.append(p), q_all.append(q)
    w, p, q = np.array(w_all).T, np.array(p_all).T, np.array(q_all).T
    coef = w @ np.linalg.solve(p.T @ w, q.T)
    return coef, y.mean(0) - x.mean(0) @ coef


def test_grid_scores_linear_models_as_by_hand(spark):
    rng = np.random.default_rng(12)
    x, who = rng.normal(size=(90, 4)), rng.integers(0, 7, 90)
    y = x @ rng.normal(size=(4, 2)) + rng.normal(size=(90, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist(), int(w), i) for i, (a, b, w) in enumerate(zip(x, y, who, strict=True))], "x array<double>, y array<double>, p long, i long")
    want = [c for c in L.grid() if c["model"] in L.LINEAR or c.get("k") == 5]
    got = {r["configuration_id"]: r for r in L.run_grid(df.filter("i < 60"), df.filter("i >= 60"), "x", "y", "p", want).collect()}
    assert set(got) == {c["configuration_id"] for c in want}
    m, medians = moments(x[:60], y[:60]), np.median(y[:60], axis=0)
    for c, (w, b, _) in zip([c for c in want if c["model"] in L.LINEAR], L._fit_linear([c for c in want if c["model"] in L.LINEAR], m, medians), strict=True):
        e = x[60:] @ w + b - y[60:]
        g = pd.DataFrame({"w": who[60:], "s": (e**2).mean(1), "a": np.abs(e).mean(1)}).groupby("w").mean()
        assert got[c["configuration_id"]]["participant_macro_rmse"] == pytest.approx(np.sqrt(g["s"]).mean())
        assert got[c["configuration_id"]]["participant_macro_mae"] == pytest.approx(g["a"].mean())
    assert L.run_grid(df, df, "x", "y", "p", want, done=list(got)).count() == 0


def test_ridge_pca_pls_against_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 6))
    y = x @ rng.normal(size=(6, 3)) + 0.1 * rng.normal(size=(200, 3)) + 2
    df = spark.createDataFrame([(r.tolist(), t.tolist()) for r, t in zip(x, y, strict=True)], "x array<double>, y array<double>")
    w, b = L.ridge(df, "x", "y", 6, [2.0])[2.0]
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = np.linalg.solve(xc.T @ xc + 2 * np.eye(6), xc.T @ yc)
    assert np.allclose(w, want) and np.allclose(b, y.mean(0) - x.mean(0) @ want)
    pca = L.PCA.fit(df, "y")
    s = np.linalg.svd(yc, compute_uv=False) ** 2
    assert np.allclose(pca.ratio, (s / s.sum())[: len(pca.ratio)]) and pca.ratio.sum() >= 0.9 > pca.ratio[:-1].sum()
    m = L.Moments.of(df, "x", "y", 6)
    fits = L.pls_fit(m, 6)
    for k, (coef, at) in enumerate(fits, 1):
        want_coef, want_at = nipals(x, y, k)
        assert np.allclose(coef, want_coef, atol=1e-4) and np.allclose(at, want_at, atol=1e-4)
    full, c = fits[-1]
    assert np.allclose(x @ full + c, x @ np.linalg.lstsq(np.c_[x, np.ones(200)], y, rcond=None)[0][:6] + (y - x @ np.linalg.lstsq(np.c_[x, np.ones(200)], y, rcond=None)[0][:6]).mean(0), atol=1e-6)


def test_elastic_net_conditions():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(80, 5)), rng.normal(size=(80, 2))
    m = moments(x, y)
    base = L.elastic_net_base(m)
    w, _, _ = L.elastic_net_fit(m, base * 1.01, 1.0)
    assert not w.any()
    alpha = base * 0.3
    w, b, _ = L.elastic_net_fit(m, alpha, 0.5, tol=1e-10)
    r = y - x @ w - b
    g = (x - x.mean(0)).T @ r / len(x) - alpha * 0.5 * w
    for j in range(5):  # stationarity
        n = np.linalg.norm(w[j])
        assert np.allclose(g[j], alpha * 0.5 * w[j] / n, atol=1e-6) if n else np.linalg.norm(g[j]) <= alpha * 0.5 + 1e-6


def test_knn_and_grid(spark):
    rng = np.random.default_rng(2)
    t = spark.createDataFrame([(i, rng.normal(size=3).tolist(), float(i % 5)) for i in range(60)], "k long, x array<double>, y double")
    q = t.filter("k < 10")
    pdf = t.toPandas()
    x = np.stack(pdf["x"])
    for weights in ("uniform", "distance"):
        got = {r["k"]: r["prediction"] for r in L.knn_regress(t, q, "k", "x", "y", 4, weights, pivots=6, cell_rows=7).collect()}
        for i in range(10):
            d = np.linalg.norm(x - x[i], axis=1)
            ix = np.lexsort((pdf["k"], d))[:4]
            want = pdf["y"][ix].mean() if weights == "uniform" else pdf["y"][ix[0]]
            assert got[i] == pytest.approx(want)
    ids = [c["configuration_id"] for c in L.grid()]
    assert len(ids) == len(set(ids)) == 53


def test_split_search_resumes(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"participant": np.arange(80), "n_visits": rng.integers(1, 6, 80), "followup_months": rng.random(80) * 40, "modality_count_mean": rng.random(80) * 8})
    for c in B.CATEGORICAL:
        pdf[c] = rng.choice(["u", "v"], 80)
    df = spark.createDataFrame(pdf)
    a = B.search_splits(df, 30, tasks=3).orderBy("candidate_id").toPandas()
    b = B.search_splits(df, 30, first=11, tasks=2).orderBy("candidate_id").toPandas()
    pd.testing.assert_frame_equal(a.iloc[10:].reset_index(drop=True), b, rtol=1e-12)
    assert len(a) == 30
    assert a["seed"].iloc[0] == B.MASTER_SEED + 1


def split_one_by_one(profile, seed):
    """One candidate at a time: the split laid out and every criterion compared with all participants."""
    sizes, visits = B.split_sizes(len(profile)), profile["n_visits"].to_numpy()
    order = np.random.default_rng(seed).permutation(len(profile))
    by, reasons, at = {}, set(), 0
    for s, size in sizes.items():
        ix, at = order[at : at + size], at + size
        error = abs(visits[ix].sum() / visits.sum() - B.SHARES[s])
        by.setdefault("visit_proportion", []).append(error)
        reasons |= {f"visit_proportion_outside_tolerance:{s}"} if error > B.VISIT_TOLERANCE else set()
        reasons |= {f"insufficient_{k}plus:{s}" for k in (2, 3) if not (visits[ix] >= k).any()}
        for c in B.CATEGORICAL:
            values = profile[c].fillna("__MISSING__").astype(str)
            all_ = values.value_counts(normalize=True)
            by.setdefault(c, []).append(js_of(values.iloc[ix].value_counts(normalize=True).reindex(all_.index, fill_value=0).to_numpy(), all_.to_numpy()))
            common = {v for v, n in values.value_counts().items() if n >= B.REQUIRED_COUNT and v not in ("__MISSING__", "__RARE__")}
            if c == "diagnosis_first" and not common <= set(values.iloc[ix]):
                reasons.add(f"missing_required_diagnosis_category:{s}")
        for c in B.NUMERIC:
            x = profile[c].to_numpy(float)
            known = np.isfinite(x)
            if known.sum() >= 2 and x[known].std() > 0:
                z = (x - x[known].mean()) / x[known].std()
                mine = z[ix][np.isfinite(z[ix])]
                by.setdefault(c, []).append(w1_of(z[known], mine) if len(mine) else np.inf)
    scores = {c: (np.mean(d) + np.max(d)) / 2 for c, d in by.items()}
    live = {c: d for c, d in scores.items() if np.isfinite(d)}
    return np.mean(list(live.values())), max(live.values()), not reasons, "|".join(sorted(reasons))


def test_split_search_scores(spark):
    """Many candidates at once score as each by itself, with missing cells, rare categories and a constant criterion."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"participant": np.arange(70), "n_visits": rng.choice([1, 1, 1, 2, 3], 70), "followup_months": np.where(rng.random(70) < 0.2, np.nan, rng.integers(0, 9, 70)), "modality_count_mean": 2.0})
    for c in B.CATEGORICAL:
        pdf[c] = rng.choice(["u", "v", "w", None], 70, p=[0.6, 0.2, 0.15, 0.05])
    got = B.search_splits(spark.createDataFrame(pdf), 60, tasks=2).orderBy("candidate_id").toPandas()
    profile = pdf.sort_values("participant").reset_index(drop=True)
    for r in got.itertuples():
        score, worst, valid, reasons = split_one_by_one(profile, r.seed)
        assert (r.score_final, r.score_max_component) == pytest.approx((score, worst), rel=1e-9) and (r.is_valid, r.rejection_reasons) == (valid, reasons)
    assert 0 < got["is_valid"].sum() < 60


def test_split_search_counts_codes_not_cells():
    """A candidate costs its permutation and counts of codes in the smaller splits, whatever the number of criteria; codes that need over 63 bits take several words."""
    rng = np.random.default_rng(8)
    n = 5000
    pdf = pd.DataFrame({"n_visits": rng.permutation(n) + 1, "followup_months": rng.permutation(n) / 3, "modality_count_mean": np.where(rng.random(n) < 0.1, np.nan, rng.permutation(n))})
    for c in B.CATEGORICAL:
        pdf[c] = rng.choice([f"v{k}" for k in range(40)], n)
    context = B.SearchContext.of(pdf)
    assert len(context.words) == 2  # five times 6 bits, four times 13
    got, order, at = context.counts([5]), np.random.default_rng(5).permutation(n), 0
    for s, size in enumerate(context.sizes.values()):
        mine, at = pdf.iloc[order[at : at + size]], at + size
        assert got["sex"][s, 0].tolist() == mine["sex"].value_counts().reindex(sorted(pdf["sex"].unique()), fill_value=0).tolist()
        x = mine["modality_count_mean"]
        assert got["modality_count_mean"][s, 0].tolist() == [*x.value_counts().reindex(sorted(pdf["modality_count_mean"].dropna()), fill_value=0), x.isna().sum()]


def test_split_search_permutes_as_numpy(monkeypatch):
    """Only the smaller splits are permuted, and as the whole permutation has them; draws are judged many at once."""
    monkeypatch.setattr(B, "REPLAYED", 0)
    assert B.replays()
    for n in (1, 2, 3, 70, 1024, 1025, 40_000, 150_000):
        for seed in range(3):
            order = np.random.default_rng(seed).permutation(n)
            for m in (0, n // 2, int(0.7 * n)):
                assert np.array_equal(B.permuted_tail(n, m, seed), order[m:])


def test_split_search_of_many_participants(spark):
    """Over two million participants; counts and codes are made in tasks, and give what the whole profile gives."""
    n = 2_000_500
    number = F.col("id")
    df = spark.range(0, n, 1, 4).select(number.alias("participant"), (number % 5 + 1).alias("n_visits"), F.when(number % 7 > 0, number % 61 / 3).alias("followup_months"), (number % 3).cast("double").alias("modality_count_mean"), *[F.when(number % 11 > 0, (number % k).cast("string")).alias(c) for k, c in enumerate(B.CATEGORICAL, 2)])
    assert B.search_splits(df, 1, tasks=1).count() == 1
    assert B.split_mapping(df, 3).groupBy("split").count().collect()
    small = df.filter(number % 500 == 0)
    context, whole = B.search_context(small), B.SearchContext.of(small.orderBy("participant").toPandas())
    assert context.place == whole.place and all(np.array_equal(a, b) for a, b in zip(context.words, whole.words, strict=True))
    assert context.score([5, 6]) == whole.score([5, 6])
    ids, order = sorted(r[0] for r in small.select("participant").collect()), np.random.default_rng(3).permutation(4001)
    got = {r["participant"]: r["split"] for r in B.split_mapping(small.repartition(5), 3).collect()}
    assert got == {ids[k]: s for s, at in zip(B.SHARES, np.split(order, np.cumsum(list(B.split_sizes(4001).values()))[:2]), strict=True) for k in at}


def test_best_split_replayed_by_operators(spark, small):
    """The best candidate's mapping gives its score again through the Spark operators of each distance."""
    from visitloom.plans.model_queries import _profile

    profile = _profile(spark, small)
    best = B.search_splits(profile, 300, tasks=4).orderBy("score_final").first()
    df = profile.join(B.split_mapping(profile, best["seed"]), "participant").cache()
    per = [B.js_distance(df, c, "split").withColumn("criterion", F.lit(c)) for c in B.CATEGORICAL] + [B.wasserstein(df, c, "split").withColumn("criterion", F.lit(c)) for c in B.NUMERIC]
    total = df.agg(F.sum("n_visits")).first()[0]
    share = F.create_map(*[F.lit(x) for kv in B.SHARES.items() for x in kv])[F.col("split")]
    visits = df.groupBy("split").agg(F.sum("n_visits").alias("v")).select("split", F.abs(F.col("v") / total - share).alias("distance"), F.lit("visit_proportion").alias("criterion"))
    out = B.score_criteria(R.union_all([*per, visits])).first()
    assert out["score_final"] == pytest.approx(best["score_final"], rel=1e-6) and out["worst"] == best["score_max_component_name"]


@pytest.mark.parametrize("cell_rows", [5000, 60])
def test_neighbours_in_cells(spark, cell_rows):
    """Clusters, one of them crowded, repeated vectors and ties: as all distances give them, and most rows are never compared."""
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 10, (25, 8))
    x = centres[np.where(rng.random(1200) < 0.33, 0, rng.integers(0, 25, 1200))] + rng.normal(0, 0.5, (1200, 8)).round(2)
    x[100:140] = x[7]
    df = spark.createDataFrame([(i, v, f"r{i}") for i, v in enumerate(x.tolist())], "id long, v array<double>, name string").repartition(3)
    ask = np.arange(0, 1200, 15)
    got = {}
    visited = {}
    for r in L.knn_neighbours(df, df.filter("id % 15 = 0").select("id", "v"), "id", "v", 12, ["name"], cell_rows=cell_rows).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["neighbour"], r["distance"])
        visited[r["id"]] = r["visited"]
        assert r["name"] == f"r{r['neighbour']}"
    assert set(got) == set(ask.tolist())
    for i in ask.tolist():
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        best = np.lexsort((np.arange(1200), d))[:12]
        assert [got[i][k][0] for k in range(1, 13)] == best.tolist() and [got[i][k][1] for k in range(1, 13)] == d[best].tolist()
    assert np.mean(list(visited.values())) < 0.4 * 1200
    few = L.knn_neighbours(df.limit(3), df.filter("id = 5"), "id", "v", 12)
    assert few.count() == 3 and L.knn_neighbours(df.limit(0), df, "id", "v", 2).count() == 0


def test_queries_are_copied_by_parts_not_cells(spark, monkeypatch):
    """In many dimensions bounds leave nearly every cell; a query then goes once to each part, and a large k makes the turns smaller."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 40))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    sent = []
    keep = L.staged
    monkeypatch.setattr(L, "staged", lambda d, name: sent.append((name, keep(d, name))) or sent[-1][1])
    monkeypatch.setattr(L, "TURN_NEIGHBOURS", 300)
    got = {(r["id"], r["rank"]): r["neighbour"] for r in L.knn_neighbours(df.filter("id >= 100"), df.filter("id < 100"), "id", "v", 30, cell_rows=300).collect()}
    for i in range(100):
        d = np.sqrt(((x[100:] - x[i]) ** 2).sum(1))
        assert [got[i, k] for k in range(1, 31)] == (np.argsort(d, kind="stable")[:30] + 100).tolist()
    assert dict(sent)["visits"].count() <= 100 * 4  # 28 cells in three or four parts


def test_knn_trials_of_the_grid(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(150, 4)), rng.normal(size=(150, 2))
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist(), str(i % 7)) for i in range(150)], "i long, x array<double>, y array<double>, p string")
    want = [c for c in L.grid() if c["model"] == "knn" and c["k"] <= 80]
    got = {r["configuration_id"]: r for r in L.run_grid(df.filter("i < 100"), df.filter("i >= 100"), "x", "y", "p", want, key="i").collect()}
    for c in want:
        e = []
        for i in range(100, 150):
            d = np.sqrt(((x[:100] - x[i]) ** 2).sum(1))
            near = np.argsort(d, kind="stable")[: c["k"]]
            w = np.ones(c["k"]) if c["weights"] == "uniform" else 1 / d[near]
            e.append(w @ y[near] / w.sum() - y[i])
        per = pd.DataFrame({"p": [i % 7 for i in range(100, 150)], "s": (np.array(e) ** 2).mean(1)}).groupby("p")["s"].mean()
        assert got[c["configuration_id"]]["participant_macro_rmse"] == pytest.approx(np.sqrt(per).mean(), rel=1e-9)


def test_memory_of_a_block_not_of_the_process():
    import time

    with L.PeakMemory() as large:
        block = np.ones(40_000_000)
        time.sleep(0.1)
        del block
    with L.PeakMemory() as small:
        time.sleep(0.05)
    assert large.peak_mb > small.peak_mb + 200


# --- features, governance, sources ---


def test_schema_and_ids(spark):
    assert X.decision_id({"b": 1, "a": 2}) == X.decision_id({"a": 2, "b": 1}) and len(X.decision_id({}, 16)) == 16
    cat = spark.createDataFrame([("f",), ("g",), ("h",)], "feature string")
    d, leg = spark.createDataFrame([("f", "in")], "feature string, decision string"), spark.createDataFrame([("f", "out"), ("g", "in")], "feature string, decision string")
    assert {r["feature"]: r["decision"] for r in X.directive_table(cat, d, leg, ["feature"]).collect()} == {"f": "in", "g": "in", "h": "exclude"}


def test_checks_and_validator(spark):
    c = G.Checks()
    splits = spark.createDataFrame([("1", "train"), ("2", "test")], "RID string, split string")
    visits = spark.createDataFrame([("1", "bl", 1), ("1", "m12", 2), ("2", "bl", 1)], "RID string, V string, pos int")
    targets = visits.select("RID", "V", F.lit(1.0).alias("t"))
    G.validate_package(c, splits, visits, targets, {"s": targets}, "RID", ["RID", "V"], "pos", ["t"])
    c.gate()
    bad = G.Checks()
    G.validate_package(bad, splits, visits.withColumn("pos", F.col("pos") + 1), targets.limit(2), {}, "RID", ["RID", "V"], "pos", ["t"])
    assert {r[0] for r in bad.records if not r[1]} == {"positions_consecutive", "visit_and_target_keys_equal"}
    with pytest.raises(G.GateError):
        bad.gate()
    assert c.frame(spark).count() == len(c.records) and "Checks" in G.story("t", {"a": 1}, c)
    with pytest.raises(G.GateError):
        G.safe_report(visits, ["RID"], ["RID"])


def test_sources(spark, tmp_path):
    (tmp_path / "x_DXSUM.csv").write_text("RID,VISCODE2,VALUE\n001,BL,-1\n002,m06, observed \n")
    files = tables.discover(tmp_path, ["dxsum"])
    df = tables.load_all(spark, {"D": files["dxsum"]}, {"D": V.Contract("D", "visit", ("RID", "VISCODE2"), ("RID", "VISCODE2"))})["D"]
    assert sorted(map(tuple, df.collect())) == [("1", "bl", None), ("2", "m06", "observed")]
    (tmp_path / "y_DXSUM.csv").write_text("A,A\n1,2\n")
    with pytest.raises(tables.SourceError):
        tables.discover(tmp_path, ["DXSUM"])
    with pytest.raises(tables.SourceError):
        tables.read_header(tmp_path / "y_DXSUM.csv")
    with pytest.raises(tables.SourceError):
        tables.check_contract(df, V.Contract("D", "visit", ("RID",), ("RID", "GONE")))
    t = spark.createDataFrame([("1", "bl", "train", "1.5"), ("2", "bl", "test", "secret")], "RID string, V string, split string, t string")
    assert tables.development_targets(t, ["RID", "V"], ["t"], directory=f"file://{tmp_path}/dev").first()["t"] == 1.5
    assert tables.tree_fingerprints(spark, str(tmp_path)).count() >= 2


def test_packages(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    one, two = packages.csv_bytes(df, ["k"], True), packages.csv_bytes(df.orderBy("v"), ["k"], True)
    assert one == two and packages.csv_bytes(df, ["k"]) == b"k,v\n1,a\n2,b\n"
    target = tmp_path / "pkg"
    packages.commit_package(target, lambda p: packages.write_json(p / "a.json", {"x": 1}) and None, lambda p: None)
    with pytest.raises(FileExistsError):
        packages.commit_package(target, lambda p: None, lambda p: None)
    packages.commit_package(target, lambda p: packages.write_json(p / "b.json", {"y": 2}) and None, lambda p: None, overwrite=True, archive=tmp_path / "old")
    assert (tmp_path / "old" / "pkg-001" / "a.json").exists() and (target / "b.json").exists()
    listed = packages.inventory(target)
    assert not any(packages.verify_inventory(target, listed).values())
    (target / "b.json").write_text("changed")
    found = packages.verify_inventory(target, [*listed, {"path": "../up", "size": 0, "sha256": ""}])
    assert found["changed"] == ["b.json"] and found["unsafe"] == ["../up"]
    r = spark.createDataFrame([(1, 0.5), (2, 0.6)], "candidate_id int, s double")
    path = f"file://{tmp_path}/results"
    packages.append_results(r, path, "candidate_id")
    done = packages.append_results(spark.createDataFrame([(2, 9.0), (3, 0.7)], r.schema), path, "candidate_id")
    assert done.count() == 3 and packages.next_candidate(done) == 4
    packages.write_model(spark, f"file://{tmp_path}/model", {"m": {"a": 1.5}})
    assert packages.read_model(spark, f"file://{tmp_path}/model") == {"m": {"a": 1.5}}
    kv = packages.parse_pairs(spark.createDataFrame([("a=1\nb = 2",)], "t string"), "t")
    assert {r["key"]: r["value"] for r in kv.collect()} == {"a": "1", "b": "2"}


def test_left_join_checks_keys(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError):
        R.left_join_one(a, b, ["k"])
    assert R.left_join_one(a, b.limit(1), ["k"]).count() == 2


def test_quantiles_by_selection(spark):
    """Heavy tails, few values, missing cells, null and small groups: as one sort of each group would give them."""
    rng = np.random.default_rng(1)
    rows = [(None if i % 3 == 0 else "ab"[i % 2], float(rng.lognormal(0, 8)) if i % 11 else None, float(rng.integers(0, 4)), float(i) if i < 5 else None, -0.0 if i % 2 else 0.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double, w double").repartition(3)
    shares = [0, 0.1, 0.25, 0.5, 1]
    want = {}
    for g in (None, "a", "b"):
        for i, f in enumerate("xyzw", 1):
            if v := sorted(r[i] for r in rows if r[0] == g and r[i] is not None):
                want[g, f] = (len(v), [float(np.percentile(v, 100 * s)) for s in shares])
    got = {(r["g"], r["feature"]): (r["n"], r["q"]) for r in exact_quantiles(df, ["g"], list("xyzw"), shares, small=40, accuracy=200).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-12)
    assert exact_quantiles(df.limit(0), [], ["x"], [0.5]).count() == 0


def test_positions_of_a_hot_key(spark):
    """Null keys and null order values, a key with most rows, ties broken by the last column."""
    rng = np.random.default_rng(2)
    rows = [(None if i % 2 else i % 7, None if i % 10 == 0 else int(rng.integers(0, 300)), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, o int, i int").repartition(4)
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0, r[2])), 1):
            want[r[2]] = n
    out = R.with_position(df, ["k"], ["o", "i"], hot_rows=500)
    assert {r["i"]: r["position"] for r in out.collect()} == want
    plain = R.with_position(df, ["k"], ["o", "i"])
    assert plain.schema == out.schema and {r["i"]: r["position"] for r in plain.collect()} == want


def test_ordered_digest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "SORTED_BYTES", 2000)
    monkeypatch.setattr(A, "BLOCK_BYTES", 300)
    rows = [(i % 50, None if i % 9 == 0 else f"x{i % 3}") for i in range(3000)] + [(7, "same")] * 1000
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    lines = [line for _, line in sorted((a, f"{a}|{'<NA>' if b is None else b}") for a, b in rows)]
    assert tuple(A.table_hash(df, ["a"], ["a", "b"]).first()) == (4000, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert tuple(A.table_hash(df.limit(0), ["a"], ["a", "b"]).first()) == (0, hashlib.sha256(b"").hexdigest())


def test_baseline_of_every_person(spark):
    rows = [
        ("none", None, None, 4, None), ("none", None, None, None, 9),  # nothing tells which came first, and neither covers the other
        ("alike", None, None, 4, None), ("alike", None, None, 4, None),
        ("covers", None, None, 4, 9), ("covers", None, None, 4, None),  # without evidence only equivalent rows resolve
        ("undated", 0, None, 1, None), ("undated", 0, None, 1, 2), ("undated", 6, None, 5, 5),
        ("apart", 0, 10, 4, None), ("apart", 0, 10, None, 9), ("apart", 0, 12, 7, 7),
        ("dated", None, 3, 1, 1), ("dated", None, None, 2, 2), ("dated", None, 5, 3, 3),
        ("twice", 0, 10, 4, 9), ("twice", 0, 10, 4, 9), ("twice", 0, 10, 4, None),
    ]
    df = spark.createDataFrame(rows, "p string, w int, d int, a int, b int")
    got = {r["p"]: tuple(r)[1:] for r in X.refine_baseline(df, "p", "w", "d", ["a", "b"]).collect()}
    wave, dated = "earliest_protocol_wave", "+earliest_date_within_wave"
    assert got == {
        "none": (2, "no_temporal_evidence", "unresolved_no_temporal_evidence", None, None),
        "alike": (2, "no_temporal_evidence", "same_time_equivalent_duplicate", 4, None),
        "covers": (2, "no_temporal_evidence", "unresolved_no_temporal_evidence", None, None),
        "undated": (2, wave, "same_time_unique_dominant_record", 1, 2),
        "apart": (2, wave + dated, "same_time_unresolved_conflict", None, None),
        "dated": (1, "earliest_available_clinical_date", "unique_temporal_candidate", 1, 1),
        "twice": (3, wave + dated, "same_time_unresolved_conflict", None, None),  # two rows cover
    }


def test_constraints_of_entities(spark):
    people = spark.createDataFrame([("1", "train"), ("2", "test")], "p string, s string")
    rows = [("1", 1, "train", "1.5"), ("1", 2, "train", "x"), ("2", 1, "train", "inf"), ("3", 1, "test", None), (None, 1, "test", "2"), ("", 2, "valid", "2"), ("2", 1, "test", "nan")]
    visits = spark.createDataFrame(rows, "p string, i int, s string, y string")
    entities = {
        "people": K.Entity(people, ("p",), rows=2),
        "visits": K.Entity(
            visits, ("p", "i"), domains={"s": ("train", "test")}, numeric=("y",), finite=("y",), parents={"person": K.Parent("people", {"p": "p"}, {"s": "s"})},
            positions=(("p",), "i"), rules={"second": F.col("i") == 2}, counts={"train": (F.col("s") == "train", 3)},
        ),
        "lame": K.Entity(people, ("p",), ("q",)),
    }
    c = G.Checks()
    K.validate(c, entities, {"twin": K.Twin("visits", "visits", {"s": "s"})})
    got = {name: observed for name, _, _, observed in c.records}
    want = {
        "visits_missing_key": "2", "visits_domain_s": "1", "visits_numeric_y": "2", "visits_finite_y": "4", "visits_second": "2", "visits_orphans_person": "3",
        "visits_differ_person_s": "1", "visits_duplicate_key": "1", "visits_broken_positions": "2", "visits_train": "3", "lame_required_columns": "q", "people_total": "2",
        "twin_left_only": "1", "twin_right_only": "1", "twin_differ_s": "0",
    }
    assert {k: got[k] for k in want} == want and "lame_missing_key" not in got
    policy = {"a": 1, "b": {"c": [1]}}
    K.locked(c, "policy", policy | {"id": X.decision_id(policy), "note": 5}, "id", ["note"])
    K.facts(c, "policy", policy, {"b.c": [1], "a": True, "b.c.d": None})
    assert [r[1] for r in c.records[-4:]] == [True, True, False, True]


def test_counts_of_tasks_that_ran_twice(spark):
    """A chain whose observed and collected row counts differ runs again."""
    from pyspark.sql import Observation

    calls = []

    def make(wrong):
        def once():
            o = Observation(f"o{len(calls)}")
            calls.append(1)
            df = spark.range(10).observe(o, (F.count(F.lit(1)) + (1 if len(calls) <= wrong else 0)).alias("rows"))
            return [o], df.agg(F.count(F.lit(1)).alias("end"))

        return once

    assert K._run(make(1), "rows", "end")["rows"] == 10 and len(calls) == 2
    with pytest.raises(G.GateError):
        K._run(make(99), "rows", "end")


def test_reports_in_a_file_system_that_is_not_local(spark, tmp_path, monkeypatch):
    """Reports and packages by a URI that open() cannot reach; stretches of few rows, so that there are many."""
    import gzip

    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.reports.link./data", f"file://{tmp_path}")
    monkeypatch.setattr(shared, "MEMBER_ROWS", 40)
    root = "viewfs://reports/data"
    rows = [(i % 7, f"x{i % 3},{i}", None if i % 5 == 0 else i) for i in range(333)]
    df = spark.createDataFrame(rows, "a int, b string, c int")
    want = pd.DataFrame(sorted(rows, key=lambda r: (r[0], r[1])), columns=["a", "b", "c"]).astype({"c": "Int64"}).to_csv(index=False, lineterminator="\n").encode()
    df = df.withColumn("c", F.col("c").cast("string"))
    for n in (1, 5):  # however the rows were dealt out
        shared.write_report(df.repartition(n), ["a", "b"], f"{root}/r{n}.csv")
        shared.write_report(df.repartition(n), ["a", "b"], f"{root}/r{n}.csv.gz", compressed=True)
    assert (tmp_path / "r1.csv").read_bytes() == (tmp_path / "r5.csv").read_bytes() == want
    assert (tmp_path / "r1.csv.gz").read_bytes() == (tmp_path / "r5.csv.gz").read_bytes() and gzip.decompress((tmp_path / "r1.csv.gz").read_bytes()) == want
    back, encoding = shared.read_text_table(spark, shared.discover(spark, root, ["R5.csv.GZ"])["R5.csv.GZ"])
    assert encoding == "utf-8-sig" and back.count() == 333 and back.columns == ["a", "b", "c"]
    shared.write_report(df.limit(0), ["a"], f"{root}/none.csv")
    assert (tmp_path / "none.csv").read_text() == "a,b,c\n"
    with pytest.raises(tables.SourceError):
        shared.discover(spark, root, ["r1"])
    put = lambda at: shared.write_bytes(spark, f"{at}/one.txt", b"1")
    listed = shared.commit_package(spark, f"{root}/p", put, lambda at: None)
    assert [tuple(r) for r in listed.collect()] == [("one.txt", 1, hashlib.sha256(b"1").hexdigest())]
    with pytest.raises(FileExistsError):
        shared.commit_package(spark, f"{root}/p", put, lambda at: None)

    def fails(at):
        raise ValueError(at)

    with pytest.raises(ValueError):
        shared.commit_package(spark, f"{root}/p", put, fails, overwrite=True)
    assert [f.name for f in tmp_path.iterdir() if f.name.startswith("p")] == ["p"]
    shared.write_bytes(spark, f"{root}/p/two.txt", b"2")
    assert shared.verify_package(spark, f"{root}/p", listed) == {"missing": 0, "unlisted": 1, "changed": 0, "unsafe": 0}
    shared.commit_package(spark, f"{root}/p", put, lambda at: None, overwrite=True)
    assert shared.verify_package(spark, f"{root}/p", listed) == {"missing": 0, "unlisted": 0, "changed": 0, "unsafe": 0}


def test_positions_of_rows_not_of_keys(spark):
    """Two rows of one key with different positions: the positions of the rows are whole, the key is repeated."""
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 3, 3), ("b", 1, 1), ("b", 2, 1), (None, 4, 1), (None, 5, None)], "p string, v int, i int")
    checks = G.Checks()
    K.validate(checks, {"e": K.Entity(df, ("p", "v"), positions=(("p",), "i"))})
    got = {r["check"]: r["observed"] for r in checks.frame(spark).collect()}
    assert (got["e_broken_positions"], got["e_duplicate_key"], got["e_missing_key"]) == ("2", "1", "2")


def test_digest_blocks_travel_compressed():
    lines = [f"1-URGENT|{i // 10}|{i}|O" for i in range(50_000)]
    blocks = list(A._line_blocks(iter([pa.RecordBatch.from_arrays([pa.array(lines)], names=["l"])])))
    assert sum(b.num_rows for b in blocks) == len(blocks) and sum(b.column(1)[0].as_py() for b in blocks) == len(lines)
    assert sum(len(b.column(0)[0].as_py()) for b in blocks) < sum(map(len, lines)) / 3


def test_date_profile_multiplies_no_rows(spark):
    rows = [(1, "2024-01-01", "a", "x"), (1, "2024-01-03", "a", None), (1, "2024-01-03", None, "x"), (1, "2024-01-03", "b", "x"), (1, None, "c", "x")]
    d = spark.createDataFrame(rows, "k int, d string, s string, c string").withColumn("d", F.to_date("d"))
    out = T.date_profile(d, ["k"], "d", "s", "c")
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    r = out.first()
    assert (r["observed_cells"], r["distinct_dates"], r["sources"], r["fields"], str(r["date_median"]), r["span_days"]) == (4, 2, 2, 2, "2024-01-03", 2)


def test_ledger_of_numbered_rows_is_one_join(spark):
    rows = [(1, "x", 7), (1, "x", 5), (2, "y", 1), (3, "p", 2), (3, "q", 3), (4, None, 8), (4, "z", 9), (None, "n", 4)]
    df = spark.createDataFrame(rows, "k int, a string, __source_row long")
    out = V.resolve(df, V.Contract("t", "visit", ("k",))).ledger()
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = {r["__source_row"]: (r["action"], r["reason"], r["group_rows"]) for r in out.collect()}
    assert got == {
        7: ("excluded", "not_selected", 2), 5: ("selected", V.EQUIVALENT, 2), 1: ("selected", V.UNIQUE, 1), 2: ("excluded", "unresolved_group", 2), 3: ("excluded", "unresolved_group", 2),
        8: ("excluded", "not_selected", 2), 9: ("selected", V.DOMINANT, 2), 4: ("excluded", "missing_key", 0),
    }


def test_quantiles_take_one_count_of_values(spark, monkeypatch):
    """However few values are sorted in one place, different values are counted once and only the ranges that hold a rank are sorted."""
    from visitloom.operators import quantiles as Q

    written = []
    keep = Q.staged
    monkeypatch.setattr(Q, "staged", lambda d, name: written.append(name) or keep(d, name))
    x = np.random.default_rng(3).integers(0, 4000, 20_000) / 7
    df = spark.createDataFrame(pd.DataFrame({"g": np.where(np.arange(20_000) % 3 == 0, "a", None), "x": x}))
    got = {r["g"]: (r["n"], r["q"]) for r in exact_quantiles(df, ["g"], ["x"], [0, 0.1, 0.5, 0.99, 1], small=10).collect()}
    for g, mine in (("a", x[::3]), (None, np.delete(x, np.arange(0, 20_000, 3)))):
        assert got[g][0] == len(mine) and np.allclose(got[g][1], np.quantile(mine, [0, 0.1, 0.5, 0.99, 1]))
    assert written == ["sizes", "rank-counts", "rank-ranges", "ranks"]
