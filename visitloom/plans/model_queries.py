"""Preprocessing, metrics, models and the split search bound to the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from visitloom.operators import balance as B
from visitloom.operators import forest as W
from visitloom.operators import metrics as M
from visitloom.operators import models as L
from visitloom.operators import preprocess as P
from visitloom.operators import tables as R
from visitloom.plans.registry import query
from visitloom.session import shared_folder, table


@query("WITH m AS (SELECT quantile_cont(l_discount, 0.5) FILTER (WHERE l_discount <> 0) AS d, quantile_cont(l_tax, 0.5) FILTER (WHERE l_tax <> 0) AS t FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount <> 0 THEN l_discount ELSE d END, 6) AS discount, CAST(l_discount = 0 AS INT) AS discount_missing, round(CASE WHEN l_tax <> 0 THEN l_tax ELSE t END, 6) AS tax FROM lineitem, m")
def impute_indicator(spark, sf):
    """M01."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.nullif("l_discount", F.lit(0.0)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("t"))
    m = P.medians(df, ["d", "t"])
    d, missing = P.impute("d", m["d"])
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.round(d, 6).alias("discount"), missing.cast("int").alias("discount_missing"), F.round(P.impute("t", m["t"])[0], 6).alias("tax"))


@query("WITH m AS (SELECT avg(c_acctbal) AS a, stddev_pop(c_acctbal) AS s FROM customer WHERE c_custkey % 20 < 14) SELECT c_custkey, round((c_acctbal - a) / s, 6) AS z, 0.0 AS constant FROM customer, m")
def standardize(spark, sf):
    """Fitted on train, applied to all; a constant column scales by 1."""
    c = table(spark, sf, "customer").withColumn("one", F.lit(1.0))
    s = P.scaling(c.filter("c_custkey % 20 < 14"), ["c_acctbal", "one"])
    return c.select("c_custkey", F.round(P.standardize(F.col("c_acctbal"), *s["c_acctbal"]), 6).alias("z"), P.standardize(F.col("one"), *s["one"]).alias("constant"))


@query("SELECT c_mktsegment, c_custkey % 3 AS g, count(*) AS rows, CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 3 <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS building, CAST(sum(CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM customer GROUP BY 1, 2")
def one_hot(spark, sf):
    """The missing category is one of the train categories."""
    c = table(spark, sf, "customer").withColumn("s", F.when(F.col("c_custkey") % 3 != 2, F.col("c_mktsegment")))
    levels = P.categories(c.filter("c_custkey % 20 < 14"), "s")
    hot = c.select("*", *P.one_hot("s", levels))
    return hot.groupBy("c_mktsegment", (F.col("c_custkey") % 3).alias("g")).agg(F.count(F.lit(1)).alias("rows"), F.sum("`s=BUILDING`").cast("long").alias("building"), F.sum("`s=__MISSING__`").cast("long").alias("missing"))


@query("""
WITH t AS (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS w FROM part), v AS (SELECT list(DISTINCT x) AS known FROM (SELECT unnest(w) AS x FROM t WHERE p_partkey % 20 < 14))
SELECT p_partkey, CAST(len(list_distinct(list_intersect(w, known))) AS BIGINT) AS known, CAST(len(list_filter(w, lambda x: NOT list_contains(known, x))) > 0 AS BIGINT) AS unknown FROM t, v
""")
def multi_hot(spark, sf):
    """The vocabulary of the train parts, applied to all."""
    p = table(spark, sf, "part").select("p_partkey", F.translate("p_name", " ", ";").alias("w"))
    words = P.vocabulary(p.filter("p_partkey % 20 < 14"), "w")
    cols = P.multi_hot("w", words)
    known = F.aggregate(F.array(*cols[: len(words)]), F.lit(0.0), lambda a, x: a + x)
    return p.select("p_partkey", known.cast("long").alias("known"), cols[-1].cast("long").alias("unknown"))


@query("SELECT 'constant' AS dropped UNION ALL SELECT 'nothing'")
def zero_range(spark, sf):
    """M05."""
    df = table(spark, sf, "lineitem").select("l_quantity", F.lit(3.0).alias("constant"), F.lit(None).cast("double").alias("nothing"), "l_tax")
    return spark.createDataFrame([(c,) for c in P.zero_range(df, df.columns)], "dropped string")


@query("""
WITH m AS (SELECT quantile_cont(l_discount, 0.5) FILTER (WHERE l_discount <> 0) AS md FROM lineitem WHERE l_orderkey % 5 < 4),
f AS (SELECT l_orderkey, CASE WHEN l_discount <> 0 THEN l_discount ELSE md END AS d, (l_discount = 0)::INT AS miss, l_returnflag AS g FROM lineitem, m), s AS (SELECT avg(d) AS a, stddev_pop(d) AS sd FROM f WHERE l_orderkey % 5 < 4)
SELECT count(*) AS rows, 5 AS width, round(sum((d - a) / sd), 3) AS d, CAST(sum(miss) AS DOUBLE) AS missing, CAST(count(*) FILTER (WHERE g = 'A') AS DOUBLE) AS a FROM f, s WHERE l_orderkey % 5 = 4
""")
def preprocess_scenario(spark, sf):
    """Fitted on train orders, applied to the others; the columns of the encoded matrix summed up."""
    df = table(spark, sf, "lineitem").select("l_orderkey", F.nullif("l_discount", F.lit(0.0)).alias("d"), F.col("l_returnflag").alias("g"), F.lit(1.0).alias("const"))
    pre = P.Preprocessor(["d", "const"], [], ["g"], []).fit(df.filter("l_orderkey % 5 < 4"))
    x = pre.transform(df.filter("l_orderkey % 5 = 4"), ["l_orderkey"])
    n = pre.names()
    total = lambda c: F.sum(F.col("x")[n.index(c)].cast("double"))
    return x.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("x")).alias("width"), F.round(total("d"), 3).alias("d"), total("d__missing").alias("missing"), total("g=A").alias("a"))


LONG = "l AS (SELECT l_suppkey AS participant, l_orderkey AS r, t, y, avg(y) OVER (PARTITION BY t, l_partkey) AS p FROM (SELECT l_suppkey, l_orderkey, l_partkey, 'q' AS t, l_quantity / 10 AS y FROM lineitem UNION ALL SELECT l_suppkey, l_orderkey, l_partkey, 'd', l_discount * 10 FROM lineitem))"


def _long(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("participant"), F.col("l_orderkey").alias("row"), "l_partkey", (F.col("l_quantity") / 10).alias("q"), (F.col("l_discount") * 10).alias("d"))
    means = li.groupBy(F.col("l_partkey").alias("k")).agg(F.avg("q").alias("mq"), F.avg("d").alias("md"))
    j = li.join(means, F.col("l_partkey") == F.col("k"))
    return j.select("participant", "row", F.inline(F.array(F.struct(F.lit("q").alias("target"), F.col("q").alias("y"), F.col("mq").alias("p")), F.struct(F.lit("d").alias("target"), F.col("d").alias("y"), F.col("md").alias("p")))))


@query(f"WITH {LONG}, a AS (SELECT participant, r, avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae FROM l GROUP BY 1, 2), b AS (SELECT participant, avg(mse) AS m, avg(mae) AS e FROM a GROUP BY 1) SELECT round(avg(sqrt(m)), 6) AS participant_macro_rmse, round(avg(e), 6) AS participant_macro_mae, (SELECT round(sqrt(avg(mse)), 6) FROM a) AS visit_weighted_rmse, (SELECT round(avg(mae), 6) FROM a) AS visit_weighted_mae, count(*) AS participants, (SELECT count(*) FROM a) AS rows FROM b")
def macro_metrics(spark, sf):
    """A19."""
    m = M.macro_metrics(_long(spark, sf))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns[:4]], "participants", "rows")


@query(f"WITH {LONG}, s AS (SELECT t, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, corr(y, p) AS c, sum((y - p) ** 2) AS e, var_pop(y) * count(*) AS v FROM l GROUP BY 1) SELECT round(avg(r2), 6) AS r2_uniform, round(1 - sum(e) / sum(v), 6) AS r2_weighted, round(quantile_cont(c, 0.5), 6) AS median_pearson, round(quantile_cont(r2, 0.5), 6) AS median_r2, round(avg((r2 > 0)::INT), 6) AS positive_r2_share FROM s")
def r2_pearson(spark, sf):
    """A20."""
    s = M.score_summary(M.target_scores(_long(spark, sf)))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("SELECT o_custkey, round(a, 4) AS base, round(b, 4) AS other, round(b - a, 4) AS difference, round((b - a) * 100 / a, 4) AS percent FROM (SELECT o_custkey, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS a, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_comparison(spark, sf):
    """R20."""
    d = M.paired_difference(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", "F", "O", "o_totalprice")
    return d.select("o_custkey", *[F.round(c, 4).alias(c) for c in ("base", "other", "difference", "percent")])


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    return e, e.filter("vec_id % 5 < 4"), e.filter("vec_id % 5 = 4")


@query("""
WITH q AS (SELECT vec_id AS q, embedding AS a FROM embeddings WHERE vec_id % 5 = 4), t AS (SELECT vec_id AS n, embedding AS b, label FROM embeddings WHERE vec_id % 5 < 4),
d AS (SELECT q, n, label, row_number() OVER (PARTITION BY q ORDER BY round(list_distance(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])), 9), n) AS r FROM q, t)
SELECT q AS vec_id, round(avg(label), 6) AS prediction FROM d WHERE r <= 10 GROUP BY 1
""")
def knn_regress(spark, sf):
    """M11."""
    _, train, rest = _vectors(spark, sf)
    return L.knn_regress(train, rest, "vec_id", "x", "y", 10).withColumn("prediction", F.round("prediction", 6))


@query("""
WITH q AS (SELECT vec_id AS q, embedding AS a FROM embeddings WHERE vec_id % 5 = 4), t AS (SELECT vec_id AS n, embedding AS b FROM embeddings WHERE vec_id % 5 < 4),
d AS (SELECT q, n, list_distance(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])) AS d FROM q, t)
SELECT q AS vec_id, CAST(row_number() OVER (PARTITION BY q ORDER BY round(d, 9), n) AS INT) AS rank, n AS neighbour, round(d, 6) AS distance FROM d QUALIFY rank <= 5
""")
def knn_nearest(spark, sf):
    """The exact nearest neighbours, found by visiting only the Voronoi cells that the triangle inequality leaves."""
    _, train, rest = _vectors(spark, sf)
    return L.knn_neighbours(train, rest, "vec_id", "x", 5).select("vec_id", "rank", "neighbour", F.round("distance", 6).alias("distance"))


@query()
def pca90(spark, sf):
    """Share of variance and reconstruction error of standardized vectors."""
    e, train, _ = _vectors(spark, sf)
    z = L.standardized(e, "x", 64, train)
    pca = L.PCA.fit(z.filter("vec_id % 5 < 4"), "x")
    back = L.map_array(z, "x", lambda a: pca.inverse(pca.transform(a)))
    err = F.aggregate(F.zip_with("x", "out", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    split = F.when(F.col("vec_id") % 5 < 4, "train").otherwise("validation").alias("split")
    return back.groupBy(split).agg(F.lit(len(pca.ratio)).alias("components"), F.lit(float(pca.ratio.sum())).alias("explained"), F.sqrt(F.avg(err / 64)).alias("rmse"))


@query()
def ridge(spark, sf):
    """Baselines and ridge by normal equations."""
    _, train, rest = _vectors(spark, sf)
    t, v = train.withColumn("y", F.array("y")), rest.withColumn("y", F.array("y"))
    rows = [("mean", 0.0, L.mean_baseline(t, "y", 1), None), ("median", 0.0, L.median_baseline(t, "y", 1), None)]
    rows += [("ridge", a, b, w) for a, (w, b) in L.ridge(t, "x", "y", 64, [0.1, 1.0, 10.0]).items()]
    out = None
    for model, alpha, b, w in rows:
        pred = F.lit(float(b[0]))
        if w is not None:
            pred = pred + F.aggregate(F.zip_with("x", F.array(*[F.lit(float(c)) for c in w[:, 0]]), lambda a, c: a * c), F.lit(0.0), lambda s, x: s + x)
        r = v.agg(F.lit(model).alias("model"), F.lit(alpha).alias("alpha"), F.sqrt(F.avg((F.col("y")[0] - pred) ** 2)).alias("rmse"))
        out = r if out is None else out.union(r)
    return out


def _labelled(d):
    return d.select("vec_id", "x", F.array("y", F.col("x")[0] * 3 + F.col("x")[1]).alias("y"), (F.col("vec_id") % 50).cast("string").alias("participant"))


@query()
def model_grid(spark, sf):
    """All 53 declared configurations on vectors; the best trial of each model."""
    _, train, rest = _vectors(spark, sf)
    trials = L.run_grid(_labelled(train), _labelled(rest), "x", "y", "participant", L.grid(), key="vec_id")
    cols = ["configuration_order", "configuration_id", "model", "participant_macro_rmse", "participant_macro_mae", "converged"]
    return R.best_configurations(trials.select(*cols), ["model"], ["participant_macro_rmse", "participant_macro_mae", "configuration_order"], "converged", "configuration_order")


def _scenarios(spark, sf):
    """Sixteen targets from three sets of inputs: all others of the vector, its first half, its third quarter."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    y, who = F.slice("v", 49, 16).alias("y"), (F.col("vec_id") % 50).cast("string").alias("participant")
    parts = {"all_inputs": (1, 48), "first_half": (1, 32), "third_quarter": (33, 16)}
    both = {n: e.select("vec_id", F.slice("v", a, k).alias("x"), y, who) for n, (a, k) in parts.items()}
    return {n: (d.filter("vec_id % 5 < 4"), d.filter("vec_id % 5 = 4")) for n, d in both.items()}


@query()
def grid_resume(spark, sf):
    """Three scenarios, both target representations, every linear and neighbour configuration (``model_grid`` has the forests);
    the run is stopped after one scenario's first configurations and goes on. The best trial of each model, and how many ran.
    """
    path = f"{shared_folder(spark)}/trials-{uuid.uuid4().hex}"
    scenarios, configurations = _scenarios(spark, sf), [c for c in L.grid() if c["model"] != "extra_trees"]
    L.run_trials({"all_inputs": scenarios["all_inputs"]}, "x", "y", "participant", configurations[:10], path, "vec_id")
    trials = L.run_trials(scenarios, "x", "y", "participant", configurations, path, "vec_id")
    by = ["scenario", "representation", "model"]
    cols = [*by, "configuration_order", "configuration_id", "participant_macro_rmse", "participant_macro_mae", "converged"]
    best = R.best_configurations(trials.select(*cols), by, ["participant_macro_rmse", "participant_macro_mae", "configuration_order"], "converged", "configuration_order")
    return best.join(trials.groupBy(*by).agg(F.count(F.lit(1)).alias("trials")), by)


@query()
def extra_trees(spark, sf):
    """The three declared forests with five seeds each, 1,950 trees: prediction and seed stability of every validation vector."""
    _, train, rest = _vectors(spark, sf)
    out = W.extra_trees(_labelled(train), rest, "vec_id", "x", "y", L.FORESTS, L.FOREST_SEEDS)
    return out.select("vec_id", "forest", F.round(F.col("prediction")[0], 6).alias("label"), F.round(F.col("prediction")[1], 6).alias("sum"), F.round("spread", 6).alias("spread"))


def _profile(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    v = o.groupBy(F.col("o_custkey").alias("participant")).agg(F.count(F.lit(1)).alias("n_visits"), (F.datediff(F.max("o_orderdate"), F.min("o_orderdate")) / 30.4375).alias("followup_months"), F.count_distinct("o_orderpriority").cast("double").alias("modality_count_mean"), F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("modality_pattern_first"))
    cls = F.when(F.col("n_visits") <= 1, "1_visit").when(F.col("n_visits") == 2, "2_visits").otherwise("3plus_visits")
    return v.join(c, F.col("c_custkey") == F.col("participant")).select(
        "participant", "n_visits", "followup_months", "modality_count_mean", "modality_pattern_first", F.col("c_mktsegment").alias("diagnosis_first"),
        (F.col("c_custkey") % 2).cast("string").alias("sex"), (F.col("c_nationkey") % 3 > 0).cast("string").alias("apoe_availability"), cls.alias("longitudinal_class"),
    )


@query()
def split_search(spark, sf):
    """The ten best of the declared 100,000 seeded splits."""
    out = B.search_splits(_profile(spark, sf))
    return R.best_candidates(out, ["score_final", "score_max_component", "seed"], n=10)


@query("SELECT split, CAST(CASE split WHEN 'train' THEN round_even(n * 0.70, 0) WHEN 'validation' THEN round_even(n * 0.15, 0) ELSE n - round_even(n * 0.70, 0) - round_even(n * 0.15, 0) END AS BIGINT) AS participants FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders), (VALUES ('train'), ('validation'), ('test')) t(split)")
def split_sizes(spark, sf):
    """The sizes of the mapping of one seed."""
    return B.split_mapping(_profile(spark, sf), B.MASTER_SEED + 1).groupBy("split").agg(F.count(F.lit(1)).alias("participants"))


@query()
def pls(spark, sf):
    """Every declared number of components, from one pass of cross products."""
    _, train, rest = _vectors(spark, sf)
    want = [c for c in L.grid() if c["model"] == "pls"]
    one = lambda d: d.select("x", F.array("y").alias("y"), (F.col("vec_id") % 50).cast("string").alias("participant"))
    return L.run_grid(one(train), one(rest), "x", "y", "participant", want).select("configuration_id", "model", "participant_macro_rmse", "converged")
