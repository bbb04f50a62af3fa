"""Joins, resolution, aggregation, windows, time and balance bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom.functions import scalars as S
from visitloom.operators import aggregates as A
from visitloom.operators import balance as B
from visitloom.operators import features as X
from visitloom.operators import resolve as V
from visitloom.operators import tables as R
from visitloom.operators import temporal as T
from visitloom.operators.quantiles import exact_quantiles
from visitloom.plans.registry import query
from visitloom.session import staged, table

# --- time -------------------------------------------------------------------------------------------

VISITS_SQL = """
d AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS date_min, max(CAST(l_shipdate AS DATE)) AS date_max FROM lineitem GROUP BY 1),
v AS (SELECT o_custkey AS person, o_orderkey AS code, year(o_orderdate) * 12.0 + month(o_orderdate) AS month, date_min, date_max FROM orders LEFT JOIN d ON l_orderkey = o_orderkey),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY month DESC, code DESC) AS rn FROM v) WHERE rn = 1),
l AS (SELECT person, max(v.month) AS latest FROM v JOIN c USING (person) WHERE v.month < c.month GROUP BY 1),
t AS (SELECT v.* FROM v JOIN l ON l.person = v.person AND l.latest = v.month),
n AS (SELECT person, count(*) AS candidates, min(code) AS only_code FROM t GROUP BY 1),
w AS (SELECT a.person, a.code FROM t a WHERE a.date_min IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t b WHERE b.person = a.person AND b.code <> a.code AND (b.date_max IS NULL OR b.date_max >= a.date_min)))
"""


def visits(spark, sf):
    """Participant = customer, visit = order, month = calendar month, clinical days = ship days."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    days = li.groupBy("l_orderkey").agg(F.min(F.to_date("l_shipdate")).alias("date_min"), F.max(F.to_date("l_shipdate")).alias("date_max"), F.percentile(F.unix_date(F.to_date("l_shipdate")), 0.5).alias("m"))
    v = o.select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("code"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("double").alias("month"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor("m").cast("int"))
    return v.join(days, v["code"] == days["l_orderkey"], "left").select(*v.columns, "date_min", "date_max", day.alias("date_median"))


def paired(spark, sf):
    v = staged(visits(spark, sf), "visits")
    return T.pair_previous(T.current_visits(v, "person", ["month", "code"]), v, "person", "code", "month")


PAIRS_SQL = f"""WITH {VISITS_SQL},
p AS (
  SELECT c.person, c.code AS current_code, c.month AS current_month, n.candidates, w.code AS winner, n.only_code, l.latest, c.date_min AS cmin,
    CASE WHEN l.latest IS NULL AND EXISTS (SELECT 1 FROM v WHERE v.person = c.person AND v.month >= c.month) THEN 'only_unknown_or_non_earlier_history'
         WHEN n.candidates = 1 THEN 'eligible_unique_previous_visit' WHEN w.code IS NULL THEN 'ambiguous_same_wave_no_strict_interval_winner'
         WHEN c.date_min IS NULL THEN 'ambiguous_same_wave_current_date_unavailable'
         WHEN (SELECT max(date_max) FROM t WHERE t.person = c.person AND t.code = w.code) >= c.date_min THEN 'strict_latest_not_fully_before_current'
         ELSE 'eligible_strict_date_interval_winner' END AS reason
  FROM c LEFT JOIN l USING (person) LEFT JOIN n USING (person) LEFT JOIN w ON w.person = c.person AND n.candidates > 1)"""


@query(PAIRS_SQL + """
SELECT CASE WHEN reason LIKE 'eligible%' THEN 'eligible' ELSE 'excluded' END AS status, reason,
       CASE WHEN latest IS NULL THEN 'none' WHEN candidates = 1 THEN 'unique_most_recent_prior_protocol_month' ELSE 'strict_date_intervals' END AS method,
       count(*) AS participants, CAST(sum(coalesce(candidates, 0)) AS BIGINT) AS candidates,
       round(avg(CASE WHEN reason LIKE 'eligible%' THEN current_month - latest END), 6) AS mean_gap_months
FROM p GROUP BY 1, 2, 3
""")
def prev_visit_pairing(spark, sf):
    """Flagship: W03, J06, J07, A01: outcomes of pairing each participant's last visit with a strictly earlier one."""
    p = paired(spark, sf)
    return p.groupBy("status", "reason", "method").agg(F.count(F.lit(1)).alias("participants"), F.sum("candidates").alias("candidates"), F.round(F.avg("gap_months"), 6).alias("mean_gap_months"))


@query(PAIRS_SQL + """
SELECT person, current_code, CASE WHEN reason LIKE 'eligible%' THEN coalesce(winner, only_code) END AS previous_code, reason FROM p
""")
def previous_visits(spark, sf):
    """J06 row by row."""
    return paired(spark, sf).select("person", "current_code", "previous_code", "reason")


WAVES_SQL = """WITH d AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi, quantile_cont(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)), 0.5) AS m FROM lineitem GROUP BY 1),
v AS (SELECT o_custkey AS person, o_orderkey AS code, year(o_orderdate) * 12.0 + month(o_orderdate) AS month, lo, hi, CASE WHEN m IS NOT NULL THEN CAST(floor(m) AS BIGINT) END AS med FROM orders LEFT JOIN d ON l_orderkey = o_orderkey),
g AS (SELECT *, count(*) OVER (PARTITION BY person, month) AS n FROM v),
t AS (SELECT * FROM g WHERE n > 1)"""


def dated_visits(spark, sf):
    return visits(spark, sf).withColumn("status", F.when(F.col("date_min") == F.col("date_max"), "exact_date_consensus").otherwise("other"))


def waves(spark, sf):
    v = staged(visits(spark, sf), "visits")
    many = v.groupBy("person", "month").count().filter("count > 1").select("person", "month")
    return v.join(many, ["person", "month"])


@query(WAVES_SQL + """
SELECT person, month, max(CASE WHEN ok THEN code END) AS winner FROM (
  SELECT a.person, a.month, a.code, a.lo IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t b WHERE b.person = a.person AND b.month = a.month AND b.code <> a.code AND (b.hi IS NULL OR b.hi >= a.lo)) AS ok FROM t a) GROUP BY 1, 2
""")
def same_wave_tie_strict(spark, sf):
    """The strict interval winner of every wave with several visits."""
    return T.strict_interval_winner(visits(spark, sf), ["person", "month"], "code", least=2)


@query(WAVES_SQL + """
, a AS (SELECT person, month, count(*) AS n, count(lo) AS d, bool_and(coalesce(lo = hi, false)) AS cons, max(lo) AS mlo, max(med) AS mmed, bool_and(code % 4 < 3) AS listed, max(code % 4) AS mo FROM t GROUP BY 1, 2),
b AS (SELECT a.*, (SELECT count(*) FROM t WHERE t.person = a.person AND t.month = a.month AND t.lo = a.mlo) AS nc, (SELECT count(*) FROM t WHERE t.person = a.person AND t.month = a.month AND t.med = a.mmed) AS nm,
  (SELECT count(*) FROM t WHERE t.person = a.person AND t.month = a.month AND t.code % 4 = a.mo) AS ne FROM a)
SELECT CASE WHEN d = 0 THEN 'none_dated' WHEN d = n THEN 'all_dated' ELSE 'partially_dated' END AS coverage, count(*) AS waves, count(*) FILTER (WHERE cons AND nc = 1) AS consensus,
  count(*) FILTER (WHERE d = n AND nm = 1) AS median, count(*) FILTER (WHERE listed AND ne = 1) AS explicit_order FROM b GROUP BY 1
""")
def same_wave_policies(spark, sf):
    """How many waves each policy decides, by date coverage."""
    v = dated_visits(spark, sf)
    policies = {"consensus": T.by_consensus(), "median": T.by_median(), "explicit_order": T.by_explicit_order((F.col("code") % 4).cast("string"), ["0", "1", "2"])}
    out = T.decide_ties(v, ["person", "month"], "code", policies).filter("candidates > 1")
    coverage = T.coverage_label(F.col("dated"), F.col("candidates"))
    return out.groupBy(coverage.alias("coverage")).agg(F.count(F.lit(1)).alias("waves"), *[F.count(c).alias(c) for c in policies])


@query(WAVES_SQL + " SELECT a.person, a.month, a.code AS first, b.code AS second, CAST(abs(a.med - b.med) AS BIGINT) AS gap_days FROM t a JOIN t b ON a.person = b.person AND a.month = b.month AND a.code < b.code WHERE a.med IS NOT NULL AND b.med IS NOT NULL")
def same_wave_gaps(spark, sf):
    """Days between the medians of tied visits."""
    return T.median_gaps(waves(spark, sf), ["person", "month"], "code").withColumn("gap_days", F.col("gap_days").cast("long"))


@query("""
WITH e AS (SELECT l_orderkey AS k, CAST(l_shipdate AS DATE) AS day, 'lineitem' AS s, l_returnflag AS f FROM lineitem UNION ALL SELECT o_orderkey, CAST(o_orderdate AS DATE), 'orders', 'o' FROM orders),
p AS (SELECT k, date_diff('day', min(day), max(day)) AS span, count(*) AS cells, count(DISTINCT day) AS days, count(DISTINCT s) AS sources, count(DISTINCT s || f) AS fields, floor(quantile_cont(date_diff('day', DATE '1970-01-01', day), 0.5)) AS med FROM e GROUP BY 1)
SELECT CASE WHEN span = 0 THEN 'exact_date_consensus' WHEN span <= 7 THEN 'date_range_within_7_days' WHEN span <= 30 THEN 'date_range_8_to_30_days' ELSE 'date_range_over_30_days' END AS status,
  count(*) AS visits, CAST(sum(cells) AS BIGINT) AS cells, CAST(sum(days) AS BIGINT) AS days, CAST(sum(sources) AS BIGINT) AS sources, CAST(sum(fields) AS BIGINT) AS fields, CAST(sum(med) AS BIGINT) AS medians FROM p GROUP BY 1
""")
def date_profile_status(spark, sf):
    """A12 over two sources."""
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.to_date("l_shipdate").alias("day"), F.lit("lineitem").alias("s"), F.col("l_returnflag").alias("f"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.lit("orders").alias("s"), F.lit("o").alias("f"))
    p = T.date_profile(a.union(b), ["k"], "day", "s", "f")
    return p.groupBy("status").agg(F.count(F.lit(1)).alias("visits"), *[F.sum(c).alias(n) for c, n in (("observed_cells", "cells"), ("distinct_dates", "days"), ("sources", "sources"), ("fields", "fields"))], F.sum(F.unix_date("date_median")).alias("medians"))


@query(PAIRS_SQL + """, q AS (SELECT p.person, p.current_code, coalesce(winner, only_code) AS prev, cmin FROM p WHERE reason LIKE 'eligible%'),
s AS (SELECT l_orderkey, l_returnflag AS source, max(CAST(l_shipdate AS DATE)) AS day, count(*) AS n FROM lineitem GROUP BY 1, 2),
j AS (SELECT q.person, source, n, day IS NOT NULL AND cmin IS NOT NULL AND day >= cmin AS bad FROM q JOIN s ON l_orderkey = prev),
r AS (SELECT q.person, count(*) FILTER (WHERE NOT bad) AS sources, coalesce(sum(n) FILTER (WHERE NOT bad), 0) AS features, coalesce(string_agg(source, '|' ORDER BY source) FILTER (WHERE NOT bad), '') AS items, coalesce(string_agg(source, '|' ORDER BY source) FILTER (WHERE bad), '') AS excluded FROM q LEFT JOIN j USING (person) GROUP BY 1)
SELECT items, excluded, features > 0 AS retained, count(*) AS pairs, CAST(sum(features) AS BIGINT) AS features FROM (SELECT person, CASE WHEN items = '' AND excluded = '' THEN '' ELSE items END AS items, excluded, features FROM r) GROUP BY 1, 2, 3
""")
def temporal_exclusions(spark, sf):
    """Sources of the previous visit that are not before the current one, and what is left of each pair."""
    v = staged(visits(spark, sf), "visits")
    cur = T.current_visits(v, "person", ["month", "code"])
    pairs = T.pair_previous(cur, v, "person", "code", "month").filter("status = 'eligible'").select("person", "previous_code")
    pairs = staged(pairs.join(cur.select("person", F.col("date_min").alias("current_date")), "person"), "pairs")
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("source")).agg(F.max(F.to_date("l_shipdate")).alias("previous_date"), F.count(F.lit(1)).alias("n"))
    content = staged(pairs.join(li, pairs["previous_code"] == li["l_orderkey"]).select("person", "source", "previous_date", "n"), "content")
    acts = T.exclusion_actions(pairs.select("person", "current_date"), content.select("person", "source", "previous_date"), ["person"], "source")
    out = T.apply_exclusions(pairs.select("person"), content.select("person", "source", "n"), acts, ["person"], "source", "n")
    return out.groupBy("items", "excluded", "retained").agg(F.count(F.lit(1)).alias("pairs"), F.sum("features").alias("features"))


@query("""SELECT o_custkey AS person, round(CASE WHEN count(*) >= 2 THEN date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) / 30.4375 ELSE 0 END, 6) AS followup_months FROM orders GROUP BY 1""")
def followup_months(spark, sf):
    """A13."""
    v = table(spark, sf, "orders").select(F.col("o_custkey").alias("person"), F.to_date("o_orderdate").alias("day"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month"))
    return T.follow_up(v, "person", "day", "month").withColumn("followup_months", F.round("followup_months", 6))


# --- windows, order, selection ------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS position FROM orders")
def visit_positions(spark, sf):
    """W01."""
    return R.with_position(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "position")


@query("""
SELECT o_custkey, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) FILTER (WHERE o_orderstatus <> 'O') AS first_closed, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS last_order FROM orders GROUP BY 1
""")
def first_last_visit(spark, sf):
    """W02, W03."""
    o = table(spark, sf, "orders").withColumn("seen", F.when(F.col("o_orderstatus") != "O", F.lit(1)))
    first = R.first_by(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "seen").select("o_custkey", F.col("o_orderkey").alias("first_closed"))
    return R.last_by(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("last_order")).join(first, "o_custkey", "left")


@query("""
WITH r AS (SELECT p_partkey, p_brand, p_type, p_size, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS rank FROM part) SELECT p_partkey, rank FROM r
""")
def rank_models(spark, sf):
    """W04."""
    return R.competition_rank(table(spark, sf, "part"), ["p_brand"], "p_size").select("p_partkey", "rank")


@query("SELECT l_orderkey, count(*) AS rows, round(max(l_quantity), 6) AS quantity FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_discount) AS rk FROM lineitem) WHERE rk = 1 GROUP BY 1")
def group_extremes(spark, sf):
    """W05."""
    top = R.group_extreme(table(spark, sf, "lineitem"), ["l_orderkey"], [("l_quantity", "max"), ("l_discount", "min")])
    return top.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rows"), F.round(F.max("l_quantity"), 6).alias("quantity"))


@query("SELECT consecutive, count(*) AS orders FROM (SELECT l_orderkey, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS consecutive FROM lineitem GROUP BY 1) GROUP BY 1")
def consecutive_positions(spark, sf):
    """W07."""
    return R.positions_consecutive(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber").groupBy("consecutive").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 25")
def topk_stable(spark, sf):
    """The limit is the feature."""
    o = table(spark, sf, "orders").withColumn("is_valid", F.col("o_orderstatus") == "F")
    return R.best_candidates(o, ["o_totalprice", "o_orderkey"], n=25).select("o_orderkey", "o_totalprice")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size % 3 > 0 DESC, p_retailprice, p_partkey) AS rn, min(p_size) OVER (PARTITION BY p_brand, p_type) AS lo, max(p_size) OVER (PARTITION BY p_brand, p_type) AS hi FROM part)
SELECT p_brand, p_type, p_partkey, CASE WHEN lo = hi THEN 'single' WHEN p_size = lo THEN 'low' WHEN p_size = hi THEN 'high' ELSE 'inside' END AS boundary FROM r WHERE rn = 1
""")
def best_config(spark, sf):
    """O03."""
    p = table(spark, sf, "part").withColumn("converged", F.col("p_size") % 3 > 0)
    return R.best_configurations(p, ["p_brand", "p_type"], ["p_retailprice", "p_partkey"], "converged", "p_size").select("p_brand", "p_type", "p_partkey", "boundary")


# --- joins and sets -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def left_joins(spark, sf):
    """J01, J02."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    out = R.left_join_one(table(spark, sf, "orders"), c, ["o_custkey"])
    return R.left_join_one(out, table(spark, sf, "nation"), ["n_nationkey"]).select("o_orderkey", "c_mktsegment", "n_name")


@query("""
SELECT count(*) AS documents, count(*) FILTER (WHERE l) AS labelled, count(*) FILTER (WHERE NOT l) AS unlabelled, (SELECT count(*) FROM documents SEMI JOIN labels USING (doc_id)) AS semi, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS anti FROM (SELECT doc_id IN (SELECT doc_id FROM labels) AS l FROM documents)
""")
def semi_anti_membership(spark, sf):
    """J03, J04, S06."""
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    m = R.membership(d, lab, ["doc_id"], "l").agg(F.count(F.lit(1)).alias("documents"), F.count_if("l").alias("labelled"), F.count_if(~F.col("l")).alias("unlabelled"))
    s, a = R.semi_join(d, lab, ["doc_id"]), R.anti_join(d, lab, ["doc_id"])
    return m.crossJoin(s.agg(F.count(F.lit(1)).alias("semi"))).crossJoin(a.agg(F.count(F.lit(1)).alias("anti")))  # one row each


@query("SELECT CASE WHEN l_orderkey IS NULL THEN 'left_only' ELSE 'both' END AS match, count(*) AS orders FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1")
def match_indicator(spark, sf):
    """J05."""
    k = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return R.left_join_marked(table(spark, sf, "orders").select("o_orderkey"), k, ["o_orderkey"]).groupBy("match").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT doc_id, coalesce(CASE WHEN quality = 0 THEN 'low' END, CASE WHEN toxic = 1 THEN 'toxic' END, 'exclude') AS decision FROM documents LEFT JOIN labels USING (doc_id)")
def directive_precedence(spark, sf):
    """Directive before legacy before default."""
    lab = table(spark, sf, "labels")
    a = lab.filter("quality = 0").select("doc_id", F.lit("low").alias("decision"))
    b = lab.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("decision"))
    return X.directive_table(table(spark, sf, "documents").select("doc_id"), a, b, ["doc_id"])


@query("SELECT count(*) FILTER (WHERE b.k IS NULL) AS left_only, count(*) FILTER (WHERE a.k IS NULL) AS right_only, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS shared, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL AND a.n IS DISTINCT FROM b.n) AS diff_n FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer) a FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) b ON a.k = b.k")
def key_set_compare(spark, sf):
    """J11."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    return R.compare_keyed(a, b, ["k"], ["n"])


@query("SELECT origin, count(*) AS rows, count(segment) AS segments, round(sum(balance), 4) AS balance FROM (SELECT 'customer' AS origin, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_acctbal, NULL FROM supplier) GROUP BY 1")
def union_by_name(spark, sf):
    """U01."""
    a = table(spark, sf, "customer").select(F.lit("customer").alias("origin"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_acctbal").alias("balance"))
    return R.union_all([a, b]).groupBy("origin").agg(F.count(F.lit(1)).alias("rows"), F.count("segment").alias("segments"), F.round(F.sum("balance"), 4).alias("balance"))


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events)) AS only_orders, (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events)) AS shared, (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type FROM part)) AS kinds")
def set_ops(spark, sf):
    """U02, U03."""
    a, b = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "events").select(F.col("user_id").alias("k"))
    kinds = R.distinct_by(table(spark, sf, "part"), ["p_brand", "p_type"], [F.col("p_partkey")])
    n = lambda d, c: d.agg(F.count(F.lit(1)).alias(c))
    return n(R.set_difference(a, b), "only_orders").crossJoin(n(a.intersect(b), "shared")).crossJoin(n(kinds, "kinds"))  # one row each


# --- resolution ---------------------------------------------------------------------------------------

LINES = V.Contract("lineitem", "visit", ("k", "line"), administrative=("price",))
SRC_SQL = """
s AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_discount <> 0 THEN CAST(l_discount AS VARCHAR) END AS a, CASE WHEN l_tax <> 0 THEN CAST(l_tax AS VARCHAR) END AS b, l_returnflag AS f, l_partkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS __source_row, CAST(l_extendedprice AS VARCHAR) AS price FROM lineitem),
g AS (SELECT k, n, count(*) AS rows, count(DISTINCT a) > 1 OR count(DISTINCT b) > 1 OR count(DISTINCT f) > 1 AS conflict, max((a IS NOT NULL)::INT) + max((b IS NOT NULL)::INT) + 1 AS al, min((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1) AS least FROM s GROUP BY 1, 2),
c AS (SELECT s.k, s.n, count(*) AS covering FROM s JOIN g USING (k, n) WHERE NOT conflict AND (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1 = al GROUP BY 1, 2),
j AS (SELECT g.k, g.n, rows, CASE WHEN rows = 1 THEN 'unique_record' WHEN conflict THEN 'unresolved_conflict' WHEN least = al THEN 'exact_or_equivalent_duplicate' WHEN covering = 1 THEN 'dominant_record' ELSE 'unresolved_conflict' END AS status FROM g LEFT JOIN c USING (k, n))
"""


def line_source(spark, sf):
    li = table(spark, sf, "lineitem")
    row = F.col("l_partkey") * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("long")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.nullif("l_discount", F.lit(0.0)).cast("string").alias("a"), F.nullif("l_tax", F.lit(0.0)).cast("string").alias("b"), F.col("l_returnflag").alias("f"), row.alias("__source_row"), F.col("l_extendedprice").cast("string").alias("price"))


@query(f"WITH {SRC_SQL} SELECT k, n, status, rows FROM j")
def resolve_duplicates(spark, sf):
    """The verdict for every key."""
    return _resolution(spark, sf).judged.select("k", F.col("line").alias("n"), "status", F.col("group_rows").alias("rows"))


def _resolution(spark, sf):
    src = line_source(spark, sf).withColumnRenamed("n", "line")
    return V.resolve(src, LINES)


@query(f"WITH {SRC_SQL} SELECT CAST(sum(rows) AS BIGINT) AS original_rows, CAST(sum(rows) AS BIGINT) AS valid_key_rows, count(*) AS valid_key_groups, count(*) FILTER (WHERE rows > 1) AS duplicate_groups, count(*) FILTER (WHERE status <> 'unresolved_conflict') AS resolved_rows, count(*) FILTER (WHERE status = 'unique_record') AS unique_record, count(*) FILTER (WHERE status = 'exact_or_equivalent_duplicate') AS exact_or_equivalent_duplicate, count(*) FILTER (WHERE status = 'dominant_record') AS dominant_record, count(*) FILTER (WHERE status = 'unresolved_conflict') AS unresolved_conflict FROM j")
def resolution_summary(spark, sf):
    """Accounting."""
    return _resolution(spark, sf).summary()


@query(f"WITH {SRC_SQL} SELECT k, n, rows AS n_source_rows FROM j WHERE status = 'unresolved_conflict'")
def unresolved_groups(spark, sf):
    """R01."""
    return _resolution(spark, sf).unresolved().select("k", F.col("line").alias("n"), "n_source_rows")


@query(f"WITH {SRC_SQL} SELECT CASE WHEN status = 'unresolved_conflict' THEN 'excluded' ELSE 'selected' END AS action, CASE WHEN status = 'unresolved_conflict' THEN 'unresolved_group' ELSE status END AS reason, CAST(sum(CASE WHEN status = 'unresolved_conflict' THEN rows ELSE 1 END) AS BIGINT) AS rows FROM j GROUP BY 1, 2 UNION ALL SELECT 'excluded', 'not_selected', CAST(sum(rows - 1) AS BIGINT) FROM j WHERE status <> 'unresolved_conflict' HAVING sum(rows - 1) > 0")
def row_action_ledger(spark, sf):
    """R08, J04."""
    return _resolution(spark, sf).ledger().groupBy("action", "reason").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {SRC_SQL}, u AS (SELECT DISTINCT k FROM j WHERE status = 'unresolved_conflict') SELECT count(*) AS visits, count(DISTINCT o_custkey) AS participants, count(*) FILTER (WHERE o_orderstatus = 'F') AS complete_visits, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS complete_participants FROM orders WHERE o_orderkey IN (SELECT k FROM u)")
def conflict_impact(spark, sf):
    """R05."""
    v = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", (F.col("o_orderstatus") == "F").alias("whole"))
    return V.conflict_impact(_resolution(spark, sf).unresolved(), v, ["k"], "o_custkey", "whole")


@query("""
WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_discount <> 0 THEN l_discount END AS a, CASE WHEN l_tax <> 0 THEN l_tax END AS b, l_quantity AS q, (l_discount <> 0)::INT + (l_tax <> 0)::INT + 1 AS c FROM lineitem),
m AS (SELECT k, n, max(c) AS best, count(*) AS rows FROM s GROUP BY 1, 2),
t AS (SELECT s.* FROM s JOIN m ON m.k = s.k AND m.n = s.n AND c = best),
e AS (SELECT k, n, count(*) AS n_best, count(DISTINCT (a, b, q)) = 1 AS same FROM t GROUP BY 1, 2)
SELECT m.k, m.n AS line, rows AS n, n_best, CAST(best AS INT) AS best_count, CASE WHEN rows = 1 THEN 'unique_candidate' WHEN n_best = 1 THEN 'unique_maximum_target_completeness' WHEN same THEN 'equivalent_maximum_target_candidates' ELSE 'unresolved_maximum_target_conflict' END AS status FROM m JOIN e ON e.k = m.k AND e.n = m.n
""")
def resolve_by_completeness(spark, sf):
    """R03."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.nullif("l_discount", F.lit(0.0)).alias("a"), F.nullif("l_tax", F.lit(0.0)).alias("b"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("image"), F.monotonically_increasing_id().alias("__source_row"))
    return V.resolve_by_completeness(li, ["k", "line"], ["a", "b", "q"], "image").drop("__source_row")


@query("""
WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_discount <> 0 THEN l_discount END AS a, l_quantity AS q, (l_discount <> 0)::INT + 1 AS t, (l_tax <> 0)::INT AS m, (l_returnflag <> 'N')::INT AS qc, (l_linestatus = 'F')::INT AS p, (l_suppkey % 2 = 0)::INT AS f FROM lineitem),
d AS (SELECT * FROM (SELECT *, max(t) OVER w AS mt, count(*) OVER w AS c FROM s WINDOW w AS (PARTITION BY k, n)) WHERE c > 1 AND t = mt),
e0 AS (SELECT * EXCLUDE (c), count(*) OVER (PARTITION BY k, n) AS c FROM d), f0 AS (SELECT * FROM e0 WHERE c > 1),
d1 AS (SELECT * EXCLUDE (c), count(*) OVER (PARTITION BY k, n) AS c FROM (SELECT *, max(m) OVER (PARTITION BY k, n) AS x FROM f0) WHERE m = x), f1 AS (SELECT * EXCLUDE (x) FROM d1 WHERE c > 1),
d2 AS (SELECT * EXCLUDE (c), count(*) OVER (PARTITION BY k, n) AS c FROM (SELECT *, max(qc) OVER (PARTITION BY k, n) AS x FROM f1) WHERE qc = x), f2 AS (SELECT * EXCLUDE (x) FROM d2 WHERE c > 1),
d3 AS (SELECT * EXCLUDE (c), count(*) OVER (PARTITION BY k, n) AS c FROM (SELECT *, max(p) OVER (PARTITION BY k, n) AS x FROM f2) WHERE p = x), f3 AS (SELECT * EXCLUDE (x) FROM d3 WHERE NOT (c = 1 AND p = 1)),
d4 AS (SELECT * EXCLUDE (c), count(*) OVER (PARTITION BY k, n) AS c FROM (SELECT *, min(f) OVER (PARTITION BY k, n) AS x FROM f3) WHERE f = x), f4 AS (SELECT * EXCLUDE (x) FROM d4 WHERE c > 1),
z AS (SELECT k, n, count(DISTINCT (a, q)) = 1 AS same FROM f4 GROUP BY 1, 2),
x AS (SELECT 1 AS step_no, 'measure_completeness' AS step, (SELECT count(DISTINCT (k, n)) FROM f0) AS entering, (SELECT count(*) FROM d1 WHERE c = 1) AS resolved
UNION ALL SELECT 2, 'qc_availability', (SELECT count(DISTINCT (k, n)) FROM f1), (SELECT count(*) FROM d2 WHERE c = 1)
UNION ALL SELECT 3, 'unique_overall_pass', (SELECT count(DISTINCT (k, n)) FROM f2), (SELECT count(*) FROM d3 WHERE c = 1 AND p = 1)
UNION ALL SELECT 4, 'fewer_regional_failures', (SELECT count(DISTINCT (k, n)) FROM f3), (SELECT count(*) FROM d4 WHERE c = 1)
UNION ALL SELECT 5, 'numerical_equivalence', (SELECT count(*) FROM z), (SELECT count(*) FROM z WHERE same))
SELECT CAST(step_no AS INT) AS step_no, step, entering, resolved, entering - resolved AS remaining FROM x
""")
def tie_funnel(spark, sf):
    """R04."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.nullif("l_discount", F.lit(0.0)).alias("a"), F.col("l_quantity").alias("q"), F.nullif("l_tax", F.lit(0.0)).alias("m"),
        F.when(F.col("l_returnflag") != "N", "x").alias("qc"), F.when(F.col("l_linestatus") == "F", "pass").alias("p"), F.when(F.col("l_suppkey") % 2 == 0, "Fail").alias("f"),
    )
    return V.tie_funnel(li, ["k", "n"], ["a", "q"], ["m"], ["qc"], "p", ["f"])


# --- aggregates ---------------------------------------------------------------------------------------


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS rows, count(DISTINCT o_custkey) AS participants, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS percent FROM orders GROUP BY 1, 2")
def counts_by_group(spark, sf):
    """A01."""
    return A.counts_by(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], "o_custkey")


@query("WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_discount <> 0 GROUP BY 1, 2) SELECT (SELECT count(*) FROM lineitem) AS rows, (SELECT count(*) FROM lineitem WHERE l_discount = 0) AS missing_key_rows, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_key_rows, count(*) AS distinct_keys FROM k")
def load_summary(spark, sf):
    """A01."""
    li = table(spark, sf, "lineitem").withColumn("k", F.when(F.col("l_discount") != 0, F.col("l_orderkey")))
    return A.load_summary(li, ["k", "l_linenumber"])


@query("SELECT count(*) FILTER (WHERE f > 1) AS l_returnflag, count(*) FILTER (WHERE s > 1) AS l_linestatus FROM (SELECT count(DISTINCT l_returnflag) AS f, count(DISTINCT l_linestatus) AS s FROM lineitem GROUP BY l_orderkey)")
def disagreeing_groups(spark, sf):
    """A02."""
    return A.disagreeing_groups(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("SELECT l_orderkey, bool_or(l_discount <> 0) AS any_d, bool_and(l_discount <> 0) AS all_d, arg_min(l_discount <> 0, (l_linenumber, l_shipdate, l_partkey)) AS first_d, round(avg((l_discount <> 0)::INT), 6) AS rate_d FROM lineitem GROUP BY 1")
def availability_rates(spark, sf):
    """A03, A13."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_shipdate", "l_partkey").alias("p"), (F.col("l_discount") != 0).alias("d"))
    return A.any_first_all(li, ["l_orderkey"], "p", ["d"]).withColumn("rate_d", F.round("rate_d", 6))


@query("SELECT l_returnflag, count(v) AS n, round(min(v), 6) AS low, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS high FROM (SELECT l_returnflag, CASE WHEN l_tax <> 0 THEN l_tax * l_quantity END AS v FROM lineitem) GROUP BY 1")
def distribution_summary(spark, sf):
    """A04."""
    li = table(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_tax") != 0, F.col("l_tax") * F.col("l_quantity")).alias("v"))
    d = A.distribution(li, ["l_returnflag"], "v")
    return d.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("low", "q25", "median", "mean", "q75", "high")])


@query("SELECT o_custkey, count(DISTINCT k) AS classes, CASE count(DISTINCT k) WHEN 0 THEN 'missing' WHEN 1 THEN 'consensus' ELSE 'conflict' END AS verdict, CASE WHEN count(DISTINCT k) = 1 THEN min(k) END AS value FROM (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 2 AS VARCHAR) WHEN o_orderkey % 7 = 0 THEN '5' END AS k FROM orders) GROUP BY 1")
def equivalence_classes(spark, sf):
    """``1`` and ``1.0`` are one class."""
    k = F.when(F.col("o_orderkey") % 3 == 0, F.concat((F.col("o_custkey") % 2).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise(""))).when(F.col("o_orderkey") % 7 == 0, "5")
    return A.equivalence_classes(table(spark, sf, "orders").withColumn("k", k), ["o_custkey"], "k")


@query("WITH l AS (SELECT coalesce(CASE WHEN p_size > 2 THEN p_brand || p_size END, '__MISSING__') AS c FROM part), n AS (SELECT c, count(*) AS k FROM l GROUP BY 1) SELECT CASE WHEN k < 5 THEN '__RARE__' ELSE c END AS category, CAST(sum(k) AS BIGINT) AS rows FROM n GROUP BY 1")
def rare_collapse(spark, sf):
    """A06."""
    p = table(spark, sf, "part").select(F.when(F.col("p_size") > 2, F.concat("p_brand", "p_size")).alias("category"))
    return A.collapse_rare(p, "category").groupBy("category").agg(F.count(F.lit(1)).alias("rows"))


@query("WITH n AS (SELECT p_brand || '/' || p_size AS label, count(*) AS n FROM part GROUP BY 1) SELECT label, CASE WHEN n BETWEEN 1 AND 4 THEN NULL ELSE n END AS nulled, CASE WHEN n BETWEEN 1 AND 4 THEN '<5' ELSE CAST(n AS VARCHAR) END AS text FROM n")
def small_cell_suppression(spark, sf):
    """A07."""
    n = table(spark, sf, "part").groupBy(F.concat_ws("/", "p_brand", "p_size").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("label", A.suppressed(F.col("n")).alias("nulled"), A.suppressed(F.col("n"), "text").alias("text"))


@query("WITH n AS (SELECT p_type || '/' || p_size AS label, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY label) AS k FROM n) SELECT printf('category_%03d', k) AS label, n, (SELECT count(*) FROM n WHERE n BETWEEN 1 AND 4) AS suppressed_categories, CAST(coalesce((SELECT sum(n) FROM n WHERE n BETWEEN 1 AND 4), 0) AS BIGINT) AS suppressed_rows FROM r WHERE n NOT BETWEEN 1 AND 4")
def safe_distribution(spark, sf):
    """A07 with pseudonyms."""
    n = table(spark, sf, "part").groupBy(F.concat_ws("/", "p_type", "p_size").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return A.safe_distribution(n, "label", "n", pseudonyms=True)


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS sources, CAST(sum(l_linenumber) AS BIGINT) AS total, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS items FROM lineitem GROUP BY 1")
def set_to_text(spark, sf):
    """A08."""
    return A.sets_as_text(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber")


@query(f"WITH {SRC_SQL}, u AS (SELECT s.* FROM s JOIN j USING (k, n) WHERE status = 'unresolved_conflict'), l AS (SELECT k, n, 'a' AS c, a AS v FROM u UNION ALL SELECT k, n, 'b', b FROM u UNION ALL SELECT k, n, 'f', f FROM u), p AS (SELECT k, n, c, count(DISTINCT v) > 1 AS vd, count(v) > 0 AND count(v) < count(*) AS md FROM l GROUP BY 1, 2, 3) SELECT c AS \"column\", count(*) FILTER (WHERE vd) AS value_groups, count(*) FILTER (WHERE md) AS missing_groups FROM p WHERE vd OR md GROUP BY 1")
def disagreement_profile(spark, sf):
    """A09."""
    r = _resolution(spark, sf)
    d = V.disagreement_profile(r.source, r.unresolved(), ["k", "line"], ["a", "b", "f"])
    return d.groupBy("column").agg(F.count_if("value_disagreement").alias("value_groups"), F.count_if("missingness_disagreement").alias("missing_groups"))


LONG_SQL = "l AS (SELECT l_suppkey AS p, CASE WHEN l_suppkey % 20 < 14 THEN 'train' WHEN l_suppkey % 20 < 17 THEN 'validation' ELSE 'test' END AS split, feature, value FROM (SELECT l_suppkey, 'discount' AS feature, CASE WHEN l_discount <> 0 THEN CAST(l_discount AS VARCHAR) END AS value FROM lineitem UNION ALL SELECT l_suppkey, 'flag', l_returnflag FROM lineitem UNION ALL SELECT l_suppkey, 'line', CAST(l_linenumber AS VARCHAR) FROM lineitem UNION ALL SELECT l_suppkey, 'none', NULL FROM lineitem UNION ALL SELECT l_suppkey, 'both', l_returnflag || ';' || l_linestatus FROM lineitem))"


def long_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    split = F.when(F.col("l_suppkey") % 20 < 14, "train").when(F.col("l_suppkey") % 20 < 17, "validation").otherwise("test")
    w = li.select(F.col("l_suppkey").alias("p"), split.alias("split"), F.nullif("l_discount", F.lit(0.0)).cast("string").alias("discount"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), F.lit(None).cast("string").alias("none"), F.concat_ws(";", "l_returnflag", "l_linestatus").alias("both"))
    return X.long_form(w, ["p", "split"], ["discount", "flag", "line", "none", "both"])


@query(f"WITH {LONG_SQL} SELECT feature, count(*) AS rows, count(DISTINCT p) AS participants, count(value) AS observed_rows, count(*) - count(value) AS missing_rows, round(count(value) / count(*), 6) AS observed_fraction, count(DISTINCT CASE WHEN value IS NOT NULL THEN p END) AS observed_participants, count(DISTINCT value) AS distinct_observed, count(DISTINCT value) + (count(value) < count(*))::INT AS distinct_with_missing, count(value) = 0 AS all_missing, count(DISTINCT value) = 1 AS observed_constant, count(DISTINCT value) + (count(value) < count(*))::INT <= 1 AS effective_constant FROM l GROUP BY 1")
def feature_profile(spark, sf):
    """A11, R14."""
    out = A.scope_profile(long_lines(spark, sf), ["feature"], "value", "p")
    return out.drop("observed_participant_fraction").withColumn("observed_fraction", F.round("observed_fraction", 6))


@query(f"""WITH {LONG_SQL}, f AS (SELECT feature, count(value) AS o, count(DISTINCT value) AS d, count(try_cast(value AS DOUBLE)) AS x, count(*) FILTER (WHERE try_cast(value AS DOUBLE) = round(try_cast(value AS DOUBLE))) AS i, count(*) FILTER (WHERE value LIKE '%;%') AS m FROM l WHERE split = 'train' GROUP BY 1)
SELECT feature, CASE WHEN o = 0 THEN 'undetermined_all_missing' WHEN m > 0 THEN 'multi_response_candidate' WHEN x >= 0.98 * o AND d <= 2 THEN 'binary_numeric_candidate' WHEN x >= 0.98 * o AND d <= 20 AND i >= 0.98 * x THEN 'categorical_numeric_code_candidate' WHEN x >= 0.98 * o THEN 'numeric_candidate' WHEN d <= 2 THEN 'binary_categorical_candidate' ELSE 'categorical_candidate' END AS suggested_type, d AS distinct_values, i AS integer_cells FROM f""")
def type_inference(spark, sf):
    """P28."""
    t = X.infer_types(X.type_facts(long_lines(spark, sf).filter("split = 'train'")))
    return t.select("feature", "suggested_type", "distinct_values", "integer_cells")


@query(f"WITH {LONG_SQL}, c AS (SELECT feature, count(DISTINCT CASE WHEN split = 'train' AND value IS NOT NULL THEN p END) AS n FROM l GROUP BY 1) SELECT feature, n AS train_participants, n >= 50 AS retained, CASE WHEN n <= 0 THEN '000_all_missing' WHEN n <= 5 THEN '001_1_to_5' WHEN n <= 10 THEN '002_6_to_10' WHEN n <= 20 THEN '003_11_to_20' WHEN n <= 30 THEN '004_21_to_30' WHEN n <= 50 THEN '005_31_to_50' WHEN n <= 100 THEN '006_51_to_100' WHEN n <= 250 THEN '007_101_to_250' WHEN n <= 500 THEN '008_251_to_500' ELSE '009_over_500' END AS band FROM c")
def support_counts(spark, sf):
    """A14, P22."""
    return A.support_counts(long_lines(spark, sf), ["feature"], "value", "p", "split")


@query(f"WITH {LONG_SQL} SELECT a.feature, cells, missing_cells, missing_share, coalesce(unknown_cells, 0) AS unknown_cells FROM (SELECT feature, count(*) AS cells, count(*) - count(value) AS missing_cells, round((count(*) - count(value)) / count(*), 6) AS missing_share FROM l GROUP BY 1) a LEFT JOIN (SELECT feature, count(*) AS unknown_cells FROM l v WHERE split = 'validation' AND value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l t WHERE t.split = 'train' AND t.feature = v.feature AND t.value = v.value) GROUP BY 1) b ON a.feature = b.feature")
def missingness_and_unknown(spark, sf):
    """The vocabulary is that of the train participants."""
    long = long_lines(spark, sf)
    u = A.unknown_values(long.filter("split = 'train'"), long.filter("split = 'validation'"), "feature", "value").select("feature", "unknown_cells")
    m = A.missingness(long, ["feature"], "value").withColumn("missing_share", F.round("missing_share", 6))
    return m.join(u, "feature", "left").withColumn("unknown_cells", F.coalesce("unknown_cells", F.lit(0)))


# --- balance ------------------------------------------------------------------------------------------

SPLIT_SQL = "s AS (SELECT *, CASE WHEN c_custkey % 20 < 14 THEN 'train' WHEN c_custkey % 20 < 17 THEN 'validation' ELSE 'test' END AS split FROM customer)"
JS_SQL = f"""WITH {SPLIT_SQL}, g AS (SELECT c_mktsegment AS c, count(*) / (SELECT count(*) FROM s) AS q FROM s GROUP BY 1), z AS (SELECT split, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT z.split, g.q, (SELECT count(*) FROM s WHERE s.split = z.split AND s.c_mktsegment = g.c) / z.n AS p FROM g, z)
"""
W1_SQL = f"""WITH {SPLIT_SQL}, x AS (SELECT DISTINCT c_acctbal AS v FROM s), z AS (SELECT split, count(*) AS n FROM s GROUP BY 1), k AS (SELECT split, c_acctbal AS v, count(*) AS n FROM s GROUP BY 1, 2), a AS (SELECT c_acctbal AS v, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT z.split, x.v, sum(coalesce(k.n, 0)) OVER w / z.n AS p, sum(a.n) OVER w / (SELECT count(*) FROM s) AS q, lead(x.v) OVER w - x.v AS d FROM z CROSS JOIN x LEFT JOIN k ON k.split = z.split AND k.v = x.v LEFT JOIN a ON a.v = x.v WINDOW w AS (PARTITION BY z.split ORDER BY x.v))
"""


def split_customers(spark, sf):
    k = F.col("c_custkey") % 20
    return table(spark, sf, "customer").withColumn("split", F.when(k < 14, "train").when(k < 17, "validation").otherwise("test"))


@query(JS_SQL + "SELECT split, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)), 6) AS distance FROM p GROUP BY 1")
def js_distance(spark, sf):
    """A16."""
    return B.js_distance(split_customers(spark, sf), "c_mktsegment", "split").withColumn("distance", F.round("distance", 6))


@query(W1_SQL + "SELECT split, round(sum(abs(p - q) * d) / (SELECT stddev_pop(c_acctbal) FROM s), 6) AS distance FROM f GROUP BY 1")
def wasserstein_distance(spark, sf):
    """A17."""
    return B.wasserstein(split_customers(spark, sf), "c_acctbal", "split").withColumn("distance", F.round("distance", 6))


@query("SELECT round(avg(sc), 6) AS score_final, round(max(sc), 6) AS score_max_component, arg_max(c, sc) AS worst FROM (SELECT 'segment' AS c, (avg(d) + max(d)) / 2 AS sc FROM (" + JS_SQL + "SELECT split, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d FROM p GROUP BY 1) UNION ALL SELECT 'balance', (avg(d) + max(d)) / 2 FROM (" + W1_SQL + "SELECT split, sum(abs(p - q) * d) / (SELECT stddev_pop(c_acctbal) FROM s) AS d FROM f GROUP BY 1))")
def split_score(spark, sf):
    """A18."""
    c = split_customers(spark, sf)
    a = B.js_distance(c, "c_mktsegment", "split").select(F.lit("segment").alias("criterion"), "split", "distance")
    b = B.wasserstein(c, "c_acctbal", "split").select(F.lit("balance").alias("criterion"), "split", "distance")
    out = B.score_criteria(a.union(b))
    return out.select(F.round("score_final", 6).alias("score_final"), F.round("score_max_component", 6).alias("score_max_component"), "worst")


# --- population and scenarios --------------------------------------------------------------------------


@query("""
WITH li AS (SELECT l_orderkey AS k, bool_or(l_discount <> 0) AS c FROM lineitem GROUP BY 1), u AS (SELECT DISTINCT l_orderkey AS k FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 3), e AS (SELECT user_id AS p, true AS c FROM events GROUP BY 1),
t AS (SELECT o_custkey AS p, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS position FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT t.*, coalesce(li.c, false) AS al, coalesce(NOT li.c, false) AS el, u.k IS NOT NULL AS cl, coalesce(e.c, false) AS ae FROM t LEFT JOIN li USING (k) LEFT JOIN u USING (k) LEFT JOIN e USING (p))
SELECT k, position, al AS available_lines, el AS empty_lines, cl AS conflict_lines, ae AS available_events, CAST(al::INT + ae::INT AS INT) AS available_count,
  CASE al::INT + ae::INT WHEN 0 THEN 'no_input_modality_available' WHEN 2 THEN 'all_input_modalities_available' ELSE 'partially_available_inputs' END AS completeness, CASE WHEN al AND ae THEN 'lines+events' WHEN al THEN 'lines' WHEN ae THEN 'events' ELSE '<NONE>' END AS combination FROM f
""")
def supervised_population(spark, sf):
    """Target-complete visits with the availability of each source."""
    return _anchor(spark, sf).select("k", "position", "available_lines", "empty_lines", "conflict_lines", "available_events", "available_count", "completeness", "combination")


def _anchor(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("p"), F.col("o_orderkey").alias("k"), "o_orderdate", (F.col("o_orderstatus") != "P").alias("whole"))
    li = table(spark, sf, "lineitem")
    lines = li.select(F.col("l_orderkey").alias("k"), F.nullif("l_discount", F.lit(0.0)).alias("d"))
    bad = li.groupBy(F.col("l_orderkey").alias("k"), "l_linenumber").count().filter("count > 3").select("k")
    ev = table(spark, sf, "events").select(F.col("user_id").alias("p"), "value")
    return X.supervised_population(o, {"lines": lines, "events": ev}, {"lines": bad}, ["p", "k"], ["o_orderdate", "k"], "whole", {"lines": ["d"], "events": ["value"]})


@query("""
WITH li AS (SELECT l_orderkey AS k, bool_or(l_discount <> 0) AS c FROM lineitem GROUP BY 1), e AS (SELECT DISTINCT user_id AS p FROM events),
f AS (SELECT o_custkey AS p, o_orderkey AS k, o_orderdate AS d, coalesce(li.c, false) AS al, e.p IS NOT NULL AS ae FROM orders LEFT JOIN li ON k = o_orderkey LEFT JOIN e ON e.p = o_custkey WHERE o_orderstatus <> 'P')
SELECT p, count(*) AS visits, CASE WHEN count(*) <= 1 THEN '1_visit' WHEN count(*) = 2 THEN '2_visits' ELSE '3plus_visits' END AS longitudinal_class, 'lines:' || arg_min(al::INT, (d, k)) || '|events:' || arg_min(ae::INT, (d, k)) AS first_pattern, round(avg(al::INT + ae::INT), 6) AS modality_count_mean, bool_or(al) AS any_lines, bool_and(al) AS all_lines, round(avg(al::INT), 6) AS rate_lines FROM f GROUP BY 1
""")
def participant_rollup(spark, sf):
    """R06, A03, A13."""
    r = X.participant_rollup(_anchor(spark, sf), "p", ["lines", "events"])
    return r.select("p", "visits", "longitudinal_class", "first_pattern", F.round("modality_count_mean", 6).alias("modality_count_mean"), "any_lines", "all_lines", F.round("rate_lines", 6).alias("rate_lines"))


@query("WITH v AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderstatus END AS d FROM orders) SELECT o_custkey, arg_min(d, pos) FILTER (WHERE d IS NOT NULL) AS d, CAST(min(pos) AS INT) AS position FROM v WHERE d IS NOT NULL GROUP BY 1")
def first_observed_attr(spark, sf):
    """The first known attribute by position."""
    v = R.with_position(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    a = v.select("o_custkey", "o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus")).alias("d"))
    return X.first_observed(v.select("o_custkey", "o_orderkey", "position"), a, ["o_custkey", "o_orderkey"], "d")


@query(PAIRS_SQL + """, q AS (SELECT person, current_code, coalesce(winner, only_code) AS prev FROM p WHERE reason LIKE 'eligible%')
SELECT 'longitudinal' AS scenario, count(*) AS rows, round(sum(a.o_totalprice), 2) AS current_total, round(sum(b.o_totalprice), 2) AS previous_total FROM q JOIN orders a ON a.o_orderkey = current_code JOIN orders b ON b.o_orderkey = prev
UNION ALL SELECT 'snapshot_matched', count(*), round(sum(a.o_totalprice), 2), NULL FROM q JOIN orders a ON a.o_orderkey = current_code
UNION ALL SELECT 'snapshot_all', count(*), round(sum(o_totalprice), 2), NULL FROM orders
""")
def scenarios(spark, sf):
    """The three views."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("code"), "o_totalprice")
    pairs = staged(paired(spark, sf), "pairs")
    both = X.longitudinal(o.select("person", "code"), pairs, o, "person", "code", ["o_totalprice"])
    a = both.groupBy("scenario").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("current__o_totalprice"), 2).alias("current_total"), F.round(F.sum("previous__o_totalprice"), 2).alias("previous_total"))
    single = X.snapshot_all(o).unionByName(X.snapshot_matched(o, pairs, "person", "code"))
    b = single.groupBy("scenario").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("current_total"), F.lit(None).cast("double").alias("previous_total"))
    return a.unionByName(b)


@query("""
WITH u AS (SELECT o_custkey AS p, 'orders' AS s, 1 + (o_orderstatus <> 'O')::INT AS n FROM orders UNION ALL SELECT user_id, 'events', 1 FROM events)
SELECT p, count(DISTINCT s) AS sources, CAST(sum(n) AS BIGINT) AS features, string_agg(DISTINCT s, '|' ORDER BY s) AS items FROM u GROUP BY 1
""")
def availability_timeline(spark, sf):
    """A08 over sources."""
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("p"), F.col("o_totalprice").alias("x"), F.when(F.col("o_orderstatus") != "O", F.lit(1)).alias("y"))
    b = table(spark, sf, "events").select(F.col("user_id").alias("p"), F.col("value").alias("x"))
    return X.availability_timeline({"orders": a, "events": b}, ["p"], {"orders": ["x", "y"], "events": ["x"]})


@query("""SELECT l_returnflag AS flag, feature, count(v) AS n, round(quantile_cont(v, 0), 6) AS low, round(quantile_cont(v, 0.1), 6) AS q10, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.99), 6) AS q99, round(quantile_cont(v, 1), 6) AS high
FROM (SELECT l_returnflag, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, CASE WHEN l_tax > 0 THEN l_tax END]) AS v FROM lineitem) GROUP BY 1, 2""")
def large_group_quantiles(spark, sf):
    """Exact quantiles of several columns in groups that no task sorts whole."""
    li = table(spark, sf, "lineitem").withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    q = exact_quantiles(li, ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], [0, 0.1, 0.5, 0.99, 1], small=1_000)
    return q.select(F.col("l_returnflag").alias("flag"), "feature", "n", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("low", "q10", "median", "q99", "high"))])


HOT_PERSON = "CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END"


@query(f"SELECT o_orderkey, {HOT_PERSON} AS person, CAST(row_number() OVER (PARTITION BY {HOT_PERSON} ORDER BY o_orderdate, o_orderkey) AS INT) AS position FROM orders")
def hot_participant_positions(spark, sf):
    """Positions where one participant has a third of all rows, numbered in stretches."""
    o = table(spark, sf, "orders").withColumn("person", F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey")))
    return R.with_position(o.select("o_orderkey", "person", "o_orderdate"), ["person"], ["o_orderdate", "o_orderkey"], hot_rows=200).select("o_orderkey", "person", "position")


@query("""SELECT count(*) AS rows, sha256(string_agg(line, chr(10) ORDER BY o_orderpriority, o_custkey, line)) AS digest FROM (
SELECT *, concat_ws('|', coalesce(o_orderpriority, '<NA>'), CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), CASE WHEN o_custkey % 9 = 0 THEN '<NA>' ELSE o_orderstatus END) AS line FROM orders)""")
def ordered_digest(spark, sf):
    """A10: the digest of a table's lines in order, of any number of rows."""
    o = table(spark, sf, "orders").withColumn("o_orderstatus", F.when(F.col("o_custkey") % 9 != 0, F.col("o_orderstatus")))
    return A.table_hash(o, ["o_orderpriority", "o_custkey"], ["o_orderpriority", "o_custkey", "o_orderkey", "o_orderstatus"])
