"""Sources, packages, checks and identities bound to the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from visitloom.functions import scalars as S
from visitloom.operators import aggregates as A
from visitloom.operators import constraints as K
from visitloom.operators import crosscheck as C
from visitloom.operators import features as X
from visitloom.operators import governance as G
from visitloom.operators import resolve as V
from visitloom.operators import tables as R
from visitloom.operators import temporal as T
from visitloom.plans.registry import query
from visitloom.plans.table_queries import PAIRS_SQL, WAVES_SQL, dated_visits, paired
from visitloom.session import shared_folder, table
from visitloom.sources import packages as P
from visitloom.sources import shared as SH
from visitloom.sources import spine as SP
from visitloom.sources import tables as SRC


def report_folder(spark) -> str:
    """A new folder for report files below the shared one, in whatever file system that is."""
    return f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"


def export_reports(spark, sf, folder: str) -> None:
    """The two small reference tables as CSV, one of them compressed."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    SH.write_report(nation.select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"], f"{folder}/nation_export.csv")
    SH.write_report(region.select("r_regionkey", "r_name"), ["r_regionkey"], f"{folder}/sub/region_export.csv.gz", compressed=True)


CSV_SQL = """WITH f AS (
  SELECT 'nation_export.csv' AS name, 'n_nationkey,n_name,n_regionkey' || chr(10) || string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey || chr(10), '' ORDER BY n_nationkey) AS body FROM nation
)"""


@query("""SELECT 'nation' AS source, CAST(n_nationkey AS VARCHAR) AS code, n_name AS label, CAST(n_regionkey AS VARCHAR) AS parent, 'utf-8-sig' AS encoding FROM nation
UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name, NULL, 'utf-8-sig' FROM region""")
def text_table_scan(spark, sf):
    """Tables exported as plain and compressed CSV, found by token, inspected and read as text."""
    folder = report_folder(spark)
    export_reports(spark, sf, folder)
    files = SH.discover(spark, folder, ["NATION", "region"])
    (n, n_encoding), (r, r_encoding) = (SH.read_text_table(spark, files[t]) for t in ("NATION", "region"))
    a = n.select(F.lit("nation").alias("source"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("parent"), F.lit(n_encoding).alias("encoding"))
    b = r.select(F.lit("region"), "r_regionkey", "r_name", F.lit(None).cast("string"), F.lit(r_encoding))
    return a.union(b)


@query(CSV_SQL + " SELECT name, CAST(strlen(body) AS BIGINT) AS size, sha256(body) AS sha256 FROM f")
def content_fingerprint(spark, sf):
    """Size and digest of an exported file, hashed by the executors; the same rows give the same bytes."""
    folder = report_folder(spark)
    export_reports(spark, sf, folder)
    tree = SRC.tree_fingerprints(spark, folder)
    return tree.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "sha256").filter("name LIKE '%.csv'")


SPLIT_SQL = "CASE WHEN o_custkey % 20 < 14 THEN 'train' WHEN o_custkey % 20 < 17 THEN 'validation' ELSE 'test' END"


def split_of(key):
    return F.when(key % 20 < 14, "train").when(key % 20 < 17, "validation").otherwise("test")


@query(f"SELECT split, count(*) AS rows, count(DISTINCT o_custkey) AS participants, round(sum(o_totalprice), 2) AS total FROM (SELECT *, {SPLIT_SQL} AS split FROM orders) WHERE split IN ('train', 'validation') GROUP BY 1")
def development_scan(spark, sf):
    """Rows of the development splits alone."""
    o = table(spark, sf, "orders").withColumn("split", split_of(F.col("o_custkey")))
    dev = R.development(o)
    return dev.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_custkey").alias("participants"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"SELECT o_orderkey, split, c_mktsegment, c_acctbal FROM (SELECT *, {SPLIT_SQL} AS split FROM orders) LEFT JOIN customer ON c_custkey = o_custkey WHERE split IN ('train', 'validation')")
def laid_participants(spark, sf):
    """Visits and participants laid out by participant, then joined without an exchange, the test split unopened."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("participant"), split_of(F.col("o_custkey")).alias("split"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("participant"), "c_mktsegment", "c_acctbal")
    laid = SP.lay_out({"visits": o, "people": c}, "participant")
    return SP.left_join_laid(laid["visits"], laid["people"], ["train", "validation"]).select("o_orderkey", "split", "c_mktsegment", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice, n AS lines, quantity FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def laid_visits(spark, sf):
    """Sources laid out by visit; the grouping of one and its join with the other move no rows."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("visit"), "o_totalprice")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("visit"), "l_quantity")
    laid = SP.lay_out({"visits": o, "items": li}, "visit")
    items = laid["items"].rows().groupBy("visit").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return laid["visits"].rows().join(items, "visit", "left").select(F.col("visit").alias("o_orderkey"), "o_totalprice", "lines", "quantity")


@query(f"SELECT split, count(*) AS rows, round(sum(o_totalprice), 2) AS target_sum FROM (SELECT *, {SPLIT_SQL} AS split FROM orders) WHERE split <> 'test' GROUP BY 1")
def target_scan(spark, sf):
    """Targets as numbers; the test rows hold text that no cast may meet."""
    o = table(spark, sf, "orders").withColumn("split", split_of(F.col("o_custkey")))
    text = o.select("o_orderkey", "split", F.when(F.col("split") == "test", "sealed").otherwise(F.col("o_totalprice").cast("string")).alias("target"))
    dev = SRC.development_targets(text, ["o_orderkey"], ["target"], directory=f"{shared_folder(spark)}/targets-{uuid.uuid4().hex}")
    return dev.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("target"), 2).alias("target_sum"))


CONTRACTS = {
    "orders": V.Contract("orders", "visit", ("o_custkey", "o_orderkey"), ("o_custkey", "o_orderkey", "o_orderdate")),
    "lineitem": V.Contract("lineitem", "visit", ("l_orderkey",), ("l_orderkey", "l_linenumber", "l_shipdate", "l_returned_by")),
    "customer": V.Contract("customer", "participant", ("c_custkey",), ("c_custkey", "c_name", "c_nationkey")),
}


@query("""WITH k(source, grain, cols) AS (VALUES ('orders', 'visit', ['o_custkey', 'o_orderkey', 'o_orderdate']), ('lineitem', 'visit', ['l_orderkey', 'l_linenumber', 'l_shipdate', 'l_returned_by']), ('customer', 'participant', ['c_custkey', 'c_name', 'c_nationkey'])),
t AS (SELECT table_name, list(column_name) AS have FROM duckdb_columns() GROUP BY 1)
SELECT source, grain, array_to_string(list_sort(list_filter(cols, lambda x: NOT list_contains(have, x))), '|') AS missing, CAST(len(have) AS BIGINT) AS columns, len(list_filter(cols, lambda x: NOT list_contains(have, x))) = 0 AS passed FROM k JOIN t ON table_name = source""")
def contract_registry(spark, sf):
    """Every source against its contract; extra columns are allowed."""
    SRC.check_registry(CONTRACTS, CONTRACTS)
    rows = []
    for name, contract in CONTRACTS.items():
        df = table(spark, sf, name)
        missing = sorted({*contract.required, *contract.keys} - set(df.columns))
        try:
            SRC.check_contract(df, contract)
            passed = True
        except SRC.SourceError:
            passed = False
        rows.append((name, contract.grain, "|".join(missing), len(df.columns), passed))
    return spark.createDataFrame(rows, "source string, grain string, missing string, columns long, passed boolean")


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))), 4) AS total FROM embeddings")
def matrix_sink(spark, sf):
    """A matrix written as keys and float arrays and read again."""
    path = f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex}"
    P.write_matrix(table(spark, sf, "embeddings"), path, ["vec_id"], "embedding")
    back = spark.read.parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("vec_id", F.size("embedding").alias("width"), F.round(total, 4).alias("total"))


@query("""
SELECT vec_id, CAST(len(x) AS INT) AS width, CAST(len(list_filter(x, lambda v: v <> 0)) AS INT) AS stored, CAST(len(x) AS INT) AS dense, round(coalesce(list_sum(list_transform(x, lambda v, i: v * i)), 0), 3) AS weighted
FROM (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v > 0.1 THEN CAST(CAST(v AS FLOAT) AS DOUBLE) ELSE 0 END) AS x FROM embeddings)
""")
def sparse_matrix_sink(spark, sf):
    """A sparse matrix of single precision, written as places and values, and both forms read again."""
    path = f"{shared_folder(spark)}/sparse-{uuid.uuid4().hex}"
    x = F.transform("embedding", lambda v: F.when(v > 0.1, v).otherwise(0))
    P.write_sparse(table(spark, sf, "embeddings").select("vec_id", x.alias("x")), path, ["vec_id"], "x")
    dense = P.read_sparse(spark, path, "x").select(F.col("vec_id").alias("k"), "x")
    weighted = F.aggregate(F.transform("x", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    both = spark.read.parquet(path).join(dense, F.col("vec_id") == F.col("k"))
    return both.select("vec_id", "width", F.size("cells").alias("stored"), F.size("x").alias("dense"), F.round(weighted, 3).alias("weighted"))


@query("SELECT CAST(0 AS BIGINT) AS unsafe, CAST(0 AS BIGINT) AS missing, CAST(1 AS BIGINT) AS changed, CAST(1 AS BIGINT) AS unlisted, true AS refused, CAST(2 AS BIGINT) AS listed")
def package_commit(spark, sf):
    """A package is staged, verified and renamed; a second commit is refused; later changes are found."""
    target = f"{report_folder(spark)}/package"
    listed = SH.commit_package(spark, target, lambda at: export_reports(spark, sf, at), lambda at: SH.discover(spark, at, ["nation", "region"]))
    try:
        SH.commit_package(spark, target, lambda at: None, lambda at: None)
        refused = False
    except FileExistsError:
        refused = True
    SH.write_bytes(spark, f"{target}/nation_export.csv", b"changed")
    SH.write_bytes(spark, f"{target}/note.txt", b"new")
    found = SH.verify_package(spark, target, listed)
    return spark.createDataFrame([(*[found[k] for k in ("unsafe", "missing", "changed", "unlisted")], refused, listed.count())], "unsafe long, missing long, changed long, unlisted long, refused boolean, listed long")


@query("""WITH found AS (SELECT CASE WHEN p_partkey % 50 = 1 THEN '../' ELSE 'parts/' END || p_partkey AS path, CAST(p_size AS BIGINT) AS size, sha256(p_name) AS sha256 FROM part WHERE p_partkey % 7 <> 0),
listed AS (SELECT 'parts/' || p_partkey AS path, CAST(p_size AS BIGINT) + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS size, sha256(p_name) AS sha256 FROM part WHERE p_partkey % 13 <> 0)
SELECT count(*) FILTER (WHERE f.path IS NULL) AS missing, count(*) FILTER (WHERE l.path IS NULL) AS unlisted, count(*) FILTER (WHERE f.size <> l.size OR f.sha256 <> l.sha256) AS changed, count(*) FILTER (WHERE coalesce(f.path, l.path) LIKE '../%') AS unsafe FROM found f FULL JOIN listed l USING (path)""")
def inventory_compare(spark, sf):
    """S15 on tables of paths, of any size."""
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    name, digest = key.cast("string"), F.sha2("p_name", 256)
    found = p.filter(key % 7 != 0).select(F.concat(F.when(key % 50 == 1, "../").otherwise("parts/"), name).alias("path"), F.col("p_size").cast("long").alias("size"), digest.alias("sha256"))
    listed = p.filter(key % 13 != 0).select(F.concat(F.lit("parts/"), name).alias("path"), (F.col("p_size").cast("long") + F.when(key % 11 == 0, 1).otherwise(0)).alias("size"), digest.alias("sha256"))
    return P.compare_inventories(found, listed)


@query("SELECT count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS checksum, max(c_custkey) + 1 AS resume_at FROM customer")
def resume_append(spark, sf):
    """Results appended in three overlapping rounds stand once; a search resumes after the last of them."""
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"), "c_acctbal")
    for part in (c.filter("candidate_id % 3 = 0"), c.filter("candidate_id % 2 = 0"), c):
        done = P.append_results(part, path, "candidate_id")
    resume = P.next_candidate(done, metadata={"search": 1}, expected={"search": 1})
    return done.agg(F.count(F.lit(1)).alias("rows"), F.sum("candidate_id").alias("checksum")).withColumn("resume_at", F.lit(resume).cast("long"))


@query("""WITH c AS (SELECT column_name AS name, row_number() OVER (ORDER BY column_index) AS position FROM duckdb_columns() WHERE table_name = 'lineitem' AND regexp_full_match(upper(column_name), 'L_(.*)(KEY|DATE)') AND column_name <> 'l_partkey')
SELECT name, position, (SELECT sha256(string_agg(upper(name), chr(10) ORDER BY position)) FROM c) AS catalog, 'previous__lineitem__' || name AS feature, 'modality_present__previous__lineitem' AS present, 'exclude_previous__lineitem' AS excluded FROM c""")
def column_catalog(spark, sf):
    """Columns by pattern with the hash of the catalog, and the names of their features."""
    names = S.column_catalog(table(spark, sf, "lineitem").columns, "l_(.*)(key|date)", without=["L_PARTKEY"])
    digest = S.catalog_hash(names)
    rows = [(n, i, digest, S.feature_name("previous", "lineitem", n), S.presence_name("previous", "lineitem"), S.exclusion_flag("lineitem")) for i, n in enumerate(names, 1)]
    return spark.createDataFrame(rows, "name string, position long, catalog string, feature string, present string, excluded string")


@query("""WITH o AS (SELECT count(*) - count(DISTINCT o_orderkey) AS a, count(*) FILTER (WHERE o_totalprice <= 0) AS b FROM orders), l AS (SELECT count(*) FILTER (WHERE l_discount > 0.05) AS c FROM lineitem),
r AS (SELECT 'orders_unique' AS name, a AS v, 0 AS want FROM o UNION ALL SELECT 'prices_positive', b, 0 FROM o UNION ALL SELECT 'no_large_discount', c, 0 FROM l)
SELECT name AS "check", v = want AS passed, CAST(want AS VARCHAR) AS expected, CAST(v AS VARCHAR) AS observed FROM r
UNION ALL SELECT 'gate', (SELECT bool_and(v = want) FROM r), 'open', CASE WHEN (SELECT bool_and(v = want) FROM r) THEN 'open' ELSE 'closed' END""")
def checks_gate(spark, sf):
    """Named checks from one aggregate a table, and whether the gate opens."""
    checks = G.Checks()
    checks.counts(table(spark, sf, "orders"), {"orders_unique": (F.count(F.lit(1)) - F.count_distinct("o_orderkey"), 0), "prices_positive": (F.count_if(F.col("o_totalprice") <= 0), 0)})
    checks.counts(table(spark, sf, "lineitem"), {"no_large_discount": (F.count_if(F.col("l_discount") > 0.05), 0)})
    try:
        checks.gate()
        state = "open"
    except G.GateError:
        state = "closed"
    checks.equal("gate", state, "open")
    return checks.frame(spark)


@query("""SELECT n_nationkey AS k, substr(sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","parents":[' || n_regionkey || ']}'), 1, 24) AS id FROM nation""")
def canonical_identity(spark, sf):
    """Decision ids of small records: canonical JSON, SHA-256, 24 digits."""
    rows = [(r["n_nationkey"], X.decision_id({"parents": [r["n_regionkey"]], "name": r["n_name"], "key": r["n_nationkey"]})) for r in table(spark, sf, "nation").collect()]  # 25 rows at every size
    return spark.createDataFrame(rows, "k long, id string").withColumn("k", F.col("k").cast(table(spark, sf, "nation").schema["n_nationkey"].dataType))


@query("""SELECT 'report' AS kind, o_orderstatus AS item, CAST(count(*) AS VARCHAR) AS value FROM orders GROUP BY 2
UNION ALL SELECT 'story', 'lines', '6' UNION ALL SELECT 'failure', 'GateError', 'failed' UNION ALL SELECT 'refused', 'o_custkey', 'true'""")
def safe_outputs(spark, sf):
    """An aggregate-only report, a story of it, a failure record, and a private column that is refused."""
    counts = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    report = G.safe_report(counts, ["o_orderstatus", "n"], ["o_custkey"])
    checks = G.Checks()
    checks.true("counted", True)
    text = G.story("orders", {"statuses": "counted", "source": "orders"}, checks)
    try:
        G.safe_report(table(spark, sf, "orders"), ["o_custkey"], ["o_custkey"])
        refused = "false"
    except G.GateError as e:
        refused, failure = "true", G.failure_record(e, "report")
    rest = [("story", "lines", str(text.count("\n"))), ("failure", failure["error"], failure["status"]), ("refused", "o_custkey", refused)]
    head = report.select(F.lit("report").alias("kind"), F.col("o_orderstatus").alias("item"), F.col("n").cast("string").alias("value"))
    return head.union(spark.createDataFrame(rest, "kind string, item string, value string"))


SOURCES = {
    "events": V.Contract("events", "participant", ("user_id",), ("user_id",), administrative=("event_id", "ts", "props")),
    "orders": V.Contract("orders", "participant", ("o_custkey",), ("o_custkey",), compared=("o_orderstatus",)),
}


def _resolved_sql(source: str, key: str, columns: list[str]) -> str:
    differ = " OR ".join(f"count(DISTINCT {c}) > 1" for c in columns)
    return f"""SELECT '{source}' AS source, CASE WHEN n = 1 THEN 'unique_record' WHEN differ THEN 'unresolved_conflict' ELSE 'exact_or_equivalent_duplicate' END AS status, count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows
FROM (SELECT {key}, count(*) AS n, {differ} AS differ FROM {source} WHERE {key} IS NOT NULL GROUP BY 1) GROUP BY 1, 2"""


@query(_resolved_sql("events", "user_id", ["event_type", "value"]) + " UNION ALL " + _resolved_sql("orders", "o_custkey", ["o_orderstatus"]))
def resolve_all_sources(spark, sf):
    """Every source resolved by its contract."""
    out = None
    for name, r in V.resolve_all({n: table(spark, sf, n) for n in SOURCES}, SOURCES).items():
        counts = r.judged.groupBy("status").agg(F.count(F.lit(1)).alias("keys"), F.sum("group_rows").alias("rows")).select(F.lit(name).alias("source"), "status", "keys", "rows")
        out = counts if out is None else out.union(counts)
    return out


@query(WAVES_SQL + """
, a AS (SELECT person, month, count(*) AS n, count(lo) AS d, bool_and(coalesce(lo = hi, false)) AS cons, max(lo) AS mlo, max(med) AS mmed, min(med) AS nmed FROM t GROUP BY 1, 2),
s AS (SELECT person, month, max(CASE WHEN ok THEN code END) AS strict FROM (SELECT x.person, x.month, x.code, x.lo IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t b WHERE b.person = x.person AND b.month = x.month AND b.code <> x.code AND (b.hi IS NULL OR b.hi >= x.lo)) AS ok FROM t x) GROUP BY 1, 2),
c AS (SELECT a.person, a.month, CASE WHEN count(*) = 1 THEN min(code) END AS consensus FROM a JOIN t ON t.person = a.person AND t.month = a.month AND t.lo = a.mlo WHERE a.cons GROUP BY 1, 2),
m AS (SELECT a.person, a.month, CASE WHEN count(*) = 1 THEN min(code) END AS median FROM a JOIN t ON t.person = a.person AND t.month = a.month AND t.med = a.mmed WHERE a.d = a.n GROUP BY 1, 2)
SELECT a.person, a.month, CASE WHEN d = 0 THEN 'none_dated' WHEN d = n THEN 'all_dated' ELSE 'partially_dated' END AS coverage, n AS candidates, strict, consensus, median,
  CAST((strict IS NOT NULL)::INT + (consensus IS NOT NULL)::INT + (median IS NOT NULL)::INT AS INT) AS decided_by,
  coalesce(strict <> consensus, false) OR coalesce(strict <> median, false) OR coalesce(consensus <> median, false) AS disagree, CAST(mmed - nmed AS INT) AS widest_gap_days
FROM a LEFT JOIN s USING (person, month) LEFT JOIN c USING (person, month) LEFT JOIN m USING (person, month)
""")
def same_wave_audit(spark, sf):
    """Every wave with several visits under each policy, whether the policies agree, and the widest gap."""
    return T.same_wave_audit(dated_visits(spark, sf), ["person", "month"], "code", least=2).drop("explicit_order")


POLICY = {"boundary": "winner_date_max < current_date_min", "method": "strict_date_intervals", "version": 1}
POLICY_JSON = X.canonical_json(POLICY)


@query(PAIRS_SQL + f""" SELECT person, current_code, coalesce(winner, only_code) AS previous_code, reason, substr(sha256('{POLICY_JSON}'), 1, 24) AS policy_id FROM p WHERE reason LIKE 'eligible%'""")
def strict_date_freeze(spark, sf):
    """The frozen pairs of the strict-date policy, each with the id that locks it."""
    frozen, lock = T.strict_date_freeze(paired(spark, sf), POLICY)
    T.check_lock(lock, POLICY)
    return frozen.select("person", "current_code", "previous_code", "reason", "policy_id")


BASELINE_ROWS_SQL = """e AS (SELECT event_id AS id, user_id * 31 + event_id % 31 AS person,
  CASE WHEN user_id % 5 < 3 AND event_id // 31 % 6 <> 1 THEN CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'cart' THEN 2 ELSE 3 END END AS wave,
  CASE WHEN user_id % 5 IN (0, 3) AND event_id // 31 % 4 <> 1 THEN CAST(date_trunc('year', ts) AS DATE) END AS day,
  CASE WHEN event_id // 31 % 3 > 0 THEN CASE WHEN user_id % 4 = 0 THEN event_id // 31 % 2 ELSE user_id % 7 END END AS a,
  CASE WHEN user_id % 2 = 0 OR event_id // 31 % 2 = 0 THEN user_id % 9 END AS b FROM events)"""


def baseline_rows(spark, sf):
    """Records with missing waves, days and cells: some persons have neither wave nor day, some a wave without any day."""
    e = table(spark, sf, "events")
    user, event = F.col("user_id"), F.floor(F.col("event_id") / 31)
    rank = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "cart", 2).otherwise(3)
    return e.select(
        (user * 31 + F.col("event_id") % 31).alias("person"), F.when((user % 5 < 3) & (event % 6 != 1), rank).alias("wave"),
        F.when((user % 5).isin(0, 3) & (event % 4 != 1), F.to_date(F.date_trunc("year", "ts"))).alias("day"),
        F.when(event % 3 > 0, F.when(user % 4 == 0, event % 2).otherwise(user % 7)).alias("a"), F.when((user % 2 == 0) | (event % 2 == 0), user % 9).alias("b"),
    )


@query("WITH " + BASELINE_ROWS_SQL + """,
f AS (SELECT person, min(wave) AS w0, min(day) AS d0 FROM e GROUP BY 1),
c AS (SELECT e.*, CASE WHEN w0 IS NOT NULL THEN 'earliest_protocol_wave' WHEN d0 IS NOT NULL THEN 'earliest_available_clinical_date' ELSE 'no_temporal_evidence' END AS basis
  FROM e JOIN f USING (person) WHERE CASE WHEN w0 IS NOT NULL THEN wave = w0 WHEN d0 IS NOT NULL THEN day = d0 ELSE true END),
g AS (SELECT *, count(*) OVER p AS many, min(day) OVER p AS d1 FROM c WINDOW p AS (PARTITION BY person)),
k AS (SELECT * EXCLUDE (basis), CASE WHEN many > 1 AND d1 IS NOT NULL THEN basis || '+earliest_date_within_wave' ELSE basis END AS basis FROM g WHERE many = 1 OR d1 IS NULL OR day = d1),
p AS (SELECT x.person, x.id, bool_and(x.a IS NOT DISTINCT FROM y.a AND x.b IS NOT DISTINCT FROM y.b) AS same, bool_and((x.a = y.a OR y.a IS NULL) IS TRUE AND (x.b = y.b OR y.b IS NULL) IS TRUE) AS covers
  FROM k x JOIN k y ON x.person = y.person GROUP BY 1, 2),
s AS (SELECT k.person, count(*) AS candidates, min(basis) AS basis, bool_and(same) AS same, count(*) FILTER (WHERE covers) AS covering, min(k.id) FILTER (WHERE covers) AS id FROM k JOIN p USING (person, id) GROUP BY 1),
t AS (SELECT *, CASE WHEN candidates = 1 THEN 'unique_temporal_candidate' WHEN same THEN 'same_time_equivalent_duplicate' WHEN basis = 'no_temporal_evidence' THEN 'unresolved_no_temporal_evidence'
  WHEN covering = 1 THEN 'same_time_unique_dominant_record' ELSE 'same_time_unresolved_conflict' END AS status FROM s)
SELECT t.person, candidates, basis, status, CASE WHEN status NOT LIKE '%unresolved%' THEN e.a END AS a, CASE WHEN status NOT LIKE '%unresolved%' THEN e.b END AS b FROM t LEFT JOIN e ON e.id = t.id""")
def baseline_refinement(spark, sf):
    """One baseline record for each participant: earliest wave, then earliest date, then equivalence or dominance."""
    return X.refine_baseline(baseline_rows(spark, sf), "person", "wave", "day", ["a", "b"])


CROSS_RULES = [
    C.Rule("orders", ("o_orderstatus",), "retain_harmonized", "categorical", "status_map"), C.Rule("orders", ("o_totalprice", "o_orderpriority", "o_orderdate"), "retain", "numeric", "numeric_identity"),
    C.Rule("orders", ("o_year",), C.DERIVE_RETAIN, "numeric"), C.Rule("orders", ("age_at_order",), C.DERIVE_LATER, "numeric", later=True), C.Rule("lines", ("l_quantity",), "retain_transform_retype", "categorical", "tens"),
    C.Rule("lines", ("l_discount", "l_returnflag"), "retain", "categorical"), C.Rule("customers", ("c_acctbal",), "retain_retype", "categorical"), C.Rule("customers", ("c_mktsegment",), "retain", "categorical"),
]
CROSS_REMOVED = {"orders": ["o_custkey"], "lines": ["l_tax"]}


def crosschecked(spark, sf):
    """Three sources before and after correction. Planted faults: prices changed, priorities emptied, flags filled in, an excluded column left
    in, a column without directive, rows dropped, rows added; the lines' keys repeat."""
    o, li, c = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "customer")
    orders = o.filter("o_orderkey % 1000 <> 3").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        (F.col("o_totalprice") + F.when(F.col("o_orderkey") % 97 == 0, 1.0).otherwise(0.0)).alias("o_totalprice"), F.year("o_orderdate").alias("o_year"),
        F.when(F.col("o_orderkey") % 50 != 7, F.lower("o_orderpriority")).alias("o_orderpriority"), "o_orderdate",
    )
    old = li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("l_returnflag"), "l_tax", "l_linestatus")
    new = li.select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") / 10).alias("l_quantity"), "l_discount", "l_returnflag", "l_tax", "l_linestatus")
    more = c.select((F.col("c_custkey") + F.when(F.col("c_custkey") % 100 == 1, 10_000_000).otherwise(0)).alias("c_custkey"), F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_mktsegment", "c_nationkey")
    return {"orders": (o, orders, ["o_orderkey"]), "lines": (old, new, ["l_orderkey", "l_linenumber"]), "customers": (c, more, ["c_custkey"])}


def _cross_sql(source, features):
    """SQL rows of one source; its CTEs are <source>_o and <source>_c with keys k."""
    return " UNION ALL ".join(
        f"""SELECT '{source}' AS source, '{name}' AS feature, {position} AS position, {action} AS action, {kind} AS feature_type, {before} AS in_original, {after} AS in_corrected,
  any_value(r.compared) AS compared, any_value(r.only_original) AS only_original, any_value(r.only_corrected) AS only_corrected, any_value(r.repeated) AS repeated, """
        + (
            f"""count(*) FILTER (WHERE k IS NOT NULL AND {a} IS NOT DISTINCT FROM {b}) AS kept, count(*) FILTER (WHERE {a} <> {b}) AS changed, count(*) FILTER (WHERE k IS NOT NULL AND {a} IS NULL AND {b} IS NOT NULL) AS filled,
  count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NULL) AS emptied, {verdict} AS verdict FROM {source}_r r LEFT JOIN {source}_j ON true"""
            if a
            else f"NULL, NULL, NULL, NULL, '{verdict}' FROM {source}_r r"
        )
        for name, position, action, kind, before, after, a, b, verdict in features
    )


def _cross_features():
    text = lambda n: (f"lower(o.{n})", f"lower(c.{n})")
    plain = lambda n: (f"o.{n}", f"c.{n}")
    keep = "CASE WHEN changed + filled + emptied > 0 THEN 'changed_beyond_directive' ELSE 'ok' END"
    return {
        "orders": [
            ("o_orderstatus", 1, "'retain_harmonized'", "'categorical'", True, True, *text("o_orderstatus"), "'ok'"), ("o_totalprice", 2, "'retain'", "'numeric'", True, True, *plain("o_totalprice"), keep),
            ("o_year", 3, "'derive_retain'", "'numeric'", False, True, None, None, "ok"), ("o_orderpriority", 4, "'retain'", "'numeric'", True, True, *text("o_orderpriority"), keep),
            ("o_orderdate", 5, "'retain'", "'numeric'", True, True, *plain("o_orderdate"), keep),
            ("o_custkey", "NULL", "'exclude'", "'excluded'", True, False, None, None, "ok"), ("age_at_order", "NULL", "'derive_later'", "'numeric'", False, False, None, None, "ok"),
        ],
        "lines": [
            ("l_quantity", 1, "'retain_transform_retype'", "'categorical'", True, True, "o.l_quantity", "floor(o.l_quantity / 10)", "CASE WHEN filled + emptied > 0 THEN 'changed_beyond_directive' ELSE 'ok' END"),
            ("l_discount", 2, "'retain'", "'categorical'", True, True, *plain("l_discount"), keep), ("l_returnflag", 3, "'retain'", "'categorical'", True, True, "nullif(o.l_returnflag, 'N')", "c.l_returnflag", keep),
            ("l_tax", 4, "'exclude'", "'excluded'", True, True, *plain("l_tax"), "'excluded_but_present'"), ("l_linestatus", 5, "NULL", "NULL", True, True, *plain("l_linestatus"), "'no_directive'"),
        ],
        "customers": [
            ("c_acctbal", 1, "'retain_retype'", "'categorical'", True, True, *plain("c_acctbal"), keep), ("c_mktsegment", 2, "'retain'", "'categorical'", True, True, *text("c_mktsegment"), keep),
            ("c_nationkey", 3, "NULL", "NULL", True, True, *plain("c_nationkey"), "'no_directive'"), ("c_name", "NULL", "NULL", "NULL", True, False, None, None, "removed_without_directive"),
        ],
    }


def _cross_ctes(source, keys, original, corrected):
    k = f"({', '.join(keys)})" if len(keys) > 1 else keys[0]
    return f"""{source}_o AS (SELECT {k} AS k, *, count(*) OVER (PARTITION BY {k}) AS n FROM ({original})), {source}_c AS (SELECT {k} AS k, *, count(*) OVER (PARTITION BY {k}) AS n FROM ({corrected})),
{source}_j AS (SELECT o.k, o, c FROM {source}_o o JOIN {source}_c c ON o.k = c.k WHERE o.n = 1 AND c.n = 1),
{source}_k AS (SELECT coalesce(o.k, c.k) AS k, max(o.n) AS o, max(c.n) AS c FROM {source}_o o FULL JOIN {source}_c c ON o.k = c.k GROUP BY 1),
{source}_r AS (SELECT count(*) FILTER (WHERE o = 1 AND c = 1) AS compared, count(*) FILTER (WHERE c IS NULL) AS only_original, count(*) FILTER (WHERE o IS NULL) AS only_corrected, count(*) FILTER (WHERE o IS NOT NULL AND c IS NOT NULL AND (o > 1 OR c > 1)) AS repeated FROM {source}_k)"""


CROSS_SQL = "WITH " + ", ".join([
    _cross_ctes("orders", ["o_orderkey"], "FROM orders", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS o_totalprice, CASE WHEN o_orderkey % 50 <> 7 THEN o_orderpriority END AS o_orderpriority, o_orderdate FROM orders WHERE o_orderkey % 1000 <> 3"),
    _cross_ctes("lines", ["l_orderkey", "l_linenumber"], "FROM lineitem", "FROM lineitem"),
    _cross_ctes("customers", ["c_custkey"], "FROM customer", "SELECT c_custkey + CASE WHEN c_custkey % 100 = 1 THEN 10000000 ELSE 0 END AS c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM customer"),
]) + " " + " UNION ALL ".join(_cross_sql(s, f) for s, f in _cross_features().items())


@query(CROSS_SQL)
def feature_crosscheck(spark, sf):
    """Every feature of three corrected sources against its directive: cells kept, changed, filled, emptied, and a verdict."""
    sources = crosschecked(spark, sf)
    corrected = {s: c.columns for s, (_, c, _) in sources.items()}
    directives = C.build_directives(CROSS_RULES, corrected, CROSS_REMOVED)
    checks = G.Checks()
    C.check_policy(checks, directives, {f"{r.source}_{r.columns[0]}": r for r in CROSS_RULES}, corrected)
    checks.gate()
    return C.cross_check(sources, directives)


@query(f"""WITH s AS (SELECT c_custkey AS person, {SPLIT_SQL.replace('o_custkey', 'c_custkey')} AS split FROM customer), v AS (SELECT o_custkey AS person, o_orderkey AS code, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders),
l AS (SELECT l_orderkey AS code, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT 'split_participants_unique' AS name, CAST(count(*) - count(DISTINCT person) AS VARCHAR) AS v, '0' AS want FROM s UNION ALL SELECT 'split_names_known', CAST(count(*) FILTER (WHERE split NOT IN ('train', 'validation', 'test')) AS VARCHAR), '0' FROM s
UNION ALL SELECT 'visit_keys_complete', CAST(count(*) FILTER (WHERE person IS NULL OR code IS NULL) AS VARCHAR), '0' FROM v UNION ALL SELECT 'visit_keys_unique', CAST(count(*) - count(DISTINCT (person, code)) AS VARCHAR), '0' FROM v
UNION ALL SELECT 'positions_consecutive', '0', '0' UNION ALL SELECT 'visits_have_a_split', CAST(count(*) AS VARCHAR), '0' FROM v WHERE person NOT IN (SELECT person FROM s)
UNION ALL SELECT 'visit_and_target_keys_equal', '(0, 0)', '(0, 0)' UNION ALL SELECT 'targets_complete', '0', '0'
UNION ALL SELECT 'lines_keys_unique', CAST((SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS VARCHAR), '0')
SELECT name AS "check", v = want AS passed, want AS expected, v AS observed FROM r""")
def package_validation(spark, sf):
    """Splits, visits, targets and a source of a package against each other."""
    splits = table(spark, sf, "customer").select(F.col("c_custkey").alias("person"), split_of(F.col("c_custkey")).alias("split"))
    visits = R.with_position(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("code"), "position")
    targets = table(spark, sf, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("code"), "o_totalprice")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("code"))
    checks = G.Checks()
    G.validate_package(checks, splits, visits, targets, {"lines": lines}, "person", ["person", "code"], "position", ["o_totalprice"])
    return checks.frame(spark)


# A package with planted faults: ``visits`` and ``targets`` are the orders once more, with cells, keys, splits, positions and rows changed.
VISITS_SQL = f"""p AS (SELECT c_custkey AS person, {SPLIT_SQL.replace("o_custkey", "c_custkey")} AS split FROM customer),
a AS (SELECT o_custkey AS person, o_orderkey AS visit, {SPLIT_SQL} AS split, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS position, o_totalprice AS target FROM orders),
b AS (SELECT CASE WHEN visit % 97 <> 5 THEN person END AS person, visit, CASE WHEN visit % 89 = 7 THEN 'other' ELSE split END AS split, CASE WHEN visit % 83 = 1 THEN position + 1 ELSE position END AS position,
  CASE WHEN visit % 79 = 2 THEN 'n/a' WHEN visit % 79 = 3 THEN 'inf' ELSE CAST(target AS VARCHAR) END AS target FROM a WHERE visit % 71 <> 4
  UNION ALL SELECT person, visit, split, position, CAST(target AS VARCHAR) FROM a WHERE visit % 73 = 6)"""


def planted_visits(spark, sf):
    a = R.with_position(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    a = a.select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("visit"), split_of(F.col("o_custkey")).alias("split"), "position", F.col("o_totalprice").alias("target"))
    v = F.col("visit")
    text = F.col("target").cast("string")
    b = a.filter(v % 71 != 4).select(
        F.when(v % 97 != 5, F.col("person")).alias("person"), "visit", F.when(v % 89 == 7, "other").otherwise(F.col("split")).alias("split"),
        F.when(v % 83 == 1, F.col("position") + 1).otherwise(F.col("position")).alias("position"), F.when(v % 79 == 2, "n/a").when(v % 79 == 3, "inf").otherwise(text).alias("target"),
    )
    return a, b.union(a.filter(v % 73 == 6).select("person", "visit", "split", "position", text))


POLICY_FACTS = {"boundary": "winner_date_max < current_date_min", "method": "strict_date_intervals", "version": 2}
MANIFEST = {"package": "visits", "splits": {"names": ["train", "validation", "test"], "frozen": True}, "tables": {"region": 5, "nation": 25}}
MANIFEST_FACTS = {"package": "visits", "splits.names": ["train", "validation", "test"], "splits.frozen": True, "splits.test_values_used": False, "tables.region": 5}


def _checks_sql() -> str:
    """One row for each check: its name, what is expected, and a query for what is observed."""
    zero, rows = [], []
    count = lambda t, where: f"SELECT count(*) FROM {t} WHERE {where}"
    repeated = lambda t, key: f"SELECT count(*) - count(DISTINCT ({key})) FROM {t}"
    orphan = lambda t, on, parent, to: f"SELECT count(*) FROM {t} WHERE {on} IS NULL OR {on} NOT IN (SELECT {to} FROM {parent})"
    entities = {  # name: (table, key columns, [(check, query)])
        "regions": ("region", ["r_regionkey"], []),
        "nations": ("nation", ["n_nationkey"], [("orphans_region", orphan("nation", "n_regionkey", "region", "r_regionkey"))]),
        "suppliers": ("supplier", ["s_suppkey"], [("finite_s_acctbal", "SELECT 0"), ("orphans_nation", orphan("supplier", "s_nationkey", "nation", "n_nationkey"))]),
        "parts": ("part", ["p_partkey"], [("finite_p_retailprice", "SELECT 0"), ("large", count("part", "p_size > 45"))]),
        "participants": ("p", ["person"], [("domain_split", "SELECT 0")]),
        "anchor": ("a", ["person", "visit"], [("domain_split", "SELECT 0"), ("orphans_participant", "SELECT 0"), ("differ_participant_split", "SELECT 0"), ("broken_positions", "SELECT 0")]),
        "visits": ("b", ["person", "visit"], [
            ("domain_split", count("b", "split = 'other'")), ("numeric_target", count("b", "target = 'n/a'")), ("finite_target", count("b", "target IN ('n/a', 'inf')")),
            ("orphans_participant", count("b", "person IS NULL")), ("differ_participant_split", "SELECT count(*) FROM b JOIN p USING (person) WHERE b.split <> p.split"),
            ("broken_positions", """SELECT count(*) FROM (SELECT person, list_sort(list(position)) AS x FROM b GROUP BY 1) WHERE x <> range(1, len(x) + 1)"""),
        ]),
        "lines": ("lineitem", ["l_orderkey", "l_linenumber"], [
            ("domain_l_returnflag", count("lineitem", "l_returnflag NOT IN ('A', 'N')")), ("finite_l_quantity", "SELECT 0"), ("finite_l_discount", "SELECT 0"),
            ("shipped_late", count("lineitem", "l_shipdate > TIMESTAMP '1998-09-01'")), ("dear", count("lineitem", "l_extendedprice > 50000")),
            ("orphans_order", orphan("lineitem", "l_orderkey", "orders", "o_orderkey")), ("orphans_part", orphan("lineitem", "l_partkey", "part", "p_partkey")), ("orphans_supplier", orphan("lineitem", "l_suppkey", "supplier", "s_suppkey")),
            ("broken_positions", "SELECT count(*) FROM (SELECT l_orderkey, list_sort(list(CAST(l_linenumber AS BIGINT))) AS x FROM lineitem GROUP BY 1) WHERE x <> range(1, len(x) + 1)"),
        ]),
        "events": ("events", ["event_id"], [("domain_event_type", count("events", "event_type NOT IN ('view', 'click', 'cart')")), ("orphans_participant", orphan("events", "user_id", "customer", "c_custkey"))]),
        "documents": ("documents", ["doc_id"], [("empty", count("documents", "text IS NULL OR text = ''")), ("domain_lang", count("documents", "lang NOT IN ('en', 'de', 'fr')"))]),
        "labels": ("labels", ["doc_id"], [("domain_toxic", "SELECT 0"), ("orphans_document", orphan("labels", "doc_id", "documents", "doc_id"))]),
        "turns": ("conversations", ["conv_id", "turn"], [("domain_role", count("conversations", "role <> 'user'")), ("broken_positions", "SELECT count(*) FROM (SELECT conv_id, list_sort(list(turn)) AS x FROM conversations GROUP BY 1) WHERE x <> range(1, len(x) + 1)")]),
    }
    for name, (t, key, more) in entities.items():
        rows.append((f"{name}_required_columns", "", "SELECT ''"))
        missing = " OR ".join(f"{k} IS NULL" for k in key)
        distinct = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in key)
        zero += [(f"{name}_missing_key", count(t, missing)), (f"{name}_duplicate_key", repeated(t, distinct)), *[(f"{name}_{n}", q) for n, q in more if n not in ("large", "dear")]]
    rows += [(n, "0", q) for n, q in zero]
    rows += [("nations_catalog_order", "n_nationkey,n_name,n_regionkey", "SELECT 'n_nationkey,n_name,n_regionkey'"), ("regions_total", "5", "SELECT count(*) FROM region"), ("nations_total", "25", "SELECT count(*) FROM nation")]
    rows += [("parts_large", "0", entities["parts"][2][1][1]), ("lines_dear", "10", next(q for n, q in entities["lines"][2] if n == "dear"))]
    keys = lambda t: f"(SELECT person, visit FROM {t} WHERE person IS NOT NULL)"
    rows += [
        ("anchor_and_visits_left_only", "0", f"SELECT count(*) FROM ({keys('a')} EXCEPT {keys('b')})"),
        ("anchor_and_visits_right_only", "0", "SELECT count(DISTINCT visit) FROM b WHERE person IS NULL"),
        ("anchor_and_visits_differ_split", "0", "SELECT count(*) FROM a JOIN (SELECT person, visit, min(split) AS s FROM b GROUP BY 1, 2) x USING (person, visit) WHERE a.split <> s"),
        ("anchor_and_visits_differ_position", "0", "SELECT count(*) FROM a JOIN (SELECT person, visit, min(position) AS q FROM b GROUP BY 1, 2) x USING (person, visit) WHERE a.position <> q"),
        ("manifest_package", '["visits"]', """SELECT '["visits"]'"""), ("manifest_splits_names", '[["train","validation","test"]]', """SELECT '[["train","validation","test"]]'"""),
        ("manifest_splits_frozen", "[true]", "SELECT '[true]'"), ("manifest_splits_test_values_used", "[false]", "SELECT '[null]'"), ("manifest_tables_region", "[5]", "SELECT '[5]'"),
        ("policy_version", "[2]", "SELECT '[1]'"), ("policy_method", '["strict_date_intervals"]', """SELECT '["strict_date_intervals"]'"""), ("policy_boundary", '["winner_date_max < current_date_min"]', """SELECT '["winner_date_max < current_date_min"]'"""),
        ("participant_mapping_sha256", None, "SELECT sha256(string_agg(person || ',' || split, chr(10) ORDER BY person)) FROM p"),
    ]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [f"SELECT {quoted(n)} AS name, {quoted(w) if w is not None else f'({q})'} AS want, CAST(({q}) AS VARCHAR) AS got" for n, w, q in rows]
    return f"WITH {VISITS_SQL}, r AS (" + " UNION ALL ".join(parts) + """) SELECT name AS "check", want = got AS passed, want AS expected, got AS observed FROM r"""


@query(_checks_sql())
def package_constraints(spark, sf):
    """A package of all kinds of constraints with planted faults: each check with what it expects and finds."""
    t = lambda name: table(spark, sf, name)
    a, b = planted_visits(spark, sf)
    participants = t("customer").select(F.col("c_custkey").alias("person"), split_of(F.col("c_custkey")).alias("split"))
    person = {"participant": K.Parent("participants", {"person": "person"}, {"split": "split"})}
    names = ("train", "validation", "test")
    entities = {
        "regions": K.Entity(t("region"), ("r_regionkey",), ("r_name",), rows=5),
        "nations": K.Entity(t("nation"), ("n_nationkey",), catalog=("n_nationkey", "n_name", "n_regionkey"), rows=25, parents={"region": K.Parent("regions", {"n_regionkey": "r_regionkey"})}),
        "suppliers": K.Entity(t("supplier"), ("s_suppkey",), finite=("s_acctbal",), parents={"nation": K.Parent("nations", {"s_nationkey": "n_nationkey"})}),
        "parts": K.Entity(t("part"), ("p_partkey",), finite=("p_retailprice",), counts={"large": (F.col("p_size") > 45, 0)}),
        "participants": K.Entity(participants, ("person",), domains={"split": names}),
        "anchor": K.Entity(a, ("person", "visit"), domains={"split": names}, parents=person, positions=(("person",), "position")),
        "visits": K.Entity(b, ("person", "visit"), domains={"split": names}, numeric=("target",), finite=("target",), parents=person, positions=(("person",), "position")),
        "orders": K.Entity(t("orders"), ("o_orderkey",)),
        "lines": K.Entity(
            t("lineitem"), ("l_orderkey", "l_linenumber"), ("l_shipdate",), domains={"l_returnflag": ("A", "N")}, finite=("l_quantity", "l_discount"),
            rules={"shipped_late": F.col("l_shipdate") > F.lit("1998-09-01").cast("timestamp")}, counts={"dear": (F.col("l_extendedprice") > 50000, 10)},
            parents={"order": K.Parent("orders", {"l_orderkey": "o_orderkey"}), "part": K.Parent("parts", {"l_partkey": "p_partkey"}), "supplier": K.Parent("suppliers", {"l_suppkey": "s_suppkey"})},
            positions=(("l_orderkey",), "l_linenumber"),
        ),
        "events": K.Entity(t("events"), ("event_id",), domains={"event_type": ("view", "click", "cart")}, parents={"participant": K.Parent("participants", {"user_id": "person"})}),
        "documents": K.Entity(t("documents"), ("doc_id",), domains={"lang": ("en", "de", "fr")}, rules={"empty": F.col("text").isNull() | (F.col("text") == "")}),
        "labels": K.Entity(t("labels"), ("doc_id",), domains={"toxic": (0, 1)}, parents={"document": K.Parent("documents", {"doc_id": "doc_id"})}),
        "turns": K.Entity(t("conversations"), ("conv_id", "turn"), domains={"role": ("user",)}, positions=(("conv_id",), "turn")),
    }
    checks = G.Checks()
    K.validate(checks, entities, {"anchor_and_visits": K.Twin("anchor", "visits", {"split": "split", "position": "position"})})
    K.facts(checks, "manifest", MANIFEST, MANIFEST_FACTS)
    K.facts(checks, "policy", POLICY, POLICY_FACTS)
    mapping = A.table_hash(participants.select("person", F.concat_ws(",", "person", "split").alias("line")), ["person"], ["line"]).first()["digest"]
    checks.equal("participant_mapping_sha256", mapping, mapping)
    return checks.frame(spark).filter("check NOT LIKE 'orders_%'")


@query("""WITH f AS (SELECT 'o_orderkey,o_custkey,o_orderstatus' || chr(10) || string_agg(o_orderkey || ',' || o_custkey || ',' || o_orderstatus || chr(10), '' ORDER BY o_custkey, o_orderkey) AS body FROM orders)
SELECT CAST(strlen(body) AS BIGINT) AS size, sha256(body) AS sha256 FROM f""")
def deterministic_export(spark, sf):
    """A whole table as one CSV file of fixed bytes, sorted and formatted by the executors."""
    uri = f"{report_folder(spark)}/orders.csv"
    SH.write_report(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderkey"], uri)
    return SH.inventory(spark, uri.rpartition("/")[0]).select("size", "sha256")
