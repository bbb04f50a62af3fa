"""Scalar functions and filters bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom.functions import scalars as S
from visitloom.operators import aggregates as A
from visitloom.operators import tables as R
from visitloom.plans.registry import query
from visitloom.session import table

WS = r"' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def num_sql(x: str) -> str:
    return f"(CASE WHEN regexp_matches(trim({x}, {WS}), {NUM}) THEN try_cast(trim({x}, {WS}) AS DOUBLE) END)"


def label_sql(x: str) -> str:
    d = num_sql(x)
    return f"(CASE WHEN {d} = floor({d}) THEN CAST(CAST({d} AS DECIMAL(38,0)) AS VARCHAR) WHEN {d} IS NOT NULL THEN printf('%.15g', {d}) WHEN trim({x}, {WS}) <> '' THEN trim({x}, {WS}) END)"


RAW = "CASE c_custkey % 6 WHEN 0 THEN ' -1 ' WHEN 1 THEN '-4' WHEN 2 THEN '   ' WHEN 3 THEN NULL ELSE concat(' ', c_name, ' ') END"
ID = "CASE c_custkey % 5 WHEN 0 THEN concat('00', c_custkey) WHEN 1 THEN concat(c_custkey, '.0') WHEN 2 THEN concat(c_custkey, '.5') WHEN 3 THEN NULL ELSE concat('X', c_custkey) END"
LABEL = "CASE c_custkey % 4 WHEN 0 THEN concat(c_custkey, '.0') WHEN 1 THEN CAST(c_acctbal AS VARCHAR(30)) WHEN 2 THEN concat(' ', lower(c_mktsegment), ' ') ELSE NULL END"
VISIT = "CASE c_custkey % 9 WHEN 0 THEN ' BL ' WHEN 1 THEN 'sc' WHEN 2 THEN 'm00' WHEN 3 THEN concat('m', c_nationkey) WHEN 4 THEN concat('Y', c_nationkey) WHEN 5 THEN 'v01' WHEN 6 THEN 'nv' WHEN 7 THEN NULL ELSE 'scmri' END"
DAYTEXT = "CASE o_orderkey % 4 WHEN 0 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) WHEN 1 THEN concat(substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10), ' 14:15:00') WHEN 2 THEN 'unknown' ELSE NULL END"
FLAG = "CASE c_custkey % 8 WHEN 0 THEN ' Yes ' WHEN 1 THEN '0' WHEN 2 THEN 'TRUE' WHEN 3 THEN NULL WHEN 4 THEN 'maybe' WHEN 5 THEN 'no' WHEN 6 THEN '' ELSE 'y' END"


@query(f"SELECT c_custkey, CASE WHEN trim(r, {WS}) NOT IN ('', '-1', '-4') THEN trim(r, {WS}) END AS value, CASE WHEN trim(r, {WS}) <> '' THEN trim(r, {WS}) END AS staged FROM (SELECT c_custkey, {RAW} AS r FROM customer)")
def missing_sentinel(spark, sf):
    """P01, both profiles."""
    df = table(spark, sf, "customer").select("c_custkey", F.expr(RAW).alias("r"))
    return df.select("c_custkey", S.missing_to_null(F.col("r")).alias("value"), S.missing_to_null(F.col("r"), S.STAGED_MISSING).alias("staged"))


@query(f"SELECT c_custkey, CASE WHEN d = floor(d) THEN CAST(CAST(d AS BIGINT) AS VARCHAR) END AS id, r IS NOT NULL AND (d IS NULL OR d <> floor(d)) AS violation FROM (SELECT c_custkey, r, {num_sql('r')} AS d FROM (SELECT c_custkey, {ID} AS r FROM customer))")
def id_canonical(spark, sf):
    """P02."""
    df = table(spark, sf, "customer").select("c_custkey", F.expr(ID).alias("r"))
    return df.select("c_custkey", S.canonical_id(F.col("r")).alias("id"), S.id_violation(F.col("r")).alias("violation"))


@query(f"SELECT c_custkey, lower(trim(r, {WS})) AS code, upper(trim(r, {WS})) AS phase, CASE WHEN lower(trim(r, {WS})) IN ('bl','sc','scmri','m00','v01') THEN 0.0 WHEN regexp_matches(lower(trim(r, {WS})), '^m[0-9]+$') THEN CAST(substr(trim(r, {WS}), 2) AS DOUBLE) WHEN regexp_matches(lower(trim(r, {WS})), '^y[0-9]+$') THEN 12 * CAST(substr(trim(r, {WS}), 2) AS DOUBLE) END AS month FROM (SELECT c_custkey, {VISIT} AS r FROM customer)")
def protocol_month(spark, sf):
    """P03, P05."""
    df = table(spark, sf, "customer").select("c_custkey", F.expr(VISIT).alias("r"))
    return df.select("c_custkey", S.code(F.col("r")).alias("code"), S.phase(F.col("r")).alias("phase"), S.protocol_month(F.col("r")).alias("month"))


@query(f"SELECT c_custkey, {label_sql('r')} AS label, coalesce(upper({label_sql('r')}), '__NONE__') AS upper_label, round(CASE WHEN c_nationkey = 0 THEN NULL ELSE c_acctbal / c_nationkey END, 6) AS ratio FROM (SELECT *, {LABEL} AS r FROM customer)")
def code_label(spark, sf):
    """P04."""
    df = table(spark, sf, "customer").withColumn("r", F.expr(LABEL))
    return df.select("c_custkey", S.code_label(F.col("r")).alias("label"), S.code_label(F.col("r"), "__NONE__", upper=True).alias("upper_label"), F.round(S.safe_divide(F.col("c_acctbal"), F.col("c_nationkey")), 6).alias("ratio"))


@query(f"SELECT o_orderkey, strftime(CAST(coalesce(try_strptime(r, '%Y-%m-%d %H:%M:%S'), try_strptime(r, '%Y-%m-%d')) AS DATE), '%Y-%m-%d') AS day FROM (SELECT o_orderkey, {DAYTEXT} AS r FROM orders)")
def date_parse(spark, sf):
    """P06."""
    df = table(spark, sf, "orders").select("o_orderkey", F.expr(DAYTEXT).alias("r"))
    return df.select("o_orderkey", S.iso_day(S.parse_day(F.col("r"))).alias("day"))


STYLES = ("yyyy-MM-dd", "M/d/yyyy", "yyyy/M/d", "MM-dd-yyyy", "d MMM yyyy", "MMMM d, yyyy", "yyyyMMdd", "EEEE, d MMMM yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "M.d.yyyy h:mm a", "dd-MMM-yyyy HH:mm:ss.SSS", "yyyy-MM-dd 29:00")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % {len(STYLES)} < {len(STYLES) - 1} THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS day FROM orders")
def date_parse_mixed(spark, sf):
    """Days written in eleven styles, and one impossible time, read without being told which."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    written = F.coalesce(*[F.when(F.col("o_orderkey") % len(STYLES) == i, F.date_format("t", f)) for i, f in enumerate(STYLES)])
    return o.select("o_orderkey", S.iso_day(S.parse_day_mixed(written)).alias("day"))


@query(f"SELECT c_custkey, CASE WHEN lower(trim(r, {WS})) IN ('true','1','yes','y') THEN true WHEN r IS NULL OR lower(trim(r, {WS})) IN ('false','0','no','n','') THEN false END AS flag, coalesce(lower(trim(r, {WS})) NOT IN ('true','1','yes','y','false','0','no','n',''), false) AS violation FROM (SELECT c_custkey, {FLAG} AS r FROM customer)")
def bool_parse(spark, sf):
    """P07."""
    df = table(spark, sf, "customer").select("c_custkey", F.expr(FLAG).alias("r"))
    return df.select("c_custkey", S.parse_flag(F.col("r")).alias("flag"), S.flag_violation(F.col("r")).alias("violation"))


@query(f"SELECT count(*) AS rows, count(r) AS observed, count({num_sql('r')}) AS numeric_cells, count(*) FILTER (WHERE r IS NOT NULL AND {num_sql('r')} IS NULL) AS violations, round(sum({num_sql('r')}), 4) AS total FROM (SELECT {ID} AS r FROM customer)")
def numeric_coercion(spark, sf):
    """P08."""
    df = table(spark, sf, "customer").select(F.expr(ID).alias("r"))
    x = S.number(F.col("r"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count("r").alias("observed"), F.count(x).alias("numeric_cells"), F.count_if(S.number_violation(F.col("r"))).alias("violations"), F.round(F.sum(x), 4).alias("total"))


@query(f"SELECT c_custkey, coalesce(upper(trim(r, {WS})), '<MISSING>') AS audit, CASE WHEN r IS NULL OR trim(r, {WS}) = '' THEN '__MISSING__' ELSE trim(r, {WS}) END AS category FROM (SELECT c_custkey, {RAW} AS r FROM customer)")
def audit_text(spark, sf):
    """P09."""
    df = table(spark, sf, "customer").select("c_custkey", F.expr(RAW).alias("r"))
    return df.select("c_custkey", S.audit_text(F.col("r")).alias("audit"), S.category(F.col("r")).alias("category"))


@query("SELECT count(*) AS cells, max(len(t)) AS max_tokens, CAST(sum(len(t)) AS BIGINT) AS tokens, (SELECT count(DISTINCT u) FROM (SELECT unnest(string_split(p_name, ' ')) AS u FROM part) WHERE trim(u) <> '') AS distinct_tokens FROM (SELECT list_filter(list_transform(string_split(replace(p_name, ' ', ';'), ';'), lambda x: trim(x)), lambda x: x <> '') AS t FROM part)")
def multi_tokens(spark, sf):
    """P10: words of a part's name, as tokens between separators."""
    t = table(spark, sf, "part").select(S.multi_tokens(F.translate("p_name", " ", ";")).alias("t"))
    words = t.select(F.explode("t").alias("u")).agg(F.count_distinct("u").alias("distinct_tokens"))
    return t.agg(F.count(F.lit(1)).alias("cells"), F.max(F.size("t")).cast("long").alias("max_tokens"), F.sum(F.size("t")).alias("tokens")).crossJoin(words)  # one row each


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '0' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '1' END AS value, p_size % 5 = 4 AS failure FROM part")
def dict_map(spark, sf):
    """P11."""
    df = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5).cast("string").alias("c"))
    m = {"0": "0", "1": "0", "2": "1", "3": "1"}
    return df.select("p_partkey", S.map_values(F.col("c"), m).alias("value"), S.map_failure(F.col("c"), m).alias("failure"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(year(o_orderdate) AS DOUBLE) END AS placeholder, CASE WHEN year(o_orderdate) - (1930 + o_custkey % 60) BETWEEN 18 AND 60 THEN CAST(year(o_orderdate) - (1930 + o_custkey % 60) AS INT) END AS age FROM orders")
def year_placeholder_age(spark, sf):
    """P12, P14."""
    df = table(spark, sf, "orders").withColumn("t", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.year("o_orderdate"), F.lit("-01-01 00:00"))).otherwise("n/a"))
    born = (F.lit(1930) + F.col("o_custkey") % 60).cast("string")
    year = S.agreed_year(born, F.concat(born, F.lit("-06-30")))
    return df.select("o_orderkey", S.placeholder_year(F.col("t")).alias("placeholder"), S.age_at(F.col("o_orderdate"), year, 18, 60).alias("age"))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE l_linenumber NOT IN (0, 1)) AS binary_failures, count(*) FILTER (WHERE l_returnflag IS NOT NULL) AS numeric_failures, round(sum(l_quantity), 4) AS total, CAST(sum(1 + CASE WHEN l_discount <> 0 THEN 1 ELSE 0 END + CASE WHEN l_tax <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS observed, count(*) FILTER (WHERE l_discount <> 0 AND l_tax <> 0) AS complete FROM lineitem")
def typed_validation(spark, sf):
    """P13, P15."""
    df = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("string").alias("q"), F.col("l_linenumber").cast("string").alias("b"), F.col("l_returnflag").alias("f"), F.nullif("l_discount", F.lit(0.0)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("t"))
    cols = ["q", "d", "t"]
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(S.type_failure(F.col("b"), "binary")).alias("binary_failures"), F.count_if(S.type_failure(F.col("f"), "numeric")).alias("numeric_failures"),
        F.round(F.sum(S.typed(F.col("q"), "numeric")), 4).alias("total"), F.sum(S.observed_count(cols)).alias("observed"), F.count_if(S.complete(cols)).alias("complete"),
    )


@query("SELECT c_custkey, sha256('c_custkey=' || c_custkey || chr(31) || 'c_mktsegment=' || coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END, '<NA>') || chr(31) || 'c_name=' || c_name) AS row_hash, sha256(c_custkey || chr(31) || c_name) AS value_hash FROM customer")
def row_hash(spark, sf):
    """P16."""
    df = table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment"))
    return df.select("c_custkey", S.row_hash(["c_name", "c_mktsegment", "c_custkey"]).alias("row_hash"), S.row_hash(["c_custkey", "c_name"], named=False).alias("value_hash"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, round(CASE WHEN l_discount = 0 AND l_tax <> 0 THEN 0 WHEN l_discount = 0 THEN NULL ELSE l_discount END, 6) AS completed, round(CASE WHEN l_linenumber <= 3 THEN NULL ELSE l_tax END, 6) AS masked FROM lineitem")
def completion_and_mask(spark, sf):
    """P18, P19, P24, P26."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.nullif("l_discount", F.lit(0.0)).cast("string").alias("d"), F.nullif("l_tax", F.lit(0.0)).cast("string").alias("t"), F.col("l_tax").alias("__masked"), F.lit(1).alias("gone"))
    df = S.drop_columns(df, ["l_orderkey", "l_linenumber"], ["gone"])
    df = S.mask(df.withColumn("completed", S.implied_zero(F.col("d"), [F.col("t")])), F.col("l_linenumber") <= 3, ["__masked"])
    out = S.project(df, ["l_orderkey", "l_linenumber"]).drop("d", "t")
    return out.withColumns({"completed": F.round(F.col("completed").cast("double"), 6), "masked": F.round("masked", 6)})


@query("""
WITH b AS (SELECT c_custkey, c_custkey % 2 AS a, (c_custkey // 2) % 2 AS b, (c_custkey // 4) % 2 AS c, c_custkey % 7 AS k, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 END AS n, c_custkey % 5 = 0 AS hole FROM customer)
SELECT c_custkey, CAST(CASE WHEN n IS NOT NULL AND NOT hole AND n <> a + b + c THEN NULL WHEN hole THEN n ELSE a + b + c END AS DOUBLE) AS score,
       CASE k WHEN 0 THEN '3' WHEN 1 THEN '3' WHEN 2 THEN '6' WHEN 3 THEN '5' WHEN 4 THEN '6' ELSE NULL END AS code FROM b
""")
def merged_score_and_codes(spark, sf):
    """P20, P21."""
    k = F.col("c_custkey")
    item = [(k % 2).cast("string"), (F.floor(k / 2) % 2).cast("string"), F.when(k % 5 != 0, (F.floor(k / 4) % 2).cast("string"))]
    newer = F.when(k % 3 == 0, (k % 4).cast("string"))
    codes = F.element_at(F.array(*[F.lit(x) for x in ("8", "9", "1|5", "5", "1;8", "", None)]), (k % 7 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", S.merged_score(item, newer).alias("score"), S.collapsed_code(codes, {"8": "3", "9": "3"}, "6").alias("code"))


@query("""
SELECT band, class, count(*) AS participants FROM (
  SELECT CASE WHEN n <= 0 THEN '000_all_missing' WHEN n <= 5 THEN '001_1_to_5' WHEN n <= 10 THEN '002_6_to_10' WHEN n <= 20 THEN '003_11_to_20' WHEN n <= 30 THEN '004_21_to_30' WHEN n <= 50 THEN '005_31_to_50' WHEN n <= 100 THEN '006_51_to_100' WHEN n <= 250 THEN '007_101_to_250' WHEN n <= 500 THEN '008_251_to_500' ELSE '009_over_500' END AS band,
         CASE WHEN n <= 1 THEN '1_visit' WHEN n = 2 THEN '2_visits' ELSE '3plus_visits' END AS class
  FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)) GROUP BY 1, 2
""")
def support_bands(spark, sf):
    """P22."""
    n = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return n.groupBy(S.band(F.col("n")).alias("band"), S.longitudinal_class(F.col("n")).alias("class")).agg(F.count(F.lit(1)).alias("participants"))


@query("""
SELECT combination, pattern, count(*) AS rows FROM (
  SELECT CASE WHEN l_discount = 0 AND l_tax = 0 AND l_returnflag <> 'R' THEN '<NONE>' ELSE concat_ws('+', CASE WHEN l_discount <> 0 THEN 'discount' END, CASE WHEN l_tax <> 0 THEN 'tax' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END) END AS combination,
         'discount:' || CAST(l_discount <> 0 AS INT) || '|tax:' || CAST(l_tax <> 0 AS INT) || '|returned:' || CAST(l_returnflag = 'R' AS INT) AS pattern FROM lineitem) GROUP BY 1, 2
""")
def modality_combinations(spark, sf):
    """P23."""
    flags = {"discount": F.col("l_discount") != 0, "tax": F.col("l_tax") != 0, "returned": F.col("l_returnflag") == "R"}
    return table(spark, sf, "lineitem").groupBy(S.combination_label(flags).alias("combination"), S.pattern_label(flags).alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))


@query("""
WITH p AS (SELECT a.c_custkey, a.c_acctbal AS x, b.c_acctbal AS y, a.c_mktsegment AS s, lower(b.c_mktsegment) AS t FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1)
SELECT c_custkey, CAST(x AS VARCHAR) = CAST(y AS VARCHAR) OR abs(x - y) <= 1e-12 AS numbers, s = t AS strict_text, lower(s) = lower(t) AS loose_text FROM p
""")
def tolerant_equality(spark, sf):
    """P27, both forms."""
    c = table(spark, sf, "customer")
    p = c.alias("a").join(c.withColumn("k", F.col("c_custkey") - 1).alias("b"), F.col("a.c_custkey") == F.col("b.k"))
    x, y, s, t = F.col("a.c_acctbal").cast("string"), F.concat(F.col("b.c_acctbal").cast("string"), F.lit(" ")), F.col("a.c_mktsegment"), F.lower("b.c_mktsegment")
    return p.select(F.col("a.c_custkey").alias("c_custkey"), S.equal_for_audit(x, y).alias("numbers"), S.equality_key(s).eqNullSafe(S.equality_key(t)).alias("strict_text"), S.equal_for_audit(s, t).alias("loose_text"))


@query("""
SELECT count(*) FILTER (WHERE l_discount <> 0 AND l_tax <> 0) AS keyed, count(*) FILTER (WHERE NOT (l_discount <> 0 AND l_tax <> 0)) AS unkeyed,
       count(*) FILTER (WHERE l_suppkey % 20 < 17) AS development, count(*) FILTER (WHERE l_discount <> 0 OR l_tax <> 0) AS with_content,
       count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS domain_violations, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1997-01-01') AS unsafe FROM lineitem
""")
def filters(spark, sf):
    """The counts of each predicate."""
    split = F.when(F.col("l_suppkey") % 20 < 14, "train").when(F.col("l_suppkey") % 20 < 17, "validation").otherwise("test")
    df = table(spark, sf, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("t"), "l_returnflag", F.to_date("l_shipdate").alias("day"), split.alias("split"))
    cols = R.substantive(df.columns, ["l_returnflag"], ["day", "split"])
    seen = S.observed_count(cols) > 0
    one = df.agg(
        F.count_if(R.keyed(["d", "t"])).alias("keyed"), F.count_if(~R.keyed(["d", "t"])).alias("unkeyed"), F.count_if(F.col("split").isin("train", "validation")).alias("development"),
        F.count_if(seen).alias("with_content"), F.count_if(R.unsafe_in_time(F.col("day"), F.lit("1997-01-01").cast("date"))).alias("unsafe"),
    )
    return one.crossJoin(R.domain_violations(df, {"l_returnflag": ["A", "N"]}).withColumnRenamed("l_returnflag", "domain_violations"))  # one row each


@query("SELECT CAST(count(*) AS BIGINT) AS rows, sha256(string_agg(r_regionkey || '|' || r_name, chr(10) ORDER BY r_regionkey)) AS digest FROM region")
def table_hash(spark, sf):
    """A10."""
    return A.table_hash(table(spark, sf, "region"), ["r_regionkey"], ["r_regionkey", "r_name"])


@query("SELECT k, count(*) AS events, CAST(sum(v) AS BIGINT) AS total FROM (SELECT json_extract_string(props, '$.k') AS v0, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v, event_type AS k FROM events) GROUP BY k")
def json_props(spark, sf):
    """JSON cells."""
    df = table(spark, sf, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return df.groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("events"), F.sum("p.k").alias("total"))
