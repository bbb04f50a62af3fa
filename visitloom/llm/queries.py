"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from visitloom.llm import ann, exact_dedup, language, licenses, merkle, mixing, near_dup, packing, periods, sharding, suffix_dedup, tokens, toxicity
from visitloom.llm.common import table


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op1_nearest(spark, table(spark, sf_dir, "embeddings"))


def op2_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op2_shard_documents(spark, table(spark, sf_dir, "documents"))


def op3_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.op3_section_tokens(spark, table(spark, sf_dir, "documents"))


def op4_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op4_licenses(spark, table(spark, sf_dir, "documents"))


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op5_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op6_exact_dedup(spark, table(spark, sf_dir, "documents"))


def op7_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.op7_near_duplicates(spark, table(spark, sf_dir, "documents"))


def op8_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op8_pack(spark, table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op9_remove_repeats(spark, table(spark, sf_dir, "documents"))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op10_mix_sources(spark, table(spark, sf_dir, "documents"))


def op11_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op11_language(spark, table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op12_manifest(spark, table(spark, sf_dir, "documents"))


def op13_basic_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.op13_runs(spark, table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


def op4_sql() -> str:
    """Every unit in canonical form, without the choice of units that the operator makes first."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def words(x: str) -> str:
        x = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
        for pattern, to in licenses.SPELLINGS:
            x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
        return f"trim({x})"

    known = ", ".join(f"({i}, {quoted(a)}, {quoted(b)})" for i, (a, _, b) in enumerate(licenses.known_texts()))
    bare = "chr(10) || replace(low, chr(10), chr(10) || chr(10)) || chr(10)"
    for pattern in licenses.NOTICE_LINES:
        bare = f"regexp_replace({bare}, {quoted(pattern)}, chr(10), 'g')"
    return rf"""
WITH k AS (SELECT * FROM (VALUES {known}) AS t(n, license, body)),
d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
b AS (SELECT doc_id, string_split_regex(body, '\n[ \t\r]*\n') AS a FROM d),
l AS (SELECT doc_id, string_split(body, chr(10)) AS a FROM d),
u AS (
  SELECT * FROM (
    SELECT doc_id, 'document' AS unit, CAST(0 AS BIGINT) AS unit_no, body FROM d
    UNION ALL SELECT doc_id, 'block', CAST(unnest(range(len(a))) AS BIGINT), unnest(a) FROM b
  ) WHERE contains(trim(body), chr(10))
  UNION ALL SELECT doc_id, 'line', CAST(unnest(range(len(a))) AS BIGINT), unnest(a) FROM l
),
c AS (
  SELECT doc_id, unit, unit_no, lower(body) AS low FROM u
  UNION ALL SELECT NULL, license, n, lower(body) FROM k
),
w AS (SELECT doc_id, unit, unit_no, low, {words(bare)} AS bare FROM c),
f AS (SELECT doc_id, unit, unit_no, CASE WHEN bare = '' THEN {words("low")} ELSE bare END AS form FROM w)
SELECT f.doc_id, f.unit, f.unit_no, g.license
FROM f JOIN (SELECT form, arg_min(unit, unit_no) AS license FROM f WHERE doc_id IS NULL AND form <> '' GROUP BY form) g USING (form)
WHERE f.doc_id IS NOT NULL
"""


def op12_sql(levels: int = 6, tops: int = 4) -> str:
    """The manifest level by level, for up to 16 ** levels rows in a source and 16 ** tops sources."""

    def entry(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}) || ':' || {x} END"

    fields = " || ".join(entry(f"CAST({c} AS VARCHAR)") for c in merkle.FIELDS[:-1])
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = f"translate(text, '{upper}', '{upper.lower()}')"
    bit = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    byte = f"list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: {bit})"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))), lambda c, b: {byte}), 4294967295)"
    parts = [
        f"""d AS (SELECT doc_id, source, sha256({fields} || {entry("text")}) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({fields} || {entry(lower)}) END AS changed FROM documents)""",
        """l0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d)""",
    ]

    def grow(name: str, count: int) -> None:
        for k in range(count):
            parts.append(
                f"{name}{k + 1} AS (SELECT source, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h "
                f"FROM {name}{k} GROUP BY source, i // 16, n)"
            )
            parts.append(f"{name}k{k} AS (SELECT source, i // 16 AS i, list(h ORDER BY i) AS kids FROM {name}{k} WHERE n > 1 GROUP BY source, i // 16)")

    grow("l", levels)
    parts.append(f"t0 AS (SELECT NULL AS source, source AS name, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM l{levels})")
    grow("t", tops)
    parts.append(f"f0 AS (SELECT l0.doc_id, l0.source, l0.leaf, l0.i, coalesce(l0.changed, l0.leaf) AS cur, '' AS proof, t0.i AS ti, t0.h AS subroot FROM l0 JOIN t0 ON l0.source IS NOT DISTINCT FROM t0.name)")
    for k in range(levels + tops):
        kids, place = (f"lk{k}", f"f.i // {16**k}") if k < levels else (f"tk{k - levels}", f"f.ti // {16 ** (k - levels)}")
        tree = "f.source IS NOT DISTINCT FROM k.source AND " if k < levels else ""
        left, right = f"array_to_string(kids[1:({place}) % 16], '')", f"array_to_string(kids[({place}) % 16 + 2:], '')"
        parts.append(
            f"f{k + 1} AS (SELECT doc_id, f.source, leaf, f.i, ti, subroot, CASE WHEN kids IS NULL THEN cur ELSE sha256({left} || cur || {right}) END AS cur, "
            f"CASE WHEN kids IS NULL THEN proof ELSE proof || {left} || {right} END AS proof FROM f{k} f LEFT JOIN {kids} k ON {tree}({place}) // 16 = k.i)"
        )
    last = f"SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM f{levels + tops}, (SELECT h AS root FROM t{tops})"
    return "WITH " + ",\n".join(parts) + "\n" + last


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_permutation_index, op2_best_fit_shards, op3_section_tokens, op4_license_digests, op5_ordinal_toxicity,
        op6_exact_dedup, op7_minhash_join, op8_concat_and_cut, op9_suffix_dedup, op10_pfair_mix, op11_crf_language,
        op12_merkle_manifest, op13_basic_factors,
    )
}
SQL: dict[str, str] = {"op6_exact_dedup": OP6_SQL, "op4_license_digests": op4_sql(), "op12_merkle_manifest": op12_sql()}
