"""Column functions: every one is a plain Column expression that stays inside code generation.

NULL is the only missing value. Where a cell breaks a rule, the function yields NULL and a sibling
``*_violation`` yields true, so that all violations of a table are counted in one aggregate.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that is stripped, missing markers, and the visit codes of month 0.
BLANKS = " \t\n\r\x0b\x0c"
RAW_MISSING = ("", "-1", "-4")
STAGED_MISSING = ("",)
ZERO_MONTH_CODES = ("bl", "sc", "scmri", "m00", "v01")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n", "")
MISSING_LABEL, UNKNOWN_TEXT, NULL_MARK = "__MISSING__", "<MISSING>", "<NA>"
# Upper bounds of the support bands and their labels.
SUPPORT_BANDS = [
    (0, "000_all_missing"), (5, "001_1_to_5"), (10, "002_6_to_10"), (20, "003_11_to_20"), (30, "004_21_to_30"),
    (50, "005_31_to_50"), (100, "006_51_to_100"), (250, "007_101_to_250"), (500, "008_251_to_500"),
]
SUPPORT_BAND_ABOVE = "009_over_500"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def missing_to_null(c: Column, markers: Sequence[str] = RAW_MISSING) -> Column:
    """Stripped text, NULL for a missing marker. ``STAGED_MISSING`` is the later stages' rule."""
    s = strip(c)
    return F.when(~s.isin(*markers), s)


def number(c: Column) -> Column:
    """The finite number that a text cell spells, else NULL (``1.0d``, ``inf`` and ``nan`` are no numbers)."""
    s = strip(c.cast("string"))
    d = F.when(s.rlike(NUMBER), s).try_cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def number_violation(c: Column) -> Column:
    """An observed cell that is no finite number."""
    return c.isNotNull() & number(c).isNull()


def canonical_id(c: Column) -> Column:
    """``001`` and ``2.0`` become ``1`` and ``2``; NULL for what is no whole number."""
    d = number(c)
    return F.when(d == F.floor(d), d.cast("long").cast("string"))


def id_violation(c: Column) -> Column:
    return c.isNotNull() & canonical_id(c).isNull()


def code(c: Column) -> Column:
    """Visit codes and split names."""
    return F.lower(strip(c))


def phase(c: Column) -> Column:
    """Phases."""
    return F.upper(strip(c))


def general_format(d: Column) -> Column:
    """Up to 15 significant digits without trailing zeros, exponents below 1e-4 and from 1e15."""
    e = F.format_string("%.14e", d)
    fixed = F.regexp_replace(F.regexp_replace(e.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when((F.abs(d) >= 1e-4) & (F.abs(d) < 1e15), fixed).otherwise(F.regexp_replace(e, r"\.?0+e", "e"))


def code_label(c: Column, missing: str | None = None, upper: bool = False) -> Column:
    """Whole numbers as integers, other numbers with 15 digits, text as it is; ``upper`` is the label form."""
    d, s = number(c), strip(c.cast("string"))
    text = F.upper(s) if upper else s
    label = F.when(d == F.floor(d), d.cast("decimal(38,0)").cast("string")).when(d.isNotNull(), general_format(d)).when(s != "", text)
    return F.coalesce(label, F.lit(missing)) if missing is not None else label


def safe_divide(a: Column, b: Column) -> Column:
    """NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def protocol_month(c: Column) -> Column:
    """Months since baseline of a visit code, NULL when it is unknown."""
    v = code(c)
    return (
        F.when(v.isin(*ZERO_MONTH_CODES), F.lit(0.0))
        .when(v.rlike("^m[0-9]+$"), F.substring(v, 2, 9).cast("double"))
        .when(v.rlike("^y[0-9]+$"), F.substring(v, 2, 9).cast("double") * 12)
    )


# Date formats in the order in which they are tried.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "yyyy/MM/dd", "yyyyMMdd")


def parse_day(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The day of the first format that fits, else NULL."""
    s = strip(c)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]).cast("date")


# What a free date may look like once its parts are joined by hyphens; month before day where both could be.
MIXED_FORMATS = ("yyyy-M-d", "M-d-yyyy", "d-M-yyyy", "d-MMM-yyyy", "MMM-d-yyyy", "yyyy-MMM-d", "yyyyMMdd", "yyyy-M", "MMM-yyyy", "yyyy")
_CLOCK = r"^(.+?)(?:(?:\s+|(?<=[0-9])t)(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:[.,][0-9]+)?)?\s*(?:[ap]m)?\s*(?:z|utc|[+-][0-9]{2}:?[0-9]{2})?)?$"
_WEEKDAY = r"^(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)(?:day|nesday|rday|urday|sday)?[\s,]+"
_MONTH = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?\b"


def parse_day_mixed(c: Column) -> Column:
    """P06 with a format of its own for every cell: the day as it is written, time of day and zone cut off, else NULL.

    Numbers, month names or both, with hyphens, slashes, points, commas or spaces, a weekday before them; month before day unless that
    is no date. A month or a year alone is its first day. Years have four digits; an impossible time makes the cell NULL.
    """
    whole = F.regexp_replace(F.lower(strip(c)), _WEEKDAY, "")
    day = F.regexp_replace(F.regexp_extract(whole, _CLOCK, 1), _MONTH, "$1")
    joined = F.initcap(F.regexp_replace(F.regexp_replace(day, r"(?<=[0-9])(?:st|nd|rd|th)\b", ""), r"[\s,./-]+", " "))
    text = F.translate(joined, " ", "-")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in MIXED_FORMATS]).cast("date")


def iso_day(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def parse_flag(c: Column, more_true: Sequence[str] = (), more_false: Sequence[str] = ()) -> Column:
    """NULL counts as false; NULL comes out for a word that is neither (see ``flag_violation``)."""
    v = code(c)
    return F.when(v.isin(*TRUE_WORDS, *more_true), True).when(v.isNull() | v.isin(*FALSE_WORDS, *more_false), False)


def flag_violation(c: Column, more_true: Sequence[str] = (), more_false: Sequence[str] = ()) -> Column:
    return parse_flag(c, more_true, more_false).isNull()


def audit_text(c: Column) -> Column:
    """Stripped and upper case, a mark for NULL."""
    return F.coalesce(F.upper(strip(c)), F.lit(UNKNOWN_TEXT))


def category(c: Column) -> Column:
    """The categorical form, NULL and blank as one label."""
    s = strip(c)
    return F.when(s.isNull() | (s == ""), F.lit(MISSING_LABEL)).otherwise(s)


def multi_tokens(c: Column) -> Column:
    """P10: tokens between ``|`` and ``;``, trimmed, without empty ones; NULL gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[|;]"), strip), lambda t: t != "")


def map_values(c: Column, mapping: Mapping[str, str]) -> Column:
    """A closed dictionary over canonical codes; what it lacks becomes NULL."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[code_label(c)]


def map_failure(c: Column, mapping: Mapping[str, str]) -> Column:
    return code_label(c).isNotNull() & map_values(c, mapping).isNull()


def placeholder_year(c: Column) -> Column:
    """The year of a ``YYYY-01-01`` placeholder."""
    return F.nullif(F.regexp_extract(strip(c), r"^([0-9]{4})-01-01(?:[ T].*)?$", 1), F.lit("")).cast("double")


def typed(c: Column, kind: str) -> Column:
    """A value of a semantic type, NULL when the cell does not have it."""
    if kind == "numeric":
        return number(c)
    if kind == "binary":
        d = number(c)
        return F.when(d.isin(0.0, 1.0), d)
    if kind == "categorical":
        return code_label(c)
    if kind == "multi_response":
        tokens = multi_tokens(c)
        return F.when(F.size(tokens) > 0, tokens)
    raise ValueError(f"unknown feature type {kind}")


def type_failure(c: Column, kind: str) -> Column:
    observed = strip(c)
    return observed.isNotNull() & (observed != "") & typed(c, kind).isNull()


def agreed_year(*cells: Column) -> Column:
    """The one year that several birth fields name, NULL when they disagree or none is known."""
    years = F.array_distinct(F.filter(F.array(*[F.nullif(F.regexp_extract(strip(c), "([0-9]{4})", 1), F.lit("")) for c in cells]), lambda y: y.isNotNull()))
    return F.when(F.size(years) == 1, F.element_at(years, 1).cast("int"))


def age_at(day: Column, birth_year: Column, low: int = 18, high: int = 120) -> Column:
    age = F.year(day) - birth_year
    return F.when(age.between(low, high), age)


def observed_count(columns: Sequence[str]) -> Column:
    """Observed cells of a row; an array keeps wide tables within one expression."""
    return F.aggregate(F.array(*[F.col(c).isNotNull().cast("int") for c in columns]), F.lit(0), lambda a, x: a + x)


def complete(columns: Sequence[str]) -> Column:
    return observed_count(columns) == len(columns)


def row_hash(columns: Sequence[str], named: bool = True) -> Column:
    """SHA-256 over name-sorted cells; the audit form hashes the values alone."""
    cells = [F.coalesce(strip(F.col(c).cast("string")), F.lit(NULL_MARK)) for c in sorted(columns)]
    parts = [F.concat(F.lit(f"{n}="), v) for n, v in zip(sorted(columns), cells, strict=True)] if named else cells
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def column_catalog(columns: Iterable[str], pattern: str, without: Iterable[str] = ()) -> list[str]:
    """Columns that match a pattern, in table order, without the named ones; case is ignored."""
    gone = {w.upper() for w in without}
    return [c for c in columns if re.fullmatch(pattern, c, re.IGNORECASE) and c.upper() not in gone]


def catalog_hash(names: Iterable[str]) -> str:
    """SHA-256 of the catalog's names in upper case, one on each line."""
    return hashlib.sha256("\n".join(n.upper() for n in names).encode()).hexdigest()


def drop_columns(df: DataFrame, protected: Iterable[str], exact: Iterable[str] = (), patterns: Iterable[str] = ()) -> DataFrame:
    """Drops names and full pattern matches; a protected column must not be among them."""
    gone = {c for c in df.columns if c in set(exact) or any(re.fullmatch(p, c) for p in patterns)}
    if bad := sorted(gone & set(protected)):
        raise ValueError(f"key columns cannot be dropped: {bad}")
    return df.drop(*sorted(gone))


def implied_zero(c: Column, companions: Sequence[Column], value: str = "0") -> Column:
    """An absent completion code is ``value`` once a companion item is observed."""
    return F.when(c.isNull() & F.coalesce(*companions).isNotNull(), F.lit(value)).otherwise(c)


def merged_score(items: Sequence[Column], newer: Column) -> Column:
    """P20: the sum of a complete set of 0/1 items, else the newer score; NULL on conflict or an invalid value."""
    d = [number(c) for c in items]
    whole = reduce(lambda a, b: a & b, [x.isNotNull() for x in d])
    valid = reduce(lambda a, b: a & b, [x.isNull() | x.isin(0.0, 1.0) for x in d])
    total, n = reduce(lambda a, b: a + b, d), number(newer)
    good = valid & (n.isNull() | ((n >= 0) & (n <= len(items)) & (n == F.floor(n))))
    return F.when(good & whole & (n.isNull() | (n == total)), total).when(good & ~whole, n)


def collapsed_code(c: Column, aliases: Mapping[str, str], several: str) -> Column:
    """Tokens through aliases; more than one different code becomes ``several``."""
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    tokens = F.transform(multi_tokens(c), lambda t: code_label(t))
    if pairs is not None:
        tokens = F.transform(tokens, lambda t: F.coalesce(pairs[t], t))
    tokens = F.array_distinct(tokens)
    return F.when(F.size(tokens) > 1, F.lit(several)).when(F.size(tokens) == 1, F.element_at(tokens, 1))


def band(c: Column, bounds: Sequence[tuple[float, str]] = tuple(SUPPORT_BANDS), above: str = SUPPORT_BAND_ABOVE) -> Column:
    """The label of the first bound that is not exceeded."""
    out = None
    for high, label in bounds:
        out = F.when(c <= high, label) if out is None else out.when(c <= high, label)
    return out.otherwise(F.lit(above))


def longitudinal_class(visits: Column) -> Column:
    """One, two, or three and more visits."""
    return F.when(visits <= 1, "1_visit").when(visits == 2, "2_visits").otherwise("3plus_visits")


def combination_label(flags: Mapping[str, Column], none: str = "<NONE>") -> Column:
    """Names of the true flags joined by ``+``."""
    s = F.concat_ws("+", *[F.when(f, F.lit(n)) for n, f in flags.items()])
    return F.when(s == "", F.lit(none)).otherwise(s)


def pattern_label(flags: Mapping[str, Column]) -> Column:
    """``name:1|name:0|...``."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{n}:"), F.coalesce(f, F.lit(False)).cast("int").cast("string")) for n, f in flags.items()])


def project(df: DataFrame, first: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    """Hidden columns lose their ``__``; ``first`` lead and ``last`` close the table."""
    shown = df.withColumnsRenamed({c: c.removeprefix("__") for c in df.columns if c.startswith("__")})
    middle = [c for c in shown.columns if c not in {*first, *last}]
    return shown.select(*[c for c in first if c in shown.columns], *middle, *[c for c in last if c in shown.columns])


def feature_name(block: str | None, source: str, column: str) -> str:
    """P25."""
    return f"{block}__{source}__{column}" if block else f"{source}__{column}"


def presence_name(block: str | None, source: str) -> str:
    return f"modality_present__{block}__{source}" if block else f"modality_present__{source}"


def exclusion_flag(source: str) -> str:
    return f"exclude_previous__{source}"


def mask(df: DataFrame, flag: Column, columns: Sequence[str]) -> DataFrame:
    """NULL in ``columns`` where the flag is true."""
    return df.withColumns({c: F.when(~F.coalesce(flag, F.lit(False)), F.col(c)) for c in columns})


def equality_key(c: Column) -> Column:
    """P27, resolver form: equal keys are equal cells (NULL = NULL, numbers by value, other text by case)."""
    s = strip(c.cast("string"))
    d = number(c)
    return F.struct((d + F.lit(0.0)).alias("num"), F.when(d.isNull(), s).alias("txt"))


def equal_for_audit(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    """P27, audit form: blank is NULL, numbers within a tolerance, text without case."""
    x, y = F.nullif(strip(a), F.lit("")), F.nullif(strip(b), F.lit(""))
    nx, ny = number(x), number(y)
    same = F.when(nx.isNotNull() & ny.isNotNull(), F.abs(nx - ny) <= tolerance).otherwise(F.lower(x) == F.lower(y))
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(same)
