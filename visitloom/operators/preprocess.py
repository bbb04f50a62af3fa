"""Input preprocessing: fitted on train rows, applied to any rows.

Fitted state is a small table of parameters on the driver (one entry for each column or category);
transforming is a single projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.functions import scalars as S
from visitloom.operators.quantiles import exact_quantiles

#: Categories of one column above which one-hot encoding is refused.
MAX_CATEGORIES = 10_000


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of the observed values of all columns together; None where nothing is observed."""
    found = {r["feature"]: r["q"][0] for r in exact_quantiles(df, [], columns, [0.5]).collect()}
    return {c: found.get(c) for c in columns}


def impute(c: str, median: float) -> tuple[Column, Column]:
    """The filled value and the 0/1 indicator of a missing cell."""
    return F.coalesce(F.col(c).cast("double"), F.lit(median)), F.col(c).isNull().cast("double")


def scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation; a deviation of zero scales by 1."""
    row = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"] or 1.0) for i, c in enumerate(columns)}


def standardize(c: Column, mean: float, deviation: float) -> Column:
    return (c - F.lit(mean)) / F.lit(deviation)


def categories(df: DataFrame, column: str) -> list[str]:
    """Sorted train categories, the missing one among them if it stands there."""
    rows = df.select(S.category(F.col(column).cast("string")).alias("v")).distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} categories")
    return sorted(r["v"] for r in rows)


def one_hot(column: str, values: Sequence[str]) -> list[Column]:
    """One 0/1 column for each category; an unseen value is all zeros."""
    v = S.category(F.col(column).cast("string"))
    return [(v == x).cast("double").alias(f"{column}={x}") for x in values]


def vocabulary(df: DataFrame, column: str) -> list[str]:
    """Sorted train tokens."""
    rows = df.select(F.explode(S.multi_tokens(F.col(column))).alias("t")).distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} tokens")
    return sorted(r["t"] for r in rows)


def multi_hot(column: str, tokens: Sequence[str]) -> list[Column]:
    """A 0/1 column for each token, one for a missing cell and one for an unknown token."""
    t = S.multi_tokens(F.col(column))
    known = F.array(*[F.lit(x) for x in tokens]).cast("array<string>")
    return [
        *[F.array_contains(t, x).cast("double").alias(f"{column}~{x}") for x in tokens],
        (F.size(t) == 0).cast("double").alias(f"{column}~{S.MISSING_LABEL}"),
        (F.size(F.array_except(t, known)) > 0).cast("double").alias(f"{column}~__UNKNOWN__"),
    ]


def zero_range(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns without spread (or with a value that is not finite), found in one aggregate."""
    q = {c: f"`{c}`" for c in columns}
    row = df.agg(*[f(F.col(q[c])).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    finite = lambda x: x is not None and x == x and abs(x) != float("inf")
    return [c for i, c in enumerate(columns) if not (finite(row[f"lo{i}"]) and finite(row[f"hi{i}"])) or row[f"lo{i}"] == row[f"hi{i}"]]


@dataclass
class Preprocessor:
    """Medians, scales, categories, token vocabularies and dropped columns of one scenario."""

    numeric: list[str]
    binary: list[str]
    categorical: list[str]
    multi: list[str]
    median: dict[str, float] = field(default_factory=dict)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    tokens: dict[str, list[str]] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)

    def fit(self, train: DataFrame) -> Preprocessor:
        measured = [*self.numeric, *self.binary]
        self.median = {c: m if m is not None else 0.0 for c, m in medians(train, measured).items()} if measured else {}
        filled = train.select(*[impute(c, self.median[c])[0].alias(c) for c in self.numeric]) if self.numeric else None
        self.scale = scaling(filled, self.numeric) if filled is not None else {}
        self.levels = {c: categories(train, c) for c in self.categorical}
        self.tokens = {c: vocabulary(train, c) for c in self.multi}
        self.dropped = []
        names = self.names()
        self.dropped = zero_range(train.select(*self.columns()), names) if names else []
        return self

    def columns(self) -> list[Column]:
        out: list[Column] = []
        for c in [*self.numeric, *self.binary]:
            value, missing = impute(c, self.median[c])
            out += [(standardize(value, *self.scale[c]) if c in self.scale else value).alias(c), missing.alias(f"{c}__missing")]
        for c in self.categorical:
            out += one_hot(c, self.levels[c])
        for c in self.multi:
            out += multi_hot(c, self.tokens[c])
        return out

    def names(self) -> list[str]:
        measured = [x for c in [*self.numeric, *self.binary] for x in (c, f"{c}__missing")]
        hot = [f"{c}={v}" for c in self.categorical for v in self.levels[c]]
        multi = [f"{c}~{t}" for c in self.multi for t in [*self.tokens[c], S.MISSING_LABEL, "__UNKNOWN__"]]
        return [n for n in [*measured, *hot, *multi] if n not in set(self.dropped)]

    def transform(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Keys and the encoded matrix row as one array, in the order of ``names()``."""
        wide = df.select(*keys, *self.columns())
        return wide.select(*keys, F.array(*[F.col(f"`{n}`").cast("float") for n in self.names()]).alias("x"))
