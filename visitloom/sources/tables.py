"""Finding, inspecting and reading source tables, and the contracts they must meet."""

from __future__ import annotations

import csv
import gzip
import hashlib
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.functions import scalars as S
from visitloom.operators.resolve import Contract
from visitloom.operators.tables import small_side

ENCODINGS = ("utf-8-sig", "utf-8", "latin-1")
SUFFIXES = (".csv", ".csv.gz")


class SourceError(ValueError):
    """A source is missing, ambiguous or not as its contract says."""


def list_tables(root: str | Path) -> list[Path]:
    """All delimited files below a folder, sorted."""
    return sorted(p for p in Path(root).rglob("*") if p.is_file() and p.name.lower().endswith(SUFFIXES))


def discover(root: str | Path, tokens: Iterable[str]) -> dict[str, Path]:
    """The one file whose name holds each token, case ignored; none or several are an error."""
    files = list_tables(root)
    out = {}
    for token in tokens:
        found = [p for p in files if token.casefold() in p.name.casefold()]
        if len(found) != 1:
            raise SourceError(f"{token}: {len(found)} files match")
        out[token] = found[0]
    return out


def _open(path: Path):
    return gzip.open(path, "rb") if path.name.lower().endswith(".gz") else path.open("rb")


def read_header(path: str | Path) -> tuple[list[str], str]:
    """Column names and encoding from the first line; empty files, empty names and repeated names are errors.

    Spark renames repeated columns silently, so this check comes before any read.
    """
    path = Path(path)
    with _open(path) as f:
        return header_of(f.readline(), path.name)


def header_of(line: bytes, name: str) -> tuple[list[str], str]:
    """Column names and encoding of the first line of the file called ``name``."""
    if not line.strip():
        raise SourceError(f"{name} is empty")
    for encoding in ENCODINGS:
        try:
            text = line.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    names = [n.strip().lstrip("\ufeff") for n in next(csv.reader([text.rstrip("\r\n")]))]
    if any(not n for n in names):
        raise SourceError(f"{name} has an empty column name")
    if len(set(names)) != len(names):
        raise SourceError(f"{name} repeats a column name")
    return names, encoding


def file_sha256(path: str | Path, block: int = 1 << 20) -> str:
    """Digest of a file, read in blocks."""
    h = hashlib.sha256()
    with Path(path).open("rb") as f:
        while data := f.read(block):
            h.update(data)
    return h.hexdigest()


def tree_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and digest of every file below a folder, hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root))
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_text_table(spark: SparkSession, path: str | Path, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Every column as text, no inference of types or missing words; empty cells are NULL."""
    names, encoding = read_header(path)
    if columns is not None and (absent := sorted(set(columns) - set(names))):
        raise SourceError(f"{Path(path).name} lacks {absent}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    charset = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin-1": "ISO-8859-1"}[encoding]
    df = spark.read.csv(str(path), schema=schema, header=True, encoding=charset, quote='"', escape='"', multiLine=False)
    df = df.select(*columns) if columns is not None else df
    return df.limit(limit) if limit is not None else df


def rows_for_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is in a set; the set is broadcast if it is small."""
    return df.join(small_side(keys.select(column).distinct()), column, "left_semi")


def development_targets(df: DataFrame, keys: Sequence[str], targets: Sequence[str], split: str = "split", directory: str | None = None) -> DataFrame:
    """Target rows of the development splits as numbers.

    Test rows are dropped before any cast: with ``directory`` the filtered text is written first,
    so that no optimizer can evaluate a cast on a test row. Incomplete or non-numeric cells and
    repeated keys are errors.
    """
    text = df.filter(S.code(F.col(split)).isin("train", "validation"))
    if directory is not None:
        text.write.mode("errorifexists").parquet(directory)
        text = df.sparkSession.read.schema(text.schema).parquet(directory)
    out = text.select(*keys, split, *[S.number(F.col(t)).alias(t) for t in targets])
    bad = out.agg(*[F.count_if(F.col(t).isNull()).alias(t) for t in targets]).first()
    if any(bad):
        raise SourceError(f"targets are not complete: {[t for t in targets if bad[t]]}")
    if not out.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise SourceError("repeated target keys")
    return out


def check_contract(df: DataFrame, contract: Contract) -> None:
    """Required columns are there; others may be."""
    if absent := sorted({*contract.required, *contract.keys} - set(df.columns)):
        raise SourceError(f"{contract.name} lacks {absent}")


def check_registry(names: Iterable[str], contracts: Mapping[str, Contract]) -> None:
    """Every source has a contract under its own name, and no other is there."""
    if set(names) != set(contracts) or any(k != c.name for k, c in contracts.items()):
        raise SourceError("sources and contracts differ")


def normalize(df: DataFrame, contract: Contract, ids: Sequence[str] = ("RID", "IMAGEUID"), codes: Sequence[str] = ("VISCODE2",), phases: Sequence[str] = ("PHASE",)) -> DataFrame:
    """P01 to P03 on a raw table: missing markers to NULL, ids, codes and phases in canonical form; broken ids are an error."""
    out = df.select(*[S.missing_to_null(F.col(c)).alias(c) for c in df.columns])
    here = [c for c in ids if c in df.columns]
    if here and any(out.agg(*[F.count_if(S.id_violation(F.col(c))) for c in here]).first()):
        raise SourceError(f"{contract.name} holds an identifier that is no whole number")
    put = {c: S.canonical_id(F.col(c)) for c in here} | {c: S.code(F.col(c)) for c in codes if c in df.columns} | {c: S.phase(F.col(c)) for c in phases if c in df.columns}
    return out.withColumns(put)


def load_all(spark: SparkSession, files: Mapping[str, Path], contracts: Mapping[str, Contract]) -> dict[str, DataFrame]:
    """S04 and S08 over all sources."""
    out = {}
    for name, contract in contracts.items():
        df = read_text_table(spark, files[name])
        check_contract(df, contract)
        out[name] = normalize(df, contract)
    return out
