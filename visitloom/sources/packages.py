"""Writing: deterministic exports, atomic files, staged packages, resumable results, inventories.

Tables are Parquet written by Spark; identity is a hash of rows (``aggregates.table_hash``), not of
part files. Byte-stable files are for reports of a size that the driver may hold.
"""

from __future__ import annotations

import gzip
import io
import json
import os
import shutil
import tempfile
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.sources.tables import file_sha256

REPORT_ROWS = 1_000_000


def _report(df: DataFrame, order: Sequence[str]):
    if df.limit(REPORT_ROWS + 1).count() > REPORT_ROWS:
        raise ValueError("too many rows for a single file; write a table instead")
    return df.orderBy(*order).toPandas()


def csv_bytes(df: DataFrame, order: Sequence[str], compressed: bool = False) -> bytes:
    """The same rows give the same bytes: newline ends, no index, no time stamp."""
    data = _report(df, order).to_csv(index=False, lineterminator="\n").encode()
    if not compressed:
        return data
    out = io.BytesIO()
    with gzip.GzipFile(filename="", fileobj=out, mode="wb", mtime=0) as f:
        f.write(data)
    return out.getvalue()


def write_atomic(path: str | Path, data: bytes) -> Path:
    """A temporary file in the same folder, then a rename."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        os.replace(temp, path)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise
    return path


def write_json(path: str | Path, payload) -> Path:
    return write_atomic(path, (json.dumps(payload, sort_keys=True, indent=2, allow_nan=False) + "\n").encode())


def write_matrix(df: DataFrame, path: str, key: Sequence[str], column: str, mode: str = "errorifexists") -> None:
    """A matrix as Parquet, keys and one float array for each row."""
    df.select(*key, F.col(column).cast("array<float>").alias(column)).write.mode(mode).parquet(path)


def write_sparse(df: DataFrame, path: str, key: Sequence[str], column: str, mode: str = "errorifexists") -> None:
    """A matrix as Parquet, for each row its keys, width, and the places (from 0) and values of its cells that are not zero.

    Values are single precision; a cell that rounds to zero is not kept. Null cells count as zero, a null row has a null width.
    """
    cells = F.transform(F.col(column).cast("array<float>"), lambda v, i: F.struct(i.alias("at"), v.alias("value")))
    held = F.filter(cells, lambda c: c["value"] != 0)
    df.select(*key, F.when(F.col(column).isNotNull(), F.size(column)).alias("width"), held["at"].alias("places"), held["value"].alias("cells")).write.mode(mode).parquet(path)


def read_sparse(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The rows of ``write_sparse`` as arrays of their whole width again."""
    held = F.map_from_arrays("places", "cells")
    cell = lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0.0).cast("float"))
    dense = F.when(F.col("width") == 0, F.array().cast("array<float>")).when(F.col("width") > 0, F.transform(F.sequence(F.lit(0), F.col("width") - 1), cell))
    return spark.read.parquet(path).withColumn(column, dense).drop("width", "places", "cells")


def write_model(spark: SparkSession, path: str, parameters: Mapping[str, object]) -> None:
    """Fitted state as a small table, one JSON value for each parameter."""
    rows = [(k, json.dumps(v, allow_nan=False)) for k, v in sorted(parameters.items())]
    spark.createDataFrame(rows, "parameter string, value string").coalesce(1).write.mode("errorifexists").parquet(path)


def read_model(spark: SparkSession, path: str) -> dict[str, object]:
    return {r["parameter"]: json.loads(r["value"]) for r in spark.read.parquet(path).collect()}


def commit_package(target: str | Path, write: Callable[[Path], None], verify: Callable[[Path], None], overwrite: bool = False, archive: str | Path | None = None) -> Path:
    """Writes to a staging folder, verifies it there, and renames it into place.

    An existing package is an error unless ``overwrite``; with ``archive`` it is kept there beside
    a record of what superseded it.
    """
    target = Path(target)
    if target.exists() and not overwrite:
        raise FileExistsError(f"{target} exists")
    target.parent.mkdir(parents=True, exist_ok=True)
    staging = Path(tempfile.mkdtemp(dir=target.parent, prefix=f".{target.name}.staging-"))
    try:
        write(staging)
        verify(staging)
        if target.exists():
            if archive is not None:
                old = Path(archive) / f"{target.name}-{len(list(Path(archive).glob(target.name + '-*'))) + 1 if Path(archive).exists() else 1:03d}"
                old.parent.mkdir(parents=True, exist_ok=True)
                os.replace(target, old)
                write_json(old.with_suffix(".superseded.json"), {"superseded_by": target.name, "archived_as": old.name})
            else:
                shutil.rmtree(target)
        os.replace(staging, target)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return target


def append_results(results: DataFrame, path: str, key: str) -> DataFrame:
    """Appends results whose key the table does not hold and returns the whole table."""
    spark = results.sparkSession
    try:
        done = spark.read.schema(results.schema).parquet(path)
        fresh = results.join(done.select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = results
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(results.schema).parquet(path)


def next_candidate(done: DataFrame, key: str = "candidate_id", metadata: Mapping | None = None, expected: Mapping | None = None) -> int:
    """Where a search resumes: after the largest finished id, if its metadata are the expected ones."""
    if metadata is not None and dict(metadata) != dict(expected or {}):
        raise ValueError("the checkpoint belongs to another search")
    return (done.agg(F.max(key)).first()[0] or 0) + 1


def collect_checkpoints(spark: SparkSession, directory: str, grid_id: str | None = None) -> DataFrame:
    """One row for each JSON checkpoint, its parameters as columns ``parameter__...``."""
    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(directory)
    if grid_id is not None and "grid_id" in df.columns:
        df = df.filter(F.col("grid_id") == grid_id)
    if "parameters" in df.columns:
        inner = df.schema["parameters"].dataType.fieldNames()
        df = df.select(*[c for c in df.columns if c != "parameters"], *[F.col(f"parameters.{n}").alias(f"parameter__{n}") for n in inner])
    return df


def parse_pairs(df: DataFrame, column: str) -> DataFrame:
    """``key=value`` lines of a text column as rows."""
    m = F.str_to_map(F.col(column), F.lit("\n"), F.lit("="))
    return df.select(*[c for c in df.columns if c != column], F.explode(m).alias("key", "value")).withColumns({"key": F.trim("key"), "value": F.trim("value")}).filter("key <> ''")


def read_registry(spark: SparkSession, path: str, types: Mapping[str, str], unique: Sequence[str] = (), vocabulary: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """A CSV registry with typed columns; repeated keys and words outside a vocabulary are errors."""
    df = spark.read.csv(path, header=True).select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()])
    if unique and not df.groupBy(*unique).count().filter("count > 1").isEmpty():
        raise ValueError("repeated registry keys")
    for c, words in (vocabulary or {}).items():
        if not df.filter(F.col(c).isNotNull() & ~F.col(c).isin(*words)).isEmpty():
            raise ValueError(f"unknown words in {c}")
    return df


def inventory(root: str | Path) -> list[dict]:
    """Relative path, size and digest of every file of a package."""
    root = Path(root)
    return [{"path": p.relative_to(root).as_posix(), "size": p.stat().st_size, "sha256": file_sha256(p)} for p in sorted(root.rglob("*")) if p.is_file()]


def verify_inventory(root: str | Path, listed: Sequence[Mapping]) -> dict[str, list[str]]:
    """Problems by kind: unsafe, missing, changed and unlisted paths."""
    unsafe = [x["path"] for x in listed if PurePosixPath(x["path"]).is_absolute() or ".." in PurePosixPath(x["path"]).parts]
    here = {x["path"]: x for x in inventory(root)}
    want = {x["path"]: x for x in listed if x["path"] not in unsafe}
    return {
        "unsafe": sorted(unsafe), "missing": sorted(set(want) - set(here)), "unlisted": sorted(set(here) - set(want)),
        "changed": sorted(k for k in set(want) & set(here) if (want[k]["size"], want[k]["sha256"]) != (here[k]["size"], here[k]["sha256"])),
    }


def compare_inventories(found: DataFrame, listed: DataFrame) -> DataFrame:
    """S15 on the executors: one row of counts from (path, size, sha256) tables."""
    a, b = found.select("path", "size", "sha256", F.lit(1).alias("f")), listed.select("path", F.col("size").alias("s2"), F.col("sha256").alias("h2"), F.lit(1).alias("l"))
    j = a.join(b, "path", "full")
    both = F.col("f").isNotNull() & F.col("l").isNotNull()
    return j.agg(
        F.count_if(F.col("f").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("unlisted"),
        F.count_if(both & ((F.col("size") != F.col("s2")) | (F.col("sha256") != F.col("h2")))).alias("changed"),
        F.count_if(F.col("path").rlike(r"(^/)|(^|/)\.\.(/|$)")).alias("unsafe"),
    )
