"""Session helper: the settings every entry point of this repository starts from."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def local_session(app: str = "visitloom", cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="visitloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Only a local session may go without the setting; it gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _own_dir()
    return shared.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back.

    For a narrow table that a plan reads several times, or whose row numbers must stay: what made it
    runs once, and lost executors cost nothing.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, where their Python would not find it by itself."""
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if str(ROOT) in paths or os.path.realpath(os.getcwd()) == str(ROOT) or app in _SHIPPED:
        return
    path = Path(tempfile.mkdtemp()) / "visitloom.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "visitloom").rglob("*.py")):
            z.write(f, f.relative_to(ROOT).as_posix())
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
