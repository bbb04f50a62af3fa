"""S01, S02, S09, S10, S12, S15 in any file system that Spark reaches: reports, packages and inventories by URI.

Nothing here opens a local file: files are listed, opened and renamed by Hadoop's file system of
their URI, rows are formatted, sorted and compressed by the executors, and digests are taken there. A single-file report is
written by the driver as a stream: it holds one stretch of ``MEMBER_ROWS`` rows at a time.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from visitloom.session import staged
from visitloom.sources.packages import compare_inventories
from visitloom.sources.tables import SUFFIXES, SourceError, header_of

#: Rows of a stretch: one gzip member of a compressed report. Fixed, as other cuts would give other bytes.
MEMBER_ROWS = 100_000
HEAD_BYTES = 1 << 16
CHARSETS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin-1": "ISO-8859-1"}


def _system(spark: SparkSession, uri: str):
    """Hadoop's file system of a URI and the URI as its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def list_files(spark: SparkSession, root: str) -> list[str]:
    """The URIs of all files below a folder, sorted."""
    fs, path = _system(spark, root)
    found, out = fs.listFiles(path, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(out)


def discover(spark: SparkSession, root: str, tokens: Iterable[str]) -> dict[str, str]:
    """The one delimited file whose name holds each token, case ignored; none or several are an error."""
    files = [f for f in list_files(spark, root) if f.lower().endswith(SUFFIXES)]
    out = {}
    for token in tokens:
        found = [f for f in files if token.casefold() in f.rpartition("/")[2].casefold()]
        if len(found) != 1:
            raise SourceError(f"{token}: {len(found)} files match")
        out[token] = found[0]
    return out


def read_head(spark: SparkSession, uri: str) -> bytes:
    """The first bytes of a file, decompressed if it is a gzip file."""
    fs, path = _system(spark, uri)
    stream = fs.open(path)
    try:
        head = bytes(stream.readNBytes(HEAD_BYTES))
    finally:
        stream.close()
    return zlib.decompressobj(31).decompress(head) if uri.lower().endswith(".gz") else head


def read_text_table(spark: SparkSession, uri: str) -> tuple[DataFrame, str]:
    """Every column as text, empty cells NULL, and the file's encoding."""
    names, encoding = header_of(read_head(spark, uri).split(b"\n", 1)[0], uri.rpartition("/")[2])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(uri, schema=schema, header=True, encoding=CHARSETS[encoding], quote='"', escape='"', multiLine=False), encoding


def _stretches(names: Sequence[str], compressed: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        at = None

        def done() -> pd.DataFrame:
            pdf = pd.concat(held)
            data = pdf[list(names)].to_csv(index=False, header=at == 0, lineterminator="\n").encode()
            if compressed:
                out = io.BytesIO()
                with gzip.GzipFile(filename="", fileobj=out, mode="wb", mtime=0) as f:
                    f.write(data)
                data = out.getvalue()
            return pd.DataFrame({"stretch": [at], "data": [data]})

        for batch in batches:
            for stretch, rows in batch.groupby("__stretch", sort=True):
                if at is not None and stretch != at:
                    yield done()
                    held = []
                at = int(stretch)
                held.append(rows)
        if held:
            yield done()

    return run


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Row numbers from 0 in a total order over the whole table: range partitions are sorted and written, their counts give offsets."""
    keys = list(dict.fromkeys([*order, *df.columns]))
    rows = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    runs = rows.groupBy(part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = runs.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return rows.join(offsets, part == F.col("__part")).select(*df.columns, (F.col("__at") + F.col("__shift")).alias(out))


def write_report(df: DataFrame, order: Sequence[str], uri: str, compressed: bool = False) -> None:
    """One CSV file of any number of rows; the same rows give the same bytes.

    Rows are in ``order``, then by all their columns. Stretches of ``MEMBER_ROWS`` rows, whose borders are row numbers
    and so depend on nothing but the rows, are formatted and compressed by tasks; gzip members one after the other are
    a gzip file. The file is written beside its place and renamed.
    """
    spark, names = df.sparkSession, df.columns
    rows = numbered(df, order, "__row").withColumn("__stretch", F.floor(F.col("__row") / MEMBER_ROWS))
    dealt = rows.repartition("__stretch").sortWithinPartitions("__stretch", "__row")
    made = staged(dealt.mapInPandas(_stretches(names, compressed), "stretch long, data binary"), "stretches")
    fs, target = _system(spark, uri)
    _, temp = _system(spark, f"{uri.rpartition('/')[0]}/.{uri.rpartition('/')[2]}.{uuid.uuid4().hex}")
    count = made.count()
    if not count:  # the header alone
        data = (",".join(names) + "\n").encode()
        made = spark.createDataFrame([(0, bytearray(gzip.compress(data, mtime=0) if compressed else data))], "stretch long, data binary")
    stream = fs.create(temp, True)
    try:
        for i in range(max(1, count)):
            stream.write(bytes(made.filter(F.col("stretch") == i).first()["data"]))
        stream.close()
        fs.delete(target, False)
        if not fs.rename(temp, target):
            raise OSError(f"{uri} cannot be renamed into place")
    except BaseException:
        stream.close()
        fs.delete(temp, False)
        raise


def write_bytes(spark: SparkSession, uri: str, data: bytes) -> None:
    """A small file, written beside its place and renamed."""
    fs, target = _system(spark, uri)
    _, temp = _system(spark, f"{uri.rpartition('/')[0]}/.{uri.rpartition('/')[2]}.{uuid.uuid4().hex}")
    stream = fs.create(temp, True)
    stream.write(data)
    stream.close()
    fs.delete(target, False)
    if not fs.rename(temp, target):
        raise OSError(f"{uri} cannot be renamed into place")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path (below the root), size and digest of every file, read and hashed by the executors."""
    fs, path = _system(spark, root)
    base = fs.makeQualified(path).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # a URI of the same place may be written with one slash or three, so the path begins after the root's last folder
    mark = "/" + base.rstrip("/").rpartition("/")[2] + "/"
    return files.select(F.substring_index("path", mark, -1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def commit_package(spark: SparkSession, target: str, write: Callable[[str], None], verify: Callable[[str], None], overwrite: bool = False) -> DataFrame:
    """A package is written beside its place, verified there and renamed; its inventory is returned.

    An existing package is an error unless ``overwrite``, which moves it aside until the new one stands.
    """
    fs, path = _system(spark, target)
    if fs.exists(path) and not overwrite:
        raise FileExistsError(f"{target} exists")
    staging = f"{target.rpartition('/')[0]}/{target.rpartition('/')[2]}-staging-{uuid.uuid4().hex}"
    _, stage = _system(spark, staging)
    fs.mkdirs(stage)
    try:
        write(staging)
        verify(staging)
        _, old = _system(spark, f"{staging}-old")
        had = fs.exists(path)
        if had and not fs.rename(path, old):
            raise OSError(f"{target} cannot be moved aside")
        if not fs.rename(stage, path):
            if had:
                fs.rename(old, path)
            raise OSError(f"{target} cannot be renamed into place")
        if had:
            fs.delete(old, True)
    except BaseException:
        fs.delete(stage, True)
        raise
    return staged(inventory(spark, target), "inventory")


def verify_package(spark: SparkSession, target: str, listed: DataFrame) -> Mapping[str, int]:
    """How many files of a package are missing, unlisted, changed or have an unsafe path."""
    return compare_inventories(inventory(spark, target), listed).first().asDict()
