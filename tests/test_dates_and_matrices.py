"""P06 without a format, S11 sparse."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from visitloom.functions import scalars as S
from visitloom.sources import packages as P

DAYS = [
    ("2020-01-02", date(2020, 1, 2)),
    (" 2020/1/2 ", date(2020, 1, 2)),
    ("1/2/2020", date(2020, 1, 2)),
    ("13/2/2020", date(2020, 2, 13)),
    ("02.01.2020", date(2020, 2, 1)),
    ("20200102", date(2020, 1, 2)),
    ("2 Jan 2020", date(2020, 1, 2)),
    ("Sept 2, 2020", date(2020, 9, 2)),
    ("Thursday, January 2nd, 2020", date(2020, 1, 2)),
    ("2-MAY-2020 23:59", date(2020, 5, 2)),
    ("2020-01-02T03:04:05.678+02:00", date(2020, 1, 2)),
    ("1/2/2020 3:04 PM", date(2020, 1, 2)),
    ("2020-02-29", date(2020, 2, 29)),
    ("2021-02-29", None),
    ("2020-01", date(2020, 1, 1)),
    ("March 2020", date(2020, 3, 1)),
    ("2020", date(2020, 1, 1)),
    ("2020-01-02 24:00", None),
    ("1/2/20", None),
    ("marble 2 2020", None),
    ("soon", None),
    ("", None),
    ("-", None),
    (None, None),
]


def test_days_of_any_form(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DAYS)], "i long, t string")
    got = {r["i"]: r["d"] for r in df.select("i", S.parse_day_mixed(F.col("t")).alias("d")).collect()}
    assert {DAYS[i][0]: d for i, d in got.items()} == dict(DAYS)


@pytest.mark.parametrize("rows", [[], [(1, [0.0, 2.5, 0.0]), (2, [0.0, 0.0, 0.0]), (3, []), (4, None), (4, [None, -1.0, 1e-60])]])
def test_sparse_round_trip(spark, tmp_path, rows):
    P.write_sparse(spark.createDataFrame(rows, "k long, m array<double>"), f"file://{tmp_path}/m", ["k"], "m")
    back = sorted((r["k"], r["m"]) for r in P.read_sparse(spark, f"file://{tmp_path}/m", "m").collect() if r["m"] is not None)
    assert back == sorted((k, [0.0 if v is None or abs(v) < 1e-50 else v for v in m]) for k, m in rows if m is not None)
    assert sum(len(r["cells"]) for r in spark.read.parquet(f"file://{tmp_path}/m").collect() if r["cells"] is not None) == (2 if rows else 0)
