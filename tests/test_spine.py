"""Tables laid out by key: joins without exchanges, hot keys apart, splits pruned."""

from visitloom.sources import spine as SP


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frames(spark, hot):
    rows = [(i, 7 if i % 3 == 0 and hot else i % 40 if i % 11 else None, ("train", "validation", "test")[i % 3], i % 5) for i in range(3000)]
    visits = spark.createDataFrame(rows, "visit long, participant long, split string, `part-no` long")
    people = spark.createDataFrame([(p, f"p{p}") for p in range(30)], "participant long, label string")
    return visits, people


def compare(visits, people, laid, splits):
    got = SP.left_join_laid(laid["visits"], laid["people"], splits)
    want = visits.filter(visits["split"].isin(*splits)).join(people, "participant", "left")
    columns = ["visit", "participant", "split", "part-no", "label"]
    order = lambda d: sorted(map(str, d.select(*[f"`{c}`" for c in columns]).collect()))
    assert order(got) == order(want)
    return got


def test_join_moves_no_rows_and_opens_no_other_split(spark):
    visits, people = frames(spark, False)
    laid = SP.lay_out({"visits": visits, "people": people}, "participant", buckets=8, crowded_rows=10**6)
    got = compare(visits, people, laid, ["train", "validation"])
    text = plan(got)
    assert "Exchange" not in text and "SelectedBucketsCount: 8 out of 8" in text
    assert "PartitionFilters: [split" in text and "split=test" not in "".join(got.inputFiles())
    per = laid["visits"].rows().groupBy("participant").count()
    assert "Exchange" not in plan(per) and "Exchange" not in plan(laid["people"].rows().join(per.hint("merge"), "participant", "left"))
    laid["visits"].drop()
    assert not spark.catalog.tableExists(laid["visits"].name)


def test_hot_and_null_keys_stand_apart(spark):
    visits, people = frames(spark, True)
    laid = SP.lay_out({"visits": visits, "people": people}, "participant", buckets=8, crowded_rows=100)
    assert laid["visits"].crowded().select("participant").distinct().count() >= 1
    assert laid["visits"].even().groupBy("participant").count().agg({"count": "max"}).first()[0] <= 3000 / 8
    compare(visits, people, laid, ["train", "test"])
    assert laid["visits"].rows().count() == 3000
    empty = SP.lay_out({"visits": visits.filter("visit < 0"), "people": people}, "participant", buckets=4)
    assert SP.left_join_laid(empty["visits"], empty["people"]).count() == 0
    nulls = SP.lay_out({"visits": visits.withColumn("participant", visits["participant"] * None), "people": people}, "participant", buckets=4, crowded_rows=10)
    rows = SP.left_join_laid(nulls["visits"], nulls["people"])
    assert rows.count() == 3000 and rows.filter("label is not null").count() == 0 and nulls["visits"].even().count() == 0
