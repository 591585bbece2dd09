"""Slots of columns with any number of categories."""

from pyspark.sql import functions as F

from swipewatch.operators.vocabulary import one_hot_slots, vocabulary


def test_numbers_and_slots(spark):
    rows = [(1, "b", 2), (2, "a", None), (3, None, 10), (4, "c", 2), (5, "b", 7)]
    df = spark.createDataFrame(rows, "id long, `a b` string, kind int")
    known = {"a b": vocabulary(df, "a b"), "kind": vocabulary(df, "kind")}
    assert {r["value"]: r["number"] for r in known["kind"].collect()} == {"10": 0, "2": 1, "7": 2}
    new = df.union(spark.createDataFrame([(6, "zzz", 2)], df.schema))
    out, width = one_hot_slots(new, known)
    assert width == 6 and out.columns == [*df.columns, "slots"]
    assert {r["id"]: r["slots"] for r in out.collect()} == {1: [1, 4], 2: [0], 3: [3], 4: [2, 4], 5: [1, 5], 6: [4]}


def test_a_million_categories_and_a_hot_one(spark):
    value = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("v%08d", F.col("id")))
    df = spark.range(1_500_000).select("id", value.alias("v")).repartition(8)
    known = vocabulary(df, "v")
    r = known.agg(F.count("*"), F.min("number"), F.max("number"), F.countDistinct("number")).first()
    assert tuple(r) == (1_000_001, 0, 1_000_000, 1_000_001)
    # in order: "hot" comes before all others
    assert known.where("value = 'hot'").first()["number"] == 0
    out, width = one_hot_slots(df, {"v": known})
    wrong = "size(slots) <> 1 OR slots[0] <> IF(id % 3 = 0, 0, 1 + id - (id div 3) - 1)"
    assert width == 1_000_001 and out.where(wrong).count() == 0


def test_no_values(spark):
    df = spark.createDataFrame([(1, None)], "id long, v string")
    out, width = one_hot_slots(df, {"v": vocabulary(df, "v")})
    assert width == 0 and out.first()["slots"] == []
