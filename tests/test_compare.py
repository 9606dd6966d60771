from pyspark.sql import functions as F

from ledgerline.operators import compare
from ledgerline.plans import dealt


def rows(df):
    return sorted(tuple(r) for r in df.collect())


S = "k string, a string, b int, k0 string"


def test_findings(spark):
    left = spark.createDataFrame([("1", "x", 1, "e"), ("2", None, 2, "e"), ("2", None, 2, "e"), ("3", "", 3, "e"), (None, "n", 1, "e")], S)
    right = spark.createDataFrame([("1", "x", 1, "other"), ("2", "", 2, "o"), ("4", "y", None, "o"), (None, "n", 1, "o")], S)
    out = compare.differences(left, right, ["k"], ["a", "b"], missing_left="L", missing_right="R")
    assert out.columns == ["k", "finding"]
    assert rows(out) == [("2", "a"), ("3", "R"), ("4", "L")]
    shown = compare.differences(left, right, ["k"], ["a", "b"], values=True).where("finding = 'a'").collect()
    assert [(r.left_value, r.right_value) for r in shown] == [(None, "")]
    assert rows(compare.summary(out)) == [("L", 1), ("R", 1), ("a", 1)]


def test_empty_tables_and_null_keys(spark):
    left = spark.createDataFrame([("1", "x", 1, "e"), (None, None, None, None)], S)
    none = spark.createDataFrame([], S)
    assert sorted(r.finding for r in compare.differences(left, none, ["k"], ["a"]).collect()) == ["missing_in_right"] * 2
    assert compare.differences(none, none, ["k"], ["a"]).count() == 0
    assert compare.differences(left, left, ["k"], []).count() == 0


def test_one_shuffle(spark):
    left = spark.createDataFrame([("1", "x", 1, "e")], S)
    plan = compare.differences(left, left, ["k"], ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_field_names_with_quotes(spark):
    left = spark.createDataFrame([("1", "x")], "`k k` string, `it's` string")
    right = spark.createDataFrame([("1", "y")], "`k k` string, `it's` string")
    assert rows(compare.differences(left, right, ["k k"], ["it's"])) == [("1", "it's")]


def test_timestamp_values_in_utc(spark):
    make = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "k int, m long").select("k", F.timestamp_micros("m").alias("at"))
    left, right = make(1_700_000_000_500_000, -1, None), make(1_700_000_000_500_001, 0, 253_402_300_799_999_999)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Dubai")
    try:
        got = {r.k: (r.left_value, r.right_value) for r in compare.differences(left, right, ["k"], ["at"], values=True).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {0: ("2023-11-14 22:13:20.5+00", "2023-11-14 22:13:20.500001+00"), 1: ("1969-12-31 23:59:59.999999+00", "1970-01-01 00:00:00+00"), 2: (None, "9999-12-31 23:59:59.999999+00")}


def test_values_name_the_same_differences_as_findings(spark):
    folder, keys = "/root/testdata/sf0.001", ["dha_unique_id", "facility_id", "source_section", "finding"]
    shown = sorted(map(str, dealt.p3_values(spark, folder).select(*keys).collect()))
    assert shown == sorted(map(str, dealt.p3_found(spark, folder).collect())) and any("updatedAt" in s for s in shown)
