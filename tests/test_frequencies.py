from pyspark.sql import functions as F

from jsonloom.functions.text import denoted_number, normal_form
from jsonloom.functions.instants import instant_seconds
from jsonloom.operators.keyed_totals import heavy_keys, keyed_distinct, keyed_totals
from jsonloom.operators.term_frequency import term_frequencies

OCC = "field string, record string, term string, n int"


def test_counts_and_marks(spark):
    rows = [("f", f"r{i}", "common", 1) for i in range(12)] + [("f", "r0", "common", 1), ("f", "r1", "rare", 9), ("f", None, "x", 1), ("f", "r9", None, 1), (None, "r", "x", 1)]
    rows += [("f", f"r{i}", f"mid{i % 3}", 1) for i in range(9)]
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_frequencies(spark.createDataFrame(rows, OCC)).collect()}
    assert got == {"common": (13, 12, "common"), "rare": (1, 1, "rare"), "mid0": (3, 3, None), "mid1": (3, 3, None), "mid2": (3, 3, None)}


def test_share_counts_records_once(spark):
    rows = [("f", f"r{i}", t, 1) for i in range(10) for t in ("a", "b")]
    got = {r.term: (r.field_records, r.mark) for r in term_frequencies(spark.createDataFrame(rows, OCC), common_above=0.99).collect()}
    assert got == {"a": (10, "common"), "b": (10, "common")}


def test_weight_and_empty(spark):
    df = spark.createDataFrame([("f", "r", "t", 4), ("f", "r", "t", None)], OCC)
    assert [r.occurrences for r in term_frequencies(df, weight=F.col("n")).collect()] == [4]
    assert term_frequencies(df.limit(0)).collect() == []


def test_too_many_fields_are_refused(spark, monkeypatch):
    """The table of fields is broadcast, so its size is checked."""
    import pytest
    from pyspark.errors import PySparkException

    from jsonloom.operators import term_frequency

    df = spark.createDataFrame([(f"f{i}", "r", "t", 1) for i in range(4)], OCC)
    monkeypatch.setattr(term_frequency, "MOST_FIELDS", 4)
    assert term_frequencies(df).count() == 4
    monkeypatch.setattr(term_frequency, "MOST_FIELDS", 3)
    with pytest.raises(PySparkException, match="more than 3 fields"):
        term_frequencies(df).collect()


def test_heavy_keys(spark):
    rows = [("a", i) for i in range(50)] + [("b", None)] * 49 + [(None, 1)] * 30
    got = {(r.field, r.key_value, r.n, r.total) for r in heavy_keys(spark.createDataFrame(rows, "p_ string, v int"), {"x": F.col("p_"), "y": F.col("v")}, 0.3).collect()}
    assert got == {("x", "a", 50, 99), ("x", "b", 49, 99), ("y", "1", 31, 80)}
    assert heavy_keys(spark.createDataFrame([], "p_ string, v int"), {"x": F.col("p_")}, 0.3).collect() == []


def test_totals_and_distinct(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", None), (None, 1), ("b", None)], "k string, v int")
    assert {(r.k, r.n) for r in keyed_totals(df, ["k"], [F.sum("v").alias("n")]).collect()} == {("a", 4), ("b", None)}
    assert {(r.k, r.n) for r in keyed_distinct(df, "k", "v", "n").collect()} == {("a", 2)}


def test_instants(spark):
    cases = {
        "2016-01-04T00:16:47Z": 1451866607, "2016-01-04 00:16:47": 1451866607, " 2016-01-04T00:16:47.999Z ": 1451866607, "2016-01-04T02:16:47+02:00": 1451866607,
        "2016-01-03T20:46:47-0330": 1451866607, "20160104T001647Z": 1451866607, "1451866607": 1451866607, "1451866607999": 1451866607, "Mon, 04 Jan 2016 07:16:47 +0700": 1451866607,
        "4 Jan 2016 00:16:47 GMT": 1451866607, "Mon, 4 Jan 2016 00:16 +0000": 1451866560, "2016-02-30T10:00:00Z": None, "2016-13-41T25:61:00Z": None, "T00:00Z": None, "yesterday": None,
        "": None, "NaN": None, "0000-00-00T00:00:00Z": None, "2016": None, "Mon, 31 Feb 2016 00:00:00 +0000": None, "1 Foo 2016 00:00:00 +0000": None, "x" * 100_000: None, None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert {r.c: r.s for r in df.select("c", instant_seconds(F.col("c")).alias("s")).collect()} == cases
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_numbers_and_names(spark):
    cases = {"24": 24, " 24\n": 24, "00024": 24, "2.4E1": 24, "24.0": 24, "+24": 24, "-3": -3, "24.5": None, "null": None, "": None, "n/a": None, "NaN": None, "1e99": None, "2 4": None, None: None, "9" * 30: None, "9223372036854775807": 2**63 - 1}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", denoted_number(F.col("c")).alias("n")).collect()
    assert {r.c: r.n for r in got} == cases
    names = {" A\t\n b ": "a b", "": None, "   ": None, None: None, "ÄB": "äb"}
    got = spark.createDataFrame([(c,) for c in names], "c string").select("c", normal_form(F.col("c")).alias("n")).collect()
    assert {r.c: r.n for r in got} == names
