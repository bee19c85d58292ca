import pytest
from pyspark.sql import functions as F

from jsonloom.llm.mixture import mixture, mixture_shares, source_rates, token_count

TARGET = "source string, weight double, max_repeat int"


def rates(spark, sizes, targets):
    s = spark.createDataFrame(sizes, "source string, n_tokens bigint")
    return source_rates(s, spark.createDataFrame(targets, TARGET))


def test_rates_and_reachability(spark):
    got = {r.source: (r.rate, r.reachable) for r in rates(spark, [("a", 60), ("b", 10), (None, 30)], [("A ", 1.0, 1), ("b", 1.0, 3), ("gone", 2.0, 9)]).collect()}
    assert got == {"a": (25 / 60, True), "b": (2.5, True), "gone": (None, False)}
    got = {r.source: r.reachable for r in rates(spark, [("a", 50), ("b", 10), ("c", 40)], [("a", 5.0, 1), ("b", 2.0, 1), ("c", 3.0, 1)]).collect()}
    assert got == {"a": True, "b": False, "c": True}  # exactly reached is reached


def test_odd_targets(spark):
    got = {r.source: (r.target_share, r.max_repeat, r.reachable) for r in rates(spark, [("a", 10)], [("a", None, None), ("b", -1.0, 2), (None, 5.0, 1), ("a", 0.0, 4)]).collect()}
    assert got == {"a": (0.0, 4, True), "b": (0.0, 2, True)}
    assert rates(spark, [], [("a", 1.0, 1)]).first().reachable
    assert rates(spark, [("a", 1)], []).collect() == []


def test_copies_are_floor_plus_a_draw(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(1).cast("bigint").alias("n_tokens"), F.lit(0).alias("rate_"))
    r = spark.createDataFrame([("a", 2.3)], "source string, rate double")
    out = mixture(docs, r)
    counts = {x["count"]: x.n for x in out.groupBy("doc_id").count().groupBy("count").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {2, 3} and abs(counts[3] / 20_000 - 0.3) < 0.015
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixture(docs.repartition(7), r).collect()))
    with pytest.raises(ValueError):
        mixture(docs.withColumn("copy", F.lit(1)), r)


def test_shares(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", 10) for i in range(4000)] + [(None, None, 5)], "doc_id bigint, source string, n_tokens bigint")
    r = source_rates(docs, spark.createDataFrame([("a", 3.0, 2), ("b", 1.0, 1), ("c", 0.0, 1)], TARGET))
    got = {x.source: x for x in mixture_shares(mixture(docs, r), r).collect()}
    assert abs(got["a"].actual_share - 0.75) < 0.02 and got["c"].mixed_tokens == 0 and abs(sum(x.actual_share for x in got.values()) - 1) < 1e-9


@pytest.mark.parametrize("file", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, file):
    path = "/opt/tokenizers/" + file
    texts = ["", None, "hello world", "a" * 200_000, "x" + " " * 300_000 + "y", " " * 300_000, "\n" * 5000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", token_count(F.col("t"), path).alias("n")).collect()}
    assert got[0] == got[1] == 0 and got[2] in (2, 3) and all(got[i] > 0 for i in (3, 4, 7))


def test_vocabularies_agree_also_on_long_blanks(spark):
    texts = ["one  two\n\n three", "x" + " " * 3000 + "y z", "a" + "\n" * 2500, "tab\t" * 500 + " " * 1500 + "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    a, b = ([r.n for r in df.select(token_count(F.col("t"), "/opt/tokenizers/byte_bpe_50k." + x).alias("n")).collect()] for x in ("tiktoken", "json"))
    assert a == b
