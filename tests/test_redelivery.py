import pytest
from pyspark.sql import functions as F

from jsonloom.operators.redelivery import keep_one_delivery

SCHEMA = "id bigint, at int, text string"


def kept(df, **more):
    out = keep_one_delivery(df, F.col("id"), [F.col("at").isNull(), F.col("at")], **more)
    return sorted(((r.id, r.at, r.text, r.message_key, r.deliveries) for r in out.collect()), key=repr)


def test_singletons_pass_and_repeated_are_ranked(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 9, "c"), (1, None, "z")], SCHEMA)
    assert kept(df) == [(1, 3, "a", 1, 3), (2, 9, "c", 2, 1)]


def test_rows_without_identifier_are_messages_of_their_own(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 1, "a"), (None, None, None)], SCHEMA)
    assert len(kept(df)) == 3 and {r[4] for r in kept(df)} == {1}


def test_equal_copies_and_ties_give_one_row(spark):
    df = spark.createDataFrame([(7, 1, "a"), (7, 1, "a"), (7, 1, "b")], SCHEMA)
    first = kept(df)
    assert len(first) == 1 and first[0][4] == 3 and kept(df.repartition(3)) == first


def test_empty(spark):
    assert kept(spark.createDataFrame([], SCHEMA)) == []


def test_stored_copies_win_and_batches_add_up(spark):
    old = spark.createDataFrame([(1, 9, "stored")], SCHEMA)
    new = spark.createDataFrame([(1, 1, "new"), (2, 1, "x")], SCHEMA)
    assert [(r[0], r[2]) for r in kept(new, stored=old)] == [(1, "stored"), (2, "x")]


def test_hot_identifier_is_spread_and_comes_out_once(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).alias("id"), F.col("id").cast("int").alias("at"), F.lit("t").alias("text"))
    out = kept(df)
    assert len(out) == 3501 and (1, 0, "t", 1, 2500) in out


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 1, 1, 2, {"a": 1}), (1, 0, 3, 4, None)], "id bigint, k_ int, n_ int, `salt_` int, `hot_` map<string,int>").withColumn("a.b`c", F.lit(1))
    out = keep_one_delivery(df, F.col("id"), [F.col("k_")]).collect()
    assert len(out) == 1 and out[0]["n_"] == 3 and out[0]["a.b`c"] == 1
    with pytest.raises(ValueError):
        keep_one_delivery(df.withColumn("deliveries", F.lit(1)), F.col("id"), [])


def test_stored_counts_are_kept(spark):
    """A message stored after five copies and seen twice more came seven times."""
    old = spark.createDataFrame([(1, 9, "stored", 5), (3, 1, "other", 2), (None, 1, "loose", 4)], SCHEMA + ", deliveries bigint")
    new = spark.createDataFrame([(1, 1, "new"), (1, 2, "new"), (2, 1, "x")], SCHEMA)
    assert [(r[0], r[2], r[4]) for r in kept(new, stored=old)] == [(1, "stored", 7), (2, "x", 1), (3, "other", 2), (None, "loose", 4)]


def test_merging_batches_gives_what_one_run_gives(spark):
    import random

    from jsonloom.operators.redelivery import merge_batch, with_repeats

    rng = random.Random(9)
    rows = [(rng.choice([None, *range(12)]), i, f"t{i}") for i in range(60)]
    order = [F.col("at")]
    stored = keep_one_delivery(spark.createDataFrame(rows[:20], SCHEMA), F.col("id"), order)
    for lo in (20, 40):
        fresh, repeats = merge_batch(spark.createDataFrame(rows[lo : lo + 20], SCHEMA), stored, F.col("id"), order)
        stored = with_repeats(stored, fresh, repeats)
    once = keep_one_delivery(spark.createDataFrame(rows, SCHEMA), F.col("id"), order)
    assert sorted(map(tuple, stored.collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)
    none, nothing = merge_batch(spark.createDataFrame([], SCHEMA), stored, F.col("id"), order)
    assert none.count() == 0 and nothing.count() == 0
