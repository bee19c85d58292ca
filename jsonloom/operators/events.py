"""The event log of the test data as typed, one-row-per-event input for the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.instants import instant_seconds
from jsonloom.functions.text import denoted_number


def deliveries(log: DataFrame) -> DataFrame:
    """Every delivery with the number its ``id`` denotes and its instant."""
    return log.select(
        "*", denoted_number(F.col("id")).alias("event_id"), instant_seconds(F.col("created_at")).alias("instant_s")
    )


def distinct_events(log: DataFrame) -> DataFrame:
    """(event_id, actor_id, instant_s, type), once per event; what one delivery lacks another gives.

    Readable copies of one event agree, so ``max`` takes the stated value. A row whose ``id`` denotes
    no number is an event of its own and needs no exchange."""
    rows = deliveries(log).select("event_id", F.col("actor.id").alias("actor_id"), "instant_s", "type")
    keyed = (
        rows.where(F.col("event_id").isNotNull())
        .groupBy("event_id")
        .agg(F.max("actor_id").alias("actor_id"), F.max("instant_s").alias("instant_s"), F.max("type").alias("type"))
    )
    return keyed.unionByName(rows.where(F.col("event_id").isNull()))
