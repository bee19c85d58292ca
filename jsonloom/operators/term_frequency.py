"""How often every distinct value or term occurs, and in how many records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_FIELDS = 10_000  # their table is broadcast

def term_frequencies(
    occurrences: DataFrame, *, weight: Column | None = None, rare_at_most: int = 2, common_at_least: int = 10, common_above: float = 0.02
) -> DataFrame:
    """(field, term, occurrences, records, field_records, mark) of all terms.

    occurrences: (field, record, term), a row each time a record holds a term; other columns are ignored.
        ``field`` names where the term is from, so there are few: more than MOST_FIELDS are an error. ``record`` may be any type; rows with NULL as field, term or record don't count.
    weight: how often a row says the term, once by default; NULL counts as 0.
    mark: 'rare' for at most ``rare_at_most`` records, 'common' for at least ``common_at_least``
        records that are also more than ``common_above`` of the field's records with a value, else NULL.

    Terms are counted per record first, then summed over records; both steps combine within the map
    task by hash before anything is exchanged, so a term in a third of all records costs one row a
    task. Empty input gives no rows."""
    times = F.coalesce(weight, F.lit(0)) if weight is not None else F.lit(1)
    rows = occurrences.select("field", "record", "term", times.cast("bigint").alias("times_")).where("field is not null and record is not null and term is not null")
    per_record = rows.groupBy("field", "record", "term").agg(F.sum("times_").alias("n_"))
    terms = per_record.groupBy("field", "term").agg(F.sum("n_").alias("occurrences"), F.count("n_").alias("records"))
    # from the same exchange as the terms: both ask for n_, so that their plans are alike below
    holders = per_record.groupBy("field", "record").agg(F.sum("n_").alias("n_")).groupBy("field").agg(F.count("n_").alias("field_records"))
    counted = holders.withColumn("fields_", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    few = counted.where(F.assert_true(F.col("fields_") <= MOST_FIELDS, F.lit(f"more than {MOST_FIELDS} fields")).isNull()).drop("fields_")
    out = terms.join(F.broadcast(few), "field")  # a row a field, their number checked
    mark = F.when(F.col("records") <= rare_at_most, F.lit("rare")).when(
        (F.col("records") >= common_at_least) & (F.col("records") > F.col("field_records") * F.lit(common_above)), F.lit("common")
    )
    return out.select("field", "term", "occurrences", "records", "field_records", mark.alias("mark"))
