"""Per-key results where a handful of keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_totals(rows: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """``aggregates`` for each key, by map-side combining.

    Each task folds its rows into a hash table of key states (bounded; it spills sorted runs when
    memory is short), and only these partial states are exchanged: a key holding a third of all rows
    sends one state a task. The aggregates must be algebraic: count, sum, min, max, avg, min_by,
    moments, sketches.

    Rows with a NULL in any key are left out; empty input gives no rows."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(*aggregates)


def keyed_distinct(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The exact number of different values of each key, without holding a key's values in one task:
    pairs are combined first (exchanged by key and value), then counted with map-side combining."""
    pairs = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.lit(1).alias("one_"))
    return pairs.groupBy(key).agg(F.count("one_").alias(name))


def stacked_keys(rows: DataFrame, fields: Mapping[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """(field, key_value, keep...): each row once for each field that has a key; keys as text."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), c.cast("string").alias("key_value")) for f, c in fields.items()]
    )
    out = rows.select(F.explode(pairs).alias("p_"), *keep).select("p_.field", "p_.key_value", *keep)
    return out.where(F.col("key_value").isNotNull())


def heavy_keys(rows: DataFrame, fields: Mapping[str, Column], share: float) -> DataFrame:
    """(field, key_value, n, total): keys holding more than ``share`` of the rows that have a key.

    At most 1/share keys a field can come out, whatever the input's size. Totals are added up from the
    per-key states; the small table of totals has one row for each of ``fields``, which the caller lists."""
    counts = keyed_totals(stacked_keys(rows, fields), ["field", "key_value"], [F.count(F.lit(1)).alias("n")])
    totals = counts.groupBy("field").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "field").where(F.col("n") > F.col("total") * F.lit(share))
